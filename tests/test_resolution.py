"""Name similarity, vector search and the staged cascade against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislegrid.functions import text as T
from aislegrid.operators import cascade as C
from aislegrid.operators import clustering as G
from aislegrid.operators import enrichment as E
from aislegrid.operators import merge as M
from aislegrid.operators import similarity, vectors
from aislegrid.sources.sync import current, sync
from aislegrid.streaming import control
from aislegrid.streaming import price_changes as P


def dice(x, y):
    x, y = " ".join(x.lower().split()), " ".join(y.lower().split())
    p, q = Counter(x[i : i + 2] for i in range(len(x) - 1)), Counter(y[i : i + 2] for i in range(len(y) - 1))
    if x and x == y:
        return 1.0
    return 2 * sum((p & q).values()) / (sum(p.values()) + sum(q.values())) if p and q else 0.0


def names(rng, n):
    words = ["milk", "milks", "full", "cream", "choc", "bar", "Bars", "oat", "aaaa", "aaaaaa", "لبن", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)] + ["", " ", "x", "X", None, "aa", "full  CREAM milk"]


@pytest.mark.parametrize("least", [0.4, 0.75, 1.0])
def test_similar_names(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "SPLIT", 5)
    rng = random.Random(3)
    rows = lambda: [(n, rng.choice("abb")) for n in names(rng, 60)] + [(n, None) for n in names(rng, 3)]
    left, right = rows(), rows()
    make = lambda r: spark.createDataFrame(r, "name string, k string")
    got = [(r.k, r.name_l, r.name_r, r.score) for r in similarity.similar_names(make(left), make(right), ["k"], least).collect()]
    wanted = {(k, x, y, s) for x, k in left for y, j in right if k == j and k and x is not None and y is not None and (s := dice(x, y)) >= least}
    assert len(got) == len(wanted) and {*got} == wanted
    met = similarity.candidates(make(left), make(right), ["k"], least).count()
    pairs = len({(k, x, y) for x, k in left for y, j in right if k == j and k and x and y})
    assert met < pairs * (0.9 if least == 0.4 else 0.5)


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", block * 4)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], int(rng.integers(3))) for i in range(60)]
    df = spark.createDataFrame(rows + [(90, None, 1), (None, [1.0], 1), (91, [float("nan")] * 6, 1), (92, [0.0] * 6, 1), (93, [1.0] * 6, None)], "id long, embedding array<double>, label int").repartition(3)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if any(v)}
    of = {i: g for i, _, g in rows}
    got = {(r.query_id, r.vec_id, r.place) for r in vectors.nearest(df, df, 4, least=0.1, by=("label",), unit=True, apart=True).collect()}
    wanted = set()
    for i in unit:
        best = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in unit if j != i and of[i] == of[j] and round(float(unit[i] @ unit[j]), 6) >= 0.1)[:4]
        wanted |= {(i, j, k) for k, (_, j) in enumerate(best, 1)}
    assert got == wanted
    assert vectors.nearest(df.where("id = 0"), df, 4).count() == 4


KIND = "id long, gtin string, brand string, name string, weight double, name_ar string, code string"


def test_reasons_and_near_misses(spark):
    scan = spark.createDataFrame(
        [
            (1, "SCAN-1", "b", "creamy milk chocolate bar", 50.0, None, None),  # B holds a conflict back, so its tie flag stands
            (2, "SCAN-2", "b", "unlike all", 5000.0, None, None),
            (3, "SCAN-3", "zz", "alone", 5.0, None, None),
            (4, "SCAN-4", "n/a", "alone", 5.0, None, None),
            (5, "SCAN-5", "c", "alone", None, None, None),
            (6, "SCAN-6", "c", "alone", None, "وحيد", None),
            (7, "SCAN-7", "d", "big mint leaf drops", 20.0, None, None),  # C alone holds a conflict back
            (8, "SCAN-8", "b", "creamy milk vanilla bars", 50.0, None, None),
            (9, None, None, None, None, None, None),
        ],
        KIND,
    )
    pool = spark.createDataFrame(
        [(20, "6280000000020", "b", "creamy milk vanilla bar", 50.0, None, None), (21, "6280000000021", "c", "something", None, None, None), (22, "6280000000022", "d", "big lime leaf drops", 21.0, None, None), (23, "6280000000023", "b", "creamy milk vanilla", 50.0, None, None)], KIND
    )
    got = {r.scan_id: (r.match_pass, r.reason_code, r.near_misses) for r in C.diagnostics(C.passes(scan, pool), pool).collect()}
    score = lambda x, y: round(dice(x, y) * 10000)
    assert got[1][:2] == (None, "ambiguous_tie") and got[1][2].startswith("628")
    assert [got[i][:2] for i in (2, 3, 4, 5, 6)] == [(None, r) for r in ("weight_mismatch_only", "no_brand_pool", "placeholder_brand_missing", "no_weight_no_arabic", "all_passes_below_threshold")]
    assert got[7] == (None, "attribute_conflict:flavor", f"6280000000022:{score('big mint leaf drops', 'big lime leaf drops')}")
    a, b = score("creamy milk vanilla bars", "creamy milk vanilla bar"), score("creamy milk vanilla bars", "creamy milk vanilla")
    assert got[8] == ("B", "", f"6280000000020:{a},6280000000023:{b}") and a > b > 4000
    assert got[9][:2] == (None, "placeholder_brand_missing")


def test_verdicts(spark):
    scan = spark.createDataFrame([(i, f"SCAN-{i}", "b", f"oat drink {w}", float(g), None, None) for i, (w, g) in enumerate([("one", 100), ("two", 200), ("three", 300), ("four", 400), ("five", 500), ("six", 600), ("seven", 700), ("eight", 800)])], KIND)
    pool = spark.createDataFrame([(100 + j, f"62800000001{j:02d}", "b", f"oat drink number {j}", 100.0, None, None) for j in range(15)], KIND)
    lists = C.shortlists(C.passes(scan, pool), pool)
    rows = {r.name: r for r in lists.withColumn("base_key", C.base_key()).withColumn("key", T.verdict_key(F.col("brand"), F.col("name"), F.col("wk"), F.transform("best", lambda x: x["gtin"]))).collect()}
    assert len(rows) == 8 and all(len(r.best) == 10 for r in rows.values())
    assert "WindowGroupLimit" in lists._jdf.queryExecution().executedPlan().toString()
    first = lambda n: rows[f"oat drink {n}"].best[0]["gtin"]
    said = [("one", 1, first("one"), 0.2, ""), ("one", 2, first("one"), 0.9, ""), ("two", 1, first("two"), 0.95, ""), ("three", 1, first("three"), 0.7, ""), ("four", 1, first("four"), 0.5, ""), ("five", 1, "6280000009999", 0.9, ""), ("six", 1, None, 0.0, "all_providers_failed")]
    stored = [(rows[f"oat drink {n}"].base_key, rows[f"oat drink {n}"].key, v, g, c, why) for n, v, g, c, why in said]
    stored.append((rows["oat drink seven"].base_key, "other", 1, first("seven"), 0.9, ""))
    got = {r.name: (r.state, r.gtin, r.confidence, r.review_reason) for r in C.replay(lists, spark.createDataFrame(stored, "base_key string, key string, version int, gtin string, confidence double, rationale string")).collect()}
    none = (None, None, None)
    assert got == {f"oat drink {n}": r for n, r in [("one", ("accepted", first("one"), 0.9, None)), ("two", ("gated", first("two"), 0.84, "gated:weight_mismatch_major")), ("three", ("review", first("three"), 0.7, None)), ("four", ("low", first("four"), 0.5, None)), ("five", ("no_match", *none)), ("six", ("failed", *none)), ("seven", ("stale", *none)), ("eight", ("unasked", *none))]}


def test_aliases_widen_blocks_until_nothing_changes(spark):
    pool = spark.createDataFrame([(100 + j, f"62800000001{j:02d}", "almarai", f"{w} cream milk", 100.0, None, f"62811{j:08d}") for j, w in enumerate(["full", "half", "double", "light", "sour"])], KIND)
    scan = spark.createDataFrame(
        [
            (1, "SCAN-1", "Old Dairy", "full cream milks", 100.0, None, None),  # given alias, then an alias of it
            *[(10 + j, f"SCAN-{10 + j}", "ALM", f"{w} cream milk", None, None, "6281100000000") for j, w in enumerate(["full", "half", "light"])],  # code prefix: evidence
            (20, "SCAN-20", "ALM", "sour cream milks", 100.0, None, None),  # found once the evidence is in
            (21, "SCAN-21", "ALM KSA", "double cream milks", 100.0, None, None),  # needs the alias that the evidence gave
            (30, "SCAN-30", "loop a", "full cream milk", 100.0, None, None),
            (31, "SCAN-31", "weak", "full cream milk", 100.0, None, None),
            (32, "SCAN-32", None, "full cream milk", 100.0, None, None),
        ],
        KIND,
    )
    aliases = spark.createDataFrame([("Old Dairy", "New Dairy", 0.9), ("New Dairy", "almarai", 0.9), ("ALM KSA", "ALM", 0.9), ("loop a", "loop b", 0.9), ("loop b", "loop a", 0.9), ("weak", "almarai", 0.8)], "brand string, slug string, confidence double")
    rows = C.rewind(scan, pool, aliases).collect()
    got, rounds = {r.id: (r.match_pass, r.gtin, r.raw_brand) for r in rows}, {r.id: r.round for r in rows}
    assert got[1][1] == "6280000000100" and got[20][1] == "6280000000104" and got[21][1] == "6280000000102"
    assert [got[i][0] for i in (10, 11, 12)] == ["E"] * 3 and [got[i][0] for i in (30, 31, 32)] == [None] * 3
    assert (rounds[1], rounds[20], rounds[21], rounds[10]) == (2, 1, 2, 0) and len(rows) == scan.count()


def links(spark, rows):
    return spark.createDataFrame(rows, "loser long, winner long")


def test_closure_of_chains_and_cycles(spark):
    rows = [(i, i - 1) for i in range(2, 12)]  # a chain of ten
    rows += [(20, 21), (21, 22), (22, 20), (23, 22), (19, 23)]  # a cycle with a tail whose ids are smaller and larger
    rows += [(30, 31), (31, 30), (40, 40), (50, 52), (50, 51), (51, None), (60, 61)]
    got = {r.loser: r.winner for r in M.closure(links(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(2, 12)}, 21: 20, 22: 20, 23: 20, 19: 20, 31: 30, 50: 51, 60: 61}
    assert M.closure(links(spark, [])).count() == 0


def test_merge_of_children(spark):
    product = spark.createDataFrame([(1, "g1", "one"), (2, "g2", "two"), (3, None, "three"), (4, "g4", "four")], "id long, gtin string, name_en string")
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = M.merge(
        product,
        links(spark, [(3, 2), (2, 1), (9, 1)]),
        "admin",
        "test",
        prices=frame([(1, 3), (2, 4), (3, None)], "id long, product_id long"),
        reports=frame([(1, "g2"), (2, "g4"), (3, None)], "id long, gtin string"),
        images=frame([(1, 3, "u"), (2, 2, "u"), (3, 1, "v"), (4, 2, "v"), (5, 8, "v"), (6, None, "v")], "id long, product_id long, url string"),
        allergens=frame([(2, "milk"), (3, "milk"), (3, "nuts")], "product_id long, allergen_key string"),
        nutrition=frame([(3, 7.0), (2, 5.0), (4, 1.0)], "product_id long, fat double"),
    )
    rows = lambda name, *cols: sorted((tuple(r) for r in out[name].select(*cols).collect()), key=str)
    assert rows("product", "id") == [(1,), (4,)]
    assert rows("prices", "id", "product_id") == [(1, 1), (2, 4), (3, None)]
    assert rows("reports", "id", "gtin") == [(1, "g1"), (2, "g4"), (3, None)]
    assert rows("images", "id", "product_id", "url") == [(2, 1, "u"), (3, 1, "v"), (5, 8, "v"), (6, None, "v")]
    assert rows("allergens", "product_id", "allergen_key") == [(1, "milk"), (1, "nuts")]
    assert rows("nutrition", "product_id", "fat") == [(1, 5.0), (4, 1.0)]
    assert rows("merge_log", "winner_id", "loser_id", "winner_gtin", "loser_gtin", "winner_name") == [(1, 2, "g1", "g2", "one"), (1, 3, "g1", None, "one")]


def one_by_one(rows):
    """The clusters of rows (id, gtin, brand, name, weight) as they come in."""
    import re

    import duckdb

    far = lambda x, y: duckdb.execute("SELECT levenshtein(?, ?)", [x, y]).fetchone()[0]
    founders, holders, out = [], {}, {}
    for i, gtin, brand, name, weight in sorted(rows):
        if gtin in holders and gtin:
            out[i] = (out[holders[gtin]][0], "gtin")
            continue
        if gtin:
            holders[gtin] = i
        if re.search("bundle|pack", (name or "").lower()):
            out[i] = (None, "rejected")
            continue
        brand, n = (brand or "").strip(), " ".join(re.sub(r"[^A-Za-z0-9_\s]", "", (name or "").lower()).split())
        generic = brand.lower() in ("", "generic")
        if generic and (not weight or not gtin):
            out[i] = (i, "weak")
            continue
        hit = next((f for f, b, w, m in founders if (b, w) == (brand, weight) and n and m and 1 - far(n, m) / max(len(n), len(m)) > 0.85), None)
        out[i] = (hit, "name") if hit is not None else (i, "new")
        if hit is None:
            founders.append((i, brand, weight, n))
    return out


def test_cluster_equals_rows_one_by_one(spark):
    rng = random.Random(8)
    base = [f"{a} {b} drops" for a in ("sweet lemon", "sour cherries", "dark honey") for b in ("with mint", "and ginger")]

    def drifted():  # one to three letters off: chains in which neighbours are similar and ends are not
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        return "".join(t)

    rows = [(i, rng.choice([None, f"g{rng.randrange(300)}"]), rng.choice(["b", "b", "b ", "c", "", "Generic"]), drifted(), rng.choice([10.0, 10.0, None])) for i in range(300)]
    rows += [(400, None, "b", "bundle of two", 10.0), (401, None, "b", None, 10.0), (402, None, "b", "لبن", 10.0), (403, None, "b", "لبن", 10.0), (404, None, None, "x", None), (405, "z", "b", "x", 0.0)]
    df = spark.createDataFrame(rows, "id long, gtin string, brand string, name string, weight double").repartition(3)
    got = {r.id: (r.cluster_id, r.how) for r in G.cluster(df).collect()}
    assert got == one_by_one(rows)
    assert Counter(how for _, how in got.values())["name"] > 50


def test_cluster_of_one_large_block(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(18)) for _ in range(10_500)]
    rows = [(i, None, "b", n, 10.0) for i, n in enumerate(names)] + [(20_000 + i, None, "b", f"{names[i][:-1].upper()}!z", 10.0) for i in range(0, 10_500, 50)]
    got = {r.id: r.cluster_id for r in G.cluster(spark.createDataFrame(rows, "id long, gtin string, brand string, name string, weight double")).collect()}
    assert len(got) == len(rows) and all(got[20_000 + i] == i for i in range(0, 10_500, 50))
    assert all(got[c] == c and c <= i for i, c in got.items())


def test_borrowing_takes_the_best_donor_of_each_field(spark):
    kind = "id long, brand string, weight double, " + ", ".join(f"{f} string" for f in E.RULES)
    rows = [
        (1, "b", 100.0, "", None, "own", None, None, None, None),
        (2, "B", 110.0, "اسم", None, None, "milk", None, "A", "2"),
        (3, "b", 300.0, "اسم ٣", "kcal", "water", None, "u3", "B", "9"),
        (4, "x", 100.0, "اسم ٤", "kcal", "oil", "nuts", "u4", "C", "3"),
        (5, "b", 90.0, None, "kcal 5", None, "gluten", "", "q", "4"),
        (6, None, None, None, None, None, None, None, None, None),
    ]
    pairs = [(1, 2, 0.95), (1, 3, 0.89), (1, 4, 0.91), (1, 5, 0.86), (1, 6, 0.99), (4, 1, 0.99)]
    out = E.borrow(spark.createDataFrame(rows, kind), spark.createDataFrame(pairs, "product_id long, donor_id long, cosine double"))
    got = {(r.product_id, r.field): (r.donor_id, r.value) for r in E.borrowed(out).collect()}
    assert got == {(1, "name_ar"): (2, "اسم"), (1, "nutrition"): (5, "kcal 5"), (1, "ingredients"): (3, "water"), (1, "allergens"): (2, "milk"), (1, "image"): (4, "u4"), (1, "grade"): (2, "A"), (1, "nova"): (2, "2")}
    scores = {r.id: (r.score_before, r.score_after) for r in out.collect()}
    assert scores[1] == (14.29, 100.0) and scores[6] == (0.0, 0.0) and len(scores) == 6


def test_price_changes_over_many_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), 1, rng.randrange(2), float(rng.randrange(3)), i) for i in range(400)]
    kind = "id long, product_id long, merchant_id long, store_id long, price double, t long"
    df = spark.createDataFrame(rows, kind).withColumn("scraped_at", F.timestamp_seconds("t")).drop("t")
    source, out, state, check = (str(tmp_path / x) for x in ("in", "out", "state", "check"))
    for a in range(0, 400, 20):  # a batch of its own each, each time from the checkpoint
        df.where((F.col("id") >= a) & (F.col("id") < a + 20)).coalesce(1).write.mode("append").parquet(source)
        P.write_price_changes(spark.readStream.schema(df.schema).parquet(source), out, state, check).awaitTermination()
    last, wanted = {}, {}
    for i, p, m, s, price, _ in rows:
        wanted[i] = "touch" if last.get((p, m, s)) == price else "insert"
        last[p, m, s] = price
    assert {r.id: r.action for r in spark.read.parquet(out).collect()} == wanted
    assert len(list((tmp_path / "state" / "snapshot").iterdir())) == 2


def test_budget_and_ring_go_on_after_a_stop(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((rng.randrange(4 * 86_400), i, rng.randrange(3), rng.choice(["error", "ok", "ok"])) for i in range(600))
    df = spark.createDataFrame([(i, u, k, t) for t, i, u, k in rows], "event_id long, user_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    cuts = [0, 150, 151, 420, 600]
    got = {}
    for name, of in (("budget", control.throttled), ("ring", control.degraded)):
        source, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
        with control.rocksdb(spark):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids = [i for _, i, _, _ in rows[a:b]]
                df.where(F.col("event_id").isin(ids)).write.mode("append").parquet(source)
                of(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got[name] = spark.read.parquet(out).collect()
    used, rings, let, flags = Counter(), {}, set(), {}
    for t, i, u, k in rows:
        used[u, t // 86_400] += 1
        if used[u, t // 86_400] <= control.BUDGET:
            let.add(i)
        rings.setdefault(u, []).append(k == "error")
        flags[i] = sum(rings[u][-control.RING :])
    assert {r.event_id for r in got["budget"]} == let and len(got["budget"]) == len(let)
    assert {r.event_id: (r.errors, r.degraded) for r in got["ring"]} == {i: (n, n >= control.MOST_ERRORS) for i, n in flags.items()}


def test_budget_and_ring_keep_state_by_bucket(spark, tmp_path):
    rows = [(i, None if i % 1001 == 0 else (i % 1500 - 700) * 2**40, "error" if i % 3 else "ok", 86_400 + i * 30) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    got, state_rows = {}, {}
    for name, of in (("budget", control.throttled), ("ring", control.degraded)):
        out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
        with control.rocksdb(spark):
            job = of(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            job.awaitTermination()
        state_rows[name] = max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress)
        got[name] = spark.read.parquet(out).collect()
    used, rings, let, flags = Counter(), {}, set(), {}
    for i, u, k, t in rows:
        used[u, t // 86_400] += 1
        if used[u, t // 86_400] <= control.BUDGET:
            let.add((i, u))
        rings.setdefault(u, []).append(k == "error")
        flags[i] = u, sum(rings[u][-control.RING :])
    assert set(map(tuple, got["budget"])) == let and len(got["budget"]) == len(let)
    assert {r.event_id: (r.user_id, r.errors) for r in got["ring"]} == flags
    assert state_rows["ring"] < 1500 and state_rows["budget"] < 5 * 1500  # not a row a user, nor for each of their days with its timer


def test_sync_in_pages_with_overlap_and_children(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(12), float(rng.randrange(9)), 1000 + 40 * (i // 3)) for i in range(120)]
    frame = lambda rs: spark.createDataFrame(rs, "id long, product_id long, price double, t long").withColumn("scraped_at", F.timestamp_seconds("t")).drop("t")
    kids = spark.createDataFrame([(p, k) for p in range(14) for k in range(2)], "product_id long, line int")
    target, children = str(tmp_path / "t"), {"lines": (kids, "product_id", ["product_id", "line"])}
    last = lambda rs: {p: (t, i, price) for i, p, price, t in sorted(rs, key=lambda r: (r[3], r[0]))}
    stored = lambda: {r.product_id: (int(r.scraped_at.timestamp()), r.id, r.price) for r in current(spark, f"{target}/rows", frame(rows).schema).collect()}
    assert sync(frame(rows), target, ["product_id"], page=50, children=children) == 50
    assert stored() == last(rows[:50])
    late = (500, 3, 77.0, rows[49][3] - 20)  # written later with a time before the mark, within the overlap
    some = rows + [late, (501, 2, 1.0, 10)]  # the last is too old to be seen
    assert sync(frame(some), target, ["product_id"], page=50, children=children) == 50
    assert stored() == last(rows[:100] + [late])
    assert sync(frame(some), target, ["product_id"], children=children) == 20 and sync(frame(some), target, ["product_id"]) == 0
    assert stored() == last(rows + [late])
    got = current(spark, f"{target}/lines", kids.schema).collect()
    assert sorted((r.product_id, r.line) for r in got) == sorted((p, k) for p in last(rows) for k in range(2))
