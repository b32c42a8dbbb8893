"""Operators 11 to 13 against brute force, with the odd rows that their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislegrid.llm import cover_tree, hard_negatives, quality_rules

from .test_operators import corpus, sentence

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


# 11 quality rules
def brute_rules(rows, least, share):
    """rows (id, text, host) -> Counter of results, and the cleaned texts by (text, host)."""
    normal = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).lower()
    texts = defaultdict(set)
    for _, t, h in rows:
        texts[h].add(t or "")
    holders = Counter((h, n) for h, all_ in texts.items() for t in all_ for n in {normal(x) for x in t.split("\n")} if n)
    frequent = {k for k, n in holders.items() if n > max(least, share * len(texts[k[0]]))}
    out, cleaned = Counter(), {}
    for i, t, h in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if normal(x)]
        gone = [x for x in lines if (h, normal(x)) in frequent]
        left = len(w) - sum(len(normal(x).split(" ")) for x in gone)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len({*lines}), len(covered), failed, not failed and left >= 0.3 * len(w), len(gone), left)] += 1
        cleaned[t, h] = "\n".join(x for x in t.split("\n") if (h, normal(x)) not in frequent)
    return out, cleaned


def rule_rows():
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["a", "b", "b", None])) for i, t in corpus(3, 90)]
    foot, head = "All  Rights\treserved #1", "Über uns | Kontakt"
    for i in range(40):
        body = [sentence(rng, 40) for _ in range(rng.randrange(4))]
        rows.append((500 + i, "\n".join([head, *body, rng.choice([foot, foot.upper(), "all rights reserved #1"])]), "a"))
    menu = "\n".join(sentence(rng, 25) for _ in range(4))
    rows += [(600 + i, sentence(rng, 10) + "\n" + menu, "a") for i in range(40)]  # boilerplate leaves little of them
    rows += [(700, "copy of one text\n" + sentence(rng, 60), "b")] * 30  # copies are one text
    rows += [(800, "a a a a " * 40, "a"), (801, "\n\n \n", "a"), (802, "x y z\r\nx y z\r\n" * 3, None), (None, "no id " * 30, "a")]
    return rows


def test_quality_rules(spark):
    rows = rule_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("x")).withColumn("h", F.lit(1)).withColumn("words", F.lit(1)).repartition(3)
    for least, share in ((5, 0.0), (2, 0.1)):
        wanted, cleaned = brute_rules(rows, least, share)
        got = quality_rules.quality(docs, least_texts=least, share=share).collect()
        assert Counter(tuple(r) for r in got) == wanted
        assert any(not r.base_failed and not r.kept for r in got) and any(r.n_lines_removed and r.kept for r in got)
        new = quality_rules.without_frequent_lines(docs, least_texts=least, share=share)
        assert new.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in new.collect()) == Counter((i, None if t is None else cleaned[t, h]) for i, t, h in rows)


def test_quality_rules_odd_tables(spark):
    assert quality_rules.quality(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    r = quality_rules.quality(spark.createDataFrame([(1, "word " * 300_000, None)], "doc_id long, text string, source string")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (300_000, 300_000, True, False)


# 12 hard negatives
def vector_rows(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(4)] + rng.normal(size=dims) * rng.choice([0.1, 1.0])
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([0.2, 1.0]))], int(rng.integers(3))))
    rows += [(n + i, rows[4][1], i % 3) for i in range(40)]  # copies: ties by id
    rows += [(n + 50, None, 1), (n + 51, [1.0, None] + [0.0] * (dims - 2), 1), (n + 52, [NAN] * dims, 1), (n + 53, [INF] * dims, 1), (n + 54, [0.1] * dims, None), (None, [0.1] * dims, 1)]
    rows += [(n + 55, [0.0] * dims, 2), (n + 56, [0.0] * dims, 2), rows[3], rows[3], (n + 60, [0.5] * (dims - 3), 1)]
    return rows


def quantised(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute_negatives(rows, every):
    kept = [(i, q, c) for i, v, c in rows if (q := quantised(v)) is not None and i is not None and c is not None]
    asks = {}
    for i, q, c in kept:
        if i % every == 0:
            asks[i] = min(asks.get(i, (c, q)), (c, q))
    out = []
    for a, (label, q) in asks.items():
        score = sorted((-sum(x * y for x, y in zip(q, p, strict=False)), i, c == label) for i, p, c in kept if i != a)
        for s, p, _ in [x for x in score if x[2]][:5]:
            fit = [(t, i) for t, i, same in score if not same and -30 * s <= -100 * t <= -90 * s][:10]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize(("block", "cluster"), [(8_000, 500), (60, 10)])
def test_hard_negatives(spark, monkeypatch, block, cluster):
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 15 if cluster == 10 else 2_000)
    monkeypatch.setattr(hard_negatives, "CLUSTER", cluster)
    rows = vector_rows(1, 400)
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, df.where("vec_id % 9 = 0")).collect()]
    wanted = brute_negatives(rows, 9)
    # repeated rows and ids give equal places, so multisets are compared
    assert Counter(got) == Counter(wanted) and len(got) > 500


def test_hard_negatives_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTORS)
    assert hard_negatives.mine(none, none).count() == hard_negatives.mine(some, none).count() == hard_negatives.mine(some, some).count() == 0


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    anchors = (rng.normal(size=(30, 8)) * 10 + 300).astype(np.int64)  # one narrow cluster
    cands = (rng.normal(size=(5000, 8)) * 200).astype(np.int64)
    centre = anchors.mean(0) / np.linalg.norm(anchors.mean(0))
    order, bound = hard_negatives.shared_list(anchors, centre, cands)
    ids, sorted_ = rng.permutation(5000)[order], cands[order]
    length = np.linalg.norm(anchors, axis=1)
    assert (anchors @ sorted_.T <= length[:, None] * bound[None, :] + 1e-6).all()
    who, at, s, looked = hard_negatives.walk(lambda r, a, b: anchors[r] @ sorted_[a:b].T, length, np.arange(30), bound, ids, 5, np.full(30, hard_negatives.LEAST), lambda r, a, b, s: np.ones(s.shape, bool))
    assert looked < 30 * 5000 / 2
    full = anchors @ sorted_.T
    for i in range(30):
        best = sorted(zip(-full[i], ids, strict=True))[:5]
        assert sorted(zip(-s[who == i], ids[at[who == i]], strict=True)) == best


# 13 cover-tree Lloyd
def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i, q, c) for i, v, c in rows if (q := quantised(v)) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // parts)
    x = {k: np.array(q + [0] * (parts * width - length)).reshape(parts, width) for k, (_, q, _) in enumerate(kept) if len(q) == length}
    books = [[list(map(int, x[k][p])) for k in list(x)[:entries]] for p in range(parts)]
    nearest = lambda p, v: min((sum((int(a) - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in x.values():
                own[nearest(p, v[p])[1]].append(v[p])
            for j, vs in own.items():
                books[p][j] = [int(sum(int(v[d]) for v in vs)) // len(vs) for d in range(width)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = {k: [nearest(p, v[p]) for p in range(parts)] for k, v in x.items()}
    error = {k: sum(d for d, _ in c) for k, c in coded.items()}
    by_label = Counter()
    for k, e in error.items():
        by_label[kept[k][2]] += e
    return [(i, "".join(f"{j:02x}" for _, j in coded[k]) if k in coded else None, error.get(k), by_label[c], digest) for k, (i, _, c) in enumerate(kept)]


@pytest.mark.parametrize(("chunk", "parts", "entries"), [(8_192, 4, 9), (70, 5, 16)])
def test_cover_tree_codes(spark, monkeypatch, chunk, parts, entries):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    rows = vector_rows(7, 300)
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit(1)).withColumn("l", F.lit(2)).repartition(2)
    got = [tuple(r) for r in cover_tree.compress(df, parts=parts, entries=entries).collect()]
    wanted = brute_codes(rows, parts, entries, 2)
    wanted = [(*r[:3], r[3], r[4]) for r in wanted]
    assert Counter(got) == Counter(wanted)


def test_cover_tree_odd_tables(spark):
    assert cover_tree.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert cover_tree.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    assert [r.code for r in cover_tree.compress(spark.createDataFrame([(1, [], 1)], VECTORS)).collect()] == [None]
    few = cover_tree.compress(spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.5] * 16, None), (3, [-0.5] * 16, None)], VECTORS)).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in few} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0), (3, "02" * 16, 0, 0)}


def test_cover_tree_invariants():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-90, 90, (3000, 4)), np.tile([[5, 5, 5, 5]], (500, 1))])
    t = cover_tree.build_tree(x)
    assert sorted(t["points"].tolist()) == list(range(len(x)))
    for n in range(len(t["begin"])):
        own = x[t["points"][t["begin"][n] : t["end"][n]]].astype(float)
        assert np.sqrt(((own - x[t["centre"][n]]) ** 2).sum(1)).max() <= t["radius"][n] + 1e-9
        kids = range(t["child"][n], t["child"][n] + t["children"][n])
        if len(kids):
            assert [t["begin"][k] for k in kids] + [t["end"][n]] == [t["begin"][n]] + [t["end"][k] for k in kids]
            c = x[[t["centre"][k] for k in kids]].astype(float)
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert apart.min() > t["radius"][n] / 2 - 1e-9 and max(t["radius"][k] for k in kids) <= t["radius"][n] / 2 + 1e-9
    book = rng.integers(-90, 90, (16, 4))
    sums, counts = cover_tree.totals(x, t, book)
    own = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (counts == np.bincount(own, minlength=16)).all() and (sums == np.stack([x[own == j].sum(0) for j in range(16)])).all()
    whole, rows, _ = cover_tree.assign(x, t, book)
    assert sum((e - b).sum() for b, e, _ in whole) + len(rows) == len(x) and len(rows) < len(x) * 0.9
