"""Literal cases and properties of the catalog's functions, feeds, markup and streams."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aislegrid.functions import markup as H
from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.operators import cascade as C
from aislegrid.operators import matching as M
from aislegrid.sources import feeds as S
from aislegrid.streaming import price_changes as P


def of(spark, column_of, values):
    """column_of over a column of texts, or over columns a and b of pairs."""
    if values and isinstance(values[0], tuple):
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
        return [r.r for r in df.select("i", column_of(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.r for r in df.select("i", column_of(F.col("s")).alias("r")).orderBy("i").collect()]


CASES = [
    ("slug", lambda s: T.brand_slug(s, T.fold_marks(s)), {"Kellogg's": "kelloggs", "P&G": "p-and-g", "Café Najd": "cafe-najd", "المراعي": "almarai", "كوكا كولا": "coca-cola", "": "", None: ""}),
    ("name", T.product_name, {"Almarai Full Cream Milk 1L": "almarai full cream milk", "Oreo Value Pack 500g": "oreo", "حليب المراعي علبة 1 لتر": "حليب المراعي", "Product   Name   Here": "product name here", None: ""}),
    ("prefix", N.gtin_prefix, {"6281007123456": "628", "01234567": "012", "16281234567890": "628", "06281234567890": "628", "628100712345": "628", "SCAN-123": None}),
    ("placeholder", T.is_placeholder, {"Generic": True, "generic": True, "Unnamed Product": True, "Unknown": True, "N/A": True, "NA": True, "none": True, "  ": True, "": True, None: True, "Almarai": False}),
    ("anchored", N.grams_anchored, {"500g": 500.0, "1.5kg": 1500.0, "330ml": 330.0, "5 oz": 5.0, "2x500g": None, "": None, None: None, "7": 7.0, "250 mg": 0.25, "3cl": 30.0}),
    ("search", N.grams_search, {"2x500g": 500.0, "5 oz": None, "milk 1.5 kg box": 1500.0, None: None}),
    ("real", N.is_real_gtin, {"12345678": True, "123456789": False, "123456789012": True, "SCAN-1": False, None: None}),
    ("normal", N.normal_gtin, {"628100712345": "0628100712345", "URL-x": None, " 12345678 ": "12345678"}),
    ("price", T.price_text, {"SAR 12.50": 12.5, "free": None, "1.2.3": 1.2}),
    ("html", T.strip_html, {"<b>a</b> c": "a c"}),
    ("merchant", T.merchant_clean, {"Carrefour Carrefour 20-30 min": "Carrefour", "Al Othaim": "Othaim", "MarketsCity": "Markets City"}),
]


@pytest.mark.parametrize("name,column_of,cases", CASES, ids=[c[0] for c in CASES])
def test_literals(spark, name, column_of, cases):
    if name == "prefix":
        cases = cases | {"628100712345": "628"}
    assert dict(zip(cases, of(spark, column_of, list(cases)), strict=True)) == cases


def dice(a, b):
    a, b = (" ".join(x.lower().split()) for x in (a, b))
    if a == b and a:
        return 1.0
    p, q = (Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b))
    n = sum(p.values()) + sum(q.values())
    return 2 * sum((p & q).values()) / n if p and q else 0.0


def test_dice(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcي ") for _ in range(rng.randrange(9)))
    pairs = [("ab", "ab"), ("a", "b"), ("", "x"), ("aaaa", "aa"), ("", "")] + [(word(), word()) for _ in range(200)]
    got = of(spark, T.dice, pairs)
    assert got == pytest.approx([dice(a, b) for a, b in pairs])
    assert got == pytest.approx(of(spark, T.dice, [(b, a) for a, b in pairs]))


def test_hamming(spark):
    rng = random.Random(2)
    pairs = [("ffffffff0000000f", "00000000ffffffff"), ("0" * 16, "FAILED"), (None, "0" * 16)] + [(f"{rng.getrandbits(64):016x}", f"{rng.getrandbits(64):016x}") for _ in range(50)]
    assert of(spark, N.hamming, pairs) == [60, None, None] + [(int(a, 16) ^ int(b, 16)).bit_count() for a, b in pairs[3:]]


def test_difference_hash(spark):
    rng = random.Random(3)
    images = [[rng.randrange(256) for _ in range(72)] for _ in range(10)]
    wanted = [f"{int(''.join('1' if im[r * 9 + c] < im[r * 9 + c + 1] else '0' for r in range(8) for c in range(8)), 2):016x}" for im in images]
    df = spark.createDataFrame(list(enumerate(images)), "i int, p array<int>")
    assert [r.r for r in df.select("i", N.difference_hash(F.col("p")).alias("r")).orderBy("i").collect()] == wanted


def test_hamming_join_misses_nothing(spark):
    rng = random.Random(4)
    bases = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    rows = [(i, "b", f"{flip(bases[i % 6], rng.randrange(8)):016x}") for i in range(60)] + [(90, "b", None), (91, "b", "FAILED")]
    left, right = rows[:25], rows[25:]
    make = lambda r: spark.createDataFrame(r, "id long, brand string, hash string")
    got = {r.scan_id: (r.bits, r.donor_id) for r in M.hamming_join(make(left), make(right)).collect()}
    wanted = {}
    for i, _, h in left:
        near = [((int(h, 16) ^ int(g, 16)).bit_count(), j) for j, _, g in right if g and g != "FAILED"]
        if near and min(near)[0] <= 8:
            wanted[i] = min(near)
    assert got == wanted and wanted


def test_size_guard(spark):
    pairs = [("milk 1l", "milk 1000 ml"), ("milk 1l", "milk 2l"), ("rice 1kg", "milk 2l"), ("x", "y 5g"), ("cola 330ml 6", "cola 350 ml")]
    assert of(spark, T.size_guard, pairs) == [True, False, True, True, True]


def test_feed(spark, tmp_path):
    good = '{"code":"6281007123456","product_name":"Milk 1L","brands":"Almarai, Other","quantity":"1 L","categories_tags":["en:dairies","en:milks"],"nutriments":{"fat_100g":"3.2","sugars_100g":4.7,"proteins_100g":"3x","sodium_100g":"0.05"},"ingredients_text":"milk, water. salt","nutriscore_grade":"B","nova_group":9}'
    lines = [good, "", "{bad", '{"code":"12"}', good]
    path = tmp_path / "feed.jsonl"
    path.write_text("\n".join(lines))
    for feed in (S.read_feed(spark, str(path)), S.parse_feed(spark.createDataFrame([(x,) for x in lines], "line string"))):
        rows = S.to_products(feed).collect()
        assert len(rows) == 2
        r = rows[0]
        assert (r.gtin, r.name_en, r.brand, r.category, r.subcategory, r.nutri_score_grade, r.nova_group) == ("6281007123456", "Milk 1L", "Almarai", "dairies", "milks", "b", None)
        assert (r.fat_g, r.sugars_g, r.protein_g, r.sodium_mg, r.nutrition_data_complete, r.ingredients) == (3.2, 4.7, 3.0, 0.05, True, ["milk", "water", "salt"])
    df = S.to_products(S.read_feed(spark, str(path)))
    first = S.insert_ignore(spark.createDataFrame([], df.schema), df, "gtin")
    assert first.count() == 1 and S.insert_ignore(first, df, "gtin").count() == 0
    assert S.upsert(first, first, "gtin").count() == 1


def test_slice_filter(spark):
    df = spark.createDataFrame([("628", ["c"], ["b"]), ("111", ["c"], ["x"]), ("222", None, None)], "code string, countries_tags array<string>, brands_tags array<string>")
    count = lambda **k: df.where(S.SliceFilter(**k).condition()).count()
    assert count() == 3
    assert count(countries=("c",), brands=("b",), prefixes=("628",)) == 2
    assert count(countries=("c",), brands=("b",), prefixes=("628",), require_any=False) == 1
    assert count(countries=("c",), require_any=False) == 0


def test_keyset_pages_cover_all(spark):
    df = spark.range(25).select("id", (F.col("id") % 4).alias("updated_at"))
    seen, cursor = [], None
    while rows := S.after(df, cursor, limit=7).collect():
        seen += [r.id for r in rows]
        cursor = (rows[-1].updated_at, rows[-1].id)
    assert sorted(seen) == list(range(25))


def test_markup(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"G","sku":"12345678","offers":{"lowPrice":"7.5"}},{"@type":"WebPage","name":"no"}]}</script><script type="application/ld+json">{broken</script>'
    got = of(spark, lambda s: H.ld_products(s), [page, "", None])
    assert [(x.name, x.gtin, x.price) for x in got[0]] == [("G", "12345678", 7.5)] and not got[1]
    assert of(spark, H.page_gtin, [page, '<b class="t text-unicode">6281007123456</b>', 'var x={"sku":"87654321"}', "none"]) == ["12345678", "6281007123456", "87654321", None]
    assert of(spark, H.page_price, ['<meta property="product:price:amount" content="3.25">', page, "x"]) == [3.25, 7.5, None]
    assert of(spark, lambda s: H.objects_around(s, '"p"'), ['a {"x":{"p":1}} {"p":"}"} {', "{", None]) == [['{"p":1}', '{"p":"}"}'], [], None]
    assert of(spark, H.product_nodes, ['[{"id":1,"name":"a","price":2,"k":[{"id":3,"name":"b","price":4}]},{"z":{"id":5,"name":"c","price":6}}]', "{"]) == [['{"id": 1, "k": [{"id": 3, "name": "b", "price": 4}], "name": "a", "price": 2}', '{"id": 5, "name": "c", "price": 6}'], []]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), 1, rng.randrange(2), float(rng.randrange(3)), i) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, product_id long, merchant_id long, store_id long, price double, t long").withColumn("scraped_at", F.timestamp_seconds("t")).drop("t")
    batch = Counter(tuple(r) for r in P.batch_price_changes(df).collect())
    got = Counter()
    source = str(tmp_path / "in")
    for lo in (0, 40):  # the second run goes on from the state of the first
        df.where(f"id >= {lo} AND id < {lo + 40}").coalesce(1).write.mode("append").parquet(source)
        query = P.price_changes(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == batch


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (2, 10, "a"), (3, 4000, "b"), (4, 90_000, "z")], "event_id long, t long, event_type string").select("event_id", F.timestamp_seconds("t").alias("ts"), "event_type")
    df.write.parquet(str(tmp_path / "in"))
    query = P.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_cascade_partitions_the_scan_set(spark):
    scan = spark.createDataFrame([(1, "SCAN-1", "b", "full cream milk", 1000.0), (2, "SCAN-2", "b", "oat biscuits", None), (3, "SCAN-3", "zz", "alone", 5.0), (4, "SCAN-4", "b", "full cream milks", 1000.0)], "id long, gtin string, brand string, name string, weight double")
    pool = spark.createDataFrame([(10, "6280000000010", "b", "full cream milk", 1000.0), (11, "6280000000011", "b", "oat biscuit", 200.0), (12, "6280000000012", "b", "full cream milk", 1000.0)], scan.schema)
    got = {r.scan_id: (r.gtin, r.match_pass, r.disposition) for r in C.cascade(scan, pool).collect()}
    assert got[1] == ("6280000000010", "A", "auto") and got[4][1] == "B" and got[2] == ("6280000000011", "C", "review") and got[3] == (None, None, "residual")


def test_cascade_passes_beyond_names(spark):
    kind = "id long, gtin string, brand string, name string, weight double, name_ar string, code string, embedding array<double>"
    scan = spark.createDataFrame(
        [
            (1, "SCAN-1", "b", "milk chocolate bar", 50.0, None, None, None),  # another flavour: B and C fall through
            (2, "SCAN-2", "b", "leban", 900.0, "لبن كامل الدسم", None, None),
            (3, "SCAN-3", "x", "dates in syrup", 300.0, None, "6281234500001", None),
            (4, "SCAN-4", "g", "aaaa", 100.0, None, None, [1.0, 0.0]),
            (5, "SCAN-5", "g", "bbbb", 10.0, None, None, [1.0, 0.0]),
            (6, "SCAN-6", "h", "cccc", None, None, None, [0.8, 0.6]),
            (7, "SCAN-7", "h", "dddd", None, None, None, [-1.0, 0.0]),
            (8, None, None, None, None, None, None, None),
        ],
        kind,
    )
    pool = spark.createDataFrame(
        [
            (20, "6280000000020", "b", "milk vanilla bar", 50.0, "لبن كامل الدسم", None, None),
            (21, "6280000000021", "y", "dates in syrup", None, None, "6289999900001", None),
            (22, "6280000000022", "g", "zzzz", 100.0, None, None, [2.0, 0.1]),
            (23, "6280000000023", "h", "yyyy", None, None, None, [1.0, 0.0]),
            (24, None, None, None, None, None, None, None),
        ],
        kind,
    )
    got = {r.scan_id: (r.gtin, r.match_pass, r.review_reason, r.disposition) for r in C.cascade(scan, pool).collect()}
    none = (None, None, None, "residual")
    assert got == {
        1: none,
        2: ("6280000000020", "D", None, "auto"),
        3: ("6280000000021", "E", None, "review"),
        4: ("6280000000022", "G", None, "auto"),
        5: ("6280000000022", "G", "gated:weight_mismatch_major", "review"),
        6: ("6280000000023", "G", None, "review"),
        7: none,
        8: none,
    }
