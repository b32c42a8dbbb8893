"""Joins through classes of equal rows: copies, ties and whole results, on small tables against plain Python."""

import duckdb
from pyspark.sql import functions as F

from aislegrid.operators import enrichment
from aislegrid.operators import matching as M
from aislegrid.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_cosine_takes_all_of_a_label(spark):
    labels = dict(duckdb.connect().execute(f"SELECT vec_id, label FROM '{DATA}/embeddings.parquet'").fetchall())
    wanted = {(q, v) for q in labels for v in labels if q % 25 == 0 and q != v and labels[q] == labels[v]}
    assert {(r.query_id, r.vec_id) for r in QUERIES["num_cosine"](spark, DATA).collect()} == wanted
    assert "a.label = b.label" in ORACLES["num_cosine"]


def test_pool_union_lists_all_codes(spark):
    scan = [(1, "A", "red bolt", "1110"), (2, "", "blue rod", None), (2, "B", "blue rod", "2220")]
    pool = [(f"628{i:03d}", "A", "grey nut", "9990") for i in range(60)] + [("7", "C", "red nut", "1119"), ("7", "A", "rod", "2229"), ("8", "C", "red bolt", "3330"), ("9", "D", "nut", "4440")]
    prefix = lambda c: c[:3] if c else None
    wanted = {}
    for i, brand, name, code in scan:
        for gtin, b, n, c in pool:
            p = 1 if brand and brand == b else 2 if code and prefix(code) == prefix(c) else 3 if set(name.split()) & set(n.split()) else None
            if p:
                wanted[i, gtin] = min(p, wanted.get((i, gtin), 9))
    pad = lambda c: c and c.ljust(13, "0")
    a = spark.createDataFrame([(i, b, n, pad(c)) for i, b, n, c in scan], "id long, brand string, name string, code string")
    b = spark.createDataFrame([(g, b, n, pad(c)) for g, b, n, c in pool], "gtin string, brand string, name string, code string")
    got = M.pool_union(a, b).collect()
    assert len(got) == len(wanted) and {(r.scan_id, r.gtin): r.priority for r in got} == wanted


def test_best_matches_with_copies(spark):
    """Copies of the best leave a gap of 0, ties go to the smaller id, null weights are a class of their own; pairs of rows are never listed."""
    scan = spark.createDataFrame([(i, "A", "small bolt", w) for i, w in [(1, 2.0), (2, 2.0), (3, None)]] + [(4, "B", "red rod", 1.0)], "id long, brand string, name string, weight double")
    pool = spark.createDataFrame([(9, "9", "A", "small bolts", 2.0), (8, "8", "A", "small bolts", 2.0), (7, "7", "A", "small colt", 2.0), (5, "5", "B", "red rods", 1.0), (6, "6", "B", "red road", 1.0)], "id long, gtin string, brand string, name string, weight double")
    got = {r.scan_id: (r.pool_id, r.gtin, r.gap) for r in M.best_matches(scan, pool, ["brand"], 0.5).collect()}
    assert got[1] == got[2] == got[3] == (8, "8", 0.0) and got[4][:2] == (5, "5") and got[4][2] > 0
    sized = {r.scan_id for r in M.best_matches(scan, pool, ["brand"], 0.5, F.expr("weight_l = weight_r"), weights=True).collect()}
    assert sized == {1, 2, 4}
    many = spark.range(4000).selectExpr("id", "'A' brand", "'small bolt' name", "2.0D weight", "cast(id AS string) gtin")
    assert M.class_pairs(many, many, ["brand"]).select("copies").collect()[0].copies == 4000 and M.best_matches(many, many, ["brand"], 0.5).where("pool_id = 0 AND gap = 0").count() == 4000


def test_local_exact_and_hamming_of_copies(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN '' ELSE 'A' END brand", "'small bolt' name", "'00ff00ff00ff00ff' hash")
    donors = spark.range(10, 3000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END brand", "'small bolt' name", "'00ff00ff00ff00fe' hash")
    assert {(r.brand, r.donor_id) for r in M.local_exact(rows, donors).join(rows, F.expr("id = scan_id")).collect()} == {("", 10), ("A", 10)}
    got = M.hamming_join(rows, donors).collect()
    assert len(got) == 2000 and {(r.donor_id, r.bits) for r in got} == {(10, 1)}


def test_donors_of_copies(spark):
    """Products that share vectors: the row itself is left out, ties go to the smaller id, also where a class holds more rows than are asked for."""
    vector = {0: [1.0, 0.0], 1: [0.9, 0.1], 2: [0.0, 1.0]}
    rows = [(i, f"b{i % 2}", str(i % 3), "c" if i % 4 else None, vector[i * i % 7 % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, brand string, prefix string, category string, embedding array<float>")
    cos = lambda x, y: round((x[0] * y[0] + x[1] * y[1]) / ((x[0] ** 2 + x[1] ** 2) * (y[0] ** 2 + y[1] ** 2)) ** 0.5, 4)
    met = lambda a, b: a[0] != b[0] and (a[1] == b[1] or a[2] == b[2] or (a[3] is not None and a[3] == b[3]))
    wanted = {(a[0], j) for a in rows for _, j in sorted((-cos(a[4], b[4]), b[0]) for b in rows if met(a, b) and cos(a[4], b[4]) >= 0.85)[:5]}
    got = enrichment.donors(df, df).collect()
    assert len(got) == len(wanted) and {(r.product_id, r.donor_id) for r in got} == wanted


def test_pairs_of_names_lose_no_text(spark, tmp_path):
    """The pairs of classes hold just the ordered pairs of texts that the pairs of rows hold, however often rows repeat."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p.* REPLACE (p_partkey + k * 1000 AS p_partkey) FROM '{DATA}/part.parquet' p, range(4) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW q AS SELECT p_partkey AS id, p_brand AS brand, p_type AS category, p_name || ' ' || p_size || 'g' AS name FROM '{tmp_path}/part.parquet'")
    rows = con.execute("SELECT DISTINCT a.brand, a.category, a.name, b.name FROM q a JOIN q b ON a.brand = b.brand AND a.category = b.category AND a.id < b.id").fetchall()
    names = {i: (b, c, n) for i, b, c, n in con.execute("SELECT id, brand, category, name FROM q").fetchall()}
    got = [(*names[r.id_a], names[r.id_b][2]) for r in QUERIES["str_verdict_key"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == set(rows)
    members = {r.id: r.class_id for r in QUERIES["pair_classes"](spark, str(tmp_path)).collect()}
    assert members.keys() == names.keys() and all(names[i] == names[c] for i, c in members.items())
    assert QUERIES["gtin_equal_loose"](spark, str(tmp_path)).count() == len(names)


def test_similar_and_linked_of_copies(spark, tmp_path):
    """Six copies of each product, so that classes hold more rows than are asked for: equal to SQL over rows."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p.* REPLACE (p_partkey + k * 1000 AS p_partkey) FROM '{DATA}/part.parquet' p, range(7) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for t in ("lineitem", "supplier"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    for t in ("part", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name, key in (("pipe_similar", ("product_id", "similar_id")), ("pipe_price_linker", ("id", "offer_id", "score"))):
        got = sorted(tuple(r[c] for c in key) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(f"SELECT {', '.join(key)} FROM ({ORACLES[name]})").fetchall())
