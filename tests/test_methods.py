"""Steps of the named methods, on small product tables made for them."""

import duckdb
import pytest

from aislegrid.plans.catalog import QUERIES


@pytest.fixture
def products(tmp_path):
    """Writes products (key, name, brand, size) as the table of parts. Keys with a remainder of 1 by 5 are scan rows, 2 to 4 pool rows; a scan row's weight is unknown where the remainder by 4 is 1."""

    def write(rows):
        con = duckdb.connect()
        con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE)")
        con.executemany("INSERT INTO part VALUES (?, ?, ?, 'SMALL', ?, 1.0)", rows)
        con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return write


def test_brand_block_asks_for_weights(spark, products):
    """The equal name of another weight loses to a like one of the same weight; with an unknown weight 0.77 is too little, with known ones enough."""
    d = products([(11, "small bolt", "A", 10), (12, "small bolt", "A", 30), (13, "small bolts", "A", 10), (21, "small bolt", "A", 10), (31, "red rod", "B", 5), (41, "red rod", "B", 5), (32, "red road", "B", 5), (51, "grey nut", "C", 5), (52, "grey nut", "C", 9)])
    got = {r.scan_id: (r.pool_id, round(r.score, 3)) for r in QUERIES["join_block_brand"](spark, d).collect()}
    assert got == {11: (13, 0.947), 21: (12, 1.0), 31: (32, 0.769)}


def test_image_join_guards_names_and_weights(spark):
    """A nearer hash under another name, or of another weight, loses; a row without a brand takes donors whose brand its name holds."""
    from aislegrid.operators.matching import image_join

    kind = "id long, brand string, name string, weight double, hash string"
    scan = spark.createDataFrame([(1, "Qx", "small bolt", 10.0, "00ff00ff00ff00ff"), (2, "", "acme bolt", None, "00ff00ff00ff00ff"), (3, "B", "zzz", 1.0, "00ff00ff00ff00ff")], kind)
    donors = [(10, "Qx", "grey nut", 10.0, "00ff00ff00ff00ff"), (11, "Qx", "small bolts", 20.0, "00ff00ff00ff00ff"), (12, "Qx", "small bolts", 10.5, "00ff00ff00ff00f0"), (13, "acme", "bolt", 3.0, "00ff00ff00ff00fe"), (14, None, "small bolt", None, "00ff00ff00ff0000"), (15, "B", "abc", 1.0, "00ff00ff00ff00ff")]
    got = {r.scan_id: (r.donor_id, r.bits) for r in image_join(scan, spark.createDataFrame(donors, kind)).collect()}
    assert got == {1: (12, 4), 2: (13, 1)}


def test_link_scores_of_brand_and_weight(spark):
    """Brand in the title 20, like it 10, none 0; weights 25, 15, 5 and 0, unknown 5: constants before."""
    from aislegrid.operators.matching import link_scores

    products = spark.createDataFrame([(1, "b#7", "hot bolt", 100.0), (2, "c#7", "hot bolt", 100.0), (3, "d#7", "hot bolt", 100.0), (4, "e#7", "hot bolt", None), (5, "f#7", "hot bolt", 100.0)], "id long, brand string, name string, weight double")
    results = spark.createDataFrame([("b#7", "hot bolt", 100.0), ("b#7", "hot bolt", 150.0), ("c#7", "c#7", 90.0), ("d#7", "hot bolt", 70.0), ("e#7", "hot bolt", 1.0), ("f#7", "hot bolt", 300.0)], "brand string, title string, weight double")
    assert {r.id: (r.score, r.tier) for r in link_scores(products, results).collect()} == {1: (75.0, "link"), 2: (40.0, "discard"), 3: (55.0, "review"), 4: (55.0, "review"), 5: (50.0, "review")}


def test_donors_where_vectors_outweigh_products(spark, products):
    """With more bytes of vectors than of products Spark broadcast the products, whose join key held a subquery, and failed; many rows of few bytes filled the driver."""
    from aislegrid.plans.catalog import ORACLES

    d = products([(i, "small bolt", f"b{i % 2}", 1 + i % 3) for i in range(400)])
    con = duckdb.connect()
    con.execute(f"COPY (SELECT a.vec_id, b.embedding, a.label FROM '/root/testdata/sf0.1/embeddings.parquet' a JOIN '/root/testdata/sf0.1/embeddings.parquet' b ON b.vec_id = a.vec_id - a.vec_id % 8) TO '{d}/embeddings.parquet' (FORMAT parquet)")
    for t in ("part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    wanted = con.execute(f"SELECT product_id, donor_id FROM ({ORACLES['join_donor_candidates']})").fetchall()
    df = QUERIES["join_donor_candidates"](spark, d)
    assert wanted and sorted((r.product_id, r.donor_id) for r in df.collect()) == sorted(wanted)
