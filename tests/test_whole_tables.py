"""Queries against plain Python over whole tables: no row of the input is left out."""

from collections import Counter, defaultdict

import duckdb
import pytest

from aislegrid.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
#: More than 200 products.
LARGER = "/root/testdata/sf0.01"


def table(sql, data=DATA):
    """Rows of a SELECT over the Parquet tables, named as {table}."""
    names = ("part", "lineitem", "supplier", "events")
    return duckdb.sql(sql.format(**{t: f"read_parquet('{data}/{t}.parquet')" for t in names})).fetchall()


@pytest.mark.parametrize("name", ["pipe_price_ingest", "stream_stateful_price"])
def test_price_changes_of_all_products(spark, name):
    rows = table("""SELECT l_partkey, s_nationkey, l_suppkey, l_shipdate, l_orderkey * 10 + l_linenumber, l_extendedprice / l_quantity
      FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE l_linenumber % 7 <> 0""")
    last, wanted = {}, Counter()
    for product, merchant, store, _, _, price in sorted(rows, key=lambda r: (r[3], r[4])):
        key = (product, merchant, store)
        wanted[product, "touch" if last.get(key) == price else "insert"] += 1
        last[key] = price
    got = {(r.product_id, r.action): r.n for r in QUERIES[name](spark, DATA).collect()}
    assert got == wanted
    assert sum(got.values()) == len(rows)


def test_price_linker_takes_all_products(spark):
    offers = defaultdict(list)
    products = table("SELECT p_partkey, p_name, p_brand, p_size::DOUBLE FROM {part}", LARGER)
    for row in products:
        if row[0] % 5 == 1:
            offers[row[2]].append(row)
    wanted = {}
    for product, name, brand, weight in products:
        best = None
        for offer, its_name, _, its_weight in offers[brand]:
            apart = abs(weight - its_weight) / weight
            score = (45 if name == its_name else 10) + 20 + (25 if apart <= 0.05 else 15 if apart <= 0.15 else 0) + 5
            if offer != product and len(name) >= 5 and (best is None or (-score, offer) < (-best[0], best[1])):
                best = (score, offer)
        if best:
            wanted[product] = (best[1], best[0], "link" if best[0] >= 60 else "review" if best[0] >= 45 else "discard")
    assert len(wanted) > 200
    assert {r.id: (r.offer_id, r.score, r.tier) for r in QUERIES["pipe_price_linker"](spark, LARGER).collect()} == wanted
