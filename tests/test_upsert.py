"""Upserts by code against plain Python that carries them out one by one."""

import random

import pytest
from pyspark.sql import functions as F

from aislegrid.operators import upsert as U

FIELDS = "name_en string, name_ar string, brand string, category string, net_weight_value double, net_unit string"
GRAMS = {"g": (1, "g"), "kg": (1000, "g"), "ml": (1, "ml"), "l": (1000, "ml"), None: (1, "g")}


def block(row):
    if not row["brand"] or not row["net_weight_value"]:
        return None
    factor, unit = GRAMS[row["net_unit"]]
    return row["brand"].lower(), row["net_weight_value"] * factor, unit


def real(code):
    return code is not None and code.isascii() and code.isdigit() and len(code) in (8, 12, 13, 14)


def sequential(products, incoming, children):
    products, children, log = {p["id"]: dict(p) for p in products}, {k: {i: list(v) for i, v in c.items()} for k, c in children.items()}, []
    for r in sorted(incoming, key=lambda r: r["seq"]):
        if not real(r["gtin"]):
            continue
        target, loser = next((i for i in sorted(products) if products[i]["gtin"] == r["gtin"]), None), None
        if target is None and block(r):
            target = next((i for i in sorted(products) if products[i]["gtin"] is not None and not real(products[i]["gtin"]) and block(products[i]) == block(r)), None)
            loser = target and products[target]["gtin"]
        if target is None:
            target = max(products, default=0) + 1
            products[target] = dict.fromkeys(["name_en", "name_ar", "brand", "category", "net_weight_value", "net_unit"]) | {"id": target}
        products[target]["gtin"] = r["gtin"]
        products[target].update({f: r[f] for f in U.FIELDS if r[f] is not None})
        for k in children:
            if r[k] is not None:
                children[k][target] = list(dict.fromkeys(r[k])) if k == "allergens" else r[k]
        log.append((r["seq"], target, r["gtin"], target if loser else None, loser, "scan_twin_merge" if loser else "admin_upsert"))
    return products, children, log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upserts_are_those_of_one_row_at_a_time(spark, seed):
    rng = random.Random(seed)
    # Stored twins keep their brand and size: only rows for their own codes could change them, and those are not synthetic.
    fields = lambda s: dict(name_en=rng.choice([None, "", f"name {s} 5g"]), name_ar=rng.choice([None, "لبن"]), brand=rng.choice([None, "", "Acme", "ACME", "Zeta"]), category=rng.choice([None, f"c{s}"]), net_weight_value=rng.choice([None, 0.0, 1.0, 1000.0]), net_unit=rng.choice([None, "g", "kg", "l", "ml"]))
    products = [dict(id=i, gtin=rng.choice([None, f"SCAN-{i}", f"SCAN-{i}", f"6281{i:04d}"]), **fields(i)) for i in range(1, 60)]
    incoming = [dict(seq=s, gtin=rng.choice([None, "SCAN-4", "12", f"6281{rng.randrange(80):04d}", f"6291{rng.randrange(30):04d}"]), **fields(s), allergens=rng.choice([None, [], ["milk", "soy", "milk"], [f"a{s}"]]), ingredients=rng.choice([None, [], ["salt", "oats", "salt"]])) for s in range(1, 90)]
    children = {"allergens": {i: ["milk", "nuts"] for i in range(1, 40)}, "ingredients": {i: ["water"] for i in range(1, 40)}}
    wanted, lists, log = sequential(products, incoming, children)
    make = lambda rows, schema: spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    out = U.upsert_by_code(
        make(products, "id long, gtin string, " + FIELDS),
        make(incoming, "seq long, gtin string, " + FIELDS + ", allergens array<string>, ingredients array<string>"),
        "off_backfill_job",
        allergens=spark.createDataFrame([(i, a) for i, v in children["allergens"].items() for a in v], "product_id long, allergen_key string"),
        ingredients=spark.createDataFrame([(i, k, a) for i, v in children["ingredients"].items() for k, a in enumerate(v)], "product_id long, place int, name_en string"),
    )
    assert {r.id: {c: r[c] for c in ("id", "gtin", *U.FIELDS)} for r in out["product"].collect()} == wanted
    rows = out["merge_log"].collect()
    assert sorted((r.seq, r.winner_id, r.winner_gtin, r.loser_id, r.loser_gtin, r.reason) for r in rows) == log
    assert sum(r.reason == "scan_twin_merge" for r in rows) > 0 and {r.triggered_by for r in rows} == {"off_backfill_job"}
    assert sorted((r.product_id, r.allergen_key) for r in out["allergens"].collect()) == sorted((i, a) for i, v in lists["allergens"].items() for a in v)
    assert sorted((r.product_id, r.place, r.name_en) for r in out["ingredients"].collect()) == sorted((i, k, a) for i, v in lists["ingredients"].items() for k, a in enumerate(v))
    assert {r.seq for r in out["rejected"].collect()} == {r["seq"] for r in incoming if not real(r["gtin"])}


def test_upserts_of_nothing(spark):
    products = spark.createDataFrame([(1, "62810001", None, None, None, None, None, None)], "id long, gtin string, " + FIELDS)
    none = products.withColumn("seq", F.col("id")).where("id < 0")
    out = U.upsert_by_code(products, none, "a")
    assert (out["product"].count(), out["merge_log"].count()) == (1, 0)
    first = U.upsert_by_code(products.where("id < 0"), products.withColumn("seq", F.col("id")), "a")
    assert [(r.id, r.gtin, r.gtin_prefix) for r in first["product"].collect()] == [(1, "62810001", "628")]
