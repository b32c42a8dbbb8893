"""Ingest of offers, places and runs against plain Python that takes rows one by one."""

import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from aislegrid.operators import ingest as I
from aislegrid.operators import ordered
from aislegrid.sources import feeds as S

OFFERS = """seq long, gtin string, url string, brand string, name string, name_ar string, weight string, price double, promo double, in_stock boolean, merchant_id long, store_id long, scraped_at timestamp,
  description string, description_ar string, subcategory string, allergen_tags array<string>, ingredient_tags array<string>, image_urls array<string>, image_types array<string>, product_id string"""
PRODUCTS = "id long, gtin string, name_en string, name_ar string, brand string, net_weight_value double, net_unit string, " + ", ".join(f"{c} {t}" for c, t in I.ENRICHED.items())
PRICES = "id long, product_id long, merchant_id long, store_id long, price double, promo double, in_stock boolean, source_url string, scraped_at timestamp"
PLACEHOLDERS = {"", "generic", "unnamed", "unnamed product", "unknown", "n/a", "na", "none"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def similar(a, b):
    return 1 - edits(a, b) / max(len(a), len(b)) > 0.85


def cleaned(name):
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s]", "", name.lower().strip())).strip()


def measured(text):
    m = re.search(r"([0-9]+\.?[0-9]*)\s*(g|kg|l|ml|cc|cl)", (text or "").lower())
    if not m or float(m[1]) == 0:
        return None
    n, u = float(m[1]), m[2]
    return (n * 1000, "g" if u == "kg" else "ml") if u in ("kg", "l") else (n * 10, "ml") if u == "cl" else (n, "g" if u == "g" else "ml")


def sequential(products, prices, images, offers):
    """The ingest, an offer at a time."""
    products = {p["id"]: dict(p) for p in products}
    stored, founders, holders = sorted(products), [], {}
    codes = {}
    for i in stored:
        if products[i]["gtin"] is not None:
            codes.setdefault(products[i]["gtin"], i)
    latest = {}
    for r in sorted(prices, key=lambda r: (r["scraped_at"], r["id"])):
        latest[r["product_id"], r["merchant_id"], r["store_id"]] = dict(r, n_offers=0)
    done, how, found_images, given = [], {}, {}, set()
    for o in sorted(offers, key=lambda o: o["seq"]):
        if o["price"] is None or not o["price"] > 0:
            how[o["seq"]] = ("price", None)
            continue
        code = (o["gtin"] or "").strip(" ") or None
        if code is None and o["url"] is not None:
            code = "URL-" + base64.b64encode(o["url"].encode()).decode()[-16:]
        brand = "Generic" if (o["brand"] or "").strip().lower() in PLACEHOLDERS else o["brand"].strip()
        name, size = (o["name"] or "").strip() or "Unnamed Product", measured(o["weight"])
        if code in codes and code is not None:
            target, kind = codes[code], "gtin"
        elif "offer" in name.lower():
            how[o["seq"]] = ("rejected", None)
            continue
        elif code is not None and code in holders:
            target, kind = holders[code], "follows"
        else:
            alone = brand == "Generic" and (size is None or code is None)
            target, kind = None, "weak" if alone else "new"
            if not alone and cleaned(name):
                for i in stored + founders:
                    p = products[i]
                    theirs = cleaned((p["name_en"] or "").strip() or p["name_ar"] or "")
                    its_size = (p["net_weight_value"], p["net_unit"]) if p["net_weight_value"] else None
                    if theirs and (p["brand"] or "").strip() == brand and (size is None or size == its_size) and similar(cleaned(name), theirs):
                        target, kind = i, "name"
                        break
            if target is None:
                target = max(products) + 1
                products[target] = dict.fromkeys(products[stored[0]]) | {"id": target, "gtin": code or f"SCAN-{target}", "name_en": name, "name_ar": o["name_ar"], "brand": brand, "net_weight_value": size and size[0], "net_unit": size and size[1]}
                if not alone:
                    founders.append(target)
            if code is not None:
                holders[code] = target
        how[o["seq"]] = (kind, target)
        p = products[target]
        urls, kinds = o["image_urls"] or [], o["image_types"] or []
        at = lambda k: urls[kinds.index(k)] if k in kinds and kinds.index(k) < len(urls) else None  # noqa: E731, B023
        for field, value in (("name_ar", o["name_ar"]), ("description_en", o["description"]), ("description_ar", o["description_ar"]), ("subcategory", o["subcategory"]), ("image_front_url", at("front") or (urls[0] if urls else None)), ("image_nutrition_url", at("nutrition"))):
            p[field] = p[field] or value or p[field]
        for field in ("allergen_tags", "ingredient_tags"):
            p[field] = o[field] or p[field]
        for k, u in enumerate(urls):
            if u and (target, u) not in images and (target, u) not in found_images:
                found_images[target, u] = kinds[k] if k < len(kinds) else None
        key = (target, o["merchant_id"], o["store_id"])
        row = latest.get(key)
        if row is None or row["price"] != o["price"]:
            row = {"id": None, "price": o["price"], "promo": None, "in_stock": None, "source_url": o["url"], "n_offers": 0, "key": key}
            latest[key] = row
        row["key"] = key
        row["scraped_at"] = o["scraped_at"]
        row["in_stock"] = o["in_stock"] if o["in_stock"] is not None else row["in_stock"]
        row["promo"] = o["promo"] if o["promo"] is not None and o["promo"] > 0 else row["promo"]
        row["n_offers"] += 1
        if id(row) not in given:
            given.add(id(row))
            done.append(row)
    prices = sorted(repr((*r["key"], r["id"], r["price"], r["promo"], True if r["in_stock"] is None else r["in_stock"], r["source_url"], r["scraped_at"], r["n_offers"])) for r in done)
    return how, products, prices, found_images


def table(rng, n_products, n_offers):
    import datetime

    words, brands = ["milk", "cream", "oats"], ["Acme", "Acme", "Acme", "Zeta ", "Generic", None, "n/a"]
    name = lambda: rng.choice([None, "", "x", "!!"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(2, 4))) + rng.choice(["", "", "s", "!", "لبن", " offer"])
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)
    code = lambda: rng.choice([None, None, "", f"628{rng.randrange(30):05d}"])
    products = []
    for i in range(1, n_products + 1):
        w = rng.choice([None, 100.0, 500.0, 1000.0])
        products.append(dict(id=i, gtin=code() or None, name_en=name(), name_ar=rng.choice([None, "", "لبن"]), brand=rng.choice(brands), net_weight_value=w, net_unit=w and rng.choice(["g", "ml"]), description_en=rng.choice([None, "", "text"]), description_ar=None, subcategory=rng.choice([None, "", "dairy"]), allergen_tags=rng.choice([None, [], ["milk"]]), ingredient_tags=None, image_front_url=rng.choice([None, "f"]), image_nutrition_url=None))
    offers = []
    for s in range(1, n_offers + 1):
        urls = rng.choice([None, [], ["a"], ["a", "b", "a"], ["c", "", "b"]])
        offers.append(dict(seq=s, gtin=code(), url=rng.choice([None, f"https://shop.example/{rng.randrange(15)}"]), brand=rng.choice(brands), name=name(), name_ar=rng.choice([None, "", "قشطة"]), weight=rng.choice([None, "", "100g", "0.1 kg", "1 L", "500 ml", "50cl", "ten", "100 g"]), price=rng.choice([None, 0.0, -1.0, float("nan")] + [2.5] * 5 + [3.0] * 3), promo=rng.choice([None, 0.0, 1.5, 2.0]), in_stock=rng.choice([None, True, False]), merchant_id=rng.choice([1, None]), store_id=rng.choice([None, 7]), scraped_at=day(s), description=rng.choice([None, "", f"d{s}"]), description_ar=rng.choice([None, f"ar{s}"]), subcategory=rng.choice([None, f"sub{s}"]), allergen_tags=rng.choice([None, [], [f"t{s}"]]), ingredient_tags=rng.choice([None, [f"i{s}"]]), image_urls=urls, image_types=rng.choice([None, ["front"], ["nutrition", "front"], [None, "nutrition"]]), product_id="clash"))
    prices = [dict(id=k, product_id=rng.randrange(1, n_products + 1), merchant_id=rng.choice([1, None]), store_id=rng.choice([None, 7]), price=rng.choice([2.5, 3.0]), promo=rng.choice([None, 1.0]), in_stock=rng.choice([None, True]), source_url="old", scraped_at=day(-rng.randrange(3))) for k in range(1, 60)]
    images = {(rng.randrange(1, n_products + 1), rng.choice("abc")) for _ in range(20)}
    return products, prices, images, offers


def frames(spark, products, prices, images, offers):
    make = lambda rows, schema: spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in schema.replace("\n", " ").split(",")) for r in rows], schema)
    return make(products, PRODUCTS), make(prices, PRICES), spark.createDataFrame(sorted(images), "product_id long, url string"), make(offers, OFFERS)


@pytest.mark.parametrize("seed", [1, 3])
def test_ingest_is_that_of_one_offer_at_a_time(spark, seed):
    data = table(random.Random(seed), 25, 150)
    how, products, prices, images = sequential(*data)
    out = I.ingest(*frames(spark, *data))
    assert {r.seq: (r.how, r.product_id) for r in out["resolved"].collect()} == how
    assert len({h for h, _ in how.values()}) == 7
    got = {r.id: r.asDict() for r in out["product"].collect()}
    assert {(i, c): (v, products[i][c]) for i, p in got.items() for c, v in p.items() if v != products[i][c]} == {} and len(got) == len(products)
    rows = out["prices"].collect()
    assert sorted(repr((r.product_id, r.merchant_id, r.store_id, r.id, r.price, r.promo, r.in_stock, r.source_url, r.scraped_at, r.n_offers)) for r in rows) == prices
    for r in rows:
        w, u = products[r.product_id]["net_weight_value"], products[r.product_id]["net_unit"]
        assert (r.unit_price, r.unit) == ((pytest.approx(round(r.price * 1000 / w, 2)), {"g": "kg", "ml": "L"}[u]) if w else (None, None))
    assert {(r.product_id, r.url): r.image_type for r in out["images"].collect()} == images


def test_ingest_of_nothing(spark):
    data = table(random.Random(3), 5, 5)
    products, prices, images, offers = frames(spark, *data)
    out = I.ingest(products, prices, images, offers.limit(0))
    assert [out[k].count() for k in ("resolved", "product", "prices", "images")] == [0, 5, 0, 0]
    out = I.ingest(products.limit(0), prices.limit(0), images.limit(0), offers)
    assert out["product"].count() == out["resolved"].where("how IN ('new', 'weak')").count() > 0


@pytest.fixture
def small_parts(spark):
    """Small parts are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_runs_of_a_hot_group(spark, small_parts):
    """One key has nearly all rows, so that its rows lie in several parts."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), i, rng.choice([1.0, 1.0, 2.0, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(3)
    parts = ordered.parted(df, ["k"], ["at"]).where("k = 'hot'").select("part").distinct().count()
    assert parts > 1
    place, run, last, at = {}, {}, {}, {}
    for k, i, v in rows:
        place[k] = place.get(k, 0) + 1
        run[k] = run.get(k, -1) + (k not in last or last[k] != v)
        last[k] = v
        at[i] = (place[k], run[k])
    got = {r["at"]: r.place for r in ordered.numbered(df, ["k"], ["at"], "place").collect()}
    assert got == {i: p for i, (p, _) in at.items()}
    assert {r["at"]: r.run for r in ordered.runs(df, ["k"], ["at"], "v").collect()} == {i: r for i, (_, r) in at.items()}
    assert [r.n for r in ordered.numbered(df, [], ["at"], "n").orderBy("at").collect()] == list(range(1, 401))
    assert ordered.numbered(df.where(F.lit(False)), [], ["at"], "n").count() == 0


def test_import_of_a_feed(spark):
    """The first row of a code makes the product; later ones add ingredients, missing allergens and, where there was none, nutrition."""
    line = lambda code, **more: json.dumps({"code": code, **more})
    full = dict(product_name="Full cream", product_name_ar="قشطة", brands="Acme, Other", categories_tags=["en:dairies"], image_front_url="https://img.example/1", nutriments={"fat_100g": 1, "sugars_100g": "2 g", "salt": 3, "proteins_100g": "0"}, ingredients=[{"text": " milk "}, {"text": ""}, {}], allergens_tags=["en:milk", "milk"], quantity="1 kg", nutriscore_grade="A")
    lines = [
        (5, line("62810001", **full)),
        (1, line("62810002", product_name="Oats", brands="Generic", ingredients=[], ingredients_text="oats, salt", nutriments={"fat_100g": "n/a"})),
        (9, line("62810002", product_name="Oats again", ingredients_text="oats. , salt", allergens_tags=["en:gluten"], nutriments={"fat_100g": "7"})),
        (2, line("12", product_name="bad code")),
        (3, line("62810003")),
        (4, "{bad"),
        (6, ""),
        (7, None),
    ]
    feed = S.parse_feed(spark.createDataFrame(lines, "at long, line string"), keep=("at",))
    out = {k: v.collect() for k, v in S.import_feed(feed, "at").items()}
    assert {r.gtin: (r.id, r.name_en, r.data_completeness_score, r.net_weight_value, r.nutrition_data_complete) for r in out["product"]} == {
        "62810002": (1, "Oats", 15, None, False),
        "62810003": (2, None, 0, None, False),
        "62810001": (3, "Full cream", 100, 1000.0, True),
    }
    assert sorted((r.product_id, r.fat_g, r.sugars_g) for r in out["nutrition"]) == [(1, 7.0, None), (3, 1.0, 2.0)]
    assert sorted((r.product_id, r["at"], r.place, r.name_en) for r in out["ingredient"]) == [(1, 9, 0, "oats"), (1, 9, 1, "salt"), (3, 5, 0, "milk")]
    assert sorted((r.product_id, r.allergen_key) for r in out["allergen"]) == [(1, "gluten"), (3, "milk")]
    assert {r.upto: r.n for r in out["import_summary"]} == {20: 2, 40: 1, 100: 1, -1: 1}
    assert {k: [r.n for r in v.collect()] if k == "import_summary" else v.count() for k, v in S.import_feed(feed.limit(0), "at").items()} == {"product": 0, "nutrition": 0, "ingredient": 0, "allergen": 0, "import_summary": [0]}
