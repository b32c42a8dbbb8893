"""Ingest of scraped offers: each offer is resolved to a product, products gain what they lack, prices move on, new images are added.

Offers have seq (unique; the order of arrival), gtin, url, brand, name, name_ar, weight (text), price, promo, in_stock, merchant_id, store_id, scraped_at, description, description_ar,
subcategory, allergen_tags, ingredient_tags, image_urls, image_types; `arranged` gives rows without a seq one. Products have id, gtin, name_en, name_ar, brand, net_weight_value, net_unit
and the columns that ENRICHED names. Any column may be null. The result is that of taking the offers one by one, with one exception: offers of one code stay together with the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.sources.shared import settled

from .clustering import DICE_BOUND, SIMILAR, clean_name, is_offer, settle_leaders
from .ordered import numbered, runs
from .similarity import candidates

#: Columns that an ingest fills in, with their types.
ENRICHED = {
    "description_en": "string",
    "description_ar": "string",
    "subcategory": "string",
    "allergen_tags": "array<string>",
    "ingredient_tags": "array<string>",
    "image_front_url": "string",
    "image_nutrition_url": "string",
}
POSITIVE = "price > 0 AND NOT isnan(price)"
PRICE_KEYS = ["product_id", "merchant_id", "store_id"]


def arranged(offers: DataFrame, order: list[str]) -> DataFrame:
    """offers with seq, their place in an order of columns; rows that are equal in all of them may change places."""
    return numbered(offers, [], order, "seq")


def code_of(gtin: Column, url: Column) -> Column:
    """The code, else one made of the end of the page's address, else null."""
    return F.coalesce(T.blank_to_null(gtin), F.concat(F.lit("URL-"), F.right(F.base64(F.encode(url, "UTF-8")), F.lit(16))))


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """brand, name_l, name_r: equal names of a brand, and those over SIMILAR similar by edits."""
    close = T.levenshtein_similarity(F.col("name_l"), F.col("name_r")) > SIMILAR
    found = candidates(left, right, ["brand"], DICE_BOUND).where((F.col("name_l") != F.col("name_r")) & close).select("brand", "name_l", "name_r")
    own = lambda df, side: df.select("brand", "name", F.col("name").alias(f"name_{side}")).distinct()
    return found.unionByName(own(left, "l").join(own(right, "r"), ["brand", "name"]).drop("name"))


#: An offer without a weight meets products of any weight, one with a weight only those of just that weight.
SAME_SIZE = "(size_l = '' OR size_l = size_r)"


def resolve(products: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, product_id, how) of all offers with a positive price, and the products that they create.

    gtin: a stored code; rejected: a name like an offer's, no product; name: the first stored product, else the first founder, of the brand and size whose cleaned name is over 0.85
    similar by edits; weak: a placeholder brand without a code or a size stands alone; new: founds a product; follows: the code of an earlier offer. Stored products come first, in the order of id. Founders
    get ids after the largest stored one, in the order of seq. Names are compared once for each distinct name of a brand.
    """
    size = lambda value, unit: F.when(value > 0, F.concat_ws(" ", value.cast("double").cast("string"), unit)).otherwise("")
    value, unit = N.measure(F.col("weight"))
    brand = F.when(T.is_placeholder(F.col("brand")), F.lit("Generic")).otherwise(F.trim("brand"))
    name = F.coalesce(T.blank_to_null(F.col("name")), F.lit("Unnamed Product"))
    rows = offers.where(POSITIVE).select("seq", code_of(F.col("gtin"), F.col("url")).alias("code"), brand.alias("brand"), name.alias("raw"), clean_name(name).alias("name"), "name_ar", value.alias("value"), unit.alias("unit"))
    rows = rows.withColumn("size", size(F.col("value"), F.col("unit")))
    stored = products.where("gtin IS NOT NULL").groupBy(F.col("gtin").alias("code")).agg(F.min("id").alias("stored_id"))
    rows = settled(rows.join(stored, "code", "left"), "offers")

    by_code = rows.where("stored_id IS NOT NULL").select("seq", F.col("stored_id").alias("product_id"), F.lit("gtin").alias("how"))
    rejected = rows.where(F.col("stored_id").isNull() & is_offer(F.col("raw"))).select("seq", F.lit(None).cast("long").alias("product_id"), F.lit("rejected").alias("how"))
    rest = rows.where(F.col("stored_id").isNull() & ~is_offer(F.col("raw")))
    first = rest.where("code IS NOT NULL").groupBy("code").agg(F.min("seq").alias("holder"))
    rest = rest.join(first, "code", "left").withColumn("holder", F.coalesce("holder", "seq"))
    generic = F.col("brand") == "Generic"
    weak = generic & ((F.col("size") == "") | F.col("code").isNull())
    own = settled(rest.where("holder = seq").withColumn("weak", weak).withColumn("alone", weak | (F.col("name") == "")), "own")

    node = F.concat_ws("\u0001", "brand", "size", "name")
    nodes = settled(own.where("NOT alone").groupBy("brand", "size", "name").agg(F.min("seq").alias("first")).withColumn("node", node), "nodes")
    pool = products.select("id", F.trim(F.coalesce("brand", F.lit(""))).alias("brand"), size(F.col("net_weight_value"), F.col("net_unit")).alias("size"), clean_name(F.coalesce(T.blank_to_null(F.col("name_en")), "name_ar", F.lit(""))).alias("name"))
    pool = settled(pool.where("name <> ''").groupBy("brand", "size", "name").agg(F.min("id").alias("id")), "pool")
    side = lambda df, s, *more: df.select("brand", F.col("name").alias(f"name_{s}"), F.col("size").alias(f"size_{s}"), *more)
    met = _near(nodes, pool).join(side(nodes, "l", "node"), ["brand", "name_l"]).join(side(pool, "r", "id"), ["brand", "name_r"]).where(SAME_SIZE)
    to_stored = settled(met.groupBy("node").agg(F.min("id").alias("product_id")), "stored")

    open_ = nodes.join(to_stored, "node", "left_anti")
    pairs = _near(open_, open_).join(side(open_, "l", "node", F.col("first").alias("first_l")), ["brand", "name_l"]).join(side(open_, "r", F.col("node").alias("earlier"), F.col("first").alias("first_r")), ["brand", "name_r"])
    edges = settled(pairs.where(SAME_SIZE).where("first_r < first_l").select(F.col("node").alias("name"), "earlier", "first_r"), "edges")
    led = settle_leaders(open_.select(F.col("node").alias("name")), edges, []).withColumnRenamed("name", "node")
    led = settled(led.join(nodes.select(F.col("node").alias("leader"), F.col("first").alias("founder")), "leader").select("node", "founder"), "led")

    known = own.withColumn("node", F.when(~F.col("alone"), node)).join(to_stored, "node", "left").join(led, "node", "left")
    known = known.withColumn("founder", F.when(F.col("alone"), F.col("seq")).otherwise(F.col("founder")))
    most = products.agg(F.max("id")).first()[0] or 0
    founders = known.where("product_id IS NULL AND founder = seq").drop("product_id", "node", "founder", "holder", "stored_id")
    founders = settled(numbered(founders, [], ["seq"], "place").withColumn("id", F.col("place") + F.lit(most)), "founders")
    known = known.join(founders.select(F.col("seq").alias("founder"), "id"), "founder", "left")
    how = F.when(F.col("weak"), "weak").when(F.col("founder") == F.col("seq"), "new").otherwise("name")
    known = settled(known.select("seq", F.coalesce("product_id", "id").alias("product_id"), how.alias("how")), "known")
    follow = rest.where("holder <> seq").select("seq", "holder").join(known.select(F.col("seq").alias("holder"), "product_id"), "holder").select("seq", "product_id", F.lit("follows").alias("how"))
    created = founders.select(
        "id",
        F.coalesce("code", F.concat(F.lit("SCAN-"), F.col("id").cast("string"))).alias("gtin"),
        F.col("raw").alias("name_en"),
        "name_ar",
        "brand",
        F.when(F.col("value") > 0, F.col("value")).alias("net_weight_value"),
        F.when(F.col("value") > 0, F.col("unit")).alias("net_unit"),
    )
    return by_code.unionByName(rejected).unionByName(known).unionByName(follow), created


def enriched(products: DataFrame, offers: DataFrame) -> DataFrame:
    """products with what offers (with product_id) add: texts and images only where there is none, from the first offer that has one; the tags of the last offer that has any. Empty texts, lists and addresses count as none."""
    given = lambda c: F.when(F.length(c) > 0, F.col(c))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("seq")))
    last = lambda c: F.max_by(c, F.when(F.size(c) > 0, F.col("seq")))
    image = lambda at: F.nullif(F.get("image_urls", at), F.lit(""))
    typed = lambda kind: image(F.array_position("image_types", kind).cast("int") - 1)
    front = F.coalesce(typed("front"), image(F.lit(0)))
    its = offers.where("product_id IS NOT NULL").groupBy(F.col("product_id").alias("its_id")).agg(
        first(given("name_ar")).alias("its_name_ar"),
        first(given("description")).alias("its_description_en"),
        first(given("description_ar")).alias("its_description_ar"),
        first(given("subcategory")).alias("its_subcategory"),
        last(F.col("allergen_tags")).alias("its_allergen_tags"),
        last(F.col("ingredient_tags")).alias("its_ingredient_tags"),
        first(front).alias("its_image_front_url"),
        first(typed("nutrition")).alias("its_image_nutrition_url"),
    )
    rows = products.join(its, F.col("id") == F.col("its_id"), "left")
    texts = ["name_ar", "description_en", "description_ar", "subcategory", "image_front_url", "image_nutrition_url"]
    values = {c: F.coalesce(given(c), F.col(f"its_{c}"), F.col(c)) for c in texts} | {c: F.coalesce(f"its_{c}", c) for c in ("allergen_tags", "ingredient_tags")}
    return rows.withColumns(values).select(products.columns)


def moved_prices(stored: DataFrame, offers: DataFrame, products: DataFrame) -> DataFrame:
    """The price rows that offers (with product_id) change or add: id (null: new), the keys, price, promo, unit_price, unit, in_stock, source_url, scraped_at, n_offers.

    Of the stored rows (id, keys, price, promo, in_stock, source_url, scraped_at) the latest of a key counts. An offer of the price before it touches that row: its time, stock (if known) and promotion (if
    positive) are the offer's. Another price makes a new row. So a row is a run of equal prices, counted without a window over a whole key.
    """
    columns = ["promo", "in_stock", "source_url", "scraped_at"]
    latest = stored.groupBy(*PRICE_KEYS).agg(F.max_by(F.struct("id", "price", *columns), F.struct("scraped_at", "id")).alias("r")).select(*PRICE_KEYS, "r.*", F.lit(0).cast("long").alias("seq"))
    new = offers.where("product_id IS NOT NULL").where(POSITIVE).select(*PRICE_KEYS, F.lit(None).cast("long").alias("id"), "price", *[F.col("url").alias(c) if c == "source_url" else F.col(c) for c in columns], "seq")
    latest = latest.join(new.select(*[F.col(k).alias(f"its_{k}") for k in PRICE_KEYS]).distinct(), F.expr(" AND ".join(f"{k} <=> its_{k}" for k in PRICE_KEYS)), "left_semi")
    rows = runs(latest.unionByName(new), PRICE_KEYS, ["seq"], "price")
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    made = rows.groupBy(*PRICE_KEYS, "run").agg(
        F.max("id").alias("id"),
        F.first("price").alias("price"),
        last("promo", F.col("promo") > 0).alias("promo"),
        F.coalesce(last("in_stock", F.col("in_stock").isNotNull()), F.lit(True)).alias("in_stock"),
        F.min_by("source_url", "seq").alias("source_url"),
        F.max_by("scraped_at", "seq").alias("scraped_at"),
        F.count_if(F.col("seq") > 0).alias("n_offers"),
    )
    value, unit = N.unit_price(F.col("price"), F.col("net_weight_value"), F.col("net_unit"))
    sizes = products.select(F.col("id").alias("product_id"), "net_weight_value", "net_unit")
    return made.where("n_offers > 0").join(sizes, "product_id", "left").select("id", *PRICE_KEYS, "price", "promo", value.alias("unit_price"), unit.alias("unit"), "in_stock", "source_url", "scraped_at", "n_offers")


def new_images(stored: DataFrame, offers: DataFrame) -> DataFrame:
    """product_id, url, image_type of images of offers (with product_id) that a product lacks, each once, by its first offer."""
    each = offers.where("product_id IS NOT NULL").select("product_id", "seq", "image_types", F.posexplode("image_urls").alias("at", "url")).where("url <> ''")
    kind = F.get("image_types", F.col("at"))
    found = each.groupBy("product_id", "url").agg(F.min_by(F.struct(kind.alias("image_type")), F.struct("seq", "at")).alias("r")).select("product_id", "url", "r.image_type")
    return found.join(stored.select("product_id", "url"), ["product_id", "url"], "left_anti")


def ingest(products: DataFrame, prices: DataFrame, images: DataFrame, offers: DataFrame) -> dict[str, DataFrame]:
    """resolved (see resolve; offers without a positive price have how = price and no product), product (all, old and new), prices (changed and new rows), images (new rows)."""
    found, created = resolve(products, offers)
    found = settled(found, "resolved")
    skipped = offers.where(f"NOT coalesce({POSITIVE}, false)").select("seq", F.lit(None).cast("long").alias("product_id"), F.lit("price").alias("how"))
    all_products = settled(products.unionByName(created, allowMissingColumns=True), "products")
    there = settled(offers.drop("product_id").join(found.where("product_id IS NOT NULL").select("seq", "product_id"), "seq"), "offers")
    return {"resolved": found.unionByName(skipped), "product": enriched(all_products, there), "prices": moved_prices(prices, there, all_products), "images": new_images(images, there)}
