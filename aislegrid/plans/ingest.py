"""Queries over the ingest of offers and upserts by code. Price rows before SINCE are the stored ones, those from then on are offers of products, two thirds of which are stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislegrid.operators import ingest as I
from aislegrid.operators import upsert as U
from aislegrid.sources.adapters import ADAPTERS, view

from .registry import query

SINCE = "TIMESTAMP '2000-01-01 00:00:00'"
ORDER = ["scraped_at", "offer_id", "part_id", "store_id", "price", "promo", "in_stock"]
ADAPTERS["stored_product"] = """SELECT id, gtin, plain_name AS name_en, CASE WHEN id % 2 = 0 THEN concat('اسم ', plain_name) END AS name_ar, brand, net_weight_value, net_unit,
  CASE WHEN id % 4 > 1 THEN concat('about ', plain_name) END AS description_en, CASE WHEN id % 5 = 0 THEN lower(category) ELSE '' END AS subcategory, CASE WHEN id % 3 = 0 THEN 'https://img.example/front.jpg' END AS image_front_url
  FROM product WHERE id % 3 <> 1"""
ADAPTERS["stored_price"] = f"""SELECT p.id, p.product_id, p.merchant_id, p.store_id, p.price_sar_incl_vat AS price, p.promo_price_sar AS promo, p.in_stock, p.scraped_at
  FROM product_price p JOIN stored_product s ON s.id = p.product_id WHERE p.scraped_at < {SINCE}"""
ADAPTERS["stored_image"] = "SELECT id AS product_id, concat('https://img.example/', cast(id % 50 AS string), '.jpg') AS url FROM stored_product"
ADAPTERS["scraped_offer"] = f"""SELECT p.id AS offer_id, q.id AS part_id, CASE WHEN q.id % 5 < 2 THEN NULL ELSE q.gtin END AS gtin, CASE WHEN q.id % 10 = 0 THEN concat('https://shop.example/item/', lpad(cast(q.id AS string), 8, '0')) END AS url,
  CASE WHEN q.id % 11 = 0 THEN 'n/a' ELSE q.brand END AS brand, concat(q.plain_name, CASE WHEN q.id % 97 = 0 THEN ' offer' WHEN p.l_linenumber % 3 = 1 THEN 's' ELSE '' END) AS name,
  CASE WHEN q.id % 7 = 0 THEN concat('عرض ', q.plain_name) END AS name_ar, CASE WHEN q.id % 13 = 0 THEN NULL WHEN q.id % 2 = 0 THEN concat(cast(cast(q.net_weight_value AS int) AS string), 'g') ELSE concat(cast(cast(q.net_weight_value AS int) AS string), ' G pack') END AS weight,
  CASE WHEN p.l_linenumber = 5 THEN 0 ELSE p.price_sar_incl_vat END AS price, p.promo_price_sar AS promo, CASE WHEN p.l_linenumber = 3 THEN NULL ELSE p.in_stock END AS in_stock, p.merchant_id, p.store_id, p.scraped_at,
  CASE WHEN p.l_linenumber = 2 THEN concat('text of offer ', cast(p.id AS string)) END AS description, CASE WHEN q.id % 4 = 0 THEN concat('sub of ', lower(q.category)) END AS subcategory,
  concat('https://img.example/', cast(q.id % 100 AS string), '.jpg') AS url_a, CASE WHEN p.store_id IS NOT NULL THEN concat('https://img.example/', cast(p.store_id AS string), '-front.jpg') END AS url_b, p.l_linenumber
  FROM product_price p JOIN product q ON q.id = p.product_id WHERE p.scraped_at >= {SINCE}"""


def _ingested(spark, d):
    products = view(spark, d, "stored_product")
    products = products.select("*", *[F.lit(None).cast(t).alias(c) for c, t in I.ENRICHED.items() if c not in products.columns])
    prices = view(spark, d, "stored_price").withColumns({"source_url": F.lit(None).cast("string"), "merchant_id": F.col("merchant_id").cast("long")})
    offers = I.arranged(view(spark, d, "scraped_offer"), ORDER)
    two, none = F.col("url_b").isNotNull(), F.lit(None)
    offers = offers.withColumns(
        {
            "image_urls": F.when(two, F.array("url_a", "url_b")).when(F.col("l_linenumber") < 4, F.array("url_a")),
            "image_types": F.when(two, F.array(F.lit("nutrition"), F.lit("front"))),
            "allergen_tags": F.when(F.col("l_linenumber") == 2, F.array(F.concat(F.lit("milk "), F.col("offer_id").cast("string")))),
            "ingredient_tags": none.cast("array<string>"),
            "description_ar": none.cast("string"),
            "merchant_id": F.col("merchant_id").cast("long"),
        }
    )
    return I.ingest(products, prices, view(spark, d, "stored_image"), offers)


_clean = lambda c: f"trim(regexp_replace(regexp_replace(trim(lower({c})), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_LIKE = "(a.name = b.name OR 1.0 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) > 0.85)"
# An earlier name that is similar decides, as similarity of this data's names is transitive.
RESOLVED_CTES = f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in ORDER)}) AS seq FROM scraped_offer),
offers AS (SELECT *, coalesce(nullif(trim(gtin), ''), 'URL-' || right(base64(encode(url)), 16)) AS code, CASE WHEN brand = 'n/a' THEN 'Generic' ELSE brand END AS its_brand, {_clean('name')} AS its_name,
  coalesce(regexp_extract(lower(weight), '([0-9]+)\\s*g', 1) || '.0 g', '') AS size FROM numbered WHERE price > 0),
held AS (SELECT gtin, min(id) AS stored_id FROM stored_product WHERE gtin IS NOT NULL GROUP BY gtin),
sorted_out AS (SELECT o.*, h.stored_id, h.stored_id IS NULL AND name LIKE '%offer%' AS no_product FROM offers o LEFT JOIN held h ON h.gtin = o.code),
rest AS (SELECT *, CASE WHEN code IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY code) END AS holder FROM sorted_out WHERE stored_id IS NULL AND NOT no_product),
own AS (SELECT *, its_brand = 'Generic' AND (size = '' OR code IS NULL) AS weak FROM rest WHERE holder = seq),
nodes AS (SELECT its_brand AS brand, size, its_name AS name, min(seq) AS first FROM own WHERE NOT weak GROUP BY ALL),
pool AS (SELECT brand, CAST(net_weight_value AS VARCHAR) || ' g' AS size, {_clean('name_en')} AS name, min(id) AS id FROM stored_product GROUP BY ALL),
to_stored AS (SELECT a.brand, a.size, a.name, min(b.id) AS product_id FROM nodes a JOIN pool b ON a.brand = b.brand AND (a.size = '' OR a.size = b.size) AND {_LIKE} GROUP BY ALL),
open_nodes AS (SELECT n.* FROM nodes n LEFT JOIN to_stored t ON t.brand = n.brand AND t.size = n.size AND t.name = n.name WHERE t.name IS NULL),
led AS (SELECT a.brand, a.size, a.name, min(b.first) AS founder FROM open_nodes a JOIN open_nodes b ON a.brand = b.brand AND (a.size = '' OR a.size = b.size) AND b.first <= a.first AND {_LIKE} GROUP BY ALL),
known AS (SELECT o.*, t.product_id AS by_name, CASE WHEN o.weak THEN o.seq ELSE l.founder END AS founder FROM own o LEFT JOIN to_stored t ON NOT o.weak AND t.brand = o.its_brand AND t.size = o.size AND t.name = o.its_name
  LEFT JOIN led l ON NOT o.weak AND l.brand = o.its_brand AND l.size = o.size AND l.name = o.its_name),
founders AS (SELECT *, (SELECT max(id) FROM stored_product) + row_number() OVER (ORDER BY seq) AS id FROM known WHERE by_name IS NULL AND founder = seq),
placed AS (SELECT k.seq, coalesce(k.by_name, f.id) AS product_id, CASE WHEN k.weak THEN 'weak' WHEN k.founder = k.seq THEN 'new' ELSE 'name' END AS how FROM known k LEFT JOIN founders f ON f.seq = k.founder),
resolved AS (SELECT seq, stored_id AS product_id, 'gtin' AS how FROM sorted_out WHERE stored_id IS NOT NULL UNION ALL SELECT seq, NULL, 'rejected' FROM sorted_out WHERE no_product UNION ALL SELECT * FROM placed
  UNION ALL SELECT r.seq, p.product_id, 'follows' FROM rest r JOIN placed p ON p.seq = r.holder WHERE r.holder <> r.seq UNION ALL SELECT seq, NULL, 'price' FROM numbered WHERE NOT price > 0),
there AS (SELECT r.product_id, n.* FROM numbered n JOIN resolved r ON r.seq = n.seq WHERE r.product_id IS NOT NULL),
products AS (SELECT id, gtin, name_en, name_ar, brand, net_weight_value, description_en, subcategory, image_front_url FROM stored_product
  UNION ALL SELECT id, coalesce(code, 'SCAN-' || id), name, name_ar, its_brand, CAST(nullif(replace(size, ' g', ''), '') AS DOUBLE), NULL, NULL, NULL FROM founders)"""


@query(f"{RESOLVED_CTES} SELECT how, product_id, count(*) AS n FROM resolved GROUP BY ALL")
def pipe_price_ingest_resolved(spark, d):
    """How many offers each product got, and how."""
    return _ingested(spark, d)["resolved"].groupBy("how", "product_id").agg(F.count("*").alias("n"))


_first = lambda c: f"arg_min({c}, CASE WHEN {c} <> '' THEN seq END) FILTER ({c} <> '')"


@query(f"""{RESOLVED_CTES}, its AS (SELECT product_id, {_first('name_ar')} AS name_ar, {_first('description')} AS description_en, {_first('subcategory')} AS subcategory, arg_min(coalesce(url_b, url_a), seq) FILTER (url_b IS NOT NULL OR l_linenumber < 4) AS front,
  arg_min(url_a, seq) FILTER (url_b IS NOT NULL) AS nutrition, arg_max('milk ' || offer_id, seq) FILTER (l_linenumber = 2) AS allergens FROM there GROUP BY product_id)
SELECT p.id, p.gtin, p.name_en, coalesce(p.name_ar, i.name_ar) AS name_ar, p.brand, p.net_weight_value, coalesce(p.description_en, i.description_en) AS description_en, coalesce(nullif(p.subcategory, ''), i.subcategory, p.subcategory) AS subcategory,
  coalesce(p.image_front_url, i.front) AS image_front_url, i.nutrition AS image_nutrition_url, i.allergens FROM products p LEFT JOIN its i ON i.product_id = p.id""")
def pipe_price_ingest_products(spark, d):
    """All products after the ingest, with what they gained."""
    columns = ["id", "gtin", "name_en", "name_ar", "brand", "net_weight_value", "description_en", "subcategory", "image_front_url", "image_nutrition_url"]
    return _ingested(spark, d)["product"].select(*columns, F.array_join("allergen_tags", ",").alias("allergens"))


@query(f"""{RESOLVED_CTES}, rows_ AS (SELECT id, product_id, merchant_id, store_id, price, promo, in_stock, scraped_at, 0 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id, store_id ORDER BY scraped_at DESC, id DESC) AS rn FROM stored_price) WHERE rn = 1
  UNION ALL SELECT NULL, product_id, merchant_id, store_id, price, promo, in_stock, scraped_at, seq FROM there),
marked AS (SELECT *, CASE WHEN lag(price) OVER w = price THEN 0 ELSE 1 END AS starts FROM rows_ WINDOW w AS (PARTITION BY product_id, merchant_id, store_id ORDER BY seq, id)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY product_id, merchant_id, store_id ORDER BY seq, id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT max(r.id) AS id, r.product_id, CAST(r.merchant_id AS BIGINT) AS merchant_id, r.store_id, r.price, arg_max(promo, seq) FILTER (promo > 0) AS promo, CASE WHEN max(p.net_weight_value) > 0 THEN floor(r.price / (max(p.net_weight_value) / 1000) * 100 + 0.5) / 100 END AS unit_price,
  coalesce(arg_max(r.in_stock, seq) FILTER (r.in_stock IS NOT NULL), true) AS in_stock, CAST(arg_max(r.scraped_at, seq) AS DATE) AS scraped_on, count(CASE WHEN seq > 0 THEN 1 END) AS n_offers
FROM runs r LEFT JOIN products p ON p.id = r.product_id GROUP BY r.product_id, r.merchant_id, r.store_id, run, r.price HAVING max(seq) > 0""")
def pipe_price_ingest_prices(spark, d):
    """Price rows that the offers touched or made."""
    rows = _ingested(spark, d)["prices"]
    return rows.select("id", "product_id", "merchant_id", "store_id", "price", "promo", "unit_price", "in_stock", F.col("scraped_at").cast("date").alias("scraped_on"), "n_offers")


@query(f"""{RESOLVED_CTES}, each AS (SELECT product_id, seq, 0 AS place, url_a AS url, CASE WHEN url_b IS NOT NULL THEN 'nutrition' END AS image_type FROM there WHERE url_b IS NOT NULL OR l_linenumber < 4 UNION ALL SELECT product_id, seq, 1, url_b, 'front' FROM there WHERE url_b IS NOT NULL)
SELECT product_id, url, image_type FROM (SELECT *, row_number() OVER (PARTITION BY product_id, url ORDER BY seq, place) AS rn FROM each) e WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_image s WHERE s.product_id = e.product_id AND s.url = e.url)""")
def pipe_price_ingest_images(spark, d):
    """Images that products gained."""
    return _ingested(spark, d)["images"]


# Upserts: of every third product, under its own code or, if it has none, a new one; a repeated code comes from every sixth.
ADAPTERS["upsert_row"] = """SELECT id * 2 AS seq, CASE WHEN gtin LIKE '628%' THEN gtin ELSE concat('629', lpad(cast(id AS string), 10, '0')) END AS gtin, CASE WHEN id % 2 = 0 THEN concat(plain_name, ' ', cast(id AS string), 'g new') END AS name_en, CASE WHEN id % 12 = 0 THEN concat('جديد ', plain_name) END AS name_ar,
  brand, category, net_weight_value, net_unit, CASE WHEN id % 9 = 0 THEN 'soy' WHEN id % 9 = 3 THEN '' END AS allergen FROM product WHERE id % 3 = 0
  UNION ALL SELECT id * 2 + 1, CASE WHEN gtin LIKE '628%' THEN gtin WHEN id % 4 = 0 THEN 'bad' ELSE concat('629', lpad(cast(id AS string), 10, '0')) END, NULL, concat('أخير ', plain_name), NULL, 'late', NULL, NULL, CASE WHEN id % 18 = 0 THEN 'egg' END FROM product WHERE id % 6 = 0"""
UPSERT_CTES = """WITH rows_ AS (SELECT * FROM upsert_row WHERE gtin <> 'bad'), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY seq) AS rn FROM rows_) WHERE rn = 1),
new AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.gtin = f.gtin)),
asked AS (SELECT *, row_number() OVER (PARTITION BY lower(brand), net_weight_value ORDER BY seq) AS place FROM new), twins AS (SELECT *, row_number() OVER (PARTITION BY lower(brand), net_weight_value ORDER BY id) AS place FROM product WHERE gtin LIKE 'SCAN-%'),
absorbed AS (SELECT a.gtin, a.seq, t.id AS product_id, t.gtin AS twin_gtin FROM asked a JOIN twins t ON lower(a.brand) = lower(t.brand) AND a.net_weight_value = t.net_weight_value AND a.place = t.place),
made AS (SELECT gtin, seq, (SELECT max(id) FROM product) + row_number() OVER (ORDER BY seq) AS product_id, NULL AS twin_gtin FROM new WHERE gtin NOT IN (SELECT gtin FROM absorbed)),
targets AS (SELECT f.gtin, f.seq AS first, min(p.id) AS product_id, NULL AS twin_gtin FROM firsts f JOIN product p ON p.gtin = f.gtin GROUP BY f.gtin, f.seq UNION ALL SELECT gtin, seq, product_id, twin_gtin FROM absorbed UNION ALL SELECT * FROM made),
given AS (SELECT t.product_id, r.gtin, arg_max(name_en, seq) FILTER (name_en IS NOT NULL) AS name_en, arg_max(name_ar, seq) FILTER (name_ar IS NOT NULL) AS name_ar, arg_max(brand, seq) FILTER (brand IS NOT NULL) AS brand, arg_max(category, seq) FILTER (category IS NOT NULL) AS category,
  arg_max(net_weight_value, seq) FILTER (net_weight_value IS NOT NULL) AS net_weight_value, arg_max(allergen, seq) FILTER (allergen IS NOT NULL) AS allergen FROM rows_ r JOIN targets t ON t.gtin = r.gtin GROUP BY t.product_id, r.gtin)"""


def _upserted(spark, d):
    rows = view(spark, d, "upsert_row").withColumn("allergens", F.when(F.col("allergen") != "", F.array("allergen")).when(F.col("allergen") == "", F.array().cast("array<string>")))
    products = view(spark, d, "product").select("id", "gtin", "name_en", F.lit(None).cast("string").alias("name_ar"), "brand", "category", "net_weight_value", "net_unit")
    return U.upsert_by_code(products, rows, "admin-7", allergens=view(spark, d, "product_allergen"))


@query(f"""{UPSERT_CTES} SELECT coalesce(p.id, g.product_id) AS id, coalesce(g.gtin, p.gtin) AS gtin, coalesce(g.name_en, p.name_en) AS name_en, g.name_ar, coalesce(g.brand, p.brand) AS brand, coalesce(g.category, p.category) AS category, coalesce(g.net_weight_value, p.net_weight_value) AS net_weight_value,
  CASE WHEN regexp_matches(coalesce(g.gtin, p.gtin), '^[0-9]{{13}}$') THEN substr(coalesce(g.gtin, p.gtin), 1, 3) END AS gtin_prefix FROM product p FULL JOIN given g ON g.product_id = p.id""")
def pipe_admin_upsert_products(spark, d):
    """All products after the upserts, twins absorbed."""
    return _upserted(spark, d)["product"].select("id", "gtin", "name_en", "name_ar", "brand", "category", "net_weight_value", "gtin_prefix")


@query(f"""{UPSERT_CTES} SELECT r.seq, t.product_id AS winner_id, r.gtin AS winner_gtin, CASE WHEN r.seq = t.first AND twin_gtin IS NOT NULL THEN t.product_id END AS loser_id, CASE WHEN r.seq = t.first THEN twin_gtin END AS loser_gtin,
  CASE WHEN r.seq = t.first AND twin_gtin IS NOT NULL THEN 'scan_twin_merge' ELSE 'admin_upsert' END AS reason, 'admin' AS triggered_by, 'admin-7' AS actor_uid FROM rows_ r JOIN targets t ON t.gtin = r.gtin""")
def pipe_admin_upsert_log(spark, d):
    return _upserted(spark, d)["merge_log"]


@query(f"{UPSERT_CTES} SELECT product_id, allergen_key FROM product_allergen WHERE product_id NOT IN (SELECT product_id FROM given WHERE allergen IS NOT NULL) UNION ALL SELECT product_id, allergen FROM given WHERE allergen <> ''")
def pipe_admin_upsert_allergens(spark, d):
    return _upserted(spark, d)["allergens"]
