"""Queries over feeds, markup, sinks and streams. Texts that the tables lack are made from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislegrid.functions import markup as H
from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.sources import feeds as S
from aislegrid.sources.adapters import ADAPTERS, view
from aislegrid.sources.shared import scratch
from aislegrid.streaming import control
from aislegrid.streaming import price_changes as P

from .functions import DHASH_SQL, pixels
from .registry import query


def feed_lines(spark, d, rows: str = "product", *keep: str) -> DataFrame:
    """Product feed lines made of the product view, with one blank and one malformed line for every hundredth product; columns to keep are null there."""
    p = view(spark, d, rows)
    line = F.to_json(
        F.struct(
            F.coalesce("code" if "code" in p.columns else "gtin", F.lit("bad")).alias("code"),
            F.col("name_en").alias("product_name"),
            F.concat_ws(", ", "brand", F.lit("Other")).alias("brands"),
            F.concat(F.col("net_weight_value").cast("int").cast("string"), F.lit("g")).alias("quantity"),
            F.array(F.concat(F.lit("en:"), F.lower("category")), F.lit("en:second")).alias("categories_tags"),
            F.array(F.when(F.col("id") % 3 == 0, "en:saudi-arabia").otherwise("en:france")).alias("countries_tags"),
            F.array(F.lower("brand")).alias("brands_tags"),
            F.when(F.col("id") % 4 == 1, F.concat(F.lit("اسم "), "plain_name")).alias("product_name_ar"),
            F.when(F.col("id") % 9 > 0, F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "en:milk"), F.when(F.col("id") % 3 == 0, "nuts"), F.when(F.col("id") % 4 == 0, "en:milk")))).alias("allergens_tags"),
            F.create_map(
                F.lit("energy-kcal_100g"), F.when(F.col("id") % 8 > 0, F.col("id").cast("string")), F.lit("fat_100g"), F.when(F.col("id") % 8 > 0, "12x"), F.lit("sugars_100g"), F.when(F.col("id") % 7 > 0, "3.5").otherwise("n/a"),
                F.lit("proteins_100g"), F.when(F.col("id") % 16 > 8, " .5g"),
            ).alias("nutriments"),
            F.when(F.col("id") % 4 != 0, F.concat_ws(", ", F.lit("water"), F.lit(" sugar. "), "plain_name")).alias("ingredients_text"),
            F.when(F.col("id") % 4 == 3, F.array(F.struct(F.concat(F.lit(" "), "plain_name").alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.lower("category").alias("text")))).when(F.col("id") % 8 == 2, F.array().cast("array<struct<text:string>>")).alias("ingredients"),
            F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://img.example/"), F.col("id").cast("string"))).alias("image_front_url"),
            F.lower("nutri_score_grade").alias("nutriscore_grade"),
            (F.col("id") % 6).cast("int").alias("nova_group"),
        )
    )
    extra = p.where("id % 100 = 0")
    none = [F.lit(None).alias(c) for c in keep]
    return p.select(line.alias("line"), *keep).unionAll(extra.select(F.lit("").alias("line"), *none)).unionAll(extra.select(F.lit("{bad json").alias("line"), *none))


VALID = "gtin IS NOT NULL AND gtin NOT LIKE 'SCAN-%'"


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN gtin LIKE '628%' THEN 1 ELSE 0 END) AS BIGINT) AS n_628 FROM product")
def scan_jsonl_gz(spark, d):
    path = scratch(spark, "feed")
    feed_lines(spark, d).write.text(path, compression="gzip")
    return S.read_feed(spark, path).agg(F.count("*").alias("n"), F.count_if(F.col("code").startswith("628")).alias("n_628"))


@query(f"SELECT gtin, name_en, brand, lower(category) AS category, 'second' AS subcategory, CASE WHEN nutri_score_grade IS NOT NULL THEN lower(nutri_score_grade) END AS grade, CASE WHEN id % 6 BETWEEN 1 AND 4 THEN CAST(id % 6 AS INTEGER) END AS nova_group FROM product WHERE {VALID}")
def project_off_map(spark, d):
    return S.to_products(S.parse_feed(feed_lines(spark, d))).select("gtin", "name_en", "brand", "category", "subcategory", F.col("nutri_score_grade").alias("grade"), "nova_group")


@query(f"SELECT gtin, name_en, CAST(net_weight_value AS INTEGER)::VARCHAR || 'g' AS weight_raw FROM product WHERE {VALID}")
def project_canonical(spark, d):
    return S.to_products(S.parse_feed(feed_lines(spark, d))).select("gtin", "name_en", F.col("quantity").alias("weight_raw"))


# What the feed's fields above amount to, as SQL.
_known = "(CASE WHEN id % 8 > 0 THEN 2 ELSE 0 END + CASE WHEN id % 7 > 0 THEN 1 ELSE 0 END + CASE WHEN id % 16 > 8 THEN 1 ELSE 0 END)"
_parts = "CASE WHEN id % 4 = 3 THEN [plain_name, lower(category)] WHEN id % 8 = 2 OR id % 4 = 0 THEN [] ELSE ['water', 'sugar', plain_name] END"
_tags = "CASE WHEN id % 9 > 0 THEN list_filter([CASE WHEN id % 2 = 0 THEN 'milk' END, CASE WHEN id % 3 = 0 THEN 'nuts' END, CASE WHEN id % 4 = 0 THEN 'milk' END], lambda t: t IS NOT NULL) END"


@query(f"SELECT gtin, {_known} >= 3 AS has_nutrition, len({_parts}) > 0 AS has_ingredients, nutri_score_grade IS NOT NULL AS graded FROM product WHERE {VALID}")
def project_summary(spark, d):
    return S.to_products(S.parse_feed(feed_lines(spark, d))).select("gtin", F.col("nutrition_data_complete").alias("has_nutrition"), (F.coalesce(F.size("ingredients"), F.lit(0)) > 0).alias("has_ingredients"), F.col("nutri_score_grade").isNotNull().alias("graded"))


@query(f"SELECT gtin, CASE WHEN id % 8 > 0 THEN CAST(id AS DOUBLE) END AS energy_kcal, CASE WHEN id % 8 > 0 THEN 12.0::DOUBLE END AS fat_g, CASE WHEN id % 7 > 0 THEN 3.5::DOUBLE END AS sugars_g FROM product WHERE {VALID} AND {_known} > 0")
def map_nutriments(spark, d):
    return S.children(S.to_products(S.parse_feed(feed_lines(spark, d))))[0].select("gtin", "energy_kcal", "fat_g", "sugars_g")


@query(f"SELECT gtin, unnest({_parts}) AS name_en FROM product WHERE {VALID}")
def arr_ingredients(spark, d):
    return S.children(S.to_products(S.parse_feed(feed_lines(spark, d))))[1]


@query(f"SELECT gtin, unnest(list_distinct({_tags})) AS allergen_key FROM product WHERE {VALID}")
def arr_explode_children(spark, d):
    return S.children(S.to_products(S.parse_feed(feed_lines(spark, d))))[2]


@query(f"SELECT gtin, lower(category) AS category, 'second' AS subcategory FROM product WHERE {VALID}")
def arr_first_second(spark, d):
    return S.to_products(S.parse_feed(feed_lines(spark, d))).select("gtin", "category", "subcategory")


@query(f"SELECT gtin, array_to_string({_tags}, ',') AS tags FROM product WHERE {VALID}")
def arr_tags_clean(spark, d):
    return S.to_products(S.parse_feed(feed_lines(spark, d))).select("gtin", F.array_join("allergen_tags", ",").alias("tags"))


# The feed's rows in order; every tenth product comes once more under its neighbour's code, half of them before the neighbour.
ADAPTERS["feed_row"] = """SELECT *, gtin AS code, id * 2 AS line_no FROM product
  UNION ALL SELECT *, concat('628', lpad(cast(id - 1 AS string), 10, '0')), CASE WHEN id % 20 = 3 THEN id * 2 - 3 ELSE id * 2 + 1 END FROM product WHERE id % 10 = 3"""
IMPORT_CTES = f"""WITH rows_ AS (SELECT *, CAST(15 + CASE WHEN id % 4 = 1 THEN 15 ELSE 0 END + 10 + 5 + CASE WHEN id % 3 > 0 THEN 10 ELSE 0 END + CASE WHEN {_known} >= 3 THEN 20 ELSE 0 END + CASE WHEN len({_parts}) > 0 THEN 10 ELSE 0 END
  + CASE WHEN len({_tags}) > 0 THEN 5 ELSE 0 END + 5 + CASE WHEN nutri_score_grade IS NOT NULL THEN 5 ELSE 0 END AS INTEGER) AS score FROM feed_row WHERE code IS NOT NULL AND code NOT LIKE 'SCAN-%'),
firsts AS (SELECT *, row_number() OVER (ORDER BY line_no) AS product_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY line_no) AS rn FROM rows_) WHERE rn = 1)"""


def _imported(spark, d):
    return S.import_feed(S.parse_feed(feed_lines(spark, d, "feed_row", "line_no"), keep=("line_no",)), "line_no")


@query(f"""{IMPORT_CTES} SELECT CAST(least(ceil(score / 20), 5) * 20 AS INTEGER) AS upto, count(*) AS n FROM rows_ GROUP BY ALL UNION ALL SELECT -1, count(*) FROM feed_row WHERE code IS NULL OR code LIKE 'SCAN-%'""")
def pipe_off_import(spark, d):
    """Rows of the feed by class of completeness, and those without a valid code."""
    return _imported(spark, d)["import_summary"]


@query(f"""{IMPORT_CTES} SELECT product_id AS id, code AS gtin, name_en, CASE WHEN id % 4 = 1 THEN 'اسم ' || plain_name END AS name_ar, brand, lower(category) AS category, CASE WHEN nutri_score_grade IS NOT NULL THEN lower(nutri_score_grade) END AS nutri_score_grade,
  CASE WHEN id % 6 BETWEEN 1 AND 4 THEN CAST(id % 6 AS INTEGER) END AS nova_group, CASE WHEN id % 3 > 0 THEN 'https://img.example/' || id END AS image_front_url, {_known} >= 3 AS nutrition_data_complete, net_weight_value, score AS data_completeness_score FROM firsts""")
def pipe_off_import_products(spark, d):
    columns = ["id", "gtin", "name_en", "name_ar", "brand", "category", "nutri_score_grade", "nova_group", "image_front_url", "nutrition_data_complete", "net_weight_value", "data_completeness_score"]
    return _imported(spark, d)["product"].select(columns)


@query(f"""{IMPORT_CTES}, fed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY line_no) AS place FROM rows_ WHERE {_known} > 0)
SELECT f.product_id, CASE WHEN r.id % 8 > 0 THEN CAST(r.id AS DOUBLE) END AS energy_kcal, CASE WHEN r.id % 7 > 0 THEN 3.5::DOUBLE END AS sugars_g, CASE WHEN r.id % 16 > 8 THEN 0.5::DOUBLE END AS protein_g FROM fed r JOIN firsts f ON f.code = r.code WHERE r.place = 1""")
def pipe_off_import_nutrition(spark, d):
    return _imported(spark, d)["nutrition"].select("product_id", "energy_kcal", "sugars_g", "protein_g")


@query(f"{IMPORT_CTES}, parts AS (SELECT code, line_no, {_parts} AS p FROM rows_) SELECT f.product_id, r.line_no, CAST(i AS INTEGER) AS place, r.p[i + 1] AS name_en FROM parts r JOIN firsts f ON f.code = r.code, range(0, 3) t(i) WHERE i < len(r.p)")
def pipe_off_import_ingredients(spark, d):
    return _imported(spark, d)["ingredient"]


@query(f"{IMPORT_CTES} SELECT DISTINCT f.product_id, r.allergen_key FROM (SELECT code, unnest({_tags}) AS allergen_key FROM rows_) r JOIN firsts f ON f.code = r.code")
def pipe_off_import_allergens(spark, d):
    return _imported(spark, d)["allergen"]


@query("SELECT count(*) AS n FROM product WHERE id % 3 = 0 OR gtin LIKE '628%'")
def slice_materialize(spark, d):
    path = scratch(spark, "slice")
    S.write_slice(S.parse_feed(feed_lines(spark, d)).where(S.SliceFilter(countries=("en:saudi-arabia",), prefixes=("628",)).condition()), path)
    return spark.read.schema(S.FEED_SCHEMA.replace(", _corrupt_record string", "")).json(path).agg(F.count("*").alias("n"))


@query("SELECT substr(md5('en:bahrain,en:kuwait,en:oman,en:qatar,en:saudi-arabia,en:united-arab-emirates|628,629'), 1, 8) AS pool")
def slice_pool_hash(spark, d):
    return spark.range(1).select(S.PoolConfig().filter().key().alias("pool"))


@query("SELECT 6 AS n_countries, 2 AS n_prefixes, 2 AS n_brands")
def pool_config(spark, d):
    f = S.PoolConfig(brands=("nestle",)).filter(("oreo",))
    return spark.createDataFrame([(len(f.countries), len(f.prefixes), len(f.brands))], "n_countries int, n_prefixes int, n_brands int")


@query("SELECT page AS page, page * 10 + i AS item FROM range(1, 4) t(page), range(0, 3) u(i)")
def scan_rest_paged(spark, d):
    pages = S.read_pages(spark, lambda page: [f'{{"item": {page * 10 + i}}}' for i in range(3)], 3)
    return pages.select("page", F.get_json_object("line", "$.item").cast("long").alias("item"))


@query("SELECT id, gtin, name_en FROM product")
def scan_pg(spark, d):
    return view(spark, d, "product").select("id", "gtin", "name_en")


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type")
def sink_csv_reports(spark, d):
    path = scratch(spark, "report")
    S.write_report(view(spark, d, "events").select("event_id", F.concat(F.lit('say "'), "event_type", F.lit('", twice')).alias("note"), "event_type"), path)
    rows = spark.read.csv(path, header=True, escape='"', schema="event_id long, note string, event_type string").where(F.col("note").startswith('say "'))
    return rows.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(gtin) AS matched FROM product")
def sink_json_summary(spark, d):
    path = scratch(spark, "summary")
    S.write_summary(view(spark, d, "product").agg(F.count("*").alias("total"), F.count("gtin").alias("matched")), path)
    return spark.read.schema("total long, matched long").json(path)


@query("SELECT count(*) AS n FROM merchant")
def truncate_load(spark, d):
    path = scratch(spark, "load")
    view(spark, d, "store").select("id").write.parquet(path)
    view(spark, d, "merchant").select("id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0")
def vector_cache_io(spark, d):
    v = view(spark, d, "embeddings")
    path = scratch(spark, "vectors")
    v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), F.lit("p1").alias("pool"), F.lit("m1").alias("model"), F.lit(64).alias("dim"), F.col("embedding").alias("vector")).write.partitionBy("pool", "model", "dim").parquet(path)
    return S.missing_vectors(v.select(F.col("vec_id").alias("id")), spark.read.parquet(path), "p1", "m1", 64)


def product_pages(spark, d) -> DataFrame:
    """Product pages made of the product view, of four kinds."""
    p = view(spark, d, "product")
    ld = F.format_string('<html><script type="application/ld+json">{"@type":"Product","name":"%s","url":"u%d","gtin13":"%s","offers":{"price":"%.2f"}}</script></html>', "name_en", "id", F.coalesce("gtin", F.lit("x")), "list_price")
    listed = F.format_string('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"name":"%s","url":"u%d"}}]}</script>', "name_en", "id")
    meta = F.format_string('<meta property="product:price:amount" content="%.2f"><div class="product-sku">SKU: %s</div>', "list_price", F.lpad(F.col("id").cast("string"), 10, "0"))
    table = F.format_string("<table><tr><th>Product Name</th></tr><tr><td>%s</td><td> 1 kg </td><td>%d</td></tr><tr><td>short</td></tr></table>", "name_en", "id")
    return p.select("id", F.when(F.col("id") % 4 == 0, ld).when(F.col("id") % 4 == 1, listed).when(F.col("id") % 4 == 2, meta).otherwise(table).alias("html"))


@query("SELECT id, name_en AS name, 'u' || id AS url FROM product WHERE id % 4 IN (0, 1)")
def html_jsonld_extract(spark, d):
    return product_pages(spark, d).select("id", F.explode(H.ld_products(F.col("html"))).alias("p")).select("id", "p.name", "p.url")


@query("SELECT id, CASE WHEN id % 4 = 0 AND gtin LIKE '628%' THEN gtin END AS gtin FROM product")
def html_gtin_extract(spark, d):
    return product_pages(spark, d).select("id", H.page_gtin(F.col("html")).alias("gtin"))


@query("SELECT id, CASE WHEN id % 4 = 0 AND gtin LIKE '628%' THEN gtin WHEN id % 4 = 2 THEN lpad(id::VARCHAR, 10, '0') END AS gtin FROM product")
def html_gtin_zid(spark, d):
    return product_pages(spark, d).select("id", H.page_gtin_by_sku_block(F.col("html")).alias("gtin"))


@query("SELECT id, CASE WHEN id % 4 IN (0, 2) THEN round(list_price, 2) END AS price FROM product")
def html_price_extract(spark, d):
    return product_pages(spark, d).select("id", H.page_price(F.col("html")).alias("price"))


@query("SELECT id, name_en AS name, '1 kg' AS measure, CAST(id AS INTEGER) AS popularity FROM product WHERE id % 4 = 3")
def html_table_extract(spark, d):
    return product_pages(spark, d).select("id", F.explode(H.table_rows(F.col("html"))).alias("r")).select("id", "r.name", "r.measure", "r.popularity")


def product_json(spark, d) -> DataFrame:
    """Nested product documents made of the product view."""
    doc = F.format_string('x={"data":{"items":[{"id":%d,"name":"%s","price":%d,"originalPrice":%d,"allergens":"Milk; nuts","text":"with soy"},{"group":{"id":1,"name":"n"}}]}} tail', "id", "name_en", (F.col("id") % 50 + 1).cast("int"), (F.col("id") % 60).cast("int"))
    return view(spark, d, "product").select("id", doc.alias("doc"))


@query("SELECT id, 1 AS n FROM product")
def json_object_sweep(spark, d):
    return product_json(spark, d).select("id", F.size(H.objects_around(F.col("doc"), '"price"')).alias("n"))


@query("SELECT id, name_en AS name FROM product")
def json_product_walk(spark, d):
    nodes = H.product_nodes(F.regexp_extract(F.col("doc"), r"(?s)^x=(.*) tail$", 1))
    return product_json(spark, d).select("id", F.explode(nodes).alias("node")).select("id", F.get_json_object("node", "$.name").alias("name"))


@query("SELECT id, CASE WHEN id % 60 > id % 50 + 1 THEN id % 60 ELSE id % 50 + 1 END::DOUBLE AS price, CASE WHEN id % 60 > id % 50 + 1 THEN (id % 50 + 1)::DOUBLE END AS promo FROM product")
def json_product_map(spark, d):
    node = F.get_json_object(F.regexp_extract(F.col("doc"), r"(?s)^x=(.*) tail$", 1), "$.data.items[0]")
    return product_json(spark, d).select("id", H.offer(node).alias("o")).select("id", "o.price", "o.promo")


@query("SELECT id, 'milk,nuts' AS tags FROM product")
def json_tag_extract(spark, d):
    node = F.get_json_object(F.regexp_extract(F.col("doc"), r"(?s)^x=(.*) tail$", 1), "$.data.items[0]")
    return product_json(spark, d).select("id", F.array_join(H.tags(node, "$.allergens", "$.text", ["milk", "soy"]), ",").alias("tags"))


@query("SELECT id, gtin AS sku, CASE WHEN id % 8 = 0 THEN NULL ELSE list_price END AS price, id % 3 > 0 AS in_stock FROM product WHERE gtin LIKE '628%' AND id % 8 <> 0")
def catalog_api_map(spark, d):
    p = view(spark, d, "product").select("id", F.col("gtin").alias("sku"), F.when(F.col("id") % 8 == 0, F.lit(0.0)).otherwise(F.col("list_price")).alias("price"), (F.col("id") % 3 > 0).alias("in_stock"))
    return p.where(F.col("sku").rlike("^[0-9]{8,14}$") & (F.col("price") > 0))


@query("SELECT id, gtin AS barcode, upper(substr(split_part(plain_name, ' ', 1), 1, 1)) || substr(split_part(plain_name, ' ', 1), 2) AS first_word FROM product WHERE gtin LIKE '628%'")
def catalog_slug_map(spark, d):
    url = F.concat(F.lit("https://shop.example/p/"), "gtin", F.lit("-"), F.regexp_replace("plain_name", " ", "-"))
    p = view(spark, d, "product").where(F.col("gtin").rlike("^[0-9]+$")).select("id", F.substring_index(url, "/", -1).alias("slug"))
    word = F.get(F.split(F.regexp_extract("slug", "^[0-9]{8,14}-(.*)$", 1), "-"), F.lit(0))
    return p.select("id", F.regexp_extract("slug", "^([0-9]{8,14})", 1).alias("barcode"), F.concat(F.upper(F.substring(word, 1, 1)), F.expr(f"substring({'split(regexp_extract(slug, ' + chr(39) + '^[0-9]{8,14}-(.*)$' + chr(39) + ', 1), ' + chr(39) + '-' + chr(39) + ')[0]'}, 2)")).alias("first_word"))


@query("SELECT id, (id * 25)::DOUBLE / 100 AS price, coalesce(gtin, 'sf-' || id) AS gtin FROM product WHERE id % 11 <> 0")
def json_ninja_map(spark, d):
    doc = F.to_json(F.struct(F.when(F.col("id") % 11 == 0, "banner").otherwise("product").alias("type"), (F.col("id") * 25).alias("cents"), "gtin", F.concat(F.lit("sf-"), F.col("id").cast("string")).alias("storefront")))
    p = view(spark, d, "product").select("id", doc.alias("doc")).where(F.get_json_object("doc", "$.type") != "banner")
    return p.select("id", (F.get_json_object("doc", "$.cents").cast("double") / 100).alias("price"), F.coalesce(F.get_json_object("doc", "$.gtin"), F.get_json_object("doc", "$.storefront")).alias("gtin"))


@query("SELECT product_id, count(*) AS n_prices, min(price_sar_incl_vat) AS lowest FROM product_price GROUP BY product_id")
def json_project_product(spark, d):
    """A nested document for each product, read back by its paths."""
    prices = view(spark, d, "product_price").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(F.col("price_sar_incl_vat").alias("price"), "merchant_id", "store_id"))).alias("prices"))
    doc = prices.select("product_id", F.to_json(F.struct("product_id", "prices")).alias("doc"))
    return doc.select("product_id", F.json_array_length(F.get_json_object("doc", "$.prices")).cast("long").alias("n_prices"), F.get_json_object("doc", "$.prices[0].price").cast("double").alias("lowest"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')) AS title FROM pages", "html_title")
def html_title(spark, d):
    return view(spark, d, "pages").select("page_id", T.strip_html(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'FAILED' ELSE {DHASH_SQL} END AS hash FROM part WHERE p_size <= 25")
def pipe_image_hash_backfill(spark, d):
    """Rows whose stored hash is null (here those of small packs) get the difference hash of their image, or FAILED where there is none."""
    stored = F.when(F.col("p_size") > 25, F.substring(F.md5("p_name"), 1, 16))
    rows = view(spark, d, "part").withColumn("hash", stored).where("hash IS NULL").withColumn("image", F.when(F.col("p_size") % 10 != 0, pixels()))
    return rows.select(F.col("p_partkey").alias("id"), F.when(F.col("image").isNull(), "FAILED").otherwise(N.difference_hash(F.col("image"))).alias("hash"))


@query("SELECT id, gtin, json_extract_string(payload, '$.k') AS k FROM product_report")
def json_path_text(spark, d):
    return view(spark, d, "product_report").select("id", "gtin", F.get_json_object("payload", "$.k").alias("k"))


@query("SELECT gtin, count(*) AS n_reports, coalesce(max(json_extract_string(payload, '$.k')), max(json_extract_string(payload, '$.name_ar')), '') AS sample FROM product_report GROUP BY gtin")
def agg_count_group_order(spark, d):
    text = lambda path: F.max(F.get_json_object("payload", path))
    return view(spark, d, "product_report").groupBy("gtin").agg(F.count("*").alias("n_reports"), F.coalesce(text("$.k"), text("$.name_ar"), F.lit("")).alias("sample"))


# streams
def price_rows(spark, d) -> DataFrame:
    p = view(spark, d, "product_price").where("store_id IS NOT NULL")
    return p.select("id", "product_id", F.col("merchant_id").cast("long").alias("merchant_id"), "store_id", F.col("price_sar_incl_vat").alias("price"), F.col("scraped_at").cast("timestamp").alias("scraped_at"))


def drained(spark: SparkSession, rows: DataFrame, of, mode: str = "append", **options) -> DataFrame:
    """Runs a streaming query over rows (written as files first) until all input is read, and returns what it wrote."""
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).options(**options).parquet(source)
    of(stream).writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


CHANGES_SQL = """SELECT product_id, action, count(*) AS n FROM (SELECT product_id, CASE WHEN lag(price_sar_incl_vat) OVER (PARTITION BY product_id, merchant_id, store_id ORDER BY scraped_at, id) = price_sar_incl_vat THEN 'touch' ELSE 'insert' END AS action
  FROM product_price WHERE store_id IS NOT NULL) GROUP BY ALL"""


@query(CHANGES_SQL)
def stream_stateful_price(spark, d):
    """All price rows as a stream in two parts: the query stops in between and goes on from its checkpoint."""
    source, out, state, check = (scratch(spark, f"prices-{x}") for x in ("in", "out", "state", "check"))
    rows = price_rows(spark, d)
    middle = rows.agg(F.percentile_approx(F.unix_timestamp("scraped_at"), 0.5)).first()[0] or 0
    for part in (F.unix_timestamp("scraped_at") <= middle, F.unix_timestamp("scraped_at") > middle):
        rows.where(part).write.mode("append").parquet(source)
        P.write_price_changes(spark.readStream.schema(rows.schema).parquet(source), out, state, check).awaitTermination()
    return spark.read.parquet(out).groupBy("product_id", "action").agg(F.count("*").alias("n"))


@query(CHANGES_SQL)
def pipe_price_ingest(spark, d):
    return P.batch_price_changes(price_rows(spark, d)).groupBy("product_id", "action").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS stage FROM events WHERE value > 90")
def stream_sse_progress(spark, d):
    return drained(spark, view(spark, d, "events"), lambda s: s.where("value > 90").select("event_id", F.col("event_type").alias("stage")))


@query("SELECT event_type AS job, count(*) AS n FROM events GROUP BY event_type")
def stream_job_queue(spark, d):
    """Named jobs dispatched by micro-batch: each batch is appended to the table of its job."""
    out = scratch(spark, "jobs")
    source = scratch(spark, "jobs-in")
    view(spark, d, "events").select("event_id", "event_type").write.parquet(source)

    def dispatch(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("event_type").parquet(out)

    spark.readStream.schema("event_id long, event_type string").parquet(source).writeStream.foreachBatch(dispatch).option("checkpointLocation", scratch(spark, "jobs-check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def stream_microbatch(spark, d):
    rows = view(spark, d, "events").select("event_id").repartition(4)
    return drained(spark, rows, lambda s: s, maxFilesPerTrigger="1").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("SELECT count(*) AS n FROM events")
def stream_checkpoint_resume(spark, d):
    """The query runs, stops, gets more input and goes on from its checkpoint: every row arrives once."""
    source, out, check = (scratch(spark, f"resume-{x}") for x in ("in", "out", "check"))
    rows = view(spark, d, "events").select("event_id")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        rows.where(part).write.mode("append").parquet(source)
        spark.readStream.schema(rows.schema).parquet(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events")
def stream_dedupe_job(spark, d):
    """Extension: repeated jobs within the watermark are dropped."""
    rows = view(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return drained(spark, rows.unionAll(rows), P.once_each).agg(F.count("*").alias("n"))


def in_two_parts(spark, d, of) -> DataFrame:
    """What a streaming query writes over the events: it runs over the earlier half, stops, and goes on from its checkpoint over the later one."""
    source, out, check = (scratch(spark, f"events-{x}") for x in ("in", "out", "check"))
    rows = view(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    middle = rows.agg(F.percentile_approx(F.unix_timestamp("ts"), 0.5)).first()[0] or 0
    with control.rocksdb(spark):
        for part in (F.unix_timestamp("ts") <= middle, F.unix_timestamp("ts") > middle):
            rows.where(part).write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).parquet(source)
            of(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts, event_id) AS rn FROM events) x WHERE rn <= 2")
def stream_throttle(spark, d):
    """Two events a user and day, by a budget in the stream's state."""
    return in_two_parts(spark, d, control.throttled)


@query("""SELECT event_id, CAST(user_id AS BIGINT) AS user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w >= 5 AS degraded
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def stream_degrade(spark, d):
    """Whether a user's last fifty events hold five errors, by a ring in the stream's state."""
    return in_two_parts(spark, d, control.degraded)
