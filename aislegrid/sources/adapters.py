"""Views that give the star-schema tables the shape of the catalog's data model, as SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

ADAPTERS = {
    "product": """SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('SCAN-', cast(p_partkey AS string)) ELSE concat('628', lpad(cast(p_partkey AS string), 10, '0')) END AS gtin,
  concat(p_name, ' ', cast(p_size AS string), 'g') AS name_en, p_name AS plain_name, p_brand AS brand, p_type AS category,
  cast(p_size AS double) AS net_weight_value, 'g' AS net_unit,
  CASE p_partkey % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'scan' ELSE 'admin' END AS data_source,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE 'e' END AS nutri_score_grade,
  p_partkey % 7 <> 0 AS has_nutrition, p_partkey % 4 AS ingredient_count, p_retailprice AS list_price FROM part""",
    "merchant": "SELECT n_nationkey AS id, n_name AS name_en FROM nation",
    "store": """SELECT s_suppkey AS id, s_nationkey AS merchant_id, CASE WHEN s_suppkey % 3 = 0 THEN 'aggregator' ELSE 'direct' END AS platform,
  lower(r_name) AS city_slug, lower(n_name) AS district_slug, s_acctbal > 0 AS is_active,
  cast(24 AS double) + s_suppkey % 100 * cast(0.01 AS double) AS lat, cast(46 AS double) + s_suppkey % 70 * cast(0.01 AS double) AS lng
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "product_price": """SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, s_nationkey AS merchant_id,
  CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_suppkey END AS store_id, l_extendedprice / l_quantity AS price_sar_incl_vat,
  CASE WHEN l_discount > 0 THEN l_extendedprice * (1 - l_discount) / l_quantity END AS promo_price_sar,
  l_returnflag <> 'R' AS in_stock, l_shipdate AS scraped_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "nutrition_fact": """SELECT p_partkey AS product_id, cast(p_partkey * 37 % 900 AS double) AS energy_kcal, cast(p_partkey * 7 % 60 AS double) AS sugars_g,
  cast(p_partkey * 3 % 40 AS double) AS fat_g, cast(p_partkey * 3 % 12 AS double) AS saturated_fat_g, cast(p_partkey * 53 % 1200 AS double) AS sodium_mg,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE cast(p_partkey * 5 % 9 AS double) END AS fiber_g, cast(p_partkey * 13 % 30 AS double) AS protein_g,
  cast(p_partkey * 17 % 70 AS double) AS carbs_g FROM part""",
    "product_allergen": """SELECT p_partkey AS product_id, 'milk' AS allergen_key FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'nuts' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'gluten' FROM part WHERE p_partkey % 5 < 2""",
    "product_report": """SELECT event_id AS id, concat('628', lpad(cast(user_id % 3000 AS string), 10, '0')) AS gtin, props AS payload,
  CASE WHEN value > 50 THEN 'open' ELSE 'closed' END AS status, ts AS created_at FROM events""",
    "merge_log": """SELECT event_id AS id, user_id AS winner_id, event_type AS reason, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('u', cast(user_id % 9 AS string)) END AS actor_uid, ts AS created_at FROM events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view or base table as a DataFrame."""
    from aislegrid.plans.registry import with_views

    return spark.sql(with_views(f"SELECT * FROM {name}", sf_dir))
