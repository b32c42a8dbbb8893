"""Price analytics: latest prices, history, spreads, baskets, nearest stores, change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislegrid.sources.adapters import view
from aislegrid.sources.shared import scratch
from aislegrid.sources.sync import current, sync

from .registry import portable, query, with_views

AS_OF = "TIMESTAMP '2001-06-01 00:00:00'"
#: Great-circle kilometres from a fixed shopper's place.
KM = """6371 * 2 * atan2(sqrt(pow(sin(radians(s.lat - 24.5) / 2), 2) + cos(radians(cast(24.5 AS double))) * cos(radians(s.lat)) * pow(sin(radians(s.lng - 46.3) / 2), 2)),
  sqrt(1 - (pow(sin(radians(s.lat - 24.5) / 2), 2) + cos(radians(cast(24.5 AS double))) * cos(radians(s.lat)) * pow(sin(radians(s.lng - 46.3) / 2), 2))))"""

LATEST_STORE = """latest AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY product_id, store_id ORDER BY scraped_at DESC, id DESC) AS rn FROM product_price p WHERE store_id IS NOT NULL) x WHERE rn = 1)"""

portable("win_latest_merchant_store", """
WITH aggregated AS (SELECT DISTINCT pp.product_id FROM product_price pp JOIN store s ON pp.store_id = s.id WHERE s.platform = 'aggregator'),
kept AS (
  SELECT p.*, coalesce(s.platform, 'direct') AS platform FROM product_price p LEFT JOIN store s ON p.store_id = s.id LEFT JOIN aggregated a ON a.product_id = p.product_id
  WHERE p.store_id IS NOT NULL OR a.product_id IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id, coalesce(store_id, -1) ORDER BY scraped_at DESC, id DESC) AS rn FROM kept)
SELECT product_id, merchant_id, store_id, platform, price_sar_incl_vat, in_stock, cast(scraped_at AS date) AS scraped_on FROM ranked WHERE rn = 1""")

portable("win_distinct_on", """
SELECT product_id, merchant_id, store_id, id, price_sar_incl_vat FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id, store_id ORDER BY scraped_at DESC, id DESC) AS rn FROM product_price) x WHERE rn = 1""")

portable("win_latest_store", f"""
WITH {LATEST_STORE}
SELECT product_id, store_id, price_sar_incl_vat, cast(row_number() OVER (PARTITION BY product_id ORDER BY price_sar_incl_vat, store_id) AS int) AS position FROM latest""")

portable("win_price_change_dedup", """
WITH seen AS (SELECT p.*, lag(price_sar_incl_vat) OVER (PARTITION BY product_id, merchant_id ORDER BY scraped_at, id) AS before FROM product_price p),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> price_sar_incl_vat THEN 1 ELSE 0 END) OVER (PARTITION BY product_id, merchant_id ORDER BY scraped_at, id ROWS UNBOUNDED PRECEDING) AS run FROM seen)
SELECT product_id, merchant_id, cast(run AS bigint) AS change_no, min(price_sar_incl_vat) AS price, cast(min(scraped_at) AS date) AS first_seen, cast(max(scraped_at) AS date) AS last_seen, count(*) AS n_scrapes
FROM runs GROUP BY product_id, merchant_id, run""")

portable("win_nearest_or_cheapest", f"""
WITH {LATEST_STORE},
near AS (SELECT l.product_id, s.merchant_id, l.store_id, l.price_sar_incl_vat, round({KM}, 6) AS km FROM latest l JOIN store s ON l.store_id = s.id)
SELECT product_id, merchant_id, store_id, price_sar_incl_vat, round(km, 3) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY km, price_sar_incl_vat, store_id) AS rn FROM near) x WHERE rn = 1""")

BASKET_SQL = f"""
WITH {LATEST_STORE},
basket AS (SELECT id AS product_id, cast(1 + id % 3 AS double) AS quantity FROM product WHERE id % 100 < 5),
offers AS (SELECT l.store_id, count(*) AS covered, round(sum(l.price_sar_incl_vat * b.quantity), 4) AS total FROM latest l JOIN basket b ON l.product_id = b.product_id GROUP BY l.store_id),
full_offers AS (SELECT o.*, round({KM}, 6) AS km FROM offers o JOIN store s ON o.store_id = s.id),
best AS (SELECT * FROM full_offers WHERE covered = (SELECT max(covered) FROM full_offers)),
cheap AS (SELECT store_id FROM best ORDER BY total, store_id LIMIT 1), near AS (SELECT store_id FROM best ORDER BY km, total, store_id LIMIT 1),
chosen AS (SELECT store_id, max(cheapest) AS cheapest, max(nearest) AS nearest FROM (SELECT store_id, 1 AS cheapest, 0 AS nearest FROM cheap UNION ALL SELECT store_id, 0, 1 FROM near) x GROUP BY store_id)
SELECT b.store_id, b.covered, round(b.total, 2) AS total, round(b.km, 3) AS km, c.cheapest = 1 AS cheapest, c.nearest = 1 AS nearest FROM best b JOIN chosen c ON c.store_id = b.store_id"""
_OFFERS_SQL = f"""
WITH {LATEST_STORE},
basket AS (SELECT id AS product_id, cast(1 + id % 3 AS double) AS quantity FROM product WHERE id % 100 < 5),
offers AS (SELECT l.store_id, count(*) AS covered, round(sum(l.price_sar_incl_vat * b.quantity), 4) AS total FROM latest l JOIN basket b ON l.product_id = b.product_id GROUP BY l.store_id)
SELECT o.*, round({KM}, 6) AS km FROM offers o JOIN store s ON o.store_id = s.id"""


@query(BASKET_SQL)
def win_basket_best(spark, d):
    """Of the stores that have the most of a basket the cheapest and the nearest, in one aggregate over the stores' offers."""
    offers = spark.sql(with_views(_OFFERS_SQL, d))
    row = F.struct("store_id", "covered", "total", "km")
    best = lambda *order: F.max_by(row, F.struct("covered", *[(-F.col(c)).alias(c) for c in order]))
    both = offers.agg(best("total", "store_id").alias("cheap"), best("km", "total", "store_id").alias("near"))
    cases = F.array(F.struct(F.col("cheap").alias("o"), F.lit(True).alias("cheapest"), F.lit(False).alias("nearest")), F.struct(F.col("near").alias("o"), F.lit(False).alias("cheapest"), F.lit(True).alias("nearest")))
    rows = both.select(F.explode(cases).alias("x")).where("x.o IS NOT NULL").groupBy("x.o").agg(F.max("x.cheapest").alias("cheapest"), F.max("x.nearest").alias("nearest"))
    return rows.select("o.store_id", "o.covered", F.round("o.total", 2).alias("total"), F.round("o.km", 3).alias("km"), "cheapest", "nearest")


portable("win_price_tier", f"""
WITH {LATEST_STORE},
freq AS (SELECT product_id, price_sar_incl_vat AS price, count(*) AS n, min(id) AS first_id FROM latest GROUP BY product_id, price_sar_incl_vat),
shape AS (SELECT *, max(n) OVER (PARTITION BY product_id) AS most, min(n) OVER (PARTITION BY product_id) AS fewest, count(*) OVER (PARTITION BY product_id) AS kinds,
  min(price) OVER (PARTITION BY product_id) AS low, max(price) OVER (PARTITION BY product_id) AS high,
  first_value(price) OVER (PARTITION BY product_id ORDER BY n DESC, first_id) AS mode FROM freq)
SELECT product_id, price, n, CASE WHEN kinds = 1 THEN 'common' WHEN most = fewest THEN CASE WHEN price = low THEN 'low' WHEN price = high THEN 'high' ELSE 'common' END
  WHEN price < mode THEN 'low' WHEN price > mode THEN 'high' ELSE 'common' END AS tier FROM shape""")

portable("win_history_dedup_cap", """
WITH last_seen AS (SELECT user_id, event_type, max(ts) AS ts, max(event_id) AS event_id FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS rn FROM last_seen) x WHERE rn <= 100""")

portable("win_rolling_24h_quota", """
WITH timed AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS used, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events)
SELECT event_id, user_id, used, used <= CASE WHEN ts < first_ts + INTERVAL '24' HOUR THEN 15 ELSE 5 END AS allowed FROM timed""")

portable("win_merchant_dedup", """
WITH cleaned AS (SELECT id, name_en, lower(trim(replace(name_en, ' ', ''))) AS clean, first_value(id) OVER (PARTITION BY substr(lower(name_en), 1, 3) ORDER BY id) AS keeper FROM merchant)
SELECT c.keeper AS merchant_id, count(*) AS n_prices, count(DISTINCT c.id) AS n_merged FROM product_price p JOIN cleaned c ON p.merchant_id = c.id GROUP BY c.keeper""")

portable("win_top1_best", """
SELECT product_id, merchant_id, price_sar_incl_vat FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price_sar_incl_vat DESC, id) AS rn FROM product_price) x WHERE rn = 1""")

portable("win_runner_up", """
WITH ranked AS (SELECT product_id, price_sar_incl_vat AS price, row_number() OVER (PARTITION BY product_id ORDER BY price_sar_incl_vat DESC, id) AS rn FROM product_price)
SELECT product_id, max(CASE WHEN rn = 1 THEN price END) AS best, max(CASE WHEN rn = 2 THEN price END) AS second,
  coalesce(max(CASE WHEN rn = 1 THEN price END) - max(CASE WHEN rn = 2 THEN price END) >= 0.05, true) AS clear FROM ranked WHERE rn <= 2 GROUP BY product_id""")

portable("win_near_misses_top3", """
SELECT product_id, cast(rn AS int) AS place, id, price_sar_incl_vat FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price_sar_incl_vat DESC, id) AS rn FROM product_price WHERE in_stock) x WHERE rn <= 3""")

portable("filter_history_window", f"""
SELECT product_id, id, price_sar_incl_vat, cast(scraped_at AS date) AS day FROM product_price WHERE scraped_at BETWEEN {AS_OF} - INTERVAL '30' DAY AND {AS_OF}""")
portable("dt_days_back", f"SELECT DISTINCT cast(scraped_at AS date) AS day, scraped_at >= {AS_OF} - INTERVAL '90' DAY AS recent FROM product_price")
portable("dt_next_run", f"SELECT event_id, ts + INTERVAL '6' HOUR <= TIMESTAMP '2024-01-15 00:00:00' AS due FROM events")
portable("dt_daily_key", """SELECT event_id, concat('job-', event_type, '-', cast(cast(ts AS date) AS string)) AS job_id, cast((row_number() OVER (PARTITION BY event_type, cast(ts AS date) ORDER BY event_id) - 1) * 30 AS bigint) AS delay_s FROM events""")
portable("dt_ttl_expired", "SELECT event_id, coalesce(TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '24' HOUR > ts, true) AS expired FROM events")
portable("dt_subscription_state", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'revoked' WHEN ts + INTERVAL '7' DAY > TIMESTAMP '2024-01-20 00:00:00' THEN 'active' ELSE 'expired' END AS state FROM events")
portable("filter_price_positive", "SELECT id, product_id, price_sar_incl_vat FROM product_price WHERE price_sar_incl_vat > 0")
portable("join_zero_price", "SELECT p.id, p.name_en, pp.id AS price_id FROM product p JOIN product_price pp ON pp.product_id = p.id WHERE pp.price_sar_incl_vat <= 0")
portable("join_inner", """SELECT pp.id, pp.product_id, s.city_slug, m.name_en AS merchant, pp.price_sar_incl_vat FROM product_price pp JOIN store s ON pp.store_id = s.id JOIN merchant m ON s.merchant_id = m.id WHERE s.is_active AND pp.in_stock""")
portable("join_left_relations", """SELECT p.id, p.name_en, pp.id AS price_id, m.name_en AS merchant, s.platform FROM product p LEFT JOIN product_price pp ON pp.product_id = p.id AND pp.in_stock LEFT JOIN merchant m ON pp.merchant_id = m.id LEFT JOIN store s ON pp.store_id = s.id""")
portable("join_left_agg", "SELECT s.id AS store_id, count(pp.id) AS n_prices, min(pp.price_sar_incl_vat) AS lowest FROM store s LEFT JOIN product_price pp ON pp.store_id = s.id GROUP BY s.id")
portable("agg_min_positive", "SELECT product_id, min(price_sar_incl_vat) AS lowest FROM product_price WHERE price_sar_incl_vat > 0 GROUP BY product_id")
portable("agg_mode_price", """
WITH freq AS (SELECT product_id, cast(floor(price_sar_incl_vat) AS bigint) AS price, count(*) AS n FROM product_price GROUP BY product_id, cast(floor(price_sar_incl_vat) AS bigint))
SELECT product_id, price, n FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, price) AS rn FROM freq) x WHERE rn = 1""")
portable("agg_minmax_spread", """
WITH basket AS (SELECT id AS product_id, cast(1 + id % 3 AS double) AS quantity FROM product WHERE id % 10 = 0),
spread AS (SELECT p.product_id, min(p.price_sar_incl_vat) * min(b.quantity) AS low, max(p.price_sar_incl_vat) * min(b.quantity) AS high FROM product_price p JOIN basket b ON p.product_id = b.product_id GROUP BY p.product_id)
SELECT product_id, low, high, round(high - low, 4) AS savings FROM spread""")
portable("sort_platform_first", """SELECT product_id, id, cast(row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN s_platform = 'aggregator' THEN 0 ELSE 1 END, price_sar_incl_vat, id) AS int) AS position
FROM (SELECT pp.*, s.platform AS s_platform FROM product_price pp LEFT JOIN store s ON pp.store_id = s.id) x""")
portable("sort_distance_nulls_last", f"""SELECT product_id, id, cast(row_number() OVER (PARTITION BY product_id ORDER BY km ASC NULLS LAST, price_sar_incl_vat, id) AS int) AS position
FROM (SELECT pp.*, round({KM}, 6) AS km FROM product_price pp LEFT JOIN store s ON pp.store_id = s.id) x""")
portable("geo_haversine", f"SELECT s.id, round({KM}, 6) AS km FROM store s")
portable("geo_city", """
WITH box(city, lat0, lat1, lng0, lng1, lat_c, lng_c) AS (VALUES ('north', 24.5, 24.8, 46.0, 46.3, 24.65, 46.15), ('south', 24.0, 24.3, 46.2, 46.6, 24.15, 46.4)),
hits AS (SELECT s.id, b.city, s.lat BETWEEN b.lat0 AND b.lat1 AND s.lng BETWEEN b.lng0 AND b.lng1 AS inside, round(pow(s.lat - b.lat_c, 2) + pow(s.lng - b.lng_c, 2), 9) AS d FROM store s CROSS JOIN box b)
SELECT id, city, inside FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE d END, city) AS rn FROM hits) x WHERE rn = 1""")
portable("num_unit_price", """SELECT pp.id, CASE WHEN p.net_weight_value > 0 THEN floor(pp.price_sar_incl_vat / (p.net_weight_value / 1000) * 100 + 0.5) / 100 END AS unit_price, 'kg' AS unit_price_unit FROM product_price pp JOIN product p ON pp.product_id = p.id""")
portable("agg_error_ring", """SELECT event_id, cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS bigint) AS errors,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) >= 5 AS degraded FROM events""")
portable("agg_latency_avg5", """SELECT event_id, round(greatest(3000, least(6000, CASE WHEN count(value) OVER w < 2 THEN 6000 ELSE avg(value * 50) OVER w * 2 END)), 4) AS delay_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
portable("agg_max_watermark", "SELECT cast(max(scraped_at) AS date) AS high_water FROM product_price")


@query("""SELECT product_id, merchant_id, store_id, id, price_sar_incl_vat FROM (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id, store_id ORDER BY scraped_at DESC, id DESC) AS rn FROM product_price WHERE store_id IS NOT NULL) x WHERE rn = 1""")
def cdc_incremental_sync(spark, d):
    """A copy of the last prices of all keys, made in two runs: one over the earlier half of the rows, one over what has come since, with an overlap."""
    rows = view(spark, d, "product_price").where("store_id IS NOT NULL").select("id", "product_id", "merchant_id", "store_id", "price_sar_incl_vat", F.col("scraped_at").cast("timestamp").alias("scraped_at"))
    target, keys = scratch(spark, "sync"), ["product_id", "merchant_id", "store_id"]
    middle = rows.agg(F.percentile_approx(F.unix_timestamp("scraped_at"), 0.5)).first()[0] or 0
    sync(rows.where(F.unix_timestamp("scraped_at") <= middle), target, keys)
    sync(rows, target, keys)
    return current(spark, f"{target}/rows", rows.schema).select(*keys, "id", "price_sar_incl_vat")


portable("scan_keyset_paged", "SELECT id, product_id, cast(scraped_at AS date) AS day FROM product_price WHERE scraped_at < TIMESTAMP '1999-01-01 00:00:00' ORDER BY scraped_at DESC, id DESC LIMIT 500")
