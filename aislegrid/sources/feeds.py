"""Sources and sinks: product feed lines, slices, key-set pages, incremental copies, reports, vector caches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.operators.ordered import numbered

from .shared import settled

FEED_SCHEMA = (
    "code string, product_name string, product_name_en string, product_name_ar string, brands string, quantity string, categories_tags array<string>, countries_tags array<string>, brands_tags array<string>, "
    "allergens_tags array<string>, nutriments map<string,string>, ingredients array<struct<text:string>>, ingredients_text string, image_front_url string, image_nutrition_url string, nutriscore_grade string, nova_group int, _corrupt_record string"
)
# Nutrient keys of the feed by column.
NUTRIMENTS = {
    "energy_kcal": "energy-kcal_100g",
    "fat_g": "fat_100g",
    "saturated_fat_g": "saturated-fat_100g",
    "carbs_g": "carbohydrates_100g",
    "sugars_g": "sugars_100g",
    "fiber_g": "fiber_100g",
    "protein_g": "proteins_100g",
    "sodium_mg": "sodium_100g",
}


@dataclass(frozen=True)
class SliceFilter:
    """Which products a slice has: any of the given dimensions, or all three with require_any False; no dimension accepts all."""

    countries: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    require_any: bool = True

    def condition(self) -> Column:
        no = F.lit(False)
        country = F.coalesce(F.arrays_overlap("countries_tags", F.array(*map(F.lit, self.countries))), no) if self.countries else no
        brand = F.coalesce(F.arrays_overlap("brands_tags", F.array(*map(F.lit, self.brands))), no) if self.brands else no
        prefix = F.coalesce(F.substring("code", 1, 3).isin(list(self.prefixes)), no) if self.prefixes else no
        if not (self.countries or self.brands or self.prefixes):
            return F.lit(True)
        return country | brand | prefix if self.require_any else country & brand & prefix

    def key(self) -> Column:
        """Eight hexadecimal digits of countries and prefixes. Brands are not in it, as in the data it must agree with."""
        return F.substring(F.md5(F.lit(",".join(sorted(self.countries)) + "|" + ",".join(sorted(self.prefixes)))), 1, 8)


@dataclass(frozen=True)
class PoolConfig:
    """Defaults of the canonical pool."""

    countries: tuple[str, ...] = ("en:saudi-arabia", "en:united-arab-emirates", "en:kuwait", "en:qatar", "en:bahrain", "en:oman")
    prefixes: tuple[str, ...] = ("628", "629")
    brands: tuple[str, ...] = field(default=())

    def filter(self, extra_brands: tuple[str, ...] = ()) -> SliceFilter:
        return SliceFilter(self.countries, tuple(sorted({*self.brands, *extra_brands})), self.prefixes)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON feed (plain or gzip); blank and malformed lines are skipped. A gzip file is one task: repartition and keep Parquet."""
    return spark.read.schema(FEED_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def parse_feed(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from a column of lines, with the columns to keep."""
    parsed = F.from_json(F.col(column), FEED_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(F.trim(column) != "").select(parsed.alias("r"), *keep).select("r.*", *keep).where("_corrupt_record IS NULL AND code IS NOT NULL").drop("_corrupt_record")


def number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(text, r"^\s*(-?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def to_products(feed: DataFrame, *keep: str) -> DataFrame:
    """Product rows of feed rows with codes of 8, 12, 13 or 14 digits, with the columns to keep. A list of ingredients comes before their text, also an empty one."""
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("product_name_en", "product_name", "product_name_ar")])
    grade = F.lower("nutriscore_grade")
    clean = lambda c: F.regexp_replace(c, "^en:", "")
    nutrients = [number(F.element_at("nutriments", k)).alias(c) for c, k in NUTRIMENTS.items()]
    known = sum(F.when(number(F.element_at("nutriments", k)).isNotNull(), 1).otherwise(0) for k in NUTRIMENTS.values())
    return feed.where(F.col("code").rlike("^([0-9]{8}|[0-9]{12,14})$")).select(
        F.col("code").alias("gtin"),
        name.alias("name_en"),
        F.nullif("product_name_ar", F.lit("")).alias("name_ar"),
        F.nullif(F.trim(F.get(F.split("brands", ","), F.lit(0))), F.lit("")).alias("brand"),
        F.col("quantity"),
        F.when(grade.rlike("^[a-e]$"), grade).alias("nutri_score_grade"),
        F.when(F.col("nova_group").between(1, 4), F.col("nova_group")).alias("nova_group"),
        clean(F.get("categories_tags", F.lit(0))).alias("category"),
        clean(F.get("categories_tags", F.lit(1))).alias("subcategory"),
        F.transform("allergens_tags", clean).alias("allergen_tags"),
        F.filter(F.transform(F.coalesce(F.transform("ingredients", lambda i: i["text"]), F.split("ingredients_text", "[,.]+")), lambda t: F.trim(t)), lambda t: t != "").alias("ingredients"),
        *nutrients,
        (known >= 3).alias("nutrition_data_complete"),
        (known > 0).alias("has_nutrition"),
        F.nullif("image_front_url", F.lit("")).alias("image_front_url"),
        F.nullif("image_nutrition_url", F.lit("")).alias("image_nutrition_url"),
        *keep,
    )


def children(products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nutrition (of those with any value), ingredient and allergen rows of products."""
    nutrition = products.where("has_nutrition").select("gtin", *NUTRIMENTS)
    ingredients = products.select("gtin", F.explode("ingredients").alias("name_en"))
    allergens = products.select("gtin", F.explode("allergen_tags").alias("allergen_key")).distinct()
    return nutrition, ingredients, allergens


#: Upper ends of the classes of completeness, in hundredths.
COMPLETENESS_CLASSES = (20, 40, 60, 80, 100)


def completeness() -> Column:
    """Hundredths of completeness of a product row: which of its fields are there."""
    # Weights of the fields.
    weights = [
        (F.length("name_en") > 2, 15),
        (F.length("name_ar") > 2, 15),
        (~T.is_placeholder(F.col("brand")), 10),
        (F.length("category") > 0, 5),
        (F.length("image_front_url") > 0, 10),
        (F.col("nutrition_data_complete"), 20),
        (F.size("ingredients") >= 1, 10),
        (F.size("allergen_tags") > 0, 5),
        (N.grams_anchored(F.col("quantity")) > 0, 5),
        (F.length("nutri_score_grade") > 0, 5),
    ]
    return sum(F.when(there, w).otherwise(0) for there, w in weights)


def import_feed(feed: DataFrame, at: str) -> dict[str, DataFrame]:
    """The tables that a feed loads: product, nutrition, ingredient, allergen and import_summary; at tells the order of the feed's rows and is unique.

    The first row of a code makes the product, later ones are skipped, but add ingredients (place is their order), allergens that are missing and, where no row before has any, nutrition. Ids are the places of
    the first rows among those of the products. The summary counts the valid rows by class of completeness (score up to `upto` hundredths; -1: rows without a valid code).
    """
    rows = settled(to_products(feed, at).withColumn("data_completeness_score", completeness()), "import")
    struct = F.struct(*[c for c in rows.columns if c not in ("gtin", "ingredients")])
    firsts = rows.groupBy("gtin").agg(F.min_by(struct, at).alias("r"), F.min_by(F.when(F.col("has_nutrition"), F.struct(*NUTRIMENTS)), F.when(F.col("has_nutrition"), F.col(at))).alias("nutrition"))
    firsts = settled(numbered(firsts.withColumn(at, F.col("r")[at]), [], [at], "id"), "firsts")
    grams = N.grams_anchored(F.col("r.quantity"))
    product = firsts.select("id", "gtin", *[F.col(f"r.{c}") for c in rows.columns if c not in ("gtin", "ingredients", "has_nutrition", "quantity", at, *NUTRIMENTS)], grams.alias("net_weight_value"), F.when(grams.isNotNull(), "g").alias("net_unit"))
    ids = firsts.select("gtin", F.col("id").alias("product_id"))
    ingredient = rows.select("gtin", at, F.posexplode("ingredients").alias("place", "name_en")).join(ids, "gtin").select("product_id", at, "place", "name_en")
    allergen = rows.select("gtin", F.explode("allergen_tags").alias("allergen_key")).where("allergen_key <> ''").distinct().join(ids, "gtin").select("product_id", "allergen_key")
    upto = F.coalesce(*[F.when(F.col("data_completeness_score") <= c, c) for c in COMPLETENESS_CLASSES])
    counted = rows.groupBy(upto.alias("upto")).agg(F.count("*").alias("n"))
    invalid = feed.select(F.lit(1).alias("one")).unionAll(rows.select(F.lit(-1))).agg(F.lit(-1).alias("upto"), F.coalesce(F.sum("one"), F.lit(0)).alias("n"))
    return {"product": product, "nutrition": firsts.where("nutrition IS NOT NULL").select(F.col("id").alias("product_id"), "nutrition.*"), "ingredient": ingredient, "allergen": allergen, "import_summary": counted.unionByName(invalid)}


def after(rows: DataFrame, cursor: tuple | None, time: str = "updated_at", key: str = "id", limit: int = 500) -> DataFrame:
    """The next key-set page in descending order of (time, key)."""
    if cursor is not None:
        rows = rows.where((F.col(time) < F.lit(cursor[0])) | ((F.col(time) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key the target lacks, one for each key."""
    return incoming.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """target with incoming rows in place of those of equal key."""
    return target.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True, quoteAll=True, escape='"')


def write_summary(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_slice(rows: DataFrame, path: str) -> None:
    """Replaces a slice; the commit is atomic, so an error leaves the files of before."""
    rows.write.mode("overwrite").json(path, compression="gzip")


def missing_vectors(ids: DataFrame, cache: DataFrame, pool: str, model: str, dim: int) -> DataFrame:
    """Ids without a vector of the pool, model and dimension in a cache (id, pool, model, dim, vector)."""
    valid = cache.where((F.col("pool") == pool) & (F.col("model") == model) & (F.col("dim") == dim) & (F.size("vector") == dim))
    return ids.join(valid.select("id"), "id", "left_anti")


def read_pages(spark: SparkSession, fetch, pages: int) -> DataFrame:
    """Pages of a remote listing, one task each: fetch(page) gives a list of JSON texts. The caller supplies access."""
    numbers = spark.range(1, pages + 1, numPartitions=max(1, pages)).withColumnRenamed("id", "page")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for page in batch.column(0).to_pylist():
                lines = fetch(page)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(lines), pa.int64()), pa.array(lines, pa.string())], ["page", "line"])

    return numbers.mapInArrow(run, "page long, line string")
