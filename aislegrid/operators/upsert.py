"""Upsert of products by code: synthetic twins are absorbed, fields that are given replace stored ones, lists of children are replaced, each upsert is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.sources.shared import settled

from .ordered import numbered

FIELDS = ["name_en", "name_ar", "brand", "category", "net_weight_value", "net_unit"]


def _block(brand: Column, value: Column, unit: Column) -> Column:
    """Lower-case brand and size; null without a brand or a positive size."""
    amount, kind = N.measure(F.concat(value.cast("string"), F.coalesce(unit, F.lit("g"))))
    return F.when((F.length(brand) > 0) & (amount > 0), F.struct(F.lower(brand).alias("brand"), amount.alias("amount"), kind.alias("kind")))


def targets(products: DataFrame, incoming: DataFrame) -> DataFrame:
    """gtin, first (seq of its first row), product_id, twin_gtin, created of each real code of incoming.

    A stored code is its product (the first by id). Of new codes, in the order of their first rows, each takes the next synthetic product, by id, of the brand and size in its first row; others create one,
    with ids after the largest stored. The k-th code of a block meets the k-th twin, so both sides are numbered and joined, also in blocks with very many rows.
    """
    code = incoming.where(N.is_real_gtin(F.col("gtin")))
    firsts = code.groupBy("gtin").agg(F.min("seq").alias("first"), F.min_by(_block(F.col("brand"), F.col("net_weight_value"), F.col("net_unit")), "seq").alias("block"))
    stored = products.where(N.is_real_gtin(F.col("gtin"))).groupBy("gtin").agg(F.min("id").alias("product_id"))
    firsts = settled(firsts.join(stored, "gtin", "left"), "codes")
    new = firsts.where("product_id IS NULL").drop("product_id")
    synthetic = products.where(~N.is_real_gtin(F.col("gtin"))).select("id", F.col("gtin").alias("twin_gtin"), _block(F.col("brand"), F.col("net_weight_value"), F.col("net_unit")).alias("block"))
    asked = numbered(new.where("block IS NOT NULL"), ["block"], ["first"], "place")
    twins = numbered(synthetic.where("block IS NOT NULL").join(asked.select("block").distinct(), "block", "left_semi"), ["block"], ["id"], "place")
    absorbed = settled(asked.join(twins, ["block", "place"]).select("gtin", F.col("id").alias("product_id"), "twin_gtin"), "twins")
    most = products.agg(F.max("id")).first()[0] or 0
    made = numbered(new.join(absorbed, "gtin", "left_anti"), [], ["first"], "place")
    old = firsts.where("product_id IS NOT NULL").select("gtin", "first", "product_id", F.lit(None).cast("string").alias("twin_gtin"), F.lit(False).alias("created"))
    taken = new.join(absorbed, "gtin").select("gtin", "first", "product_id", "twin_gtin", F.lit(False).alias("created"))
    return settled(old.unionByName(taken).unionByName(made.select("gtin", "first", (F.col("place") + F.lit(most)).alias("product_id"), F.lit(None).cast("string").alias("twin_gtin"), F.lit(True).alias("created"))), "targets")


def upsert_by_code(products: DataFrame, incoming: DataFrame, actor: str, **children: DataFrame) -> dict[str, DataFrame]:
    """product, merge_log, rejected and the children given (allergens: product_id, allergen_key; ingredients: product_id, place, name_en), after incoming is carried out in the order of seq (unique).

    incoming has seq, gtin, FIELDS and lists of texts named as the children; a null is not given and changes nothing, an empty list removes what is stored. The last given value of a code counts. Rows without a real code are
    rejected. Each other row is logged: as scan_twin_merge with the twin's old code if it absorbed one, else as admin_upsert. Products get name_normalized and gtin_prefix of what they are then.
    """
    found = targets(products, incoming)
    rows = incoming.where(N.is_real_gtin(F.col("gtin")))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    given = settled(rows.groupBy("gtin").agg(*[last(c).alias(f"new_{c}") for c in [*FIELDS, *children]]).join(found, "gtin").withColumnRenamed("gtin", "new_gtin"), "given")
    kept = products.join(given, F.col("id") == F.col("product_id"), "full")
    values = {"id": F.coalesce("id", "product_id"), "gtin": F.coalesce("new_gtin", "gtin")} | {c: F.coalesce(f"new_{c}", c) for c in FIELDS}
    product = kept.select(*[values.get(c, F.col(c)).alias(c) for c in products.columns if c not in ("name_normalized", "gtin_prefix")])
    product = product.withColumns({"name_normalized": T.product_name(F.coalesce("name_en", "name_ar", F.lit(""))), "gtin_prefix": N.gtin_prefix(F.col("gtin"))})
    twin = (F.col("seq") == F.col("first")) & F.col("twin_gtin").isNotNull()
    log = rows.select("seq", "gtin").join(found, "gtin").select(
        "seq",
        F.col("product_id").alias("winner_id"),
        F.col("gtin").alias("winner_gtin"),
        F.when(twin, F.col("product_id")).alias("loser_id"),
        F.when(twin, F.col("twin_gtin")).alias("loser_gtin"),
        F.when(twin, "scan_twin_merge").otherwise("admin_upsert").alias("reason"),
        F.when(F.lit(actor) == "off_backfill_job", actor).otherwise("admin").alias("triggered_by"),
        F.lit(actor).alias("actor_uid"),
    )
    out = {"product": product, "merge_log": log, "rejected": incoming.where(~F.coalesce(N.is_real_gtin(F.col("gtin")), F.lit(False))).select("seq", "gtin")}
    for name, stored in children.items():
        lists = given.where(F.col(f"new_{name}").isNotNull())
        rest = stored.join(lists.select("product_id"), "product_id", "left_anti")
        if name == "ingredients":
            new = lists.select("product_id", F.posexplode(f"new_{name}").alias("place", "name_en"))
        else:
            new = lists.select("product_id", F.explode(F.array_distinct(f"new_{name}")).alias("allergen_key"))
        out[name] = rest.select(new.columns).unionByName(new)
    return out
