"""Merging of products: closure of loser-to-winner links by pointer jumping, and what a merge does to the tables that hang on a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegrid.sources.shared import settled


def closure(links: DataFrame) -> DataFrame:
    """loser, winner: the last winner that each loser's chain of links (loser, winner) ends at.

    Of several winners of one loser the smallest counts; links to oneself and links with a null are dropped. In a cycle the smallest id wins. Each round doubles the length that a
    pointer spans, so a chain of n links takes log2(n) rounds, each of which is a settled table. A link that still moves once pointers span as many steps as there are links runs into a cycle.
    """
    own = links.where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner"))
    base = settled(own.withColumn("least", F.least("loser", "winner")), "links")
    n = base.count()
    while True:
        state, span = base, 1
        while True:
            after = state.select(F.col("loser").alias("winner"), F.col("winner").alias("further"), F.col("least").alias("their"))
            state = settled(state.join(after, "winner", "left").select("loser", F.coalesce("further", "winner").alias("winner"), F.least("least", "their").alias("least"), F.col("further").isNotNull().alias("moved")), "closure")
            moving, span = not state.where("moved").isEmpty(), 2 * span
            if not moving:
                return state.select("loser", "winner")
            if span >= 2 * n:
                break
            state = state.drop("moved")
        on_cycle = state.where("moved").select(F.col("winner").alias("loser")).distinct()  # after n steps a pointer is on the cycle that it runs into
        firsts = state.join(on_cycle, "loser", "left_semi").where("least = loser").select("loser")
        base = settled(base.join(firsts, "loser", "left_anti"), "links")


def moved(rows: DataFrame, mapping: DataFrame, column: str = "product_id") -> DataFrame:
    """rows with the winner in place of a loser."""
    its = mapping.select(F.col("loser").alias(column), F.col("winner").alias("its_winner"))
    return rows.join(its, column, "left").withColumn(column, F.coalesce("its_winner", column)).drop("its_winner").select(rows.columns)


def moved_once(rows: DataFrame, mapping: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """rows with the winner in place of a loser, of which one stays for each winner and keys: the winner's own, else that of the first loser, each time the first by id."""
    its = mapping.select(F.col("loser").alias("product_id"), F.col("winner").alias("its_winner"))
    there = rows.join(its, "product_id", "left").withColumn("owner", F.coalesce("its_winner", "product_id"))
    order = F.struct(F.col("its_winner").isNotNull(), F.col("product_id"), F.col(id_col))
    kept = there.groupBy("owner", *keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("product_id", *keys)]), order).alias("row"))
    return kept.select(*[F.col("owner").alias(c) if c == "product_id" else F.col(c) if c in keys else F.col("row")[c].alias(c) for c in rows.columns])


def merge(products: DataFrame, links: DataFrame, actor: str, reason: str, **children: DataFrame) -> dict[str, DataFrame]:
    """The tables after all links are carried out: product without losers, merge_log, and of the children given

    prices (re-pointed), reports (by the products' codes, if both have one), images (one for each url), allergens (one for each key), nutrition (the winner's, else the first loser's).
    Links of unknown products are left out. Ids that children name but products lack stay as they are.
    """
    known = products.select("id")
    valid = links.join(known.withColumnRenamed("id", "loser"), "loser", "left_semi").join(known.withColumnRenamed("id", "winner"), "winner", "left_semi")
    mapping = closure(valid.select("loser", "winner"))
    side = lambda s: products.select(F.col("id").alias(s), F.col("gtin").alias(f"{s}_gtin"), F.col("name_en").alias(f"{s}_name"))
    log = mapping.join(side("loser"), "loser").join(side("winner"), "winner")
    log = log.select(F.col("winner").alias("winner_id"), F.col("loser").alias("loser_id"), F.coalesce("winner_gtin", F.lit("")).alias("winner_gtin"), "loser_gtin", F.lit(reason).alias("reason"), F.lit(actor).alias("actor_uid"), "winner_name", "loser_name")
    out = {"product": products.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti"), "merge_log": log}
    if "prices" in children:
        out["prices"] = moved(children["prices"], mapping)
    if "reports" in children:
        codes = log.where("loser_gtin IS NOT NULL AND winner_gtin <> ''").groupBy(F.col("loser_gtin").alias("loser")).agg(F.min("winner_gtin").alias("winner"))
        out["reports"] = moved(children["reports"], codes, "gtin")
    for name, keys in (("images", ["url"]), ("allergens", ["allergen_key"]), ("nutrition", [])):
        if name in children:
            rows = children[name]
            out[name] = moved_once(rows, mapping, keys, "id" if "id" in rows.columns else "product_id")
    return out
