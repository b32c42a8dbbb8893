"""Leader clustering in the order of arrival, as a parallel fixpoint over a graph of similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegrid.functions import text as T
from aislegrid.sources.shared import settled

from .similarity import candidates

SIMILAR = 0.85
#: Names over 0.85 similar by edits have a Dice similarity of bigrams of 1 - 2 d / (m - 1) or more for m characters and d < 0.15 m edits: at least 2/3.
DICE_BOUND = 0.66


# Patterns of names that are offers, not products.
OFFERS = [r"buy \d+ get \d+", r"save \d+%", "offer", "promo", r"\bget \d+ free\b", r"\bfree gift\b", "bundle", "value pack", "special price", "discount", "^only .* for", "pack"]


def is_offer(name: Column) -> Column:
    return F.lower(name).rlike("|".join(OFFERS))


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^A-Za-z0-9_\s]", ""), r"\s+", " "))


def leaders(names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, leader of names (keys, name, first): in the order of first, a name joins the earliest leader of its block that is over 0.85 similar, else becomes one.

    A name is no leader once an earlier similar one is; it is one once all earlier similar ones are not. Each round decides all names that this settles, so the result is that of
    going through a block one by one, whatever its size; rounds are bounded by the longest chain of ever later similar names.
    """
    near = candidates(names, names, keys, DICE_BOUND).where((F.col("name_l") != F.col("name_r")) & (T.levenshtein_similarity(F.col("name_l"), F.col("name_r")) > SIMILAR))
    of = lambda side: names.select(*keys, F.col("name").alias(f"name_{side}"), F.col("first").alias(f"first_{side}"))
    edges = settled(near.join(of("l"), [*keys, "name_l"]).join(of("r"), [*keys, "name_r"]).where("first_r < first_l").select(*keys, F.col("name_l").alias("name"), F.col("name_r").alias("earlier"), "first_r"), "edges")
    return settle_leaders(names, edges, keys)


def settle_leaders(names: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, leader of names (keys, name) and edges (keys, name, earlier, first_r): from a name to each earlier similar one and that one's place."""
    free = names.join(edges.select(*keys, "name").distinct(), [*keys, "name"], "left_anti").select(*keys, "name", F.lit(True).alias("leads"))
    decided = settled(free, "decided")
    while True:
        known = decided.select(*keys, F.col("name").alias("earlier"), "leads")
        open_ = edges.join(decided.select(*keys, "name"), [*keys, "name"], "left_anti").join(known, [*keys, "earlier"], "left")
        state = open_.groupBy(*keys, "name").agg(F.max("leads").alias("some"), F.count(F.when(F.col("leads").isNull(), 1)).alias("unknown"))
        new = settled(state.where("some OR unknown = 0").select(*keys, "name", (~F.coalesce("some", F.lit(False))).alias("leads")), "decided")
        if new.isEmpty():
            break
        decided = settled(decided.unionByName(new), "decided")
    joined = edges.join(decided.where("leads").select(*keys, F.col("name").alias("earlier")), [*keys, "earlier"], "left_semi").groupBy(*keys, "name").agg(F.min_by("earlier", "first_r").alias("leader"))
    return decided.where("leads").select(*keys, "name", F.col("name").alias("leader")).unionByName(joined.join(decided.where("NOT leads").select(*keys, "name"), [*keys, "name"], "left_semi"))


def cluster(rows: DataFrame) -> DataFrame:
    """id, cluster_id, how of rows (id, gtin, brand, name, weight in grams or null), taken in the order of id as they would come in one by one:

    a row with the code of an earlier one follows it (gtin); a name that looks like an offer gets no cluster (rejected); a row of a placeholder brand without a code or a weight
    stands alone (weak); others join the first founder of their brand and weight whose cleaned name is over 0.85 similar by edits (name) or found a cluster (new).
    Equal names of a block go together, so only distinct names are compared. Names without a Latin letter or digit are compared with nothing and found clusters.
    """
    brand = F.trim(F.coalesce("brand", F.lit("")))
    base = rows.select("id", "gtin", brand.alias("brand"), F.coalesce(F.col("weight").cast("string"), F.lit("")).alias("weight"), F.coalesce("name", F.lit("")).alias("raw"), clean_name(F.coalesce("name", F.lit(""))).alias("name"))
    first = base.where("gtin IS NOT NULL").groupBy("gtin").agg(F.min("id").alias("holder"))
    base = base.join(first, "gtin", "left").withColumn("holder", F.coalesce("holder", "id"))
    own = base.where("holder = id")
    offer = is_offer(F.col("raw"))
    placeholder = T.is_placeholder(F.col("brand"))
    weak = (placeholder & F.col("weight").isin("", "0.0")) | (F.col("gtin").isNull() & placeholder)
    kind = F.when(offer, "rejected").when(weak, "weak").when(F.col("name") == "", "new").otherwise("compared")
    own = settled(own.withColumn("kind", kind), "rows")
    keys = ["brand", "weight"]
    names = settled(own.where("kind = 'compared'").groupBy(*keys, "name").agg(F.min("id").alias("first")), "names")
    led = leaders(names, keys).join(names.select(*keys, F.col("name").alias("leader"), F.col("first").alias("cluster_id")), [*keys, "leader"])
    found = own.where("kind = 'compared'").join(led, [*keys, "name"]).select("id", "cluster_id", F.when(F.col("id") == F.col("cluster_id"), "new").otherwise("name").alias("how"))
    alone = own.where("kind <> 'compared'").select("id", F.when(F.col("kind") != "rejected", F.col("id")).alias("cluster_id"), F.col("kind").alias("how"))
    found = settled(found.unionByName(alone), "found")
    follow = base.where("holder <> id").select("id", "holder").join(found.select(F.col("id").alias("holder"), "cluster_id"), "holder").select("id", "cluster_id", F.lit("gtin").alias("how"))
    return found.unionByName(follow)
