"""Set-similarity join of names: prefix filtering for Sørensen-Dice over bigram multisets.

The k-th occurrence of a bigram in a name is an element of its own, so multisets become sets. Elements are ordered by rarity over all names. Two sets of n and m
elements with a Dice of at least t share n t / (2 - t) elements or more, so the n - ceil(n t / (2 - t)) + 1 rarest of either must meet; only those are
indexed, posting lists over SPLIT names are split and asked in each part, and sizes outside [n t / (2 - t), n (2 - t) / t] don't pair. Survivors are scored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegrid.functions import text as T
from aislegrid.sources.shared import settled

SPLIT = 2_000


def elements(name: Column) -> Column:
    """Bigrams of the cleaned name with their occurrence, all different."""
    clean = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+", " ")

    def numbered(grams: Column) -> Column:
        return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))

    return T.let(clean, lambda c: T.let(T.bigrams(c), numbered))


def prefix_length(n: Column, least: float) -> Column:
    return n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1


def _ordered(names: DataFrame) -> DataFrame:
    """name, its elements from the rarest on, and their number, of all names with a bigram."""
    each = names.select("name", F.explode(elements(F.col("name"))).alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("often"))
    return each.join(often, "e").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("o")).select("name", F.col("o.e").alias("es"), F.size("o").alias("n"))


def candidates(left: DataFrame, right: DataFrame, keys: list[str], least: float, name: str = "name") -> DataFrame:
    """keys, name_l, name_r and their elements (es_l, es_r), n_l, n_r: the pairs of distinct names that share the keys and a prefix element and whose sizes allow the similarity."""
    a, b = (df.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("name")).distinct() for df in (left, right))
    words = settled(_ordered(a.select("name").union(b.select("name")).distinct()), "elements")
    indexed = lambda df: df.join(words, "name").select(*keys, "name", F.explode(F.slice("es", F.lit(1), prefix_length(F.col("n"), least))).alias("e"), "n")
    probe, index = indexed(a), indexed(b)
    long = index.groupBy(*keys, "e").agg(F.count("*").alias("names")).where(F.col("names") > SPLIT).select(*keys, "e", F.ceil(F.col("names") / SPLIT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    probe = probe.join(long, [*keys, "e"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    index = index.join(long, [*keys, "e"], "left").withColumn("part", F.pmod(F.hash("name"), parts)).drop("parts")
    index = index.withColumnRenamed("name", "name_r").withColumnRenamed("n", "n_r")
    ratio = least / (2 - least)
    met = probe.join(index, [*keys, "e", "part"]).where((F.col("n_r") >= F.col("n") * ratio - 1e-9) & (F.col("n") >= F.col("n_r") * ratio - 1e-9))
    met = met.select(*keys, F.col("name").alias("name_l"), "name_r").distinct()
    own = lambda side: words.select(F.col("name").alias(f"name_{side}"), F.col("es").alias(f"es_{side}"), F.col("n").alias(f"n_{side}"))
    return met.join(own("l"), "name_l").join(own("r"), "name_r")


def similar_names(left: DataFrame, right: DataFrame, keys: list[str], least: float, name: str = "name") -> DataFrame:
    """keys, name_l, name_r, score of all pairs of distinct names that share the keys and have a Dice similarity of at least `least` (above 0).

    Null names pair with nothing, empty ones neither; names of one character have no bigram and pair with their equals at 1.
    """
    shared = F.size(F.array_intersect("es_l", "es_r"))
    met = candidates(left, right, keys, least, name).withColumn("score", shared * F.lit(2.0) / (F.col("n_l") + F.col("n_r")))
    clean = F.regexp_replace(F.trim(F.lower(F.col(name))), r"\s+", " ")
    tiny = lambda df, side: df.where(F.length(clean) == 1).select(*keys, clean.alias("c"), F.col(name).alias(f"name_{side}")).distinct()
    single = tiny(left, "l").join(tiny(right, "r"), [*keys, "c"]).select(*keys, "name_l", "name_r", F.lit(1.0).alias("score"))
    return met.where(F.col("score") >= least).select(*keys, "name_l", "name_r", "score").unionByName(single)
