"""Benchmark decontamination (operator 2): size-partitioned MinHash containment search, DataFrame functions only.

Items are partitioned by their number n of five-word shingles (powers of two), and each gets a bottom-k MinHash sketch whose k depends on
n: a document that holds at least ceil(0.75 n) of the shingles misses at most n - ceil(0.75 n), so a sketch one longer than that
shares a hash with every qualifying document however long it is. Documents too short for a size partition are not asked for it. Candidate pairs
are then verified by exact containment of the shingles' strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, settled

WORDS, CONTAINED = 5, 0.75
BROADCAST_ROWS = 200_000


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def shingles(text: Column, of, kind: str) -> Column:
    """of() of every window of five words; the whole sequence as one where it is shorter; none without words."""

    def windows(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 1, F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1))), lambda i: of(F.slice(words, i, WORDS))))

    return let(normal_words(text), windows)


def _joined(window: Column) -> Column:
    return F.array_join(window, " ")


def _hashed(window: Column) -> Column:
    return F.xxhash64(window)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs doc_id, item_id, n_item, n_shared, containment with containment of at least 0.75.

    n_item is the item's number of distinct shingles, n_shared those found in the document. Null or wordless texts, null ids and empty tables pair with
    nothing; of rows with a repeated id, of documents or items, each pair's best one counts, whole texts each (by containment, then n_item); an item of fewer than five words is met by a document of just those words.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("item_row", F.monotonically_increasing_id())
    asked = asked.withColumn("strings", F.array_distinct(shingles(F.col("text"), _joined, "string"))).select("item_row", "item_id", "strings", F.size("strings").alias("n")).where("n > 0")
    asked = settled(asked.withColumn("partition", F.floor(F.log2("n")).cast("int")).withColumn("need", F.ceil(F.col("n") * CONTAINED).cast("int")))
    n_items = asked.count()

    hashed = asked.select("item_row", "n", "need", "partition", F.explode("strings").alias("s")).withColumn("h", F.xxhash64(F.split("s", " ")))
    smallest = F.row_number().over(Window.partitionBy("item_row").orderBy("h", "s"))
    sketch = hashed.withColumn("k", smallest).where(F.col("k") <= F.col("n") - F.col("need") + 1)
    sketch = settled(sketch.select("h", "item_row", F.ceil(F.pow(F.lit(2.0), "partition") * CONTAINED).cast("int").alias("least")))
    n_sketch = sketch.count()

    probes = docs.select("doc_id", shingles(F.col("text"), _hashed, "bigint").alias("hs")).select("doc_id", F.size("hs").alias("size"), F.explode_outer("hs").alias("h"))
    pairs = probes.join(small(sketch, n_sketch), "h").where(F.col("size") >= F.col("least")).select("doc_id", "item_row").distinct()
    pairs = settled(pairs)
    n_pairs = pairs.count()

    texts = docs.join(small(pairs.select("doc_id").distinct(), n_pairs), "doc_id", "left_semi")
    texts = texts.select("doc_id", F.array_distinct(shingles(F.col("text"), _joined, "string")).alias("found"))
    checked = texts.join(small(pairs, n_pairs), "doc_id").join(small(asked, n_items), "item_row")
    shared = F.size(F.array_intersect("found", "strings"))
    checked = checked.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "need", shared.cast("long").alias("n_shared")).where("n_shared >= need")
    rated = checked.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = rated.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.75)
"""
