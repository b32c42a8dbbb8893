"""A corpus pipeline over the documents table: language ID, near-dedup, decontamination, PII surrogates, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet to the shared folder and reads back for the next one. All but the
last return the columns of docs. SQL cannot express the stages of language ID, PII and BPE, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislegrid.llm import bpe, decontaminate, language_id, near_dedup, pii
from aislegrid.llm.common import fold, new_path, settled, table
from aislegrid.llm.queries import PII_KEY, tokenizer_path

BROADCAST_ROWS = 100_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose id is not in gone (doc_id); a null id stays."""
    gone = settled(gone.select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text no learned language explains (null, letterless, or of too high a cross-entropy); lang becomes the predicted language."""
    identifier = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    found = language_id.identification(F.col("text").cast("string"), identifier)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), found.alias("found")).where("NOT found.rejected")
    return rows.select(*[F.col("found.lang_pred").alias(c) if c == "lang" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates. Of rows that repeat an id and its text one stays, the first by all its columns as JSON; rows without an id all stay."""
    ids = settled(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    row = F.struct(*docs.columns)
    firsts = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    docs = docs.join(ids, "doc_id", "left_anti").unionByName(firsts)
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts with surrogates; n_chars follows the new text."""
    new = pii.with_surrogates(docs, PII_KEY).select(docs.columns)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of the text decoded from them."""
    keep = tuple(c for c in ("lang", "source") if c in docs.columns)
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), results=("ids", "decoded_sha256"), keep=keep)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", replace_pii),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
