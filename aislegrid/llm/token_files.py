"""Token-id files (operator 7): ORC with integer run-length encoding, row indexes and Bloom filters on doc_id.

Rows are range-partitioned by doc_id (rows of one id, or without one, by a hash of their text) and each file holds one range in ascending order. A reader
takes stripes in parallel; read_documents prunes files' stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, byte_alphabet
from .common import text_runs

SLICE_BYTES = 4_000_000
MOST_WORDS = 1_000_000
BROADCAST_PARTS = 200_000
SCHEMA = "doc_id long, ids array<int>, n_tokens int, part int, start_in_part long"
ORC_OPTIONS = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(16 << 20),
    "orc.compress": "ZSTD",
    "orc.dictionary.key.threshold": "0",
}


@functools.cache
def _library(path: str) -> TextEncoder:
    """The tokenizers library's model, asked once for each distinct pre-token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    letters = {b: ord(c) for b, c in enumerate(byte_alphabet())}
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def merge(words: list[bytes]) -> list[np.ndarray]:
        tokenize = tokenizer.model.tokenize
        return [np.array([t.id for t in tokenize(w.decode("latin-1").translate(letters))], np.int32) for w in words]

    return TextEncoder(specials, merge, MOST_WORDS)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes doc_id, ids, n_tokens, part, start_in_part as ORC under path, in ascending doc_id order over the files.

    A null or empty text gives the end id alone. Null ids come first; rows with equal ids are all kept, ordered by a hash of their text, then by the text.
    Other columns are not read. A lost executor's tasks are written again under the same partition number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _library(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, raw in text_runs(batch.column(1), SLICE_BYTES):
                flat, counts = encoder.encode([x.decode() for x in raw])
                ids = np.insert(flat, np.cumsum(counts), end_id).astype(np.int32)
                ends = np.cumsum(counts + 1)
                starts = start + ends - counts - 1
                start += int(ends[-1])
                column = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], column, pa.array((counts + 1).astype(np.int32)), pa.array(np.full(b - a, part, np.int32)), pa.array(starts.astype(np.int64))], ["doc_id", "ids", "n_tokens", "part", "start_in_part"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # a hot id spreads over ranges
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    ordered.mapInArrow(run, SCHEMA).write.mode("overwrite").options(**ORC_OPTIONS).orc(path)


def _with_start(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """rows with start: the ids of all files before, by a total of one row a file that needs no ids, and of all rows before in the file."""
    totals = all_rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    small = len(all_rows.inputFiles()) <= BROADCAST_PARTS
    return rows.join(F.broadcast(before) if small else before, "part").select("doc_id", "ids", (F.col("before") + F.col("start_in_part")).alias("start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids and start (ids of all documents before), from the files alone."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return _with_start(rows, rows)


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id, ids and start of the documents with these (few) ids: the scan skips stripes and row groups by their ranges and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return _with_start(rows.where(F.col("doc_id").isin(*doc_ids)), rows)


def with_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows read from token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            view, crc, a = memoryview(ids).cast("B"), [], 0
            for e in (ends * 4).tolist():
                crc.append(zlib.crc32(view[a:e]))
                a = e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(np.append(0, ends)).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "ids", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
