"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. One of our own only where it is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/aislegrid"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once as a table in the shared folder: later steps read its files, not the lineage, so lost executors cost no recomputation.

    The tables stay until the folder is cleared, as a result that reads them may be used at any time.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def let(value, use):
    """use(value) with the value computed once and bound to a lambda variable, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(doc_id, modulus: int):
    """crc32 of the decimal text of an id, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most `most` units (or a single longer row)."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def text_runs(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows a to b of a text column and their bytes (null: empty), in runs of at most `most` bytes: one run's objects exist at a time."""
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield a, b, [x or b"" for x in byte_texts(column[a:b])]


class HashIndex:
    """Sorted array of 64-bit hashes with a directory over its leading bits; find() gives positions, -1 for absent keys."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        top = (self.keys[:-1] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(top, np.arange(1 << self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        got = self.keys[at]
        left = np.flatnonzero(got < h)
        while len(left):
            at[left] += 1
            got_left = self.keys[at[left]]
            got[left] = got_left
            left = left[got_left < h[left]]
        at[got != h] = -1
        if len(self.keys) > 1:
            at[at == len(self.keys) - 1] = -1
        return at
