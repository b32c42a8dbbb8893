"""Exact nearest vectors in blocks: products of dense matrices in Arrow batches, the k best of each block, one merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of up to WIDTH components: each vector is sent once for each opposite block. Few rows are cut into smaller blocks, so that there is work for all cores.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE, WIDTH = 16_000, 32_000, 128, 64


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(k: int, least: float | None, apart: bool, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray):
    """Query ids, candidate ids and scores of each query's k best; c is in id order."""
    out = []
    for a in range(0, len(q), TILE):
        scores = q[a : a + TILE] @ c.T
        some = range(len(scores))
        if least is None:
            scores = np.round(scores, 6)
        else:  # only rows with a score that may reach it
            some = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= least - 1e-5)
            scores[some] = np.round(scores[some], 6)
        if apart:
            scores[qid[a : a + TILE, None] == cid[None, :]] = -np.inf
        for i in some:
            s = scores[i]
            at = np.flatnonzero(s > -np.inf if least is None else s >= least)
            if len(at) > k:
                edge = np.partition(s[at], len(at) - k)[len(at) - k]
                above, equal = at[s[at] > edge], at[s[at] == edge]
                at = np.concatenate([above, equal[: k - len(above)]])
            out.append((np.full(len(at), qid[a + i]), cid[at], s[at]))
    return [np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3)]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, least: float | None = None, by: tuple[str, ...] = (), unit: bool = False, apart: bool = False, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, place: the k candidates of the greatest inner product (of unit vectors: cosine), rounded to six places, ties to the smaller id.

    With `by`, only candidates of the query's own values there; with `apart`, none of the query's own id; with `least`, none below it. Rows with a null id, vector, component
    or `by` value take no part, of unit vectors those of length 0 neither. Queries and candidates meet in blocks, however many share a `by` value.
    """
    keys = [f"b{i}" for i in range(len(by))] or ["b"]
    named = [F.col(c).alias(n) for c, n in zip(by, keys, strict=False)] or [F.lit(1).alias("b")]
    narrow = not unit and queries.schema[vector_col].dataType == candidates.schema[vector_col].dataType == T.ArrayType(T.FloatType())
    v = F.col(vector_col) if narrow else F.transform(F.col(vector_col), lambda x: x.cast("double"))

    def pick(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *named).dropna().where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        if not unit:
            return rows
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return rows.withColumn("length", length).where("length > 0").withColumn("v", F.transform("v", lambda x: x / F.col("length"))).drop("length")

    ask, give = pick(queries), pick(candidates)

    def blocks(df: DataFrame, size: int, few: int, name: str) -> DataFrame:
        need = F.count("*") * F.greatest(F.max(F.size("v")), F.lit(WIDTH)) / (size * WIDTH)
        return df.groupBy(*keys).agg(F.ceil(F.greatest(need, F.least(F.lit(few), F.count("*") / (few * 250)))).cast("int").alias(name))

    plan = blocks(ask, QUERY_BLOCK, 8, "nq").join(blocks(give, CANDIDATE_BLOCK, 4, "nc"), keys)
    own = lambda n: F.pmod(F.hash("id"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = ask.join(plan, keys).withColumn("qb", own(F.col("nq"))).withColumn("cb", each("nc")).select(*keys, "qb", "cb", "id", "v")
    right = give.join(plan, keys).withColumn("cb", own(F.col("nc"))).withColumn("qb", each("nq")).select(*keys, "qb", "cb", "id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        q, c = _matrix(a.column("v")), _matrix(b.column("v"))
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
        ids = lambda t: t.column("id").to_numpy().astype(np.int64)
        qid, cid, s = _best(k, least, apart, ids(a), q, ids(b), c)
        return pa.table({"query_id": pa.array(qid.astype(np.int64)), "vec_id": pa.array(cid.astype(np.int64)), "score": pa.array(s.astype(float))})

    group = [*keys, "qb", "cb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
