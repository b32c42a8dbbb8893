"""Exact top-k search (operator 5): exhaustive term-at-a-time accumulation.

Queries and candidates are cut into blocks; each pair of a query block and a candidate block is one group. In it
the query rows, as sparse (term, weight) lists, scatter weighted postings into dense score arrays; the best k of the block are
selected by partition, and the blocks' winners are merged by a window with a rank limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, TOGETHER = 2_000, 8_000, 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null unless all components are finite numbers."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every non-zero component."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = values != 0
    return row[keep], term[keep], values[keep]


def _accumulate(k: int, query_ids: np.ndarray, queries, cand_ids: np.ndarray, cands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(cands[1], kind="stable")
    rows, terms, weights = (x[order] for x in cands)
    cut = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms)) if len(terms) else np.zeros(1, np.int64)
    postings = {int(terms[a]): (rows[a:b], weights[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
    n = len(cand_ids)
    for first in range(0, len(query_ids), TOGETHER):
        ids = query_ids[first : first + TOGETHER]
        scores = np.zeros((len(ids), n), np.int64)
        a, b = np.searchsorted(queries[0], [first, first + len(ids)])
        q_row, q_term, q_weight = queries[0][a:b] - first, queries[1][a:b], queries[2][a:b]
        for term in np.unique(q_term).tolist():
            if (found := postings.get(term)) is None:
                continue
            at = q_term == term
            whose, weight = q_row[at], q_weight[at]
            if len(whose) == len(ids) and len(found[0]) == n:
                scores += weight[:, None] * found[1][None, :]
            else:
                scores[whose[:, None], found[0][None, :]] += weight[:, None] * found[1][None, :]
        for i, own in enumerate(ids.tolist()):
            allowed = np.flatnonzero(cand_ids != own)
            s = scores[i, allowed]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                better = np.flatnonzero(s > least)
                best = np.concatenate([better, np.flatnonzero(s == least)[: k - len(better)]])  # candidates are in id order
            else:
                best = np.arange(len(s))
            yield own, cand_ids[allowed[best]], s[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each row of queries by integer inner product.

    Ties go to the smaller vec_id; rows bearing the query's own id are no candidates. Null ids, null vectors and vectors with null or
    non-finite components take no part. Vectors may differ in length (missing terms weigh 0). A repeated query id gives one result;
    repeated candidate rows count each. Empty tables give an empty result.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    cands, asks = pick(vectors), pick(queries).dropDuplicates(["vec_id"])
    n_blocks = lambda df, most: max(1, -(-df.count() // most))
    n_q, n_c = n_blocks(asks, QUERY_BLOCK), n_blocks(cands, CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asks.select("*", block(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    right = cands.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), block(n_c).alias("cb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("vec_id"), b.sort_by("vec_id")
        out = list(_accumulate(k, a.column("vec_id").to_numpy(), _matrix(a.column("v")), b.column("vec_id").to_numpy(), _matrix(b.column("v"))))
        sizes = [len(x[1]) for x in out]
        whole = lambda i: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)])
        return pa.table({"query_id": np.repeat(np.array([x[0] for x in out], np.int64), sizes), "vec_id": whole(1).astype(np.int64), "score": whole(2).astype(np.int64)})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
