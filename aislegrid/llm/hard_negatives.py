"""Hard-negative mining (operator 12): anchor-clustered lists that all anchors of a cluster share.

Anchors are clustered by direction. For a cluster of angular radius t and a candidate at angle a from its centre, no member can score the candidate higher
than |anchor| |candidate| cos(max(0, a - t)). In each pair of an anchor block and a candidate block the candidates are sorted by that bound once, and
every member walks that one list until the bound of what is left is under its k-th best score, which certifies the result. A first walk finds the
positives, whose scores are the band of the second walk for the negatives. Blocks' winners are merged by windows that keep k rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .topk import quantised

ANCHOR_BLOCK, CANDIDATE_BLOCK, STEP = 2_000, 8_000, 256
#: Centres are fitted on at most SAMPLE anchors; a cluster has some CLUSTER anchors, and there are MOST_CLUSTERS at most, so they always fit a closure.
SAMPLE, CLUSTER, MOST_CLUSTERS, ROUNDS = 20_000, 500, 256, 5
LEAST = -(1 << 62)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([0, *(int(pa.compute.max(pa.compute.list_value_length(c)).as_py() or 0) for c in columns if len(c))])


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their exact range, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2.0**52 else a @ b.T


def shared_list(anchors: np.ndarray, centre: np.ndarray, cands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the candidates by falling bound, and the bounds (for an anchor of length 1) in that order. They are wider than the formula by more than doubles can err."""
    u, length = _unit(anchors)
    c, norm = _unit(cands)
    angle = lambda m: np.arccos(np.clip(m @ centre, -1, 1))
    spread = angle(u[length > 0]).max(initial=0.0) + 1e-6
    bound = norm * (np.cos(np.maximum(0.0, angle(c) - spread)) + 1e-8)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _first(k: int, asker: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each asker's k first by falling score, then id."""
    order = np.lexsort((ids, -score, asker))
    who = asker[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


def walk(score: Callable, length: np.ndarray, owner: np.ndarray, bound: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, allowed: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """asker, position and score of every asker's k best candidates, and how many scores were computed.

    Asker j belongs to anchor owner[j]; score(anchors, a, b) has the scores of positions a to b, allowed(askers, a, b, scores) says which count, floor is the least that does.
    An asker stops once no bound that is left reaches the greater of its floor and its k-th best. No more than k candidates an asker are kept, however many are equal.
    """
    n, kth, best = len(bound), floor.astype(np.int64).copy(), np.full((len(owner), k), LEAST, np.int64)
    held = [np.zeros(0, np.int64)] * 3
    active, looked = np.arange(len(owner)), 0
    for a in range(0, n, STEP):
        active = active[length[owner[active]] * bound[a] + 1e-6 >= kth[active]]
        if not len(active):
            break
        b = min(n, a + STEP)
        mine, inverse = np.unique(owner[active], return_inverse=True)
        s = score(mine, a, b)[inverse]
        looked += len(mine) * (b - a)
        s = np.where(allowed(active, a, b, s), s, LEAST)
        both = np.concatenate([best[active], s], axis=1)
        best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        kth[active] = np.maximum(floor[active], best[active].min(1))
        row, col = np.nonzero((s >= kth[active][:, None]) & (s > LEAST))
        if len(row):
            held = [np.concatenate(x) for x in zip(held, (active[row], col + a, s[row, col]), strict=True)]
            keep = _first(k, held[0], ids[held[1]], held[2])
            held = [x[keep] for x in held]
    keep = held[2] >= kth[held[0]]
    return held[0][keep], held[1][keep], held[2][keep], looked


def _centres(anchors: DataFrame, n: int, width: int) -> np.ndarray:
    """Spherical k-means on a sample of at most SAMPLE anchors, those of the least id hashes."""
    rows = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    u, _ = _unit(_matrix(rows.column("v"), width).astype(np.float64))
    m = u[np.linspace(0, len(u) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = (u @ m.T).argmax(1)
        sums = np.zeros_like(m)
        np.add.at(sums, own, u)
        length = np.sqrt((sums**2).sum(1))
        m = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], m)
    return m


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `positives` best rows of its label the first `negatives` rows
    of other labels whose score lies between low and high hundredths of the positive's. Scores are integer inner products of floor(256 x); ties go to the smaller id.

    Rows with a null id, label or vector or with null or non-finite components take no part; rows bearing the anchor's id are no partners of it. Anchors are rows of
    `anchors`; of several with one id the one of the least label and vector asks. Repeated rows count each. Vectors may differ in length (missing terms are 0).
    Anchors without a positive, and positives without a negative in their band, give no row; so do empty tables. Products of up to 2^62 are exact.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), quantised(F.col(vector_col)).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    asks = settled(pick(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v"), "anchors")
    pairs_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_asks, width = asks.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_asks or not width:
        return vectors.sparkSession.createDataFrame([], pairs_schema)
    centres = _centres(asks, max(1, min(MOST_CLUSTERS, n_asks // CLUSTER)), width)
    n_c = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    shape = "vec_id long, label string, v array<bigint>, cluster int"

    def clustered(batches):
        for batch in batches:
            u, _ = _unit(_matrix(pa.chunked_array([batch.column("v")]), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((u @ centres.T).argmax(1).astype(np.int32))], ["vec_id", "label", "v", "cluster"])

    asks = asks.mapInArrow(clustered, shape)
    sizes = {r["cluster"]: r["count"] for r in asks.groupBy("cluster").count().collect()}  # one row a cluster
    parts = [-(-sizes.get(c, 0) // ANCHOR_BLOCK) for c in range(len(centres))]
    starts = [sum(parts[:c]) for c in range(len(parts))]
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    asks = settled(asks.withColumn("block", of(starts) + F.pmod(F.xxhash64("vec_id"), of(parts))), "anchors")
    cands = pick(vectors).withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(n_c))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(sum(parts) - 1)).cast("array<bigint>")))
    keys = ["block", "cb"]

    def cells(askers: DataFrame, run: Callable, schema: str) -> DataFrame:
        left = askers.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<bigint>")))
        return left.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInArrow(run, schema)

    def prepared(a: pa.Table, b: pa.Table):
        anchor, cand = _matrix(a.column("v"), max(width, _width(b.column("v")))), _matrix(b.column("v"), max(width, _width(b.column("v"))))
        centre = np.zeros(anchor.shape[1])
        centre[:width] = centres[a.column("cluster")[0].as_py()]
        order, bound = shared_list(anchor, centre, cand)
        cand = cand[order]
        length = np.sqrt((anchor.astype(np.float64) ** 2).sum(1))
        ids = b.column("vec_id").to_numpy()[order]
        names, code = np.unique(np.array([*a.column("label").to_pylist(), *b.column("label").to_pylist()], object), return_inverse=True)
        return (lambda rows, i, j: products(anchor[rows], cand[i:j])), length, bound, ids, code[: len(a)], code[len(a) :][order]

    def find_positives(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")})
        score, length, bound, ids, own, labels = prepared(a, b)
        own_id = a.column("vec_id").to_numpy()
        allowed = lambda rows, i, j, _: (own[rows][:, None] == labels[None, i:j]) & (own_id[rows][:, None] != ids[None, i:j])
        who, at, s, _ = walk(score, length, np.arange(len(a)), bound, ids, positives, np.full(len(a), LEAST), allowed)
        return pa.table({"anchor_id": own_id[who], "positive_id": ids[at], "positive_score": s})

    found = cells(asks, find_positives, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    banded = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # `positives` rows at most
    banded = settled(asks.join(banded.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")

    def find_negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], pa.int64()) for n in columns})
        score, length, bound, ids, own, labels = prepared(a, b)
        own_id, lists = a.column("vec_id").to_numpy(), a.column("positives").to_pylist()
        owner = np.repeat(np.arange(len(a)), [len(x) for x in lists])
        place, pid, ps = (np.array([y[n] for x in lists for y in x], np.int64) for n in ("place", "positive_id", "positive_score"))
        floor = -((-low * ps) // 100)  # the least whole score of the band

        def allowed(rows, i, j, s):
            mine = owner[rows]
            return (own[mine][:, None] != labels[None, i:j]) & (own_id[mine][:, None] != ids[None, i:j]) & (100 * s <= (high * ps[rows])[:, None])

        who, at, s, _ = walk(score, length, owner, bound, ids, negatives, floor, allowed)
        return pa.table(dict(zip(columns, (own_id[owner[who]], place[who], pid[who], ps[who], ids[at], s), strict=True)))

    found = cells(banded, find_negatives, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
