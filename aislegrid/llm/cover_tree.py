"""Vector code compression (operator 13): product codes by Lloyd's rounds over partition-local cover trees.

Vectors, as integers, are cut into equal parts. Each chunk of rows of a partition gets one cover tree a part, written once as a table: a node covers
its points within a radius that halves at least from parent to child, and its points are one run of the tree's order, so cumulative sums give the sum of any
subtree. A round sends the codebooks to the trees. A subtree whose nearest entry is nearer than any other even from the far side of its ball
(the triangle inequality) is assigned whole, by count and sum; only ambiguous nodes descend, and ambiguous leaves compare their points exactly. What comes back is
one sum and count for each part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .topk import quantised

CHUNK, LEAF, BROADCAST_ROWS = 8_192, 16, 100_000
#: Chunks with their trees take some MB each, so that few go into one Arrow batch.
CHUNKS_A_BATCH, BATCH = 4, "spark.sql.execution.arrow.maxRecordsPerBatch"
TREE = "struct<points:array<int>,begin:array<int>,end:array<int>,centre:array<int>,radius:array<double>,child:array<int>,children:array<int>>"


def build_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Cover tree of the rows of x, breadth first: points (row numbers in tree order) and for each node its run of them, its centre's row, its radius and its children's run of nodes.

    The children's centres lie more than half the radius apart and each covers what it holds within that half. A node of LEAF points or of radius 0 is a leaf.
    """
    x = x.astype(np.float64)
    points = np.arange(len(x))
    begin, end, centre, radius, child, children = ([0], [len(x)], [0], [0.0], [0], [0]) if len(x) else ([], [], [], [], [], [])
    at = 0
    while at < len(begin):
        a, b = begin[at], end[at]
        rows = points[a:b]
        far = np.sqrt(((x[rows] - x[centre[at]]) ** 2).sum(1))
        radius[at] = float(far.max())
        if b - a > LEAF and radius[at] > 0:
            half, left, first = radius[at] / 2, rows, len(begin)
            d, pivot, start = far, centre[at], a
            while True:  # the node's own centre is its first child's
                near = d <= half
                own, left = left[near], left[~near]
                points[start : start + len(own)] = own
                begin.append(start), end.append(start + len(own)), centre.append(int(pivot)), radius.append(0.0), child.append(0), children.append(0)
                start += len(own)
                if not len(left):
                    break
                pivot = left[0]
                d = np.sqrt(((x[left] - x[pivot]) ** 2).sum(1))
            child[at], children[at] = first, len(begin) - first
        at += 1
    return {"points": points, "begin": np.array(begin, int), "end": np.array(end, int), "centre": np.array(centre, int), "radius": np.array(radius), "child": np.array(child, int), "children": np.array(children, int)}


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integers: by one product of doubles where they hold it exactly, else in 64 bits."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2.0**52:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)


def assign(x: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole subtrees as (begins, ends, entries) a level, then the rows of ambiguous leaves with their entries; ties go to the lower entry."""
    whole, rows, entries = [], [], []
    frontier = np.zeros(min(1, len(tree["begin"])), int)
    while len(frontier):
        d = np.sqrt(_squares(x[tree["centre"][frontier]], book))
        nearest = d.argmin(1)
        r = tree["radius"][frontier]
        if len(book) > 1:
            first, second = np.partition(d, 1, axis=1)[:, :2].T
            sure = first + r < (second - r) * (1 - 1e-12) - 1e-9
        else:
            sure = np.ones(len(frontier), bool)
        whole.append((tree["begin"][frontier[sure]], tree["end"][frontier[sure]], nearest[sure]))
        open_ = frontier[~sure]
        leaf = tree["children"][open_] == 0
        at = _runs(tree["begin"][open_[leaf]], tree["end"][open_[leaf]])
        own = tree["points"][at]
        rows.append(own)
        entries.append(_squares(x[own], book).argmin(1))
        inner = open_[~leaf]
        frontier = _runs(tree["child"][inner], tree["child"][inner] + tree["children"][inner])
    none = np.zeros(0, int)
    return whole, np.concatenate([none, *rows]), np.concatenate([none, *entries])


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the runs begin to end."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def totals(x: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of each entry's rows."""
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    run = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[tree["points"]], axis=0)])
    whole, rows, entries = assign(x, tree, book)
    for begin, end, entry in whole:
        np.add.at(sums, entry, run[end] - run[begin])
        np.add.at(counts, entry, end - begin)
    np.add.at(sums, entries, x[rows])
    np.add.at(counts, entries, 1)
    return sums, counts


def codes(x: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each row and its exact squared distance."""
    out = np.zeros(len(x), int)
    whole, rows, entries = assign(x, tree, book)
    for begin, end, entry in whole:
        out[tree["points"][_runs(begin, end)]] = np.repeat(entry, end - begin)
    out[rows] = entries
    return out, ((x - book[out]) ** 2).sum(1)


def _vectors(column, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _trees(value: dict) -> dict[str, np.ndarray]:
    return {k: np.array(v, float if k == "radius" else int) for k, v in value.items()}


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of vectors that has one (see codebooks() and encode()).

    Rows whose vector is null or holds null or non-finite components are dropped. The first row (by id, then vector; null ids last) sets the length; rows of another length are returned with a
    null code and error. A length that is no multiple of parts is filled with zeros. Fewer rows than entries give smaller codebooks; repeated rows and ids count
    each; null labels are one label. An empty table gives an empty result. Exact while components of floor(256 x) stay under 2^28 in size.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), quantised(F.col(vector_col)).alias("v")).where("v IS NOT NULL")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    seeds = rows.orderBy(*order).limit(1).select(F.size("v")).first()
    length = seeds[0] if seeds else 0
    kept = rows.where(F.size("v") == length)
    width = -(-length // parts)
    first = [r["v"] for r in kept.orderBy(*order).limit(entries).select("v").collect()]
    shape = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not first or not length:
        return spark.createDataFrame([], shape) if not first else rows.select("vec_id", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")], F.lit(None).cast("string").alias("codebooks_sha256"))
    filled = np.zeros((len(first), parts * width), np.int64)
    filled[:, :length] = np.array(first, np.int64)
    books = [np.ascontiguousarray(filled[:, i * width : (i + 1) * width]) for i in range(parts)]
    kind = dict(rows.dtypes)["label"]
    trees = settled(kept.mapInArrow(_planter(parts, width, length), f"vec_ids array<bigint>, labels array<{kind}>, v array<bigint>, trees array<{TREE}>"), "trees")
    with _few_chunks(spark):
        for _ in range(rounds):
            books = _next(trees, books, width)
        coded = settled(trees.mapInArrow(_coder(books, width), f"vec_id long, label {kind}, code string, error long"), "codes")
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()
    odd = rows.where(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = coded.unionByName(odd)
    by_label = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_ROWS else by_label
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@contextmanager
def _few_chunks(spark):
    """Jobs that run inside read CHUNKS_A_BATCH chunks a batch."""
    old = spark.conf.get(BATCH)
    spark.conf.set(BATCH, CHUNKS_A_BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH, old)


def _planter(parts: int, width: int, length: int):
    """Chunks of a partition's rows with their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk(table: pa.Table) -> pa.RecordBatch:
            v = np.zeros((len(table), parts * width), np.int64)
            v[:, :length] = _vectors(table.column("v"), length)
            found = [build_tree(v[:, i * width : (i + 1) * width]) for i in range(parts)]
            lists = lambda x: pa.array([x])
            ints = lambda x: pa.array(x, pa.int32())
            trees = [{k: (pa.array(t[k]) if k == "radius" else ints(t[k])).to_pylist() for k in t} for t in found]
            tree_type = pa.struct([(k, pa.list_(pa.float64() if k == "radius" else pa.int32())) for k in ("points", "begin", "end", "centre", "radius", "child", "children")])
            label = table.column("label").combine_chunks()
            label = pa.concat_arrays(label.chunks) if isinstance(label, pa.ChunkedArray) else label
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([lists(table.column("vec_id").to_pylist()).cast(pa.list_(pa.int64())), whole(label), whole(pa.array(v.ravel())), pa.array([trees], pa.list_(tree_type))], ["vec_ids", "labels", "v", "trees"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= CHUNK:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, CHUNK))
                held, n = table.slice(CHUNK).to_batches(), n - CHUNK
        if n:
            yield chunk(pa.Table.from_batches(held))

    return run


def _chunks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1)


def _parts(row: pa.RecordBatch, width: int, parts: int):
    """The part vectors and tree of each part of a chunk."""
    v = row.column("v")[0].values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts * width)
    for i in range(parts):
        yield np.ascontiguousarray(v[:, i * width : (i + 1) * width]), {k: w.values.to_numpy(zero_copy_only=False) for k, w in row.column("trees")[0][i].items()}


def _next(trees: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: floor(sum / count) for each part and entry; entries without rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for row in _chunks(batches):
            for i, (x, tree) in enumerate(_parts(row, width, len(books))):
                s, n = totals(x, tree, books[i])
                sums[i] += s
                counts[i] += n
        out = [(i, e, int(counts[i][e]), sums[i][e].tolist()) for i in range(len(books)) for e in np.flatnonzero(counts[i]).tolist()]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = trees.select("v", "trees").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    new = [b.copy() for b in books]
    for r in total.collect():  # a row for each part and entry
        new[r["part"]][r["entry"]] = [x // r["n"] for x in r["sums"]]
    return new


def _coder(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunks(batches):
            found = [codes(x, tree, books[i]) for i, (x, tree) in enumerate(_parts(row, width, len(books)))]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([e for _, e in found], axis=0)
            yield pa.RecordBatch.from_arrays([row.column("vec_ids")[0].values, row.column("labels")[0].values, pa.array([c.tobytes().hex() for c in code]), pa.array(error.astype(np.int64))], ["vec_id", "label", "code", "error"])

    return run
