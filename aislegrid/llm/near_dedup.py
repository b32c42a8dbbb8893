"""MinHash near-dedup (operator 10) with SetSketch registers.

A document's set is its distinct five-word shingles, as 64-bit hashes: links are confirmed on the full sets of these hashes, and sets of equal size and two equal
64-bit sums of hashes count as equal. A sketch has REGISTERS truncated minima on an exponential scale of base B: mergeable by maximum, and equal with a probability
that grows with similarity. Documents with equal sets are one class. Class representatives meet through bands of register values; in each bucket all are paired
with the bucket's smallest id. A pair is dropped only if the joint likelihood of its register comparison and sizes rules the threshold out, and is verified on the
full sets otherwise. Buckets whose members are then still in different components are searched exactly, in blocks: all members outside the bucket's largest
component against all of another component, so no link inside a bucket is lost and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_runs
from .components import components

WORDS = 5
REGISTERS, BANDS = 128, 32
B = 1.02
THRESHOLD = 0.75
DOUBT = 16.0  # log likelihood ratio beyond which a pair is out
BLOCK = 512
BROADCAST_ROWS = 100_000
SLICE_BYTES = 1_000_000

_rng = np.random.default_rng(20_241)
_A = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_X = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_COEFFICIENTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64, at least n of them."""
    if not _powers or len(_powers["up"]) < n:
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("up", _P), ("down", inverse)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[name] = out
    return _powers["up"], _powers["down"]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))  # first byte of a word, and the blank after it, by turns
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum((_LOW[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64))
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cut = np.searchsorted(starts, np.cumsum(lengths + 1))
    n = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(WORDS):
        rolled += words[j : j + n] * _COEFFICIENTS[j]
    rolled = _mix(rolled)
    out, a = [], 0
    for b in cut.tolist():
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for j in range(a, b):
                whole = np.uint64((int(whole) * _P + int(words[j])) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set."""
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, ((short[i : i + 1024, None] ^ _X) * _A).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(B)) + 400, 0, 65535).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Band keys (BANDS columns) of sketches (rows)."""
    rows = sketches.reshape(len(sketches), BANDS, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for i in range(rows.shape[2]):
        h = _mix(h * np.uint64(_P) + rows[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two sums over the set's hashes, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw in text_runs(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(raw)
                sums = [pa.array(np.array([int(f(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)) for f in (lambda s: s, lambda s: _mix(s ^ np.uint64(_P)))]
                blob = pa.array([registers(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.array([len(s) for s in sets], np.int64)), *sums, blob], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _keyed(heads: DataFrame) -> DataFrame:
    """key, doc_id for each band of heads (doc_id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "doc_id"])

    return heads.select("doc_id", "sketch").mapInArrow(run, "key long, doc_id long")


def estimate(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) of sets of known sizes, and the log likelihood that a
    similarity of at least THRESHOLD lacks to it."""
    more, less = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - more - less
    share = (n_u / (n_u + n_v))[:, None]
    top = np.minimum(share / (1 - share), (1 - share) / share)
    grid = np.append(np.linspace(0, THRESHOLD, 75, endpoint=False), np.linspace(THRESHOLD, 1, 40))[None, :]
    j = np.minimum(grid, top)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = p(share - (1 - share) * j), p((1 - share) - share * j)
    log = lambda x: np.log(np.clip(x, 1e-6, 1))
    fit = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    best = fit.argmax(1)
    at = np.arange(len(fit))
    return j[at, best], fit[at, best] - fit[:, 75:].max(1)


def _is_linked(shared, n_u, n_v):
    return 100 * shared >= round(100 * THRESHOLD) * (n_u + n_v - shared)


def small(df: DataFrame) -> DataFrame:
    """A settled table marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, the full set and its sketch, of the documents of wanted (doc_id): only candidates are taken up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw in text_runs(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(raw)
                blobs = [pa.array([f(s).tobytes() for s in sets], pa.binary()) for f in (lambda s: s, registers)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *blobs], ["doc_id", "hashes", "sketch"])

    return docs.join(small(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes binary, sketch binary")


def _linked_to_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b that are linked: by the sketches' joint likelihood, then on full sets. A group is a hub a with about BLOCK of its partners, however many it has."""
    large = settled(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1"), "hubs")
    fan = pairs.join(small(large), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("doc_id"))
    rows = fan.unionByName(fan.select("a", "part", F.col("a").alias("doc_id")).distinct()).join(sets, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        a, ids = table.column("a")[0].as_py(), np.array(table.column("doc_id").to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        sizes, sketches, linked = np.array([len(s) for s in sets], float), _matrix(table.column("sketch")), []
        for hub in np.flatnonzero(ids == a).tolist():  # several only if an id comes with several texts
            u, n = sets[hub], sizes[hub]
            near = np.flatnonzero((ids != a) & (np.minimum(n, sizes) >= THRESHOLD * np.maximum(n, sizes)))
            if len(near):
                near = near[estimate(np.broadcast_to(sketches[hub], (len(near), REGISTERS)), sketches[near], np.full(len(near), n), sizes[near])[1] < DOUBT]
            for i in near.tolist():
                at = np.minimum(np.searchsorted(u, sets[i]), len(u) - 1)
                if _is_linked(int((u[at] == sets[i]).sum()), len(u), len(sets[i])):
                    linked.append(int(ids[i]))
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(run, "a long, b long")


def _searched(rows: DataFrame) -> DataFrame:
    """Links between a block of askers and a block of members of a bucket, other components only; one link to each component."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids, comps = (np.array(table.column(c).to_pylist()) for c in ("asks", "doc_id", "component"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        members, askers = np.flatnonzero(~asks), np.flatnonzero(asks)
        out_a, out_b = [], []
        if len(members) and len(askers):
            sizes = np.array([len(sets[i]) for i in members])
            hashes, owner = np.concatenate([sets[i] for i in members]), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for q in askers.tolist():
                lo, hi = np.searchsorted(hashes, sets[q], "left"), np.searchsorted(hashes, sets[q], "right")
                n = hi - lo
                at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
                shared = np.bincount(owner[at], minlength=len(members))
                hit = np.flatnonzero(_is_linked(shared, len(sets[q]), sizes) & (comps[members] != comps[q]))
                _, first = np.unique(comps[members[hit]], return_index=True)
                out_a += [int(ids[q])] * len(first)
                out_b += ids[members[hit[first]]].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("key", "qb", "mb").applyInArrow(run, "a long, b long")


def _links_within(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Remaining links of buckets (key, doc_id) of three and more members in several components."""
    named = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    named = settled(named, "buckets")
    still = settled(named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 AND low < high").select("key"), "buckets")
    if still.isEmpty():
        return None
    named = named.join(small(still), "key")
    per = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = settled(per.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max(F.struct("n", "component")).getField("component").alias("main")), "buckets")
    blocks = sizes.select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("nq"))
    rows = named.join(F.broadcast(blocks) if sizes.count() <= BROADCAST_ROWS else blocks, "key")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    members = rows.select("key", "doc_id", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), spot("nm").alias("mb"))
    askers = rows.where("component <> main").select("key", "doc_id", "component", F.lit(True).alias("asks"), spot("nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"))
    return settled(_searched(members.unionByName(askers).join(sets.select("doc_id", "hashes"), "doc_id")).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included) and kept (doc_id = component_id) of every row.

    Null, empty and wordless texts have an empty set and are linked with nothing. Rows with a null id are linked with nothing and kept (component_id null).
    Rows that repeat an id, with the same text or another, share one component. Very long texts are cut into words whole. Empty tables give an empty result;
    other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = settled(sketch_documents(docs), "sketches")
    full = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "f1", "f2"]
    classes = settled(full.groupBy(*same, "sketch").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    again = settled(full.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    repeats = not again.isEmpty()

    keyed = _keyed(classes.select(F.col("first").alias("doc_id"), "sketch"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last")
    buckets = settled(keyed.join(shared.select("key", "a"), "key"), "buckets")
    pairs = settled(buckets.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    sets = _sets(docs, settled(buckets.select("doc_id").distinct(), "wanted"))
    sets = settled(sets.distinct() if repeats else sets, "sets")

    links = _linked_to_hubs(pairs, sets)
    if repeats:  # all classes of an id belong together
        own = full.join(small(again), "doc_id", "left_semi").join(classes.select(*same, "first"), same)
        links = links.unionByName(own.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links)
    more = _links_within(buckets.select("key", "doc_id"), labels, sets)
    if more is not None and not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select(*same, "first", "copies").join(labels.where("node <> component").withColumnRenamed("node", "first"), "first", "left")
    named = named.where("copies > 1 OR component IS NOT NULL").select(*same, F.coalesce("component", "first").alias("component"))
    rows = sketched.select("doc_id", *same).join(named, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
