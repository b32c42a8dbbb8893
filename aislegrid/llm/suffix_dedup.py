"""Suffix-array dedup (operator 8): every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

Distribution. Each LENGTH-byte window picks an anchor, the K-gram of least hash within it, by its own bytes alone: equal windows pick equal anchors,
so all windows that can be equal meet at the hash of their anchor. Runs of windows with one anchor travel together, as the anchor's context. Three
passes over the documents, cut into chunks:
1. a chunk sends the (short) hashes of its anchors to buckets; a bucket returns those that more than one document has;
2. a chunk sends the contexts of these anchors, equal ones once with their smallest doc_id, to buckets;
   a bucket keeps a logarithmic family of suffix arrays: the windows (suffixes cut at LENGTH bytes) of a batch of contexts, in doc_id order, get a sorted array, are
   probed by binary search against the existing levels for full-length matches, and levels of equal size merge geometrically. It returns, for each context, the windows that start in a smaller document;
3. a chunk marks the bytes of these windows and cuts them out.
Nothing is sampled: anchors only decide where windows meet. Frequent strings cross the exchange once a chunk, not once an occurrence.

An anchor of more than HOT_ANCHOR occurrences in all chunks (a frequent phrase, of which each document may have another context) would bring all its contexts
to one bucket. Its windows travel one by one instead, each to the bucket of its own hash: equal windows still meet, and need no further comparison.

What crosses an exchange is packed: texts and contexts by zstd, ascending numbers (ids, hashes, anchors) as differences, byte plane by byte plane, by zstd.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices

LENGTH, K = 50, 24
SPAN = LENGTH - K  # a window's anchor starts 0 .. SPAN bytes after it
CONTEXT = 2 * LENGTH - K  # bytes from SPAN before an anchor to LENGTH after it
CHUNK_BYTES, MOST_CHUNK_BYTES = 12_000_000, 128_000_000
RUN_BYTES = 2_000_000
BATCH = 2_500  # contexts, of up to SPAN + 1 windows each
HOT_ANCHOR = 20_000
SINGLE = 64  # marks a context that is one window of a hot anchor
_MASK = np.uint64((1 << 22) - 1)
_P = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the K bytes from each position."""
    sums, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while size * 2 <= K:
        h = sums[size]
        sums[2 * size] = h[:-size] * np.uint64(pow(_P, size, 1 << 64)) + h[size:]
        size *= 2
    h, got = sums[size], size
    while got < K:
        step = max(s for s in sums if s <= K - got)
        n = len(data) - got - step + 1
        h = h[:n] * np.uint64(pow(_P, step, 1 << 64)) + sums[step][got : got + n]
        got += step
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _run_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of one run of bytes: hash, position, first window, number of windows."""
    h = _rolling(data)
    least = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)  # ties go to the first K-gram in the window
    size = 1
    while size * 2 <= SPAN + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN + 1:
        least = np.minimum(least[: len(least) - (SPAN + 1 - size)], least[SPAN + 1 - size :])
    at = (least & _MASK).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return h[at[first]], at[first], first, np.diff(np.append(first, len(at)))


class Chunk:
    """The documents of a chunk in doc_id order, end to end, with their anchors. The same documents give the same numbering in each pass."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        parts = []
        for a in range(0, max(0, len(self.data) - LENGTH + 1), RUN_BYTES):  # runs overlap by all but one byte of a window
            h, at, first, n = _run_anchors(self.data[a : a + RUN_BYTES + LENGTH - 1])
            parts.append((h, at + a, first + a, n))
        self.hash, self.at, self.first, self.n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        self.hash = self.hash.astype(np.uint64)
        self._within_documents()

    def _within_documents(self) -> None:
        """Cuts runs of windows at document ends: only windows inside one document stay."""
        last = self.first + self.n - 1
        doc = np.searchsorted(self.starts, self.first, "right") - 1
        end_doc = np.searchsorted(self.starts, last, "right") - 1
        inside = (doc == end_doc) & (last + LENGTH <= (self.starts + self.sizes)[doc]) if len(doc) else np.zeros(0, bool)
        h, at, first, n, of = ([x[inside]] for x in (self.hash, self.at, self.first, self.n, doc))
        for i in np.flatnonzero(~inside).tolist():
            for d in range(int(doc[i]), int(end_doc[i]) + 1):
                a, b = max(int(self.first[i]), int(self.starts[d])), min(int(last[i]), int(self.starts[d] + self.sizes[d]) - LENGTH)
                if b >= a:
                    h.append(self.hash[i : i + 1]), at.append(self.at[i : i + 1]), first.append(np.array([a])), n.append(np.array([b - a + 1])), of.append(np.array([d]))
        h, at, first, n, of = (np.concatenate(x) for x in (h, at, first, n, of))
        order = np.argsort(first, kind="stable")
        self.hash, self.at, self.first, self.n, self.doc = h[order], at[order], first[order], n[order], of[order]

    def contexts(self, which: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
        """For each anchor: where its windows begin before it, how many they are, and their bytes; equal rows are equal contexts. With window: that one alone."""
        out = np.zeros((len(which), CONTEXT + 2), np.uint8)
        back, n = self.at[which] - self.first[which], self.n[which]
        if window is not None:
            back, n = back - window, np.ones(len(which), np.int64)
        out[:, 0], out[:, 1] = back + 1, n + (0 if window is None else SINGLE)
        columns = np.arange(CONTEXT)[None, :] - SPAN
        place = self.at[which][:, None] + columns
        keep = (columns >= -back[:, None]) & (columns < (n - back)[:, None] + LENGTH - 1)
        out[:, 2:] = np.where(keep, self.data[np.clip(place, 0, max(0, len(self.data) - 1))], 0)
        return out


    def sent(self, back: pa.Table, buckets: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What of this chunk is sent, by bucket of the anchors: bucket, whether they are hot, their numbers in doc_id order, the first of each distinct context, each one's context, and the contexts."""
        bucket = _bucket_of(self.hash, buckets)
        own = (self.hash & np.uint64(0xFFFFFFFF)) | (bucket.astype(np.uint64) << np.uint64(32))
        for column, hot in (("hashes", False), ("hot", True)):
            wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_py(), np.uint32).astype(np.uint64) | np.uint64((b or 0) << 32) for b, x in zip(back.column("bucket").to_pylist(), back.column(column), strict=True))]))
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own) if len(wanted) else np.zeros(0, np.int64)
            for b, places in _split_by(bucket[at]):
                number = at[places]
                rows = self.contexts(number)
                first, which = _equal_contexts(rows)
                yield b, hot, number, first, which, rows

    def windows(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Single windows of the anchors numbered lead (ascending): the anchor's place in lead, the window's place in it, the first of each distinct window, and each one's window."""
        n = self.n[lead]
        of = np.repeat(np.arange(len(lead)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = self.first[lead][of] + k
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[begin]).view(f"V{LENGTH}").ravel() if len(begin) else np.zeros(0, f"V{LENGTH}")
        _, first, which = np.unique(keys.view(f"S{LENGTH}"), return_index=True, return_inverse=True)
        return of, k, first, which.ravel()


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _window_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each single window, by a hash of its bytes."""
    powers = np.array([pow(_P, i, 1 << 64) for i in range(rows.shape[1])], np.uint64)
    h = np.concatenate([np.zeros(0, np.uint64), *((rows[a : a + 10_000].astype(np.uint64) * powers).sum(1, dtype=np.uint64) for a in range(0, len(rows), 10_000))])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _bucket_of(h ^ (h >> np.uint64(32)), buckets)


def _pieces(chunks: DataFrame) -> DataFrame:
    """Rows (doc_id, text, chunk) packed by chunk, a piece for each Arrow batch and at most RUN_BYTES or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column("doc_id").to_numpy(), [t or b"" for t in byte_texts(batch.column("text"))], []
            for number, rows in _split_by(batch.column("chunk").to_numpy()):
                sizes = [len(texts[i]) for i in rows.tolist()]
                for a, b in slices(sizes, RUN_BYTES):
                    out.append((number, _pack(ids[rows[a:b]]), _pack(np.array(sizes[a:b], np.int64)), _zip(b"".join([texts[i] for i in rows[a:b].tolist()]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], ["chunk", "ids", "sizes", "texts"])

    return chunks.select("doc_id", "text", "chunk").mapInArrow(run, "chunk long, ids binary, sizes binary, texts binary")


def _load(table: pa.Table) -> Chunk:
    ids, texts = [], []
    for i, n, t in zip(*(table.column(x) for x in ("ids", "sizes", "texts")), strict=True):
        ids += _unpack(i.as_py(), np.int64).tolist()
        sizes, raw = _unpack(n.as_py(), np.int64), _unzip(t.as_py())
        texts += [raw[b - a : b] for a, b in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
    return Chunk(ids, texts)


def _split_by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    if len(order):
        cut = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            yield int(keys[order[a]]), order[a:b]


def _zip(x: bytes) -> bytes:
    """zstd of bytes after their number; empty stays empty."""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) if x else b""


def _unzip(x: bytes | None) -> bytes:
    return pa.decompress(memoryview(x)[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) if x else b""


def _pack(x: np.ndarray) -> bytes:
    """Integers as differences, all lowest bytes first: short where they ascend."""
    u = np.ascontiguousarray(x).view(f"u{x.itemsize}")
    steps = np.diff(u, prepend=u.dtype.type(0))
    return _zip(steps.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(x: bytes | None, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_unzip(x), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"u{size}").ravel(), dtype=f"u{size}").view(kind)


def _send_hashes(chunks: DataFrame, buckets: int) -> DataFrame:
    """Pass 1: for each chunk and bucket the distinct 32-bit remainders of anchor hashes, those of several documents apart and with their occurrences."""

    def run(table: pa.Table) -> pa.Table:
        c, number = _load(table), table.column("chunk")[0].as_py()
        order = np.argsort(c.hash, kind="stable")
        h, doc = c.hash[order], c.ids[c.doc[order]] if len(order) else order
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        times = np.diff(np.append(first, len(h))).astype(np.uint32)
        bucket, h = _bucket_of(h[first], buckets), h[first].astype(np.uint32)
        order = np.argsort(h, kind="stable")
        bucket, h, several, times = bucket[order], h[order], several[order], times[order]
        out = []
        for b, at in _split_by(bucket):
            many = at[several[at]]
            out.append((b, _pack(h[at[~several[at]]]), _pack(h[many]), _pack(times[many])))
        names = ("once", "often", "times")
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([number] * len(out), pa.int64())} | {c: pa.array([x[i] for x in out], pa.binary()) for i, c in enumerate(names, 1)})

    return chunks.groupBy("chunk").applyInArrow(run, "bucket long, chunk long, once binary, often binary, times binary")


def _shared_hashes(sent: DataFrame) -> DataFrame:
    """Back to each chunk: its hashes (32-bit remainders in a bucket) that several documents have, those of hot anchors apart."""

    def run(table: pa.Table) -> pa.Table:
        once, often, times = ([_unpack(x.as_py(), np.uint32) for x in table.column(c)] for c in ("once", "often", "times"))
        keys = np.concatenate([*once, *often])
        values, which = np.unique(keys, return_inverse=True)
        weights = np.concatenate([np.ones(sum(map(len, once)), np.int64), *times])
        of_several = np.zeros(len(values), bool)
        of_several[which[sum(map(len, once)) :]] = True
        total = np.bincount(which.ravel(), weights, len(values))
        shared = of_several | (np.bincount(which.ravel(), minlength=len(values)) > 1)
        hot = shared & (total > HOT_ANCHOR)
        out = []
        for number, a, b in zip(table.column("chunk").to_pylist(), once, often, strict=True):
            own = np.sort(np.concatenate([a, b]))
            at = np.searchsorted(values, own)
            out.append((number, _pack(own[shared[at] & ~hot[at]]), _pack(own[hot[at]])))
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "bucket": table.column("bucket").combine_chunks(), "hashes": pa.array([x[1] for x in out], pa.binary()), "hot": pa.array([x[2] for x in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, hashes binary, hot binary")


def _equal_contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct context, and the number of each row's context."""
    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first, which.ravel()


def _send_contexts(chunks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Pass 2: contexts of shared anchors by bucket, once for each chunk, with the smallest doc_id and that anchor's number; of hot anchors, windows.

    A number is that of the anchor times 32, for a window of a hot anchor plus one more than its place.
    """

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        out, hot_numbers, hot_docs, hot_rows = [], [], [], []
        if table.num_rows and back.num_rows:
            c = _load(table)
            for b, hot, number, first, _, rows in c.sent(back, buckets):
                first = np.sort(first)  # anchors are in doc_id order, so the first of equal contexts has the smallest
                if hot:
                    lead = number[first]
                    of, k, distinct, _ = c.windows(lead)
                    distinct = np.sort(distinct)
                    hot_numbers.append(lead[of[distinct]] * 32 + k[distinct] + 1)
                    hot_docs.append(c.ids[c.doc[lead[of[distinct]]]])
                    hot_rows.append(c.contexts(lead[of[distinct]], k[distinct]))
                else:
                    out.append((b, _pack(number[first].astype(np.int64) * 32), _pack(c.ids[c.doc[number[first]]]), _zip(rows[first].tobytes())))
            if hot_rows:
                numbers, docs, rows = np.concatenate(hot_numbers), np.concatenate(hot_docs), np.concatenate(hot_rows)
                out += [(b, _pack(numbers[at]), _pack(docs[at]), _zip(rows[at].tobytes())) for b, at in _split_by(_window_bucket(rows, buckets))]
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([chunk] * len(out), pa.int64()), "anchors": pa.array([x[1] for x in out], pa.binary()), "docs": pa.array([x[2] for x in out], pa.binary()), "contexts": pa.array([x[3] for x in out], pa.binary())})

    return chunks.groupBy("chunk").cogroup(shared.groupBy("back_chunk")).applyInArrow(run, "bucket long, chunk long, anchors binary, docs binary, contexts binary")


class SuffixFamily:
    """Sorted arrays of suffixes (cut at LENGTH bytes) with the smallest doc_id of each, in levels of geometric size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _sorted(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, suffixes))
        s, d = suffixes[order], docs[order]
        first = np.append(True, s[1:] != s[:-1])
        return s[first], d[first]

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Adds a batch; tells which of its suffixes some document of smaller id (in the batch or before it) has."""
        new = self._sorted(suffixes, docs)
        seen = np.zeros(len(suffixes), bool)
        for s, d in (new, *self.levels):
            at = np.minimum(np.searchsorted(s, suffixes), len(s) - 1)
            seen |= (s[at] == suffixes) & (d[at] < docs)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))
        return seen


def _match(sent: DataFrame) -> DataFrame:
    """For each sent context the windows that start in a smaller document, as bits; sent back to the context's chunk."""

    def run(table: pa.Table) -> pa.Table:
        anchors, docs = ([_unpack(x.as_py(), np.int64) for x in table.column(c)] for c in ("anchors", "docs"))
        sizes = [len(x) for x in anchors]
        anchors, docs = np.concatenate(anchors), np.concatenate(docs)
        rows = np.frombuffer(b"".join(_unzip(x.as_py()) for x in table.column("contexts")), np.uint8).reshape(-1, CONTEXT + 2)
        chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int64), sizes)
        order = np.lexsort((anchors, chunk, docs))
        first, which = _equal_contexts(rows[order])
        head = np.sort(first)  # the first of equal contexts in doc_id order
        smallest = docs[order][first][which]
        bits = np.zeros(len(order), np.uint32)
        copied = docs[order] > smallest
        n = rows[order][:, 1].astype(np.uint32) & np.uint32(SINGLE - 1)
        every = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        bits[copied] = every[copied].astype(np.uint32)
        # single windows of hot anchors, and contexts that no other context shares an anchor with, have their answer
        head = head[rows[order[head]][:, 1] < SINGLE]
        keys = np.ascontiguousarray(rows[order[head]][:, 2 + SPAN : 2 + SPAN + K]).view(f"S{K}").ravel()
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        head = head[count[at.ravel()] > 1]
        family, found = SuffixFamily(), {}
        for a in range(0, len(head), BATCH):
            own = head[a : a + BATCH]
            ctx = rows[order[own]]
            count = ctx[:, 1].astype(np.int64)
            of = np.repeat(np.arange(len(own)), count)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            begin = 2 + SPAN + 1 - ctx[of, 0].astype(np.int64) + step
            suffixes = np.ascontiguousarray(ctx[of[:, None], begin[:, None] + np.arange(LENGTH)[None, :]]).view(f"S{LENGTH}").ravel()
            seen = family.add(suffixes, docs[order[own]][of])
            found[a] = np.bincount(of, np.where(seen, 2.0 ** step, 0.0), len(own)).astype(np.uint32)
        for a, got in found.items():
            bits[head[a : a + BATCH]] |= got
        # equal contexts of the same smallest document share its answer
        lead = np.zeros(len(first), np.uint32)
        lead[which[np.sort(first)]] = bits[np.sort(first)]
        bits |= np.where(docs[order] == smallest, lead[which], 0).astype(np.uint32)
        hit = np.flatnonzero(bits)
        back_chunk, back_anchor, back_bits = chunk[order[hit]], anchors[order[hit]], bits[hit]
        out = [(c, _pack(back_anchor[at]), _pack(back_bits[at])) for c, at in _split_by(back_chunk)]
        return pa.table({"match_chunk": pa.array([x[0] for x in out], pa.int64()), "anchors": pa.array([x[1] for x in out], pa.binary()), "bits": pa.array([x[2] for x in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "match_chunk long, anchors binary, bits binary")


def _cut(chunks: DataFrame, shared: DataFrame, matches: DataFrame, buckets: int, digests: bool) -> DataFrame:
    """Pass 3: the kept bytes. shared tells again which anchors were sent, to give equal contexts of a chunk their first one's answer."""
    both = shared.select("back_chunk", "bucket", "hashes", "hot", F.lit(None).cast("binary").alias("anchors"), F.lit(None).cast("binary").alias("bits"))
    found = matches.select(F.col("match_chunk").alias("back_chunk"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("hot"), "anchors", "bits")

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.string() if digests else pa.binary())})
        c = _load(table)
        cover = np.zeros(len(c.data) + 1, np.int32)
        if back.num_rows:
            is_answer = np.array([b is None for b in back.column("bucket").to_pylist()])
            bits = np.zeros(len(c.hash), np.uint32)
            answers = back.filter(pa.array(is_answer))
            for x, y in zip(answers.column("anchors"), answers.column("bits"), strict=True):
                number, got = _unpack(x.as_py(), np.int64), _unpack(y.as_py(), np.uint32)
                place = np.maximum(number % 32 - 1, 0)
                np.bitwise_or.at(bits, number // 32, np.where(number % 32 > 0, (got & np.uint32(1)) << place.astype(np.uint32), got))
            for _, hot, number, first, which, _ in c.sent(back.filter(pa.array(~is_answer)), buckets):
                if hot:  # equal windows: the first one's answer, and later documents lose theirs
                    leads = np.sort(number[first])
                    of, k, distinct, window = c.windows(leads)
                    one = distinct[window]
                    docs = c.ids[c.doc[leads]]
                    seen = ((bits[leads[of[one]]] >> k[one].astype(np.uint32)) & np.uint32(1) == 1) | (docs[of] > docs[of[one]])
                    bits[leads] |= np.bincount(of, np.where(seen, 2.0**k, 0.0), len(leads)).astype(np.uint32)
                lead = number[first][which]
                later = c.ids[c.doc[number]] > c.ids[c.doc[lead]]
                every = ((np.uint64(1) << c.n[number].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
                bits[number] = np.where(later, every, bits[lead])
            hit = np.flatnonzero(bits)
            for k in range(int(c.n.max()) if len(c.n) else 0):
                begin = c.first[hit[(bits[hit] >> np.uint32(k)) & np.uint32(1) == 1]] + k
                cover[begin] += 1  # a window belongs to one anchor, so no place repeats
                cover[begin + LENGTH] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        removed, spans, kept = [], [], []
        for s, n in zip(c.starts.tolist(), c.sizes.tolist(), strict=True):
            own = gone[s : s + n]
            removed.append(int(own.sum()))
            spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
            rest = (c.data[s : s + n][~own] if removed[-1] else c.data[s : s + n]).tobytes()
            kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
        return pa.table({"doc_id": pa.array(c.ids), "n_bytes": pa.array(c.sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.string() if digests else pa.binary())})

    return chunks.groupBy("chunk").cogroup(both.unionByName(found).groupBy("back_chunk")).applyInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (`kept`, or their `kept_sha256`) of every row.

    Null texts count as empty; texts under LENGTH bytes lose nothing. Rows with a null id are taken as smaller than all ids (and keep a null id in the result);
    rows that repeat an id take nothing from each other. Empty tables give an empty result; other columns are not read.
    """
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = int(min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, 400 * total**0.5)))
    n = max(1, -(-total // size))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    chunks = _pieces(rows).repartition(n, "chunk")
    shared = _shared_hashes(_send_hashes(chunks, n)).where("length(hashes) + length(hot) > 0").withColumnRenamed("chunk", "back_chunk")
    matches = _match(_send_contexts(chunks, shared, n))
    out = _cut(chunks, shared, matches, n, digests)
    return out.select(F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256" if digests else "kept"))
