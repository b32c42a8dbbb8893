"""LM scoring (operator 9): marginal document probability over subword lattices.

The unigram scores of an existing vocabulary weight all segmentations of a text: in the lattice of a word each piece of the vocabulary is an arc, and a log-space
forward recursion over byte positions sums all paths. Segments don't cross white space, so a text's marginal is the product of its words' and of its end.
The training documents add to the lattice what they show:
* the expected uses of each piece over all training words, with paths weighted by the vocabulary's scores, join these scores, which count as PRIOR uses;
* each training word of count c is an arc of its own, of weight (c - D) / N, and the discounted mass D * V / N goes to the pieces:
  P(w) = (max(c - D, 0) + D * V * lattice(w)) / N, with N tokens, V distinct words, and D from the words seen once and twice. The end of a text has count / N.
All training documents are counted. Words are counted and scored once each in a distributed table; documents look up the HOT most frequent words in a
broadcast of that bounded size and join the others by word.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, byte_texts, settled, text_runs

HOT = 100_000
MOST_WORDS = 400_000  # distinct words counted in a worker before they are passed on
PRIOR = 50_000.0  # uses that the vocabulary's own scores stand for, beside those of the training words
LONG = 64  # longer words are taken one by one, in a scalar form of the same recursions
BLOCK = 20_000
BASE = np.uint64(0x100000001B3)
FINISH = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces as byte strings (the word-start mark is a blank) with log weights; first pieces and later ones are normalised apart."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {}
        scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        ranks = bool((scores == np.round(scores)).all()) and scores.min() < -100  # scores of merge vocabularies are negative ranks
        least = -np.log(1 - scores.min()) if ranks else scores.min()
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                piece, w = bytes([int(model.id_to_piece(i)[3:5], 16)]), least - 2
            else:
                piece, w = model.id_to_piece(i).replace("▁", " ").encode(), -np.log(1 - scores[i]) if ranks else scores[i]
            if piece and b" " not in piece[1:] and piece not in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
                weights[piece] = float(np.logaddexp(weights[piece], w)) if piece in weights else float(w)
        for b in range(256):
            weights.setdefault(bytes([b]), float(least - 4))
        self.pieces = sorted(weights)
        self.first = np.array([p[:1] == b" " for p in self.pieces])
        self.lengths = np.array([len(p) for p in self.pieces])
        self.longest = int(self.lengths.max())
        h = np.zeros(len(self.pieces), np.uint64)
        for i, p in enumerate(self.pieces):
            x = 0
            for b in p:
                x = (x * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            h[i] = np.uint64((x * int(FINISH)) & 0xFFFFFFFFFFFFFFFF)
        self.index = HashIndex(h)
        self.stop = np.log(1 / 3)
        self.prior = np.exp(np.array([weights[p] for p in self.pieces]))
        self.prior /= self.prior.sum()
        self.set(self.prior.copy(), None)

    def set(self, weight: np.ndarray, stop: float | None) -> None:
        """Normalises weights; a later piece also competes with the end of the word, of probability stop."""
        for part in (self.first, ~self.first):
            weight[part] /= weight[part].sum()
        if stop is not None:
            self.stop = float(np.log(np.clip(stop, 1e-3, 0.999)))
        self.log_p = np.log(weight)
        self.sorted_log_p = self.log_p[self.index.order]

    def learn(self, uses: np.ndarray, words: float) -> None:
        """Joins expected uses of the pieces over a number of words to the vocabulary's scores."""
        self.set(PRIOR * self.prior + uses, words / max(float(uses.sum()), 1.0))

    @functools.cached_property
    def known(self) -> dict[bytes, tuple[float, int]]:
        return {p: (w, i) for i, (p, w) in enumerate(zip(self.pieces, self.log_p.tolist(), strict=True))}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def _arcs(self, block: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For each (start, end) in words of one length: rows that have a piece there, and the piece's place in sorted order."""
        n, size = block.shape
        prefix, powers = [np.zeros(n, np.uint64)], [np.uint64(1)]
        with np.errstate(over="ignore"):
            for i in range(size):
                prefix.append(prefix[-1] * BASE + block[:, i].astype(np.uint64) + np.uint64(1))
                powers.append(powers[-1] * BASE)
            arcs = {}
            for j in range(1, size + 1):
                for i in range(max(0, j - self.longest), j):
                    at = self.index.find((prefix[j] - prefix[i] * powers[j - i]) * FINISH)
                    rows = np.flatnonzero(at >= 0)
                    if len(rows):
                        arcs[i, j] = rows, at[rows]
        return arcs

    def _forward(self, arcs, n: int, size: int) -> np.ndarray:
        go = np.log1p(-np.exp(self.stop))
        a = np.full((size + 1, n), -np.inf)
        a[0] = 0
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                if (found := arcs.get((i, j))) is not None:
                    rows, piece = found
                    a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + self.sorted_log_p[piece] + (go if i else 0.0))
        return a

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            step = max(1, BLOCK * 8 // (size + 1) // (1 + size // 16))
            for a in range(0, len(rows), step):
                own = rows[a : a + step]
                yield own, np.frombuffer(b"".join([b" " + words[r] for r in own.tolist()]), np.uint8).reshape(len(own), size + 1)

    def _long_forward(self, raw: bytes) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Forward sums of one long word, and for each end the arcs (start, weight, piece) into it."""
        known, go, a, arcs = self.known, float(np.log1p(-np.exp(self.stop))), [0.0], [[]]
        for j in range(1, len(raw) + 1):
            into = [(i, hit[0] + (go if i else 0.0), hit[1]) for i in range(max(0, j - self.longest), j) if (hit := known.get(raw[i:j])) is not None]
            terms = [a[i] + w for i, w, _ in into]
            most = max(terms, default=-math.inf)
            a.append(most + math.log(sum(math.exp(t - most) for t in terms)) if most > -math.inf else -math.inf)
            arcs.append(into)
        return a, arcs

    def _long_uses(self, raw: bytes, uses: np.ndarray) -> None:
        a, arcs = self._long_forward(raw)
        b = [-math.inf] * len(raw) + [0.0]
        for j in range(len(raw), 0, -1):
            for i, w, piece in arcs[j]:
                arc = w + b[j]
                uses[piece] += math.exp(a[i] + arc - a[-1])
                b[i] = float(np.logaddexp(b[i], arc))

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's lattice probability."""
        out = np.zeros(len(words))
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            out[i] = self._long_forward(b" " + words[i])[0][-1] + self.stop
        at = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
        for rows, block in self._blocks([words[i] for i in at.tolist()]):
            out[at[rows]] = self._forward(self._arcs(block), *block.shape)[-1] + self.stop
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over the words."""
        uses, go = np.zeros(len(self.pieces)), np.log1p(-np.exp(self.stop))
        for _, block in self._blocks([w for w in words if len(w) <= LONG]):
            n, size = block.shape
            arcs = self._arcs(block)
            a = self._forward(arcs, n, size)
            b = np.full((size + 1, n), -np.inf)
            b[size] = 0
            for i in range(size - 1, -1, -1):
                for j in range(i + 1, min(size, i + self.longest) + 1):
                    if (found := arcs.get((i, j))) is not None:
                        rows, piece = found
                        arc = self.sorted_log_p[piece] + (go if i else 0.0) + b[j, rows]
                        uses += np.bincount(piece, np.exp(a[i, rows] + arc - a[size, rows]), len(uses))
                        b[i, rows] = np.logaddexp(b[i, rows], arc)
        out = np.zeros(len(self.pieces))
        out[self.index.order] = uses
        for w in words:
            if len(w) > LONG:
                self._long_uses(b" " + w, out)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their occurrences t in all texts and c in training texts."""
    counts: dict[bool, dict[bytes, int]] = {True: {}, False: {}}

    def out() -> Iterator[pa.RecordBatch]:
        for learnt, own in counts.items():
            n = np.fromiter(own.values(), np.int64, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(n), pa.array(n * learnt)], ["word", "t", "c"])
            own.clear()

    for batch in batches:
        learnt = batch.column(1).to_pylist()
        for a, _, raw in text_runs(batch.column(0), 2_000_000):
            for k, text in enumerate(raw):
                own = counts[learnt[a + k]]
                get = own.get
                for w in text.lower().split():
                    own[w] = get(w, 0) + 1
                if sum(map(len, counts.values())) > MOST_WORDS:
                    yield from out()
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, its count t in all texts and c in those where `learnt` holds."""
    return docs.select("text", "learnt").mapInArrow(_count, "word binary, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.1, one / max(1, one + 2 * two)))


class HotWords:
    """A table (word, base, c, log_p) of words that is sent to the executors, and there a dictionary of their numbers, made once."""

    def __init__(self, table: pa.Table):
        self.table = table

    @functools.cached_property
    def found(self) -> tuple[dict[bytes, int], list[np.ndarray]]:
        """Numbers of words, and per number the base, whether it is known, and the log probability (0 beyond the last)."""
        column = lambda name: self.table.column(name).to_numpy()
        return {w: i for i, w in enumerate(self.table.column("word").to_pylist())}, [np.append(x, 0.0) for x in (column("base"), (column("c") > 0).astype(float), column("log_p"))]

    def __getstate__(self):
        return {"table": self.table}


def score(docs: DataFrame, path: str, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the text's words with A-Z lower-cased, then one end. training: a Column over doc_id; rows where it is null are not learned from. A null or empty text
    is the end alone. Words of any length have their whole lattice. Null or repeated ids give a result each; other columns are not read. Without training rows the
    base is log10(1 / 1) a token and the model the vocabulary's own lattice, with an end of one half.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("learnt"))
    n_docs = rows.where("learnt").count()
    words = settled(word_counts(rows), "words")
    stats = words.agg(F.sum("c").alias("n"), *[F.count_if(x).alias(name) for name, x in (("v", F.col("c") > 0), ("one", F.col("c") == 1), ("two", F.col("c") == 2))]).first()
    n, v = (stats["n"] or 0) + n_docs, stats["v"] + (n_docs > 0)
    discount = _discount(stats["one"], stats["two"])

    pieces = Pieces(path)
    if stats["v"]:
        prior = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses = 0.0
            for batch in batches:
                uses = uses + prior.value.expected(batch.column(0).to_pylist())
            at = np.flatnonzero(uses)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], ["piece", "uses"])

        got = words.where("c > 0").select("word").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row a piece at most
        uses = np.zeros(len(pieces.pieces))
        uses[got.column("piece").to_numpy()] = got.column("uses").to_numpy()
        pieces.learn(uses, float(stats["v"]))
        prior.destroy()
    sent = spark.sparkContext.broadcast(pieces)
    spread, room = np.log10(n + v + 1), discount * stats["v"]

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(2).to_numpy().astype(float)
            log_l = sent.value.log_words(batch.column(0).to_pylist())
            with np.errstate(divide="ignore"):
                log_p = np.logaddexp(np.log(np.maximum(c - discount, 0)), np.log(room) + log_l) - np.log(n) if n > n_docs else log_l - np.log(2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.log10(c + 1) - spread), pa.array(log_p / np.log(10))], ["word", "t", "c", "base", "log_p"])

    valued = settled(words.mapInArrow(value, "word binary, t long, c long, base double, log_p double"), "words")
    # words by occurrences in steps of 2^(1/32), so that those of the upper steps are at most HOT
    step = F.floor(F.log2("t") * 32).cast("int")
    least, left = None, HOT
    for r in sorted(valued.where("t > 1").groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        least, left = r["step"], left - r["count"]
    hot = valued.where("t > 1").where(step >= (least if least is not None else 1 << 20)).select("word", "base", "c", "log_p").toArrow()
    numbers = spark.sparkContext.broadcast(HotWords(hot))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with its length and what its hot words add, then a row for each other word of it."""
        known, terms = numbers.value.found
        names = ["row", "doc_id", "word", "tf", "n_words", "base", "n_known", "log_p"]
        for batch in batches:
            for a, b, raw in text_runs(batch.column(2), 2_000_000):
                texts = [x.lower().split() for x in raw]
                sizes = np.fromiter(map(len, texts), np.int64, b - a)
                flat = [w for t in texts for w in t]
                at = np.fromiter((known.get(w, -1) for w in flat), np.int64, len(flat))
                of = np.repeat(np.arange(b - a), sizes)
                sums = [np.bincount(of, terms[k][at], b - a).astype(float) for k in range(3)]
                tf: dict[tuple[int, bytes], int] = {}
                for i, w in zip(of[at < 0].tolist(), (flat[k] for k in np.flatnonzero(at < 0).tolist()), strict=True):
                    tf[i, w] = tf.get((i, w), 0) + 1
                row = batch.column(0)[a:b]
                own = np.fromiter((k[0] for k in tf), np.int64, len(tf))
                keys = row.to_numpy()
                none = [b" %d" % k for k in keys.tolist()]  # matches no word and spreads over the join's partitions
                yield pa.RecordBatch.from_arrays([row, batch.column(1)[a:b], pa.array(none, pa.binary()), pa.array(np.zeros(b - a, np.int64)), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], names)
                nulls = [pa.nulls(len(tf), kind) for kind in (pa.int64(), pa.float64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.nulls(len(tf), pa.int64()), pa.array([k[1] for k in tf], pa.binary()), pa.array(np.fromiter(tf.values(), np.int64, len(tf))), *nulls], names)

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(look_up, "row long, doc_id long, word binary, tf long, n_words long, base double, n_known long, log_p double")
    terms = valued.select("word", "c", F.col("base").alias("w_base"), F.col("log_p").alias("w_log_p"))
    either = lambda own, word: F.sum(F.coalesce(own, F.col("tf") * F.col(word), F.lit(0.0)))
    joined = parts.join(terms, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        (F.sum("n_words") + 1).alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("tf")), F.lit(0))) + int(n_docs > 0)).alias("n_known"),
        either(F.col("base"), "w_base").alias("base_score"),
        either(F.col("log_p"), "w_log_p").alias("score"),
    )
    end_base, end = float(np.log10(n_docs + 1) - spread), float(np.log10(n_docs / n if n_docs else 0.5))
    return joined.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + end_base).alias("base_score"), (F.col("score") + end).alias("score"))
