"""Language ID (operator 1): interpolated Kneser-Ney character models in sorted hash arrays.

One model of order 4 per language. All n-grams seen in any language share one sorted array of 64-bit hashes per order, beside a
matrix of fully interpolated log probabilities (rows n-grams, columns languages); a second array per order holds the
back-off weights of contexts. A text goes to the language of lowest cross-entropy per character. A text is rejected if its cross-entropy, as a standard score that
allows for length, is beyond a limit set by a quantile of the held-back training documents of that language.

The models are fitted on a bounded sample: at most about `sample_docs` documents of each language (a hash threshold on the id,
documented bound); every text is then scored whole. Counting and scoring of held-back texts are distributed, the sample's n-gram counts are smoothed
in one task, and the driver gets the finished arrays and a few numbers for each held-back text.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashIndex, byte_texts, slices, text_runs

ORDER = 4
SAMPLE_DOCS = 4_000
CALIBRATION = 4  # one document in so many of the sample is held back from the counts
FEW, QUANTILE, MARGIN = 200, 0.995, 1.75  # the limit of rejection: so many times this quantile of the held-back standard scores; about one in 1,000 documents like them is beyond it
SLICE_CHARS = 150_000
STEP, FINISH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form (one character; white space and controls become a blank), and whether it is a letter."""
    n = 0x110000
    low, letter = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for i in range(0x323B0):  # no cased or assigned letters beyond
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low[i] = ord(c.lower()[0])
        elif c.isspace() or i < 32:
            low[i] = 32
    return low, letter


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts, each after ORDER - 1 blanks; their starts, lengths, and whether each has a letter."""
    pad = " " * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    low, letter = _folding()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    has = np.zeros(len(texts), bool)
    full = np.flatnonzero(lengths)
    if len(full):
        counts = np.add.reduceat(letter[raw].astype(np.int32), starts[full])
        has[full] = counts > 0
    return low[raw], starts, lengths, has


def _rolling(symbols: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each position from ORDER - 1 on, for n = 1 .. ORDER."""
    s = symbols.astype(np.uint64) + np.uint64(1)
    out, h = [s[ORDER - 1 :] * FINISH], s
    for n in range(2, ORDER + 1):
        h = h[:-1] * STEP + s[n - 1 :]
        out.append(h[ORDER - n :] * FINISH)
    return out


def _hash_grams(grams: np.ndarray) -> np.ndarray:
    """The same hashes of n-grams given as rows of code points."""
    h = grams[:, 0].astype(np.uint64) + np.uint64(1)
    for i in range(1, grams.shape[1]):
        h = h * STEP + (grams[:, i].astype(np.uint64) + np.uint64(1))
    return h * FINISH


class KneserNey:
    """Models of all languages, from counts n of the longest n-grams (rows of code points); lang numbers their languages' names."""

    def __init__(self, names: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.languages, place = [names[i] for i in order], np.argsort(order)
        lang = place[lang]
        grams, which = np.unique(grams, axis=0, return_inverse=True)
        c = np.zeros((len(grams), len(self.languages)))
        np.add.at(c, (which.ravel(), lang), n)
        levels = {ORDER: (grams, c)}
        for n in range(ORDER - 1, 0, -1):  # a shorter n-gram counts the distinct symbols before it
            longer, seen = levels[n + 1]
            short, at = np.unique(longer[:, 1:], axis=0, return_inverse=True)
            c = np.zeros((len(short), len(self.languages)))
            np.add.at(c, at.ravel(), (seen > 0).astype(float))
            levels[n] = (short, c)
        symbols = len(levels[1][0]) + 1
        self.tables, self.contexts = [], []
        lower = np.full((1, len(self.languages)), 1.0 / symbols)
        lower_at, self.floor = None, np.zeros(len(self.languages))
        for n in range(1, ORDER + 1):
            grams, c = levels[n]
            one, two = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95)
            heads, at = np.unique(grams[:, :-1], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0), np.uint32), np.zeros(len(grams), np.int64))
            at = at.ravel()
            total, kinds = np.zeros((len(heads), c.shape[1])), np.zeros((len(heads), c.shape[1]))
            np.add.at(total, at, c)
            np.add.at(kinds, at, (c > 0).astype(float))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                below = np.repeat(lower, len(grams), 0)
                self.floor = np.log(back[0] / symbols)
            else:
                below = lower[lower_at(grams[:, 1:])]
            p = np.where(total[at] > 0, np.maximum(c - discount, 0) / np.maximum(total[at], 1), 0) + back[at] * below
            index = HashIndex(_hash_grams(grams))
            self.tables.append((index, np.log(p)[index.order].astype(np.float32)))
            if n > 1:
                head_index = HashIndex(_hash_grams(heads))
                self.contexts.append((head_index, np.log(back)[head_index.order].astype(np.float32)))
            lower, lower_at = p[index.order], lambda g, index=index: index.find(_hash_grams(g))

    def _log_p(self, h: list[np.ndarray], heads: list[np.ndarray], n: int) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the symbols before it; heads: hashes of its context, by length."""
        index, values = self.tables[n - 1]
        at = index.find(h[n - 1])
        out = values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if n == 1:
                out[miss] = self.floor
            else:
                context, back = self.contexts[n - 2]
                found = context.find(heads[n - 2][miss])
                extra = back[found]
                extra[found < 0] = 0
                out[miss] = extra + self._log_p([x[miss] for x in h[: n - 1]], [x[miss] for x in heads[: n - 2]], n - 1)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character of each text under each language; the lengths; whether each has a letter."""
        symbols, starts, lengths, has = _symbols(texts)
        h = _rolling(symbols)
        ends = np.arange(len(symbols) - ORDER + 1)
        inside = np.ones(len(ends), bool)  # positions of padding before a later text are no symbols of it
        gaps = (starts[1:, None] - np.arange(ORDER, 2 * ORDER - 1)[None, :]).ravel()
        inside[gaps[gaps >= 0]] = False
        at = ends[inside]
        heads = [np.concatenate([np.zeros(1, np.uint64), x[:-1]])[at] for x in h[:-1]]
        if len(at) and at[0] == 0:  # the first text's first context: blanks alone
            for n in range(1, ORDER):
                heads[n - 1][0] = _hash_grams(np.full((1, n), 32, np.uint32))[0]
        log_p = self._log_p([x[at] for x in h], heads, ORDER)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(lengths)
        if len(full):
            out[full] = -np.add.reduceat(log_p, (np.cumsum(lengths) - lengths)[full], axis=0, dtype=np.float64) / lengths[full, None]
        return out, lengths, has


def _long_safe(model: KneserNey, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cross_entropy in runs of texts; a text beyond a run's size is scored in pieces that overlap by the context."""
    out, lengths, has = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for a, b in slices([len(t) for t in texts], SLICE_CHARS):
        if b - a == 1 and len(texts[a]) > 2 * SLICE_CHARS:
            text, total = texts[a], np.zeros(len(model.languages))
            for i in range(0, len(text), SLICE_CHARS):
                lead = min(i, ORDER - 1)
                h, n, any_letter = model.cross_entropy([text[i - lead : i + SLICE_CHARS]])
                total += h[0] * n[0]
                if lead:
                    h, n, _ = model.cross_entropy([text[i - lead : i]])
                    total -= h[0] * n[0]
                has[a] |= any_letter[0]
            out[a], lengths[a] = total / len(text), len(text)
        else:
            out[a:b], lengths[a:b], has[a:b] = model.cross_entropy(texts[a:b])
    return out, lengths, has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        texts = np.array([x.decode() for x in byte_texts(batch.column(0))], object)
        for lang in set(langs.tolist()):
            own = texts[langs == lang].tolist()
            for a, b in slices([len(t) for t in own], SLICE_CHARS):
                symbols, starts, lengths, _ = _symbols(own[a:b])
                ends = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)] or [np.zeros(0, np.int64)])
                _, first, n = np.unique(_rolling(symbols)[-1][ends - ORDER + 1], return_index=True, return_counts=True)
                grams = np.ascontiguousarray(symbols[ends[first][:, None] + np.arange(1 - ORDER, 1)[None, :]]).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _fitted(table: pa.Table) -> pa.Table:
    grams = np.concatenate([np.frombuffer(c.buffers()[2], "<u4")[c.offset * ORDER : (c.offset + len(c)) * ORDER] for c in table.column("gram").chunks if len(c)]).reshape(-1, ORDER)
    langs = table.column("lang").combine_chunks().dictionary_encode()
    names = langs.dictionary.to_pylist()
    model = KneserNey(names, langs.indices.to_numpy(), grams, table.column("n").to_numpy())
    return pa.table({"model": pa.array([pickle.dumps(model, 5)], pa.binary())})


@functools.lru_cache(1)
def _unpacked(blob: bytes) -> KneserNey:
    return pickle.loads(blob)


def _posterior(h: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    z = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * t
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Identifier:
    """The models (packed) with what calibration has set: a temperature for scores and, per language, centre and spread of cross-entropy and the limit of rejection."""

    blob: bytes
    temperature: float
    mean: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    @property
    def model(self) -> KneserNey:
        return _unpacked(self.blob)

    def excess(self, h: np.ndarray, n: np.ndarray, i) -> np.ndarray:
        """Standard scores of cross-entropies; short texts vary more (about 2.5 nats a character)."""
        return (h - self.mean[i]) / (self.spread[i] + 2.5 / np.sqrt(np.maximum(n, 1)))

    @classmethod
    def calibrated(cls, blob: bytes, y: np.ndarray, h: np.ndarray, n: np.ndarray) -> Identifier:
        """y, h, n: the language's number, the cross-entropy under each language and the length of held-back texts.

        The limit of a language is MARGIN times the QUANTILE of the standard scores of its held-back texts (of all languages', if it has fewer than FEW): a few junk
        texts among them don't set it.
        """
        k, temperature, best = h.shape[1], 1.0, np.inf
        for t in np.geomspace(0.05, 50, 25):
            p = _posterior(h, n, t)
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).sum() if len(y) else 0.0
            if loss < best:
                temperature, best = float(t), loss
        own = h[np.arange(len(y)), y] if len(y) else np.zeros(0)
        centre = lambda x: (np.median(x), max(0.02, 1.4826 * float(np.median(np.abs(x - np.median(x)))))) if len(x) >= 5 else None
        pooled = centre(own) or (3.0, 1.0)
        mean, spread = np.array([centre(own[y == i]) or pooled for i in range(k)]).T
        out = cls(blob, temperature, mean, spread, np.full(k, 8.0))
        z = out.excess(own, n, y)
        for i in range(k):
            mine = z[y == i] if (y == i).sum() >= FEW else z
            if len(mine) >= 5:
                out.limit[i] = MARGIN * max(1.0, float(np.quantile(mine, QUANTILE)))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        h, n, has = _long_safe(self.model, [t or "" for t in texts])
        best = h.argmin(axis=1)  # a tie goes to the first language by name
        every = np.arange(len(texts))
        score = np.where(has, _posterior(h, n, self.temperature)[every, best], 0.0)
        own = h[every, best]
        rejected = ~has | (self.excess(own, n, best) > self.limit[best])
        return [self.model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], score, np.where(has, own, 0.0), rejected


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Identifier | None:
    """Models of the languages of rows where `training` holds, text and language are given. None if there is no such row.

    What comes to the driver is bounded by sample_docs per language: the packed models and a row of numbers for each held-back text.
    """
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20))
    rows = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), spot.alias("spot"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    keep = F.lit(False)
    for lang, n in sorted(sizes.items()):
        keep = keep | ((F.col("lang") == lang) & (F.col("spot") < int((1 << 20) * min(1.0, sample_docs / n))))
    sample = rows.where(keep)
    held_back = F.col("spot") % CALIBRATION == 0

    def fitted(texts: DataFrame) -> bytes | None:
        counts = texts.select("text", "lang").mapInArrow(_count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        found = counts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fitted, "model binary").first()
        return bytes(found["model"]) if found else None

    blob = fitted(sample.where(~held_back)) or fitted(sample)  # a handful of rows: use them all for both
    if blob is None:
        return None
    sent = SparkSession.active().sparkContext.broadcast(blob)  # bounded by the fitted sample

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpacked(sent.value)
        number = {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            h, n, has = _long_safe(model, [x.decode() for x in byte_texts(batch.column(0))])
            y = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            ok = np.flatnonzero(has & (y >= 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.shape[1] * len(ok) + 1, h.shape[1], dtype=np.int32)), pa.array(h[ok].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(y[ok]), lists, pa.array(n[ok])], ["y", "h", "n"])

    check = sample.where(held_back).select("text", "lang").mapInArrow(measure, "y long, h array<double>, n long").collect()
    k = len(_unpacked(blob).languages)
    y, h, n = np.array([r["y"] for r in check], np.int64), np.array([r["h"] for r in check], float).reshape(-1, k), np.array([r["n"] for r in check], np.int64)
    sent.destroy()
    return Identifier.calibrated(blob, y, h, n)


def identification(text: Column, identifier: Identifier | None) -> Column:
    """Struct of lang_pred, score (0 to 1), xent (nats per character) and rejected for a text column.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is everything without an identifier (nothing to learn from).
    """
    session = SparkSession.active()
    sent = session.sparkContext.broadcast(identifier)  # bounded by the fitted sample
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("xent", pa.float64()), pa.field("rejected", pa.bool_())]

    def run(texts: pa.Array) -> pa.Array:
        model, out = sent.value, []
        for _, _, raw in text_runs(texts, SLICE_CHARS):
            own = [x.decode() for x in raw]
            lang, score, xent, rejected = model.predict(own) if model else (["und"] * len(own), np.zeros(len(own)), np.zeros(len(own)), np.ones(len(own), bool))
            out.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(xent), pa.array(rejected)], fields=fields))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(fields))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    once = F.arrow_udf(run, "lang_pred string, score double, xent double, rejected boolean").asNondeterministic()  # so that filters and fields of the result don't run it again
    return once(text)


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, xent and rejected of every row; only the text decides.

    Null or repeated ids give a result each; very long texts are scored whole, in pieces; equal cross-entropies go to the first language by name; an empty table
    gives an empty result; other columns are not read.
    """
    found = identification(F.col(text_col).cast("string"), identifier)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
