"""Word BPE encoding and decoding (operator 6) and the word-wise front end that operator 7 shares.

A text is normalised (NFC, white space, lower case), cut into pre-tokens, and each distinct
pre-token is merged once. Short words are merged with contiguous rank arrays: the ids of a word's
parts and the ranks of adjacent pairs lie side by side; the minimum is scanned for, its boundary
deleted, and the two neighbouring ranks refreshed, for all words of a length at once. Words of more than
LONG parts use a heap with the same merge order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import text_runs

# The white space of Unicode, and the pre-token pattern of the vocabulary file.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LONG = 96
NO_RANK = np.int32(2**31 - 1)
MOST_WORDS = 300_000  # words that a Python worker remembers between batches; beyond it starts afresh
SLICE_BYTES = 1_000_000

_space = regex.compile(f"[{SPACES}]+")
_odd_controls = regex.compile(r"[\x1c-\x1f]")
_pre_token = regex.compile(PRE_TOKEN.replace(r"\s", SPACES))


def byte_alphabet() -> list[str]:
    """The printable character for each byte value that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # single characters are lower-cased: no final sigma
            text = text.replace("Σ", "σ")
    return text.lower()


def words_of(text: str) -> list[str]:
    """White-space separated words of a normalised text."""
    if _odd_controls.search(text):
        return [w for w in _space.split(text) if w]
    return text.split()


class PairTable:
    """Open-addressing table from a pair of ids to the rank of its merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        self.bits = int(np.ceil(np.log2(max(4, len(left))))) + 2
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        for key, rank in zip(((left.astype(np.int64) << 32) | right).tolist(), ranks.tolist(), strict=True):
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == key, self.ranks[at], NO_RANK)
        left_over = np.flatnonzero((got != key) & (got >= 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[left_over]]
            hit = got == key[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (got >= 0)]
        return out


class WordBpe:
    """Merges pre-tokens with the ranks of a vocabulary file of the tokenizers library (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int32)
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        self.pairs = PairTable(left, right, np.arange(len(pairs), dtype=np.int32))
        alphabet = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in alphabet], np.int32)
        self.final = np.array([vocab.get(c + self.end, -1) for c in alphabet], np.int32)
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token, given as UTF-8."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > LONG:
                for r in rows.tolist():
                    out[r] = self._merge_long(words[r])
            elif n:
                block = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), n)
                ids = self.inner[block]
                ids[:, -1] = self.final[block[:, -1]]
                for at, got in self._merge_block(ids):
                    for r, x in zip(rows[at].tolist(), got, strict=True):
                        out[r] = x
        return out

    def _merge_block(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every live row loses one boundary in each round, so the arrays stay rectangular."""
        rows = np.arange(len(ids))
        n = ids.shape[1]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), n - 1) if n > 1 else np.zeros((len(ids), 0), np.int32)
        while len(rows):
            n = ids.shape[1]
            if n == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), at] != NO_RANK
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, ranks, at = rows[live], ids[live], ranks[live], at[live]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            new = self.merged[ranks[every, at]]
            keep = np.arange(n - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            ids[every, at] = new
            if n > 2:
                keep = np.arange(n - 2)[None, :]
                ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
                has = np.flatnonzero(at > 0)
                ranks[has, at[has] - 1] = self.pairs.find(ids[has, at[has] - 1], new[has])
                has = np.flatnonzero(at < n - 2)
                ranks[has, at[has]] = self.pairs.find(new[has], ids[has, at[has] + 1])
            else:
                ranks = np.zeros((len(rows), 0), np.int32)

    def _merge_long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.final[raw[-1]]
        first = self.pairs.find(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        one = np.zeros(1, np.int64)

        def rank(a: int, b: int) -> int:
            return int(self.pairs.find(one + a, one + b)[0])

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) < 0 or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (x := rank(ids[i], ids[after[i]])) != NO_RANK:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(ids[before[i]], ids[i])) != NO_RANK:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary file names no decoder, so token strings are joined by blanks."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class TextEncoder:
    """Encodes texts through the distinct words of a run of texts; `merge` turns new pre-tokens into ids."""

    def __init__(self, specials: dict[str, int], merge, most_words: int = MOST_WORDS):
        self.merge, self.specials, self.most_words = merge, specials, most_words
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.lead = os.path.commonprefix(list(specials))  # a quick test before the pattern
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.sizes, self.flat = np.zeros(0, np.int64), [np.zeros(0, np.int32)]

    def _words(self, text: str) -> list[str]:
        if self.special and self.lead in text and self.special.search(text):
            out = []
            for part in self.special.split(text):
                out += [part] if part in self.specials else words_of(normalise(part))
            return out
        return words_of(normalise(text))

    def _learn(self, words: list[str]) -> None:
        cut = [[w] if w in self.specials else _pre_token.findall(w) for w in words]
        distinct = list(dict.fromkeys(p for parts in cut for p in parts if p not in self.specials))
        ids = dict(zip(distinct, self.merge([p.encode() for p in distinct]), strict=True))
        ids |= {s: np.array([i], np.int32) for s, i in self.specials.items()}
        parts = [ids[p] for pieces in cut for p in pieces]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        total = np.append(0, np.cumsum(lengths))
        self.sizes = np.append(self.sizes, np.diff(np.append(0, total[ends])))
        self.flat.append(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        if len(self.known) > self.most_words:
            self.forget()
        had = len(self.known)
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._words(text)
            counts[i] = len(own)
            words += own
        codes = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        if len(self.known) > had:
            new = list(self.known)[had:] if had == 0 else [w for w in dict.fromkeys(words) if self.known[w] >= had]
            self._learn(new)
            self.flat = [np.concatenate(self.flat)]
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - sizes), sizes)
        upto = np.append(0, ends)[np.cumsum(counts)]
        return self.flat[0][at], np.diff(np.append(0, upto))


@functools.cache
def _own(path: str) -> tuple[WordBpe, TextEncoder]:
    bpe = WordBpe(path)
    return bpe, TextEncoder(bpe.specials, bpe.merge_words)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    ids, counts = _own(path)[1].encode(texts)
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


_RESULTS = {"ids": ArrayType(IntegerType()), "decoded": StringType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", results: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, and of each text what results names: token ids, the text decoded from them, or their SHA-256.

    A null or empty text has no ids and an empty decoded text; rows with null or repeated ids stay as they are, one result each; columns
    that are not named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = StructType([*fields, StructField("n_tokens", LongType()), *[StructField(r, _RESULTS[r]) for r in results]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _own(path)
        for batch in batches:
            for a, b, raw in text_runs(batch.column(1), SLICE_BYTES):
                flat, counts = encoder.encode([x.decode() for x in raw])
                ends = np.cumsum(counts)
                ids = [flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                got = {}
                if "ids" in results:
                    got["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                if "ids_sha256" in results:
                    got["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string())
                if {"decoded", "decoded_sha256"} & {*results}:
                    texts = [bpe.decode(x) for x in ids]
                    got["decoded"] = pa.array(texts, pa.string())
                    got["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())
                rest = [c[a:b] for i, c in enumerate(batch.columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts), *[got[r] for r in results]], names)

    return rows.mapInArrow(run, schema)
