"""Quality rules (operator 11): cross-document line frequency, DataFrame functions only.

Lines are normalised (lower case, blanks collapsed) and hashed. For each host the distinct texts that hold a line are counted, so that copies of one text
count once; a line in more texts than the host's limit is boilerplate and goes wherever it stands. A document is rejected if too few of its words are left or
if the base rules fail it. Texts are read once: what the rules need of them (counts, line hashes) is written as a table that all later steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: A line is frequent in a host if over LEAST_TEXTS texts and over SHARE of the host's texts hold it; a document keeps LEFT of its words at least.
LEAST_TEXTS, SHARE, LEFT = 20, 0.005, 0.3
LEAST_WORDS, MOST_REPEATED = 50, 0.5
BROADCAST_ROWS = 100_000
BLANKS, BLANK_RUN, SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Positions take the low bits of a window's key. No row can hold an array of 2^27 words, as each takes 16 bytes of at most 2^31.
POSITION = (1 << 27) - 1


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _normal_lines(text: Column) -> Column:
    """The lines of a text that have a word, in lower case and with single blanks."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    plain = F.lower(F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _statistics(docs: DataFrame) -> DataFrame:
    """doc_id, host, hash of the text, the base counts, and (hash, words) of each line with a word.

    Three-word windows get a key of hash and position. Keys that agree in the hash are neighbours once sorted; of these few the words themselves decide.
    """
    df = docs.withColumn("t", F.xxhash64("text")).withColumn("words", F.split(_trimmed(F.col("text")), BLANK_RUN)).withColumn("n_words", F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")))
    key = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long"))
    df = df.withColumn("keys", F.sort_array(F.transform("words", key)))
    low = lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")
    places = F.filter(F.transform("keys", lambda x, i: F.when(F.shiftrightunsigned(x.bitwiseXOR(F.get("keys", i + 1)), 27) == 0, i)), lambda i: i.isNotNull())
    df = df.withColumn("places", places)
    both = F.flatten(F.transform("places", lambda i: F.array(low(F.get("keys", i)), low(F.get("keys", i + 1)))))
    df = df.withColumn("likely", F.array_distinct(both))
    window = lambda p: F.struct(F.get("words", p).alias("a"), F.get("words", p + 1).alias("b"), F.get("words", p + 2).alias("c"), p.alias("p"))
    df = df.withColumn("windows", F.sort_array(F.transform(F.filter("likely", lambda p: p < F.col("n_words") - 2), window)))
    near = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = F.filter("windows", lambda x, i: near(x, F.get("windows", i - 1)) | near(x, F.get("windows", i + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != ""))
    count = lambda c: c.cast("long")
    return df.select(
        "doc_id", "host", "t",
        count(F.col("n_words")).alias("n_words"),
        count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        count(covered).alias("n_repeat_words"),
        F.transform(_normal_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))).alias("entries"),
    )


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    host = F.col(host_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _removals(stats: DataFrame, least_texts: int, share: float) -> DataFrame:
    """host, t, n_lines_removed, words_removed, hashes: of each distinct text of a host what its frequent lines are."""
    texts = settled(stats.groupBy("host", "t").agg(F.first("entries").alias("entries")), "texts")
    lines = texts.select("host", "t", F.explode("entries").alias("e")).select("host", "t", F.col("e.h").alias("h"), F.col("e.n").alias("n"))
    limit = texts.groupBy("host").agg(F.greatest(F.lit(float(least_texts)), F.count("*") * F.lit(share)).alias("most"))
    counted = texts.select("host", F.explode(F.array_distinct(F.transform("entries", lambda e: e["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > least_texts)
    frequent = settled(counted.join(_small(limit), "host").where("n_texts > most").select("host", "h"), "frequent")
    hits = lines.join(_small(frequent), ["host", "h"])
    return settled(hits.groupBy("host", "t").agg(F.count("*").alias("n_lines_removed"), F.sum("n").alias("words_removed"), F.collect_set("h").alias("hashes")), "removals")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_texts: int = LEAST_TEXTS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, words_left: one row for each row of docs.

    Null texts count as empty; they and texts without words fail the base rules. Null hosts are a host of their own. Null and repeated ids are judged by their
    row. Ties do not occur: a line at its limit stays. Texts are told apart by 64 bits. An empty table gives an empty result; long texts are taken whole.
    """
    stats = settled(_statistics(_rows(docs, id_col, text_col, host_col)), "line-statistics")
    removed = _removals(stats, least_texts, share).drop("hashes")
    gone, lines = F.coalesce("words_removed", F.lit(0)), F.coalesce("n_lines_removed", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * MOST_REPEATED)
    out = stats.drop("entries").join(_small(removed), ["host", "t"], "left").withColumn("words_left", F.col("n_words") - gone).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("words_left") >= F.col("n_words") * left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), lines.alias("n_lines_removed"), "words_left")


def without_frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", least_texts: int = LEAST_TEXTS, share: float = SHARE) -> DataFrame:
    """docs with the frequent lines taken out of their texts; other columns and null texts stay as they are."""
    keyed = _rows(docs, text_col, text_col, host_col)
    stats = settled(_statistics(keyed).select("host", "t", "entries"), "line-statistics")
    removed = _removals(stats, least_texts, share).select("host", "t", "hashes")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    key = _rows(docs.select(row, F.col(text_col).alias("__t"), F.col(host_col).alias("__h")).withColumn("__i", F.col("row")), "__i", "__t", "__h").select(F.col("doc_id").alias("row"), "host", F.xxhash64("text").alias("t"))
    normal = lambda x: F.xxhash64(F.trim(F.lower(F.regexp_replace(x, BLANK_RUN, " "))))
    stay = F.filter(F.split(F.col("row")[text_col], "\n"), lambda x: (_trimmed(x) == "") | ~F.array_contains("hashes", normal(x)))
    text = F.when(F.col("hashes").isNull(), F.col("row")[text_col]).otherwise(F.array_join(stay, "\n"))
    return key.join(_small(removed), ["host", "t"], "left").select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY r),
line AS (SELECT r, host, text, lower(array_to_string(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'), ' ')) AS x FROM (SELECT r, host, text, unnest(l) AS x FROM w)),
lim AS (SELECT host, greatest({LEAST_TEXTS}, {SHARE} * count(DISTINCT text)) AS most FROM d GROUP BY host),
freq AS (SELECT host, x FROM line JOIN lim USING (host) GROUP BY host, x, most HAVING count(DISTINCT text) > most),
gone AS (SELECT r, count(*) AS n_lines_removed, CAST(sum(len(string_split(x, ' '))) AS BIGINT) AS n FROM line JOIN freq USING (host, x) GROUP BY r),
base AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(n, 0) >= {LEFT} * n_words AS kept,
  coalesce(n_lines_removed, 0) AS n_lines_removed, n_words - coalesce(n, 0) AS words_left
FROM failed LEFT JOIN gone USING (r)
"""
