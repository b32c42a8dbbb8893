"""URL filters (operator 4): a trie over reversed host labels and path segments, with longest-match precedence.

Host and path are cut by SQL functions; the trie is broadcast after a check of its size and looked up in Arrow batches. More than MOST_RULES rules are
joined instead, on the same nodes: each distinct host and path meets the rules of its host's suffixes and of its path's closed segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MOST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Trie:
    """Host labels from the right, then path segments. The last, open segment of a rule is a prefix within its node.

    A deeper host wins over a shallower one, and on one host the longer path wins; of rules equal in both the first given counts.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *closed, last = rule.path.split("/")
            for segment in closed:
                node = node.setdefault(segment, {})
            ends = node.setdefault("/", {})
            ends.setdefault(last, (rule.text, rule.verdict))

    @staticmethod
    def _best_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            ends = node.get("/")
            if ends:
                for n in range(len(segment), -1, -1):
                    if (hit := ends.get(segment[:n])) is not None:
                        best = hit
                        break
            if i == len(segments) - 1:
                break
            node = node.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        if not host:
            return None
        node, best, segments = self.root, None, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                segments = segments or path.split("/")
                best = self._best_path(node["/"], segments) or best
        return best


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _joined(cut: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same judgement by equi-joins: on a suffix of the host and the rule's closed path segments, then by the rule's open segment.

    Rules have verdict, host, path and place (of equal rules the least counts). Only distinct hosts and paths are joined, so repeated urls cost one row.
    """
    deepest = rules.agg(F.max(F.size(F.split("path", "/", -1)))).first()[0] or 1  # no rule looks at further segments
    prefixes = lambda text, end: F.transform(F.sequence(F.lit(1), F.least(F.size(text), F.lit(deepest))), lambda n: F.concat_ws(end, F.slice(text, 1, n)))
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, n, F.size(labels))))
    sites = cut.where("host <> ''").select("host", "path").distinct()
    asked = sites.select("host", "path", F.explode(suffixes).alias("r_host")).select("*", F.explode(prefixes(F.split("path", "/", -1), "/")).alias("head"))
    # the head of a rule is its path up to the last slash; of a path without one, nothing
    head = F.when(F.col("path").contains("/"), F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)).otherwise("")
    asked = asked.select("host", "path", "r_host", F.concat("head", F.lit("/")).alias("head")).unionByName(sites.select("host", "path", F.explode(suffixes).alias("r_host"), F.lit("").alias("head")))
    keyed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict", "place", F.when(F.col("path").contains("/"), F.concat(head, F.lit("/"))).otherwise("").alias("head"))
    fits = asked.join(keyed, ["r_host", "head"]).where(F.startswith("path", "r_path"))
    order = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), (-F.col("place")).alias("c"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("m")).select("host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))
    return cut.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge_urls(rows: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row.

    rules: Rule objects, or a DataFrame of verdict, host and path, in which order says nothing: of rules equal in host and path `block` counts before `allow`.
    Null, empty or schemeless urls have an empty host and path and get the default verdict. Repeated rows give a result each; a long url is looked up
    segment by segment.
    """
    url = F.col(url_col).cast("string")
    cut = rows.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path").where("host IS NOT NULL AND path IS NOT NULL")
        few = table.limit(MOST_RULES + 1).collect()
        if len(few) > MOST_RULES:
            return _joined(cut, table.withColumn("place", (F.col("verdict") != "block").cast("long")), default)
        rules = [Rule(*r) for r in sorted(few, key=lambda r: (r.verdict != "block", r.verdict))]
    else:
        rules = list(rules)
        if len(rules) > MOST_RULES:
            listed = rows.sparkSession.createDataFrame([(r.verdict, r.host, r.path, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place long")
            return _joined(cut, listed, default)
    sent = rows.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for batch in batches:
            hits = [trie.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([h and h[0] for h in hits], pa.string()), pa.array([h[1] if h else default for h in hits], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return cut.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
