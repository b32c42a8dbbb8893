"""The staged resolution of scan rows against a canonical pool.

Names are compared once for each distinct pair of a block, in a set-similarity join; passes run on the distinct keys (brand, name, weight) of the scan rows, and each pass
only on what the passes before it left over. Every pass that has found its rows is a settled table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislegrid.functions import numbers as N
from aislegrid.functions import text as T
from aislegrid.sources.shared import settled, small

from .matching import first_of_key, with_conflicts
from .similarity import similar_names
from .vectors import nearest

NEAR, SHORTLIST = 3, 10


def weight_key(c: str = "weight") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def top(pairs: DataFrame, by: list[str], k: int = NEAR) -> DataFrame:
    """The k best pairs of each key by score, ties to the smaller pool_id, in one sorted array `best`. The rank limit also holds before the shuffle, so no more than k rows a key and task travel."""
    ranked = pairs.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "pool_id"))).where(F.col("rn") <= k)
    entry = F.struct("rn", *[c for c in pairs.columns if c not in by])
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("best"))


def _near(best: str = "best") -> Column:
    return F.transform(best, lambda x: F.struct(x["gtin"].alias("gtin"), x["score"].alias("score")))


def _result(df: DataFrame, by: list[str], letter: str, confidence: Column, reason: Column | None = None, near: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(*by, F.col("best")[0]["gtin"].alias("gtin"), F.lit(letter).alias("match_pass"), confidence.alias("confidence"), (none if reason is None else reason).cast("string").alias("reason"), (_near() if near is None else near).alias("near"))


def _conflict() -> Column:
    return F.array_join(T.attribute_conflicts(F.col("name"), F.col("best")[0]["name_r"]), ",")


def by_key(scan: DataFrame, pool: DataFrame, least: float = 0.4) -> DataFrame:
    """Passes A to C for each distinct (brand, name, weight) of scan: those and gtin, match_pass, confidence, reason, near; of keys without a match also tie, conflict and the best left over.

    pool has one row for each (brand, name, weight). Pairs of a similarity under `least` are no candidates.
    """
    by = ["brand", "name", "wk"]
    keys = scan.select("brand", "name", "weight").distinct().withColumn("wk", weight_key())
    exact = keys.join(pool.select("brand", "name", "weight", "gtin"), ["brand", "name", "weight"])
    a = exact.select(*by, "gtin", F.lit("A").alias("match_pass"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<struct<gtin:string,score:double>>").alias("near"))
    left = settled(keys.join(a.select(*by), by, "left_anti").where("brand <> ''"), "left")
    names = settled(similar_names(left, pool, ["brand"], least).withColumnRenamed("name_l", "name"), "names")
    right = pool.select("brand", F.col("id").alias("pool_id"), "gtin", F.col("name").alias("name_r"), F.col("weight").alias("b"))

    equal = left.where("weight > 0").join(names, ["brand", "name"]).join(right, ["brand", "name_r"]).where("weight = b").drop("weight", "b")
    b = settled(top(equal, by).withColumn("conflict", _conflict()), "pass-b")
    score, second = F.col("best")[0]["score"], F.get("best", F.lit(1))["score"]
    clear = (score >= 0.55) & (second.isNull() | (score - second >= 0.05))
    sure = (F.col("conflict") == "") | (score >= 0.90)
    flagged = F.when(F.col("conflict") != "", F.concat(F.lit("attribute_conflict:"), F.col("conflict")))
    found_b = _result(b.where(clear & sure), by, "B", score, flagged)

    rest = left.join(found_b.select(*by), by, "left_anti")
    state = N.weight_state(F.col("weight"), F.col("b"))
    need = F.when((F.col("state") == "bothKnown") & N.weights_match_lenient(F.col("weight"), F.col("b")), 0.70).when(F.col("state") == "oneUnknown", 0.80).when(F.col("state") == "bothUnknown", 0.85).otherwise(2.0)
    wide = rest.join(names, ["brand", "name"]).join(right, ["brand", "name_r"]).withColumn("state", state).withColumn("fits", F.col("score") >= need).drop("weight", "b")
    c = settled(top(wide.where("fits").drop("fits"), by).withColumn("conflict", _conflict()), "pass-c")
    capped = F.when(F.col("best")[0]["state"] == "oneUnknown", F.least(score, F.lit(0.7))).otherwise(score)
    found_c = _result(c.where(sure), by, "C", capped, flagged)

    found = reduce(DataFrame.unionByName, [a, found_b, found_c])
    doubt = b.where(~(clear & sure)).select(*by, (score >= 0.55).alias("tie"), F.col("best")[0]["gtin"].alias("b_gtin"), score.alias("b_score"))
    held = c.where(~sure).select(*by, F.col("conflict"), F.col("best")[0]["gtin"].alias("c_gtin"), score.alias("c_score"))
    other = left.join(found.select(*by), by, "left_anti").select(*by).join(doubt, by, "left").join(held, by, "left")
    return found.unionByName(other, allowMissingColumns=True)


def _first_match(rows: DataFrame, pool: DataFrame, keys: list[str], name: str, least: float, letter: str, confidence: Column) -> DataFrame:
    """A pass that looks at names alone, in blocks of keys: of each distinct (keys, name) the best pool row."""
    by = [*keys, name]
    pairs = similar_names(rows, pool, keys, least, name).withColumnRenamed("name_l", name)
    firsts = pool.groupBy(*keys, F.col(name).alias("name_r")).agg(F.min_by(F.struct(F.col("id").alias("pool_id"), "gtin"), "id").alias("m")).select(*keys, "name_r", "m.*")
    return _result(top(pairs.join(firsts, [*keys, "name_r"]), by), by, letter, confidence)


def passes(scan: DataFrame, pool: DataFrame, vectors: bool = True) -> DataFrame:
    """All of scan's columns with gtin, match_pass, confidence, reason, near, tie, conflict, b_gtin, b_score, c_gtin, c_score of passes A to E and, with vectors, G."""
    pool = settled(first_of_key(pool, ["brand", "name", "weight"]), "pool")
    by = ["brand", "name", "wk"]
    own = [c for c in ("gtin",) if c in scan.columns]
    scan = scan.withColumnRenamed("gtin", "own_gtin") if own else scan
    rows = settled(scan.withColumn("wk", weight_key()).join(by_key(scan, pool), by, "left").drop("wk"), "rows")
    score = F.col("best")[0]["score"]

    fields = ("gtin", "match_pass", "confidence", "reason", "near")

    def staged(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        """rows, with what the pass found, written once, for those that have nothing yet."""
        found = settled(found, "pass").select(*keys, F.struct(*fields).alias("new"))
        keep = F.col("match_pass").isNotNull()
        return rows.join(found, keys, "left").withColumns({c: F.when(keep, F.col(c)).otherwise(F.col("new")[c]) for c in fields}).drop("new")

    if "name_ar" in scan.columns and "name_ar" in pool.columns:
        some = lambda df: df.where("name_ar <> '' AND brand <> ''")
        rows = staged(rows, _first_match(some(rows.where("match_pass IS NULL")), some(pool), ["brand"], "name_ar", 0.75, "D", score), ["brand", "name_ar"])
    code = F.col("code") if "code" in scan.columns else F.col("own_gtin")
    rows = rows.withColumn("prefix", N.gtin_prefix(code))
    coded = pool.withColumn("prefix", N.gtin_prefix(F.col("code") if "code" in pool.columns else F.col("gtin"))).where("prefix IS NOT NULL")
    rows = staged(rows, _first_match(rows.where("match_pass IS NULL AND prefix IS NOT NULL"), coded, ["prefix"], "name", 0.80, "E", F.least(score, F.lit(0.6))), ["prefix", "name"]).drop("prefix")
    if vectors and "embedding" in scan.columns and "embedding" in pool.columns:
        rows = staged(rows, vector_pass(rows.where("match_pass IS NULL"), pool), ["id"])
    return rows.withColumnRenamed("own_gtin", "scan_gtin") if own else rows


def vector_pass(scan: DataFrame, pool: DataFrame, auto: float = 0.92, floor: float = 0.75, lead: float = 0.05) -> DataFrame:
    """Pass G: nearest pool row of the brand by cosine of `embedding`, if it is at least `auto`, or at least `floor` and `lead` above the second.

    A candidate whose weight differs by over 15 % or whose name has other attributes is held back for review: confidence 0.84 and the reason of the gate.
    """
    near = nearest(scan.where("brand <> ''"), pool.where("brand <> ''"), 2, by=("brand",), unit=True)
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    best = near.groupBy(F.col("query_id").alias("id")).agg(F.max_by("vec_id", F.when(F.col("place") == 1, 1)).alias("pool_id"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"), second.alias("second"))
    best = best.where((F.col("score") >= floor) & ((F.col("score") >= auto) | F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 6) >= lead)))
    best = best.join(scan.select("id", F.col("name").alias("name_l"), F.col("weight").alias("a")), "id").join(pool.select(F.col("id").alias("pool_id"), "gtin", F.col("name").alias("name_r"), F.col("weight").alias("b")), "pool_id")
    apart = (F.col("a") > 0) & (F.col("b") > 0) & (F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b") > 0.15)
    best = with_conflicts(best).withColumn("reason", F.when(apart, "gated:weight_mismatch_major").when(F.col("conflicts") != "", "gated:variant_or_flavor_conflict"))
    return best.select("id", "gtin", F.lit("G").alias("match_pass"), F.when(F.col("reason").isNull(), F.col("score")).otherwise(0.84).alias("confidence"), "reason", F.array(F.struct("gtin", "score")).alias("near"))


def disposition(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "auto").when(confidence >= 0.60, "review").otherwise("residual")


def cascade(scan: DataFrame, pool: DataFrame) -> DataFrame:
    """scan_id, gtin, match_pass, confidence, review_reason, disposition of every scan row, from the first pass that finds a pool row:

    A exact key, B brand and weight block, C brand block, D Arabic names of the brand, E code prefix, G vectors. In B and C a best row whose name has other
    attributes counts only from 0.90 on, with a reason; below, the next pass decides.

    scan and pool have id, gtin, brand, name, weight (grams or null). D, E and G run if both frames have name_ar, scan has code (digits read from the pack;
    pool may have it, else its gtin counts), and both have embedding. Rows with a null in what a pass compares take no part in it.
    """
    rows = passes(scan, pool)
    return rows.select(F.col("id").alias("scan_id"), "gtin", "match_pass", "confidence", F.col("reason").alias("review_reason"), disposition(F.col("confidence")).alias("disposition"))


def diagnostics(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """scan_id, match_pass, reason_code and near_misses (gtin:score in ten thousandths, best first) of what passes() returned.

    A matched row lists the three best candidates of its pass. A residual row has a reason (a tie in B, also after a conflict there; only weights that differ; no pool of the
    brand; neither weight nor Arabic name; a conflict in C; else all below the thresholds) and the best candidates of B and C that did not pass.
    """
    brands = pool.where("brand <> ''").groupBy("brand").agg(F.count("*").alias("n_pool"), F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).alias("n_weighed"))
    weights = pool.where("brand <> '' AND weight > 0").select("brand", F.col("weight").alias("b")).distinct()
    asked = rows.where("match_pass IS NULL AND weight > 0").select("brand", F.col("weight").alias("a")).distinct()
    fitting = asked.join(weights, "brand").groupBy("brand", "a").agg(F.max(F.abs(F.col("a") - F.col("b")) <= F.greatest("a", "b") * 0.1).alias("fits")).withColumnRenamed("a", "weight")
    rows = rows.join(small(settled(brands, "brands")), "brand", "left").join(small(settled(fitting, "fitting")), ["brand", "weight"], "left")
    placeholder = T.is_placeholder(F.col("brand"))
    reason = (
        F.when(F.col("match_pass").isNotNull(), "")
        .when(F.coalesce("tie", F.lit(False)), "ambiguous_tie")
        .when((F.col("weight") > 0) & (F.col("n_pool") == F.col("n_weighed")) & ~F.coalesce("fits", F.lit(True)), "weight_mismatch_only")
        .when(F.col("n_pool").isNull(), F.when(placeholder, "placeholder_brand_missing").otherwise("no_brand_pool"))
        .when(~F.coalesce(F.col("weight") > 0, F.lit(False)) & (F.coalesce("name_ar", F.lit("")) == ""), "no_weight_no_arabic")
        .when(F.col("conflict").isNotNull(), F.concat(F.lit("attribute_conflict:"), F.col("conflict")))
        .otherwise("all_passes_below_threshold")
    )
    left_over = F.filter(F.array(F.struct(F.col("b_score").alias("score"), F.col("b_gtin").alias("gtin")), F.struct(F.col("c_score").alias("score"), F.col("c_gtin").alias("gtin"))), lambda x: x["score"].isNotNull())
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["gtin"], F.lit(":"), F.round(x["score"] * 10000).cast("int").cast("string"))), ",")
    near = F.when(F.col("match_pass").isNotNull(), shown(F.col("near"))).otherwise(shown(F.sort_array(left_over, False)))
    return rows.select(F.col("id").alias("scan_id"), "match_pass", reason.alias("reason_code"), near.alias("near_misses"))


def shortlists(rows: DataFrame, pool: DataFrame, k: int = SHORTLIST, least: float = 0.4) -> DataFrame:
    """brand, name, wk, prefix, weight, best: for each distinct key of the rows without a match, the k best pool rows of its brand or code prefix by similarity of names (at least `least`)."""
    by = ["brand", "name", "wk", "prefix"]
    pool = first_of_key(pool, ["brand", "name", "weight"])
    code = F.col("code") if "code" in rows.columns else F.lit(None).cast("string")
    asked = rows.where("match_pass IS NULL").select("brand", "name", "weight", weight_key().alias("wk"), F.coalesce(N.gtin_prefix(code), F.lit("")).alias("prefix")).distinct()
    asked = settled(asked, "asked")
    coded = pool.withColumn("prefix", N.gtin_prefix(F.col("code") if "code" in pool.columns else F.col("gtin")))
    right = coded.select(F.col("id").alias("pool_id"), "gtin", F.col("brand").alias("pool_brand"), F.col("name").alias("name_r"), F.col("weight").alias("b"), "prefix")

    def pairs(key: str) -> DataFrame:
        some = lambda df: df.where(F.col(key) != "")
        names = similar_names(some(asked), some(coded), [key], least).withColumnRenamed("name_l", "name")
        its = right.withColumn("brand", F.col("pool_brand")) if key == "brand" else right
        drop = "prefix" if key == "brand" else "brand"
        return some(asked).join(names, [key, "name"]).join(some(its).drop(drop), [key, "name_r"]).select(*by, "score", "pool_id", "gtin", "pool_brand", "name_r", "b")

    both = pairs("brand").unionByName(pairs("prefix")).distinct()
    return asked.join(top(both, by, k), by)


def replay(lists: DataFrame, verdicts: DataFrame) -> DataFrame:
    """brand, name, wk, prefix, state, gtin, confidence, review_reason of each shortlist from stored verdicts (base_key, key, version, gtin, confidence, rationale).

    A verdict belongs to one brand, name, weight and set of candidates (key); the latest version counts. From 0.85 on it is accepted, if the candidate passes the gates of
    weight, attributes and brand, else it is held at 0.84 with the gate's reason; from 0.60 on it goes to review, from 0.50 on it is low; below, or for a code outside the list, there is no
    match. A key that was judged with other candidates only (base_key) is stale, one that never was is unasked; failed providers are failed.
    """
    gtins = F.transform("best", lambda x: x["gtin"])
    keyed = lists.withColumn("key", T.verdict_key(F.col("brand"), F.col("name"), F.col("wk"), gtins)).withColumn("base_key", base_key())
    latest = verdicts.groupBy("key").agg(F.max_by(F.struct(F.col("gtin").alias("v_gtin"), F.col("confidence").alias("v"), "rationale"), "version").alias("m")).select("key", "m.*", F.lit(True).alias("judged"))
    before = verdicts.select("base_key", F.lit(True).alias("known")).distinct()
    j = keyed.join(latest, "key", "left").join(before, "base_key", "left").withColumn("c", F.get(F.filter("best", lambda x: x["gtin"] == F.col("v_gtin")), F.lit(0)))
    gate = F.when((F.col("weight") > 0) & (F.col("c.b") > 0) & (F.abs(F.col("weight") - F.col("c.b")) / F.greatest(F.col("weight"), F.col("c.b")) > 0.15), "weight_mismatch_major")
    gate = gate.when(F.size(T.attribute_conflicts(F.col("name"), F.col("c.name_r"))) > 0, "variant_or_flavor_conflict").when((F.col("brand") != "") & (F.col("brand") != F.col("c.pool_brand")), "brand_mismatch")
    judged, fits = F.coalesce("judged", F.lit(False)), F.col("c").isNotNull()
    state = (
        F.when(judged & F.col("rationale").isin("transient_provider_failure", "all_providers_failed"), "failed")
        .when(judged & fits & (F.col("v") >= 0.85), F.when(gate.isNull(), "accepted").otherwise("gated"))
        .when(judged & fits & (F.col("v") >= 0.60), "review").when(judged & fits & (F.col("v") >= 0.50), "low").when(judged, "no_match")
        .when(F.coalesce("known", F.lit(False)), "stale").otherwise("unasked")
    )
    out = j.withColumn("gate", gate).withColumn("state", state)
    taken = F.col("state").isin("accepted", "gated", "review", "low")
    confidence = F.when(F.col("state") == "gated", 0.84).when(taken, F.col("v"))
    return out.select("brand", "name", "wk", "prefix", "state", F.when(taken, F.col("v_gtin")).alias("gtin"), confidence.alias("confidence"), F.when(F.col("state") == "gated", F.concat(F.lit("gated:"), "gate")).alias("review_reason"))


def base_key() -> Column:
    """What a verdict is about, without its candidates."""
    return F.sha1(F.concat_ws("|", "brand", "name", "wk"))


def rewind(scan: DataFrame, pool: DataFrame, aliases: DataFrame, sure: float = 0.85, least_pool: int = 3, least_evidence: int = 3) -> DataFrame:
    """The rows of passes() (without vectors), with raw_brand and `round`, after brand aliases have widened the blocks of rows that had no match until nothing changes.

    aliases (brand, slug, confidence) count from `sure` on. A brand without a pool of its own also becomes an alias once `least_evidence` of its rows were matched to rows of one
    brand, the most frequent of them (ties: the first by name), by any pass at a confidence of `sure` or, for the code prefix, 0.60. The brand an alias leads to needs a pool of `least_pool` rows or an alias of its own. Each
    round passes run again on the residual rows whose brand has an alias that they did not have before, so cycles end; each round is a settled table.
    """
    brands = settled(pool.where("brand <> ''").groupBy("brand").agg(F.count("*").alias("n")), "brands")
    of = pool.groupBy(F.col("gtin").alias("found")).agg(F.min("brand").alias("pool_brand"))
    given = settled(aliases.where(F.col("confidence") >= sure).groupBy("brand").agg(F.max_by("slug", F.struct("confidence", "slug")).alias("slug")), "aliases")
    keep = scan.columns
    first = scan.withColumn("raw_brand", F.col("brand")).withColumn("tried", F.array("brand"))
    rows = settled(passes(first, pool, vectors=False).withColumn("round", F.lit(0)), "round")
    turn = 0
    while True:
        turn += 1
        enough = (F.col("confidence") >= sure) | ((F.col("match_pass") == "E") & (F.col("confidence") >= 0.60))
        seen = rows.where(F.col("match_pass").isNotNull() & enough).join(of, F.col("gtin") == F.col("found")).where("raw_brand <> '' AND raw_brand <> pool_brand")
        seen = seen.groupBy("raw_brand", "pool_brand").agg(F.count("*").alias("n")).where(F.col("n") >= least_evidence)
        seen = seen.groupBy(F.col("raw_brand").alias("brand")).agg(F.min_by("pool_brand", F.struct(-F.col("n"), "pool_brand")).alias("slug"))
        seen = seen.join(brands, "brand", "left_anti").join(given, "brand", "left_anti").select("brand", "slug")
        known = given.unionByName(seen)
        ends = brands.where(F.col("n") >= least_pool).select(F.col("brand").alias("slug")).union(known.select(F.col("brand").alias("slug"))).distinct()
        usable = known.join(ends, "slug", "left_semi")
        again = rows.where("match_pass IS NULL").join(usable, "brand").where(~F.array_contains("tried", F.col("slug")))
        again = settled(again.withColumn("tried", F.array_append("tried", F.col("slug"))).withColumn("brand", F.col("slug")).drop("slug"), "again")
        if again.isEmpty():
            return rows.drop("tried")
        names = {"scan_gtin": "gtin"} if "gtin" in keep else {}
        fresh = again.select(*[c for c in again.columns if c not in ("gtin", "match_pass", "confidence", "reason", "near", "tie", "conflict", "b_gtin", "b_score", "c_gtin", "c_score", "round")]).withColumnsRenamed(names)
        new = passes(fresh, pool, vectors=False).withColumn("round", F.lit(turn))
        rows = settled(rows.join(again.select("id"), "id", "left_anti").unionByName(new), "round")
