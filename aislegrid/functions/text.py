"""Text functions of the catalog: names, brands, tokens, similarity. All are Column -> Column; only the Unicode fold runs in Python (Arrow)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand aliases in Arabic.
BRAND_ALIASES = {
    "المراعي": "almarai",
    "كوكا كولا": "coca-cola",
    "بيبسي": "pepsi",
    "نستله": "nestle",
    "ماجي": "maggi",
    "نيدو": "nido",
    "ليبتون": "lipton",
    "ريد بول": "red-bull",
    "اوريو": "oreo",
    "برينجلز": "pringles",
    "نوتيلا": "nutella",
    "انستنت نودلز": "indomie",
}
# Brands that stand for none.
PLACEHOLDERS = ["generic", "unnamed", "unnamed product", "unknown", "n/a", "na", "none"]
# Words without weight in keyword overlap.
NOISE = ["the", "and", "of", "with", "in", "for", "a", "an", "to", "is", "by", "from"]
# Attribute words by category, in order of precedence.
ATTRIBUTES = {
    "fat": ["low fat", "full fat", "skim", "lite"],
    "sweetness": ["zero", "diet", "sugar free", "original"],
    "flavor": ["chocolate", "vanilla", "strawberry", "mint", "lemon", "lime", "mango", "orange", "coffee", "caramel"],
    "form": ["powder", "liquid", "granules", "concentrate", "ready to drink", "rtd"],
    "pack": ["pack of", "multipack", "family", "value", "bundle", "single"],
}
# Attributes that rule each other out.
MUTEX = [("full fat", "low fat"), ("white", "dark"), ("vanilla", "chocolate"), ("red", "blue")]
# Names of large supermarket chains.
MAJOR_CHAINS = ["othaim", "panda", "carrefour", "karfour", "danube", "tamimi", "lulu", "spinneys"]
MAJOR_CHAINS_AR = ["العثيم", "عثيم", "بنده", "بندة", "كارفور", "الدانوب", "دانوب", "التميمي", "تميمي", "لولو", "سبينس", "سبينيس", "سبينيز"]
# Unit and packaging words that a normalised name loses.
UNIT_PATTERN = r"(?i)[0-9]+\.?[0-9]*\s*(g|kg|ml|l|cl|cc|oz|pcs|pack|لتر|ملل|غرام|كغ|حبة)\s?"
PACKAGING = "pack\\s+of|multipack|bundle|value\\s+pack|family\\s+size|single|bottle|can|tin|box|carton|sachet"
PACKAGING_AR = "عبوة|علبة|كرتون|زجاجة|علب"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def fold_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""

    def run(texts: pa.Array) -> pa.Array:
        def fold(t):
            return None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x) != "Mn")

        return pa.array([fold(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(c)


def brand_slug(brand: Column, folded: Column) -> Column:
    """Latin slug of a brand; folded is fold_marks(brand), computed once for each distinct brand."""
    alias = F.element_at(F.create_map(*[F.lit(x) for pair in BRAND_ALIASES.items() for x in pair]), F.trim(brand))
    text = F.regexp_replace(F.regexp_replace(F.lower(folded), "['’‘`\"]", ""), "&", "-and-")
    slug = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(alias, slug, F.lit(""))


def product_name(name: Column) -> Column:
    """Name without sizes and packaging words."""
    text = F.regexp_replace(F.lower(name), UNIT_PATTERN, "")
    text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_])({PACKAGING})(?![A-Za-z0-9_])", "")
    return F.coalesce(F.regexp_replace(F.trim(F.regexp_replace(text, PACKAGING_AR, "")), r"\s+", " "), F.lit(""))


def is_placeholder(brand: Column) -> Column:
    low = F.lower(F.trim(brand))
    return F.coalesce(low.isin(["", *PLACEHOLDERS]), F.lit(True))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice similarity of bigram multisets, after lower-casing and collapsing blanks."""
    clean = lambda c: F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))

    def of(x: Column, y: Column, p: Column, q: Column) -> Column:
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, g: acc + F.least(count(p, g), count(q, g)))
        return F.when((x == y) & (F.length(x) > 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(shared * F.lit(2.0) / (F.size(p) + F.size(q)))

    return let(clean(a), lambda x: let(clean(b), lambda y: let(bigrams(x), lambda p: let(bigrams(y), lambda q: of(x, y, p, q)))))


def dice_parts(name: Column) -> Column:
    """What dice_of needs of a name: text (cleaned) and its bigrams, each with its occurrence, so that all differ."""
    numbered = lambda p: F.transform(p, lambda g, i: F.concat(g, F.size(F.filter(F.slice(p, F.lit(1), i), lambda x: x == g)).cast("string")))
    clean = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return let(clean, lambda c: F.struct(c.alias("text"), let(bigrams(c), numbered).alias("grams")))


def dice_of(a: Column, b: Column) -> Column:
    """dice() of two names' dice_parts."""
    p, q = a["grams"], b["grams"]
    score = F.size(F.array_intersect(p, q)) * F.lit(2.0) / (F.size(p) + F.size(q))
    return F.when((a["text"] == b["text"]) & (F.length(a["text"]) > 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(score)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / most)


def unicode_tokens(text: Column) -> Column:
    """Runs of letters or of digits, lower-case, of two characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1)), lambda t: F.length(t) >= 2)


def punct_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{P}]+"), lambda t: F.length(t) > 2))


def keywords(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9\\s]", " "), r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(NOISE))


def keywords_shared(x: Column, y: Column) -> Column:
    """Share of the shorter token list that the other has."""
    hits = lambda x, y: F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.size(x)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(F.size(x) <= F.size(y), hits(x, y)).otherwise(hits(y, x))


def keyword_overlap(a: Column, b: Column) -> Column:
    """keywords_shared of two names."""
    return let(keywords(a), lambda x: let(keywords(b), lambda y: keywords_shared(x, y)))


def arabic_name(text: Column) -> Column:
    """Without vowel marks and tatweel, one form of alef, heh for teh marbuta."""
    plain = F.regexp_replace(text, "[ً-ٰٟـ]", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(plain, "أإآٱة", "ااااه")), r"\s+", " "))


def price_text(text: Column) -> Column:
    """First number of a text that has been reduced to digits and dots."""
    return F.regexp_extract(F.regexp_replace(text, "[^0-9.]", ""), r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")


def attributes(text: Column) -> Column:
    """The first attribute word of each category that a name has, by category."""
    low = F.lower(text)
    return F.struct(*[F.coalesce(*[F.when(low.rlike(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"), F.lit(w)) for w in words]).alias(k) for k, words in ATTRIBUTES.items()])


def conflicts_of(a: Column, b: Column) -> Column:
    """Categories in which two names' attributes are there and differ."""
    return F.array_compact(F.array(*[F.when(a[k] != b[k], F.lit(k)) for k in ATTRIBUTES]))


def attribute_conflicts(a: Column, b: Column) -> Column:
    """Categories in which both names have an attribute word, and different ones."""
    return conflicts_of(attributes(a), attributes(b))


def mutex_words(text: Column) -> Column:
    """Which words of MUTEX a name has."""
    return F.struct(*[F.lower(text).contains(w).alias(f"{s}{i}") for i, pair in enumerate(MUTEX) for s, w in zip("xy", pair, strict=True)])


def mutex_of(a: Column, b: Column) -> Column:
    return F.array_contains(F.array(*[(a[f"x{i}"] & b[f"y{i}"]) | (a[f"y{i}"] & b[f"x{i}"]) for i in range(len(MUTEX))]), True)


def mutex_conflict(a: Column, b: Column) -> Column:
    """Whether one name has a word that an attribute of the other rules out."""
    return mutex_of(mutex_words(a), mutex_words(b))


def sizes(text: Column) -> Column:
    """Sizes in a name as structs (value in ml or g, dimension); ounces count as volume."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:\.[0-9]+)?\s*(?:kg|g|ml|l|cl|oz|لتر|مل|كجم|جم)(?![A-Za-z]))"), F.lit(1))

    def one(s: Column) -> Column:
        n, unit = F.regexp_extract(s, r"^([0-9.]+)", 1).cast("double"), F.trim(F.regexp_replace(s, "[0-9.]", ""))
        scale = F.when(unit.isin("kg", "l", "لتر", "كجم"), 1000.0).when(unit == "cl", 10.0).when(unit == "oz", 29.574).otherwise(1.0)
        return F.struct((n * scale).alias("value"), F.when(unit.isin("kg", "g", "كجم", "جم"), F.lit("mass")).otherwise(F.lit("volume")).alias("dimension"))

    return F.transform(found, one)


def least_sizes(text: Column) -> Column:
    """The smallest size of each dimension in a name: a struct of mass and volume, null where there is none."""
    least = lambda x, d: F.array_min(F.transform(F.filter(x, lambda s: s["dimension"] == d), lambda s: s["value"]))
    return let(sizes(text), lambda x: F.struct(least(x, "mass").alias("mass"), least(x, "volume").alias("volume")))


def sizes_fit(x: Column, y: Column) -> Column:
    """size_guard() of two names' least_sizes."""
    ok = lambda p, q: F.coalesce(F.abs(p - q) <= F.greatest(p, q) * 0.1, F.lit(True))
    return ok(x["mass"], y["mass"]) & ok(x["volume"], y["volume"])


def size_guard(a: Column, b: Column) -> Column:
    """False if the smallest sizes of a shared dimension differ by more than a tenth."""
    return let(least_sizes(a), lambda x: let(least_sizes(b), lambda y: sizes_fit(x, y)))


def merchant_clean(name: Column) -> Column:
    """Without a delivery estimate, camel case split, a repeated word collapsed, leading article dropped."""
    text = F.regexp_replace(name, r"(?i)\s*[0-9]+\s*-?\s*[0-9]*\s*(min|mins|minutes).*$", "")
    text = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), r"(?i)(?<![A-Za-z0-9_])([A-Za-z]+)\s+\1(?![A-Za-z0-9_])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^al[ -]", ""), r"\s+", " "))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def verdict_key(brand: Column, name: Column, weight: Column, gtins: Column) -> Column:
    return F.sha1(F.concat_ws("|", brand, name, weight, F.array_join(F.array_sort(gtins), ",")))


def is_major_chain(name_en: Column, name_ar: Column) -> Column:
    """Whether either name holds the name of a large chain."""
    hit = lambda c, words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    return hit(name_en, MAJOR_CHAINS) | hit(name_ar, MAJOR_CHAINS_AR)


def backfill_slug(brand: Column) -> Column:
    """The plain SQL slug that stored rows were once given: no aliases, no folding, ampersands become hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(brand, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
