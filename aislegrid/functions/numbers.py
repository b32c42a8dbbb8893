"""Codes, weights, scores, vectors and hashes: Column -> Column, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score thresholds per 100 g.
NEGATIVE = {
    "energy_kcal": [335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350],
    "sugars_g": [4.5, 9, 13.5, 18, 22.5, 27, 31, 36, 40, 45],
    "saturated_fat_g": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "sodium_mg": [90, 180, 270, 360, 450, 540, 630, 720, 810, 900],
}
POSITIVE = {"fiber_g": [0.9, 1.9, 2.8, 3.7, 4.7], "protein_g": [1.6, 3.2, 4.8, 6.4, 8.0]}
# Low and high bounds of traffic lights per 100 g.
LIGHTS = {"fat_g": (3, 17.5), "saturated_fat_g": (1.5, 5), "sugars_g": (5, 22.5), "sodium_mg": (300, 600)}


def is_real_gtin(gtin: Column) -> Column:
    return gtin.rlike("^([0-9]{8}|[0-9]{12,14})$")


def normal_gtin(gtin: Column) -> Column:
    """Digits only; twelve digits are padded to thirteen; synthetic codes give null."""
    code = F.trim(gtin)
    return F.when(~code.rlike("^[0-9]+$"), F.lit(None)).when(F.length(code) == 12, F.lpad(code, 13, "0")).otherwise(code)


def gtin_prefix(gtin: Column) -> Column:
    return F.when(gtin.rlike("^[0-9]{14}$"), F.substring(gtin, 2, 3)).when(gtin.rlike("^[0-9]{8,13}$"), F.substring(gtin, 1, 3))


def bare_gtin(c: Column) -> Column:
    """Digits of a code without leading zeros."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "")


def same_gtin(a: Column, b: Column) -> Column:
    return (bare_gtin(a) == bare_gtin(b)) & (bare_gtin(a) != "")


def grams_anchored(text: Column) -> Column:
    """Grams of a text that is a number with an optional unit; an unknown unit counts as grams."""
    trimmed = F.trim(text)
    n = F.regexp_extract(trimmed, r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([a-z]+)?$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(trimmed, r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([a-z]+)?$", 2))
    return F.when(unit.isin("kg", "l"), n * 1000).when(unit == "cl", n * 10).when(unit == "mg", n / 1000).otherwise(n)


def grams_search(text: Column) -> Column:
    """Grams of the first number with a unit anywhere in a text."""
    pattern = r"([0-9.]+)\s*(g|kg|ml|l|liter|liters|mg)"
    n, unit = F.regexp_extract(F.lower(text), pattern, 1).try_cast("double"), F.regexp_extract(F.lower(text), pattern, 2)
    return F.when(unit.isin("kg", "l", "liter", "liters"), n * 1000).when(unit == "mg", n / 1000).otherwise(n)


def measure(text: Column) -> tuple[Column, Column]:
    """Value and unit (g or ml) of the first size in a text; 0 and null where there is none."""
    pattern = r"([0-9]+\.?[0-9]*)\s*(g|kg|l|ml|cc|cl)"
    n, unit = F.regexp_extract(F.lower(text), pattern, 1).try_cast("double"), F.regexp_extract(F.lower(text), pattern, 2)
    value = F.when(unit.isin("kg", "l"), n * 1000).when(unit == "cl", n * 10).otherwise(n)
    return F.coalesce(value, F.lit(0.0)), F.when(unit.isin("g", "kg"), "g").when(unit != "", "ml")


def unit_price(price: Column, value: Column, unit: Column) -> tuple[Column, Column]:
    """Price of a kilogram or litre of a pack, with the unit; null without a positive size of a known unit."""
    per = F.when(F.lower(unit).isin("g", "ml"), value / 1000).when(F.lower(unit).isin("kg", "l"), value)
    kind = F.when(F.lower(unit).isin("g", "kg"), "kg").when(F.lower(unit).isin("ml", "l"), "L")
    return F.when(per > 0, round_half_up(price / per)), F.when(per > 0, kind)


def weights_match_strict(db: Column, other: Column) -> Column:
    return F.when(db.isNull() & other.isNull(), True).when(db.isNull() | other.isNull(), False).otherwise(F.abs(db - other) <= db * 0.1)


def weights_match_lenient(a: Column, b: Column) -> Column:
    p, q = F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0))
    return F.coalesce(F.abs(p - q) <= F.greatest(p, q) * 0.1, F.lit(True))


def weight_state(a: Column, b: Column) -> Column:
    p, q = F.nullif(a, F.lit(0.0)).isNotNull(), F.nullif(b, F.lit(0.0)).isNotNull()
    return F.when(p & q, "bothKnown").when(p | q, "oneUnknown").otherwise("bothUnknown")


def weight_band(grams: Column) -> Column:
    step = F.when(grams < 200, 25).when(grams < 1000, 50).otherwise(100)
    low = (F.floor(grams / step) * step).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + step).cast("string"), F.lit("g"))


def weight_affinity(a: Column, b: Column) -> Column:
    p, q = F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0))
    return F.coalesce(1 - F.least(F.lit(1.0), F.abs(p - q) / F.greatest(p, q)), F.lit(0.5))


def round_half_up(x: Column) -> Column:
    """Two decimals, halves of the binary value upwards."""
    return F.floor(x * 100 + 0.5) / 100


def _points(value: Column, thresholds: list[float]) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return sum((v > float(t)).cast("int") for t in thresholds)


def nutri_score() -> tuple[Column, Column]:
    """Score and grade from the nutrition columns."""
    negative = sum(_points(F.col(c), t) for c, t in NEGATIVE.items())
    fiber, protein = (_points(F.col(c), t) for c, t in POSITIVE.items())
    score = negative - F.when((negative >= 11) & (fiber < 5), fiber).otherwise(fiber + protein)
    return score, F.when(score <= -1, "A").when(score <= 2, "B").when(score <= 10, "C").when(score <= 18, "D").otherwise("E")


def traffic_light(column: str) -> Column:
    low, high = LIGHTS[column]
    v = F.col(column)
    return F.when(v <= float(low), "low").when(v >= float(high), "high").otherwise("medium")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def l2_truncate(v: Column, n: int) -> Column:
    """First n components at unit length."""
    head = F.slice(F.transform(v, lambda x: x.cast("double")), 1, n)
    norm = F.sqrt(dot(head, head))
    return F.transform(head, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; null for other texts."""
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))


def difference_hash(pixels: Column) -> Column:
    """16 hexadecimal digits of a row-major 9 x 8 grey image: each bit tells whether a pixel is darker than its right neighbour."""
    at = lambda i: F.element_at(pixels, i)

    def half(k: int) -> Column:  # the four bits of half a row
        first = k // 2 * 9 + k % 2 * 4 + 1
        return sum((F.when(at(first + j) < at(first + j + 1), 8 >> j).otherwise(0) for j in range(4)), F.lit(0))

    def word(half_from: int) -> Column:  # four halves as four digits
        return F.lpad(F.lower(F.hex(sum((half(half_from + i) * (1 << 4 * (3 - i)) for i in range(4)), F.lit(0)))), 4, "0")

    return F.concat(*[word(k) for k in (0, 4, 8, 12)])
