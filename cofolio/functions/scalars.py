"""Column functions: text clean-up, weights, similarity and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\x{FEFF}]+"


def unicode_trim(c: Column) -> Column:
    """Without white space of any kind at the ends (plain trim takes blanks only)."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def pseudonym(name: Column, salt: str) -> Column:
    """Stable user id: the first 24 hex digits of SHA-256 over salt and normalised name."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.lower(unicode_trim(name))), 256), 1, 24)


def round4(c: Column) -> Column:
    """Four decimals, half away from zero, and no negative zero."""
    return F.round(c, 4) + F.lit(0.0)


def quantise(c: Column, digits: int = 5) -> Column:
    """Half-even rounding for exports."""
    return F.bround(c, digits)


def normalise_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(unicode_trim(c)), BLANKS, " ")


def node_item_id(c: Column) -> Column:
    """Item id of a node name or number, by its leading digits; -1 where there are none."""
    digits = F.regexp_extract(c, r"^(?:anime:)?\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1))


def _clamp(c: Column, low: float, high: float, fallback: float) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), c))).otherwise(F.lit(fallback))


def clamp_weight(c: Column) -> Column:
    """Watch weights lie in [0.2, 3]; what isn't finite is 1."""
    return _clamp(c, 0.2, 3.0, 1.0)


def clamp_blend(c: Column) -> Column:
    """Blend weights lie in [0, 1]; what isn't finite is 0.5."""
    return _clamp(c, 0.0, 1.0, 0.5)


def score_to_weight(score: Column) -> Column:
    """Imported scores up to 3 are weights already; beyond, 5 stands for weight 1 and 10 for 2."""
    return clamp_weight(F.when(score <= 3, score).otherwise(1 + (score - 5) / 5))


def clamp_year(c: Column) -> Column:
    return F.greatest(F.lit(1900), F.least(F.lit(2100), c.try_cast("int")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.when((F.size(a) > 0) & (F.size(b) > 0), both)), F.lit(0.0))


def content_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity of two content structs (columns or their names): genres, studios, year, score."""
    get = lambda side, field: (F.col(side) if isinstance(side, str) else side)[field]
    near = lambda field, reach: F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(get(a, field) - get(b, field)) / reach), F.lit(0.0))
    return 0.5 * jaccard(get(a, "genres"), get(b, "genres")) + 0.2 * jaccard(get(a, "studios"), get(b, "studios")) + 0.2 * near("year", 25.0) + 0.1 * near("score", 10.0)


def auto_blend(known: Column, explicit: float | None = None) -> Column:
    """Content weight by the number of watched items with features, unless given."""
    if explicit is not None:
        return F.lit(max(0.0, min(1.0, explicit)))
    return F.when(known <= 2, 0.45).when(known <= 4, 0.30).otherwise(0.15)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fixed3(c: Column) -> Column:
    """Three decimals of the exact binary value, ties away from zero (1.1025 is a little less than it looks, so 1.102); null, NaN and
    infinite values give null.

    The fraction goes to a long in 52nds powers of two and what is left of it, so nothing is rounded before the last step.
    """
    size = F.abs(c.cast("double"))
    fraction = size % 1 * F.lit(float(1 << 52))
    scaled = F.floor(fraction) * 1000 + F.floor(fraction % 1 * 1000)
    milli = F.shiftright(scaled + F.lit(1 << 51), 52)
    whole = F.floor(size) + F.when(milli >= 1000, 1).otherwise(0)
    sign = F.when(c < 0, "-").otherwise("")
    text = F.concat(sign, whole.cast("string"), F.lit("."), F.lpad((milli % 1000).cast("string"), 3, "0"))
    return F.when(size < F.lit(float(1 << 63)), text)


def format_weight(c: Column) -> Column:
    """Signed, three decimals; what rounds to nothing shows as 0.000."""
    return F.when(F.abs(c) < 0.0005, "0.000").when(c > 0, F.concat(F.lit("+"), fixed3(c))).otherwise(fixed3(c))


def shorten(c: Column, size: int) -> Column:
    flat = F.regexp_replace(unicode_trim(c), BLANKS, " ")
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size - 3), F.lit("...")))


def meta_line(year: Column, score: Column, studios: Column, genres: Column) -> Column:
    """One line of year, score, two studios, three genres; parts that are missing are left out."""
    listed = lambda names, n: F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, n), ", "))
    line = F.concat_ws(" | ", year.cast("string"), F.concat(F.lit("score "), F.format_string("%.2f", score)), listed(studios, 2), listed(genres, 3))
    return F.when(line == "", F.lit("no details")).otherwise(line)


def explain_line(parts: Column) -> Column:
    """Text of up to two helping and two hurting contributions of an array of (label, weighted) structs."""
    def top(chosen: Column) -> Column:
        placed = F.transform(chosen, lambda x, i: F.struct(F.abs(x.weighted).alias("size"), (-i).alias("at"), x.label.alias("label"), x.weighted.alias("weighted")))
        return F.slice(F.sort_array(placed, asc=False), 1, 2)  # equal sizes in the order given

    def line(shown: Column, i: Column) -> Column:
        each = F.transform(shown, lambda x: F.concat(x.label, F.lit(" ("), format_weight(x.weighted), F.lit(")")))
        return F.concat(F.when(i == 0, "for: ").otherwise("against: "), F.when(F.size(shown) > 0, F.array_join(each, " | ")).otherwise("nothing"))

    sides = F.array(top(F.filter(parts, lambda x: x.weighted > 0)), top(F.filter(parts, lambda x: x.weighted < 0)))
    return F.array_join(F.transform(sides, line), "; ")


def split_names(c: Column) -> Column:
    """Names of a comma-separated list: trimmed, lower case, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.lower(unicode_trim(x))), lambda x: x != ""))
