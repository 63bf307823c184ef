"""Column builders used by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def search_any(term: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring in any column; ``%`` and ``_`` in the term are wildcards. No term: no condition."""
    return any_of(*(F.ilike(F.col(c), F.lit(f"%{term}%")) for c in columns)) if term else None


def code(column: str) -> Column:
    return F.upper(F.trim(F.col(column)))


def preview(column: str, size: int, default: str = "—") -> Column:
    return F.left(F.coalesce(F.col(column), F.lit(default)), F.lit(size))


def within_days(ts: str, as_of: str, days: int) -> Column:
    """Strictly after ``as_of`` less some days; ``as_of`` is given, never the clock."""
    return F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def in_year(ts: str, year: int) -> Column:
    """Within a calendar year, as a range: unlike ``year(ts) = ...`` the scan can skip what lies outside."""
    first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    return (F.col(ts) >= first) & (F.col(ts) < after)


def same_day(ts: str, as_of: str) -> Column:
    return F.to_date(ts) == F.to_date(F.lit(as_of))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in the order of the elements."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normal_label(text: Column) -> Column:
    """Marks off, upper case, ``&`` as AND, single spaces."""
    plain = F.replace(F.regexp_replace(F.upper(text), "[#*]", " "), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def label_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal_label(text), F.lit("[A-Z0-9]+"), F.lit(0)))


def without_variant(text: Column) -> Column:
    """A trailing one-letter track such as `` - A`` taken off."""
    return F.regexp_replace(text, r"\s*-\s*[A-Z]\b", " ")


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"\s+", " "))


def last_parenthetical(text: Column) -> Column:
    """struct(base, inner): the last balanced parenthetical at the end of the text, or the text and null.

    Walks the characters from the end; the depth is 0 again where the parenthetical opens.
    """
    trimmed = F.rtrim(text)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("cut"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)
        seen = s["seen"] + 1
        closed = (s["cut"] == 0) & (depth == 0)
        return F.struct(F.when(s["cut"] != 0, s["depth"]).otherwise(depth).alias("depth"), seen.alias("seen"), F.when(closed, seen).otherwise(s["cut"]).alias("cut"))

    cut = F.aggregate(F.split(F.reverse(trimmed), ""), state, step)["cut"]
    has = trimmed.endswith(")") & (cut > 1)
    size = F.length(trimmed)
    return F.when(has, F.struct(F.rtrim(F.substring(trimmed, F.lit(1), size - cut)).alias("base"), F.trim(F.substring(trimmed, size - cut + 2, cut - 2)).alias("inner"))).otherwise(
        F.struct(trimmed.alias("base"), F.lit(None).cast("string").alias("inner"))
    )


def keyword_hit(text: Column, keyword: str) -> Column:
    """Keywords of up to four characters match as words, longer ones anywhere; both without regard to case."""
    low = F.lower(text)
    return low.rlike(rf"\b\Q{keyword}\E\b") if len(keyword) <= 4 else low.contains(keyword)


def host(url: Column, strict_prefix: bool = False) -> Column:
    """The lower-case authority of a URL without user, port and ``www.``, "" where there is none; no URL is an error.

    By default any leading run of w and . goes, as the results to match have it.
    """
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)
    found = F.coalesce(F.regexp_replace(authority, r":[0-9]*$", ""), F.lit(""))
    return F.regexp_replace(found, r"^www\.", "") if strict_prefix else F.ltrim(found, F.lit("w."))


def page_numbers(spec: Column) -> Column:
    """Sorted distinct numbers of a spec such as ``3-5, 9``."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    low = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    high = lambda p: F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")).otherwise(low(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.least(low(p), high(p)), F.greatest(low(p), high(p)))))))


def parse_value(raw: Column, low: float = -2, high: float = 4) -> Column:
    """struct(value decimal(6,4), problem): NQC is a null value without a problem; blanks, text and far values are problems."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    number = F.try_cast(text, "decimal(12,4)") if hasattr(F, "try_cast") else text.try_cast("decimal(12,4)")
    problem = (
        F.when(F.upper(text) == "NQC", F.lit(None))
        .when(text.isin("", "-"), F.lit("MISSING"))
        .when(number.isNull(), F.lit("UNPARSEABLE"))
        .when(~number.between(low, high), F.lit("OUT_OF_RANGE"))
    )
    return F.struct(F.when(problem.isNull() & (F.upper(text) != "NQC"), number).cast("decimal(6,4)").alias("value"), problem.cast("string").alias("problem"))


def template(text: Column, values: dict[str, Column]) -> Column:
    """Exact ``{{token}}`` replacement."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), text)


def set_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def isin_or_semi(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values)


def printable(text: Column) -> Column:
    """Control and private-use characters taken out."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Co}]", "")


def four_places(value: Column) -> Column:
    return value.cast("decimal(18,4)").cast("string")


def json_array(raw: Column) -> Column:
    """The elements of a JSON array as strings; null for anything else."""
    return F.when(F.json_array_length(raw).isNotNull(), F.from_json(raw, "array<string>"))


def utc_tag(ts: Column) -> Column:
    """A moment as the tag of a file name; the session's time zone is UTC."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM dd, yyyy")


def number_part(code_: Column) -> Column:
    """A code without the letters at its end."""
    return F.regexp_replace(code_, "[A-Za-z]+$", "")


def with_defaults(values: Column, defaults: Column) -> Column:
    """A map with the entries of another for the keys that it lacks; no map takes all of them. A key that is there with a null keeps it."""
    rest = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(values, k), F.lit(False)))
    return F.when(values.isNull(), defaults).otherwise(F.map_concat(values, rest))
