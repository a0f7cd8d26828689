"""Numbers, times and presence as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COVERAGE_FIELDS = ("supplier_name", "years_active", "rating", "categories", "certifications", "products", "reviews", "company_information", "price_information", "transaction_signals", "delivery_information", "activity_history")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rating(x: Column) -> Column:
    """A number from 0 to 5, else null; booleans and NaN are no ratings."""
    n = x.cast("string").try_cast("double")
    return F.when(~F.isnan(n) & n.between(0, 5), n)


def non_negative(x: Column, whole: bool = False, most: float | None = None) -> Column:
    """A decimal of at least 0 (and whole, and at most `most`), else null."""
    n = x.cast("string").try_cast("decimal(38,8)")
    ok = n >= 0
    if whole:
        ok = ok & (n == F.floor(n))
    if most is not None:
        ok = ok & (n <= most)
    return F.when(ok, n)


def count_or_null(x: Column) -> Column:
    n = x.cast("string").try_cast("bigint")
    return F.when(n >= 0, n)


def instant(text: Column) -> Column:
    """An ISO-8601 text with a time and an explicit offset as a timestamp; naive and malformed ones are null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def window_number(ts: Column, seconds: int) -> Column:
    """The tumbling window that an instant falls into; windows start at the epoch."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint")


def window_start(number: Column, seconds: int) -> Column:
    return F.timestamp_seconds(number * seconds)


def completed_years(since: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, since) / 12).cast("int")


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days since an instant; null for null and for the future."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    return F.when(seconds >= 0, F.floor(seconds / 86400).cast("int"))


def backoff(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """min(base * 2^(attempt - 1), most) seconds."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def present(x: Column, kind: str) -> Column:
    """Not null, not an empty string, not an empty list; 0 and an empty map are present."""
    if kind == "string":
        return F.coalesce(x != "", F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, clamped to [-1, 1]; 0 if one is all zeros, an error if the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, 0.0).otherwise(clamp(dot(a, b) / norm, -1.0, 1.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")))
