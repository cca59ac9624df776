"""Predicates, keys and arithmetic: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def length_bucket(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n <= 5, "short").when(n <= 15, "medium").otherwise("long")


def not_denied(label: Column, denied: list[str]) -> Column:
    """Labels outside a deny set; null labels pass."""
    return ~F.coalesce(label.isin(denied), F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def range_of(first: Column, last: Column) -> Column:
    """first..last as an array; first alone if last is null or smaller."""
    return F.sequence(first, F.greatest(first, F.coalesce(last, first)))


def format_ref(group: Column, first: Column, last: Column) -> Column:
    """g:a, or g:a-b where b is set and differs from a."""
    head = F.concat_ws(":", group.cast("string"), first.cast("string"))
    return F.when(last.isNotNull() & (last != first), F.concat(head, F.lit("-"), last.cast("string"))).otherwise(head)


def parse_ref(ref: Column) -> Column:
    """Struct of group, first and last of a reference; null if it is none."""
    part = lambda i: F.regexp_extract(ref, r"^(\d+):(\d+)(?:-(\d+))?$", i).try_cast("int")
    return F.when(ref.rlike(r"^\d+:\d+(-\d+)?$"), F.struct(part(1).alias("grp"), part(2).alias("first"), F.coalesce(part(3), part(2)).alias("last")))


def clamp(value: Column, low: float, high: float) -> Column:
    """value within low..high; low where it is null or not finite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == INF)
    return F.when(bad, F.lit(low)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def feasible(target_length: Column, time_steps: Column) -> Column:
    return (target_length > 0) & (2 * target_length + 1 <= time_steps)


def l2_normalize(vector: Column, floor: float = 0.0) -> Column:
    """Unit vector; zero vectors stay zero (or are divided by floor). Null elements stay null and do not count."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x, F.lit(0.0))))
    norm = F.greatest(norm, F.lit(floor)) if floor else F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x / norm)


def round_scaled(x: Column, places: int) -> Column:
    """x scaled, rounded (halves away from zero) and scaled back, as DuckDB rounds: what comes to zero keeps its sign."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled).cast("double")
    r = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**places
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == INF), x).when(x < 0, -r).otherwise(r)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def log_add_exp(a: Column, b: Column) -> Column:
    """log(exp a + exp b); minus infinity is log 0."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low == -INF, high).otherwise(high + F.log1p(F.exp(low - high)))


def log_softmax(frame: Column) -> Column:
    top = F.array_max(frame)
    total = F.aggregate(frame, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(frame, lambda x: x - top - F.log(total))


def confidence(loss: Column) -> Column:
    """exp(-loss); 0 where it is null or not finite."""
    return F.when(loss.isNull() | F.isnan(loss) | (F.abs(loss) == INF), F.lit(0.0)).otherwise(F.exp(-loss))


def rms(samples: Column) -> Column:
    """Root mean square; 0 of an empty array."""
    return F.when(F.size(samples) > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(samples))).otherwise(F.lit(0.0))
