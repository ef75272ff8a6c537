"""Scores, gates and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_score(a: Column, b: Column) -> Column:
    """FN31: 0.5 if either is unknown, 1 up to 5 years apart, 0.6 up to 15, else 0."""
    d = F.abs(a - b)
    return F.when(d.isNull(), 0.5).when(d <= 5, 1.0).when(d <= 15, 0.6).otherwise(0.0)


def age_gate(a: Column, b: Column) -> Column:
    """FN32: false for ages over 15 years apart, or over 6 between a child under 13 and someone older."""
    d = F.abs(a - b)
    child = (F.least(a, b) < 13) & (F.greatest(a, b) >= 13)
    return F.coalesce(~((d > 15) | (child & (d > 6))), F.lit(True)) | a.isNull() | b.isNull()


def composite(name: Column, age: Column, location: Column, weights: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> Column:
    """FN33: weighted sum of the three scores."""
    return weights[0] * name + weights[1] * age + weights[2] * location


def within_cooldown(last: Column, now: Column, hours: int = 24) -> Column:
    """FN34: whether the last time, a text or timestamp, is less than so many hours ago; false if unknown or malformed."""
    t = F.try_to_timestamp(last.cast("string"))
    return F.coalesce(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(t) < hours * 3600, F.lit(False))


def within_hours(start: Column, end: Column, days: Column, ts: Column) -> Column:
    """FN35: whether ts is on one of the weekdays (array of names such as Monday) and between the two HH:mm times, which
    may span midnight. No times mean all day, no days every day."""
    t = F.date_format(ts, "HH:mm")
    inside = F.when(start <= end, (t >= start) & (t <= end)).otherwise((t >= start) | (t <= end))
    day = F.coalesce(F.array_contains(days, F.date_format(ts, "EEEE")), F.lit(True)) | (F.coalesce(F.size(days), F.lit(0)) <= 0)
    return day & F.coalesce(inside, F.lit(True))


def minute(ts: Column) -> Column:
    """FN36: a time for display, to the minute."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def newest_last(ts: Column) -> Column:
    """FN40: a sort key under which earlier times are larger, and unknown ones least."""
    return F.coalesce(-F.unix_micros(ts.cast("timestamp")), F.lit(-(1 << 62)))


def cosine(a: Column, b: Column) -> Column:
    """FN30: cosine of two arrays in double precision; null where a norm is 0 or lengths differ."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def unit(v: Column) -> Column:
    """FN30: a vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


#: Fixed thresholds of the decision rules.
INTENT_HIGH, INTENT_MIDDLE, INTENT_LOW = 0.80, 0.70, 0.65
