"""Periods: buckets of days, calendars, bounds and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: First letters of months and abbreviations of weekdays, Monday first: fixed values.
MONTHS, WEEKDAYS = tuple("JFMAMJJASOND"), ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def bucket(day: Column, grain: str) -> Column:
    """The period of a day as text: year, month (2000-01), ISO week (2000-52 of the week's year) or weekday (Monday is 0)."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    if grain == "week":
        return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), day).cast("string"), two(F.weekofyear(day)))
    return {"year": F.year(day).cast("string"), "month": F.concat_ws("-", F.year(day).cast("string"), two(F.month(day))), "dow": F.weekday(day).cast("string")}[grain]


def bucket_left(day: Column, grain: str) -> Column:
    """The first day of the period."""
    return F.trunc(day, grain)


def bucket_label(day: Column, grain: str) -> Column:
    """A short label: the month's letter, the weekday's abbreviation, or the number of the week or year."""
    if grain == "month":
        return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    if grain == "dow":
        return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)
    return (F.weekofyear(day) if grain == "week" else F.year(day)).cast("string")


def rollup_calendar(tuples: DataFrame, grain: str) -> DataFrame:
    """(t, day, bucket, left) for every day from the first to the last, t numbering the periods from 0. A row per day."""
    span = tuples.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    left = bucket_left(F.col("day"), grain)
    return days.select((F.dense_rank().over(W.orderBy(left)) - 1).alias("t"), "day", bucket(F.col("day"), grain).alias("bucket"), left.alias("left"))


def period_bounds(calendar: DataFrame) -> DataFrame:
    """Per period its number from 1, left date and last day present."""
    return calendar.groupBy("t").agg(F.min("left").alias("left"), F.max("day").alias("right")).select((F.col("t") + 1).alias("index"), "left", "right")


def label_times(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """df (t, ...) with the period's left date in place of t."""
    return df.join(calendar.select("t", "left").distinct(), "t").drop("t")


def fill_linear(series: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """series (*keys, t, value) with `filled`: nulls interpolated between observed steps and constant beyond them. With
    compat the right end takes the value before the last observed one."""
    by = W.partitionBy(*keys).orderBy("t")
    # What lies ahead is past in the order turned round: a frame to the group's end would be read again for each row.
    past, ahead = (w.rowsBetween(W.unboundedPreceding, 0) for w in (by, W.partitionBy(*keys).orderBy(F.desc_nulls_last("t"))))
    seen = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    out = series.withColumns({"_l": F.last(seen, ignorenulls=True).over(past), "_r": F.last(seen, ignorenulls=True).over(ahead)})
    between = F.col("_l.value") + (F.col("_r.value") - F.col("_l.value")) * (F.col("t") - F.col("_l.t")) / F.nullif(F.col("_r.t") - F.col("_l.t"), F.lit(0))
    end = F.col("_l.value")
    if compat:
        names = ", ".join(f"`{k}`" for k in keys)
        out = out.withColumn("_o", F.expr(f"lag(value) IGNORE NULLS OVER ({f'PARTITION BY {names}' if keys else ''} ORDER BY t)"))
        out = out.withColumn("_p", F.last(F.when(F.col("value").isNotNull(), F.col("_o")), ignorenulls=True).over(past))
        end = F.coalesce("_p", "_l.value")
    filled = F.coalesce("value", F.when(F.col("_l").isNull(), F.col("_r.value")).when(F.col("_r").isNull(), end).otherwise(between))
    return out.withColumn("filled", filled).drop("_l", "_r", "_o", "_p")
