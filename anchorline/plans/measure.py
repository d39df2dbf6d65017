"""Paired measurements near the index date."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import Bounds
from anchorline.functions.values import in_open_range
from anchorline.operators.joins import anchored_window
from anchorline.schema import INDEX, PERSON, TIME

Ranges = Mapping[str, tuple[float | None, float | None]]
SIDE = "side"


def plausible(df: DataFrame, column: str, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Rows with a value strictly between the bounds."""
    return df.where(in_open_range(F.col(column), low, high))


def paired_reading(events: DataFrame, cohort: DataFrame, bounds: Bounds, ranges: Ranges,
                   kinds: tuple[str, str] = ("systolic", "diastolic"),
                   floor: float | None = 10, pick: str = "earliest_and_lowest") -> DataFrame:
    """Earliest plausible pair of two kinds taken at the same moment.

    ``events`` has ``kind`` and ``value``.  Equal values of one person and
    moment count once (the alphabetically first kind keeps it).  Where a moment
    has several values of a kind the lowest is used.  By default the person is
    kept only if that earliest pair also has the lowest first-kind value of its
    day; ``pick="earliest"`` keeps every earliest pair.

    The pair is a conditional aggregate per (person, moment): no self-join, and
    a person's readings never meet in one group larger than one calendar day.
    """
    near = anchored_window(_readings(events, kinds, floor), cohort, bounds)
    return _earliest_pairs(near, (), ranges, kinds, pick)


def paired_sides(events: DataFrame, cohort: DataFrame, sides: Mapping[str, Bounds], ranges: Ranges,
                 kinds: tuple[str, str] = ("systolic", "diastolic"),
                 floor: float | None = 10, pick: str = "earliest_and_lowest") -> DataFrame:
    """``paired_reading`` for several named windows at once: one row per (person, side).

    Each reading is tagged with the windows that it lies in, so events are read and joined once.
    """
    def any_side(event: Column, index: Column) -> Column:
        return reduce(lambda a, b: a | b, [bounds(event, index) for bounds in sides.values()])
    near = anchored_window(_readings(events, kinds, floor), cohort, any_side)
    tags = F.array(*[F.when(bounds(F.col(TIME), F.col(INDEX)), F.lit(tag)) for tag, bounds in sides.items()])
    return _earliest_pairs(near.withColumn(SIDE, F.explode(F.array_compact(tags))), (SIDE,), ranges, kinds, pick)


def _readings(events: DataFrame, kinds: tuple[str, str], floor: float | None) -> DataFrame:
    rows = events.where(F.col("kind").isin(list(kinds)))
    return rows if floor is None else plausible(rows, "value", floor)


def _earliest_pairs(near: DataFrame, extra: tuple[str, ...], ranges: Ranges, kinds: tuple[str, str], pick: str) -> DataFrame:
    """The earliest pair of every (person, *extra)."""
    upper, lower = kinds
    keys = (PERSON, *extra)
    first_kind = min(kinds)
    single = near.groupBy(*keys, TIME, "value").agg(
        F.max(F.col("kind") == first_kind).alias("is_first"), F.min(INDEX).alias(INDEX))

    def low(kind: str):
        own = F.col("is_first") if kind == first_kind else ~F.col("is_first")
        ok = own & in_open_range(F.col("value"), *ranges[kind])
        return F.min(F.when(ok, F.col("value"))).alias(kind)

    pairs = (single.groupBy(*keys, TIME).agg(low(upper), low(lower), F.min(INDEX).alias(INDEX))
             .where(F.col(upper).isNotNull() & F.col(lower).isNotNull()))
    days = pairs.groupBy(*keys, F.to_date(TIME).alias("day")).agg(
        F.min(F.struct(TIME, upper, lower)).alias("first"),
        F.min(upper).alias("day_low"), F.min(INDEX).alias(INDEX))
    earliest = days.groupBy(*keys).agg(
        F.min(F.struct("day", "first", "day_low")).alias("e"), F.min(INDEX).alias(INDEX))
    out = earliest.select(
        *keys, INDEX, F.col(f"e.first.{TIME}").alias("reading_time"),
        F.col("e.day").alias("reading_date"), F.col(f"e.first.{upper}").alias(upper),
        F.col(f"e.first.{lower}").alias(lower), F.col("e.day_low").alias("__low"))
    if pick == "earliest_and_lowest":
        out = out.where(F.col(upper) == F.col("__low"))
    return out.drop("__low")


def paired_change(events: DataFrame, cohort: DataFrame, pre: Bounds, post: Bounds, ranges: Ranges,
                  kinds: tuple[str, str] = ("systolic", "diastolic"), floor: float | None = 10,
                  pick: str = "earliest_and_lowest") -> DataFrame:
    """``before_after`` of both windows' pairs from one scan of the events: one aggregate tells the sides apart."""
    rows = paired_sides(events, cohort, {"pre": pre, "post": post}, ranges, kinds, floor, pick)
    cells = [F.max(F.when(F.col(SIDE) == tag, F.col(column))).alias(f"{tag}_{name}")
             for tag in ("pre", "post") for column, name in (*[(k, k) for k in kinds], ("reading_date", "date"))]
    both = rows.groupBy(PERSON).agg(*cells).where("pre_date IS NOT NULL AND post_date IS NOT NULL")
    return both.withColumns({f"{k}_difference": F.col(f"post_{k}") - F.col(f"pre_{k}") for k in kinds})


def before_after(pre: DataFrame, post: DataFrame,
                 kinds: tuple[str, str] = ("systolic", "diastolic")) -> DataFrame:
    """Persons with a reading on both sides, and the change."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(PERSON, *[F.col(k).alias(f"{tag}_{k}") for k in kinds],
                         F.col("reading_date").alias(f"{tag}_date"))
    both = side(pre, "pre").join(side(post, "post"), PERSON)
    return both.withColumns({f"{k}_difference": F.col(f"post_{k}") - F.col(f"pre_{k}")
                             for k in kinds})
