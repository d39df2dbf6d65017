"""Running aggregates and neighbours over ranges of rows.

A window partitioned by the group alone gives a hot group, or a whole table, to one task.
Here the sorted rows are cut into ranges of bounded size instead; windows run inside a range, and what lies
before a range comes from one row of totals per (group, range).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.operators.joins import join_groups
from anchorline.session import written

#: Rows that one task orders.
ROWS_PER_RANGE = 200_000
PART = "__part"
#: kind of running aggregate: (aggregate, what combines an earlier total with a later one)
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


@dataclass(frozen=True)
class Ranges:
    """Written rows with the number of their range in ``PART``, and how many ranges there are.

    Ranges follow one another in the order (by, order); rows that agree on these share a range.
    """

    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[Column, ...]
    parts: int

    def window(self) -> Window:
        return Window.partitionBy(PART, *self.by).orderBy(*self.order)

    def totals(self, **cells: Column) -> DataFrame:
        """One row per (by, range): the only rows that are looked at across ranges."""
        return self.rows.groupBy(*self.by, PART).agg(*[c.alias(n) for n, c in cells.items()])

    def across(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(PART)


def ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column], rows: int | None = None,
           store: str | None = None) -> Ranges:
    """Write ``df``, cut into as many ranges of its sort order as its number of rows asks for.

    Runs jobs at once: rows are written, and written again by ranges if they are more than ``rows``
    (default ``ROWS_PER_RANGE``).  Range numbers are stored, so no retry can change them.
    """
    rows = rows or ROWS_PER_RANGE
    held = written(df.withColumn(PART, F.lit(0)), store)
    parts = -(-held.count() // rows)
    if parts > 1:
        sorted_by = [*[F.col(c) for c in by], *order]
        cut = held.repartitionByRange(parts, *sorted_by).withColumn(PART, F.spark_partition_id())
        held = written(cut, store, instead_of=held)
    return Ranges(held, tuple(by), tuple(order), max(parts, 1))


def prefix_scan(cut: Ranges, before: bool = False, whole: Mapping[str, str] | None = None,
                **totals: tuple[str, Column]) -> DataFrame:
    """Running aggregates of every group along the order of ``cut``.

    ``totals`` maps a new column to (kind, value), kind a key of ``KINDS``; each covers the rows of the group up to
    its own, or with ``before`` up to the one before it (NULL at the first).  ``whole`` names
    further columns that get the whole group's value of a total.
    """
    end = -1 if before else Window.currentRow
    inside = cut.window().rowsBetween(Window.unboundedPreceding, end)
    whole = whole or {}
    if cut.parts == 1:
        group = Window.partitionBy(PART, *cut.by)
        return cut.rows.select("*", *[KINDS[k][0](v).over(inside).alias(n) for n, (k, v) in totals.items()],
                               *[KINDS[totals[n][0]][0](totals[n][1]).over(group).alias(w) for w, n in whole.items()])
    earlier = cut.across().rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*cut.by)
    sums = cut.totals(**{n: KINDS[k][0](v) for n, (k, v) in totals.items()})
    offsets = sums.select(*cut.by, PART, *[KINDS[k][0](n).over(earlier).alias(f"__{n}") for n, (k, _) in totals.items()],
                          *[KINDS[totals[n][0]][0](n).over(everything).alias(w) for w, n in whole.items()])
    running = cut.rows.select("*", *[KINDS[k][0](v).over(inside).alias(n) for n, (k, v) in totals.items()])
    met = join_groups(running, offsets, [*cut.by, PART])
    combined = {n: F.coalesce(KINDS[k][1](F.col(f"__{n}"), F.col(n)), F.col(n), F.col(f"__{n}"))
                for n, (k, _) in totals.items()}
    return met.withColumns(combined).drop(*[f"__{n}" for n in totals])


def neighbour(cut: Ranges, column: Column, name: str, ahead: bool = False) -> DataFrame:
    """``cut``'s rows with the previous (or, ``ahead``, the next) row's ``column`` in its group.

    A range's first row takes it from the last row of the group in an earlier range, one row per (group, range).
    """
    shift = F.lead if ahead else F.lag
    out = cut.rows.select("*", shift(column).over(cut.window()).alias(name),
                          F.row_number().over(cut.window()).alias("__at"),
                          F.count(F.lit(1)).over(Window.partitionBy(PART, *cut.by)).alias("__n"))
    edge = F.col("__at") == (F.col("__n") if ahead else F.lit(1))
    if cut.parts == 1:
        return out.drop("__at", "__n")
    own = F.row_number().over(cut.window())
    last = F.col("__own") == (F.lit(1) if ahead else F.col("__m"))
    ends = (cut.rows.select(*cut.by, PART, column.alias("__value"), own.alias("__own"),
                            F.count(F.lit(1)).over(Window.partitionBy(PART, *cut.by)).alias("__m")).where(last))
    beyond = ends.select(*cut.by, PART, shift("__value").over(cut.across()).alias("__beyond"))
    met = join_groups(out, beyond, [*cut.by, PART])
    return met.withColumn(name, F.when(edge, F.col("__beyond")).otherwise(F.col(name))).drop("__at", "__n", "__beyond")
