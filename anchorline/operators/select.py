"""Per-key selection.

Two shapes are used, both bounded before the shuffle even when one key owns a
third of the table: ``row_number() <= k`` (Spark puts a per-task group limit
under the exchange) and plain aggregates (map-side combine).  What needs a whole
group in order goes over ranges of its rows (``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.operators import scan

_RANK = "__rank"


def _cols(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def top_n_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int,
              rank_as: str | None = None) -> DataFrame:
    """First ``n`` rows per key; ``order`` must be a total order to be repeatable."""
    name = rank_as or _RANK
    window = Window.partitionBy(*_cols(key)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank_as else out.drop(name)


def first_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_n_per(df, key, order, 1)


def last_per(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by the named columns, NULLs never preferred."""
    return top_n_per(df, key, [F.col(c).desc_nulls_last() for c in order], 1)


def dedupe_latest(df: DataFrame, key: str | Sequence[str], dates: Sequence[str],
                  ties: Sequence[str] = ()) -> DataFrame:
    """Latest record per key by ``dates`` in turn, then a fixed choice among ties."""
    order = [F.col(c).desc_nulls_last() for c in dates] + [F.col(c).asc_nulls_last() for c in ties]
    return top_n_per(df, key, order, 1)


def rank_per(df: DataFrame, key: str | Sequence[str], column: str, rank_as: str,
             at_most: int = 1, descending: bool = True) -> DataFrame:
    """Rows ranked ``1..at_most`` per key by ``column``, ties sharing a rank, NULLs last.

    Ties are not limited in number, so they are never brought together: ranks
    are worked out on (key, value, count) rows, of which at most ``at_most`` per
    key matter, and joined back to the rows, a join adaptive execution can split.
    """
    keys = _cols(key)
    order = F.col("__v").desc_nulls_last() if descending else F.col("__v").asc_nulls_last()
    counts = df.groupBy(*keys, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = top_n_per(counts, keys, [order], at_most)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = best.withColumn(_RANK, (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) + 1).cast("int"))
    side = ranked.where(F.col(_RANK) <= at_most).select(
        *[F.col(k).alias(f"__{k}") for k in keys], "__v", F.col(_RANK).alias(rank_as))
    match = F.col(column).eqNullSafe(F.col("__v"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(side, match).drop("__v", *[f"__{k}" for k in keys])


def drop_exact_duplicates(df: DataFrame, keys: Sequence[str],
                          keep: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``; the row smallest by ``keep`` (default: the rest) survives."""
    rest = [c for c in df.columns if c not in keys]
    order = list(keep) + [c for c in rest if c not in keep]
    if not order:
        return df.dropDuplicates(list(keys))
    if len(order) == 1:
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*df.columns)
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)
                           for c in df.columns])


def keep_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Only keys that occur once (ambiguous keys are dropped, not deduplicated).

    An aggregate, not a window count: a key with many rows costs one counter.
    Where a key is kept its group is one row, so any value of it is the value.
    """
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                    *[F.first(c).alias(c) for c in rest])
    return counted.where(F.col("__n") == 1).select(*df.columns)


def sample_per(df: DataFrame, key: str | Sequence[str], value: str, seed: int, n: int = 1) -> DataFrame:
    """``n`` random distinct values per key (all, if there are fewer), the same on every run, layout and engine.

    Values are drawn in the order of md5(seed|key|value).  The first n of a task are all that leaves
    it, and the first n of those are the draw: a key with any number of rows costs n rows a task.
    """
    keys = _cols(key)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, value)]))
    if n == 1:
        pick = F.min(F.struct(draw.alias("draw"), F.col(value).alias("value"))).alias("__pick")
        return rows.groupBy(*keys).agg(pick).select(*keys, F.col("__pick.value").alias(value))
    return top_n_per(rows.distinct().withColumn("__draw", draw), keys, [F.col("__draw")], n).drop("__draw")


def sample_one_per(df: DataFrame, key: str | Sequence[str], value: str, seed: int) -> DataFrame:
    """One random distinct ``value`` per key."""
    return sample_per(df, key, value, seed)


def gap_to_previous(rows: DataFrame, key: str, time: str, gap_as: str = "gap_days",
                    order: Sequence[str] = (), store: str | None = None) -> DataFrame:
    """Days since the key's previous row, NULL at its first.

    Rows need not be collapsed to days: a key's rows are cut into ranges of bounded size, and each
    range takes its first row's predecessor from the one before.  Rows are written at once.
    """
    cut = scan.ranges(rows, [key], [F.col(time), *[F.col(c) for c in order]], store=store)
    out = scan.neighbour(cut, F.col(time), "__before")
    return out.withColumn(gap_as, F.datediff(F.col(time), F.col("__before"))).drop("__before", scan.PART)


def cumulative(df: DataFrame, by: Sequence[str], order: Sequence[Column], store: str | None = None,
               **totals: tuple[str, Column]) -> DataFrame:
    """Running aggregates per group, or over all rows with no ``by``: name=(kind, value), kind one of scan.KINDS.

    A prefix scan over ranges of rows, so neither a hot group nor a whole table is one task's
    work.  ``order`` must be a total order within the group to be repeatable.  Rows are written at once.
    """
    cut = scan.ranges(df, by, order, store=store)
    return scan.prefix_scan(cut, **totals).drop(scan.PART)
