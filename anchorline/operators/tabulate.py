"""Counts, shares, quantiles and summary tables.

Each is one aggregate whose map side already reduces a group to a few numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.operators import scan
from anchorline.operators.joins import join_groups


def group_count(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Two-way counts with one column per level; absent cells are 0."""
    cells = [F.count(F.when(F.col(columns) == level, 1)).alias(str(level)) for level in levels]
    return df.groupBy(rows).agg(*cells)


def pct_within(df: DataFrame, group: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Count per (group, within), the total per ``within`` and the percentage.

    The window runs over the counted rows only.
    """
    counts = group_count(df, [*within, *group])
    total = F.sum("n").over(Window.partitionBy(*within))
    return (counts.withColumn("total", total)
            .withColumn("percent", F.col("n") / F.col("total") * 100))


def prevalence(df: DataFrame, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Persons, persons flagged and percent flagged; a NULL flag counts as no."""
    yes = F.coalesce(flag.cast("boolean"), F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(yes, 1)).alias("n_flagged"),
        (F.avg(yes.cast("double")) * 100).alias("percent"))


def attrition(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative step: (step_no, step, n) in one pass."""
    passed, cells = F.lit(True), []
    for i, (name, keep) in enumerate(steps):
        passed = passed & F.coalesce(keep, F.lit(False))
        cells.append(F.count(F.when(passed, 1)).alias(f"s{i}"))
    counted = df.agg(*cells)
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                              F.col(f"s{i}").alias("n"))
                     for i, (name, _) in enumerate(steps)])
    return counted.select(F.inline(rows))


def n_persons(df: DataFrame, key: str, name: str = "n_persons") -> DataFrame:
    return df.agg(F.countDistinct(key).alias(name))


def describe_by(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null count, mean, sample standard deviation, minimum and maximum."""
    v = F.col(column)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"))


#: The sketch that places the cuts is off by no more than one in so many ranks.
ACCURACY = 10_000


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (),
              accuracy: int = ACCURACY, store: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics.

    A mergeable sketch of each group gives, for every wanted rank, two values that it must lie between.  All rows
    outside such ranges collapse to one count per gap between them; only values inside are kept, with their
    counts, and ordered by a prefix scan that gives exact ranks.  Groups of up to
    ``accuracy`` rows are one range.  That a wanted rank lies outside its range would be an error, not
    another value.  The counted ranges are written at once; ``df`` is read twice.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    base = df.where(F.col(column).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(column).cast("double").alias("v"))
    ends = sorted({f for p in probs for f in (max(0.0, p - 4 / accuracy), min(1.0, p + 4 / accuracy))})
    sketch = F.expr(f"percentile_approx(v, array({', '.join(f'{f}D' for f in ends)}), {accuracy})")
    cuts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("cuts"))
    if keys:
        met = join_groups(base, cuts, keys)
    else:
        met = base.select("v", cuts.select(F.struct("rows", "cuts")).scalar().alias("c")).select("v", "c.rows", "c.cuts")
    # a gap is known by the ranges' ends that lie below it
    gap, kept = F.lit(0), F.col("rows") <= accuracy
    for p in probs:
        low, high = (F.col("cuts")[ends.index(f)] for f in (max(0.0, p - 4 / accuracy), min(1.0, p + 4 / accuracy)))
        kept = kept | F.col("v").between(low, high)
        gap = gap + (F.col("v") > high).cast("int")
    placed = met.select(*keys, F.when(~kept, gap).alias("gap"), F.when(kept, F.col("v")).alias("v"),
                        F.col("v").alias("least"))
    counts = placed.groupBy(*keys, "gap", "v").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    cut = scan.ranges(counts, keys, [F.col("least")], store=store)
    ranked = scan.prefix_scan(cut, whole={"total": "upto"}, upto=("sum", F.col("n")))
    cells, outs = [], []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
            value = F.coalesce("v", F.raise_error(F.lit("a wanted rank lies outside its range")).cast("double"))
            cells.append(F.max(F.when(hit, value)).alias(f"{tag}{i}"))
        frac = (F.col("total") - 1) * F.lit(float(p))
        frac = frac - F.floor(frac)
        outs.append((F.col(f"lo{i}") + frac * (F.col(f"hi{i}") - F.col(f"lo{i}")))
                    .alias(quantile_name(p)))
    summary = ranked.groupBy(*keys, "total").agg(*cells)
    return summary.select(*[F.col(k).alias(c) for k, c in zip(keys, by)],
                          F.col("total").alias("n"), *outs)


def quantile_name(p: float) -> str:
    """0.25 -> 'q25', 0.975 -> 'q97_5'."""
    return f"q{p * 100:g}".replace(".", "_")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal-width, left-closed bins; 0 is below ``low``, bins+1 from ``high`` up."""
    v = F.col(column).cast("double")
    return (df.where(v.isNotNull())
            .groupBy(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def summary_table(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                  dependent: str | None = None, na_include: bool = False,
                  totals: bool = False, na_to_p: bool = True, column_totals: bool = False) -> DataFrame:
    """Descriptive table, long form: one row per (variable, level[, dependent]).

    Numeric variables give n, mean and sd under the level 'mean'; categories
    give n and the percentage within (variable, dependent level).  ``na_include``
    adds a row for NULLs under the label 'missing', apart from a level of that name; ``totals`` a row with every
    column's n.  Without ``na_to_p`` the
    NULLs have no percentage and are not in the others' denominator; ``column_totals`` gives
    the total row each dependent level's percentage of all rows.  One
    unpivot and one aggregate whatever the number of variables.
    """
    split = [F.col(dependent).cast("string").alias("dependent")] if dependent else []
    keep = ["dependent"] if dependent else []
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("variable"),
                      F.when(F.col(c).isNotNull(), F.lit("mean")).alias("level"),
                      F.col(c).cast("double").alias("value"))
             for i, c in enumerate(numeric)]
    cells += [F.struct(F.lit(len(numeric) + i).alias("position"), F.lit(c).alias("variable"),
                       F.col(c).cast("string").alias("level"),
                       F.lit(None).cast("double").alias("value"))
              for i, c in enumerate(categorical)]
    if totals:
        cells.insert(0, F.struct(F.lit(-1).alias("position"), F.lit("total").alias("variable"),
                                 F.lit("n").alias("level"), F.lit(None).cast("double").alias("value")))
    long = df.select(*split, F.inline(F.array(*cells)))
    if not na_include:
        long = long.where(F.col("level").isNotNull())
    grouped = long.groupBy("position", "variable", *keep, "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"))
    in_variable = Window.partitionBy("position", "variable", *keep)
    counted = F.col("n") if na_to_p else F.when(F.col("level").isNotNull(), F.col("n"))
    percent = F.when(F.col("position") >= len(numeric), counted / F.sum(counted).over(in_variable) * 100)
    if column_totals:
        of_all = F.col("n") / F.sum("n").over(Window.partitionBy("position", "variable")) * 100
        percent = F.when(F.col("position") == -1, of_all).otherwise(percent)
    return grouped.select("position", "variable", *keep, F.coalesce("level", F.lit("missing")).alias("level"),
                          "n", "mean", "sd", percent.alias("percent"))
