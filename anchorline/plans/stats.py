"""Two-sample tests and exact intervals.

The data pass is one distributed aggregate; the closing formula runs over the
handful of aggregated rows in a vectorised Python function.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from anchorline.functions import special

_INTERVAL = "lower double, upper double"


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_two_sided(a, b) if pd.notna(a) and b > 0 else None
                      for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_upper(a, b) if pd.notna(a) and b > 0 else None
                      for a, b in zip(x, df)], dtype="float64")


def _interval(function, conf: float):
    @F.pandas_udf(_INTERVAL)
    def limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(a, b, conf) for a, b in zip(k, n)],
                            columns=["lower", "upper"], dtype="float64")
    return limits


def _poisson_per_time(events: float, exposure: float, conf: float) -> tuple[float, float]:
    low, high = special.poisson_interval(events, conf)
    return low / exposure, high / exposure


def welch_t(df: DataFrame, value: str, group: str, levels: tuple[str, str]) -> DataFrame:
    """Two-sample t-test with unequal variances: first level minus second."""
    v = F.col(value).cast("double")
    cells = []
    for tag, level in zip("ab", levels):
        own = F.when(F.col(group) == level, v)
        cells += [F.count(own).alias(f"n_{tag}"), F.avg(own).alias(f"mean_{tag}"),
                  F.var_samp(own).alias(f"var_{tag}")]
    sums = df.agg(*cells)
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb)
    dof = F.pow(sa + sb, 2) / (F.pow(sa, 2) / (F.col("n_a") - 1) + F.pow(sb, 2) / (F.col("n_b") - 1))
    return (sums.select("n_a", "mean_a", "n_b", "mean_b", t.alias("t"), dof.alias("df"))
            .withColumn("p_value", _t_p("t", "df")))


def paired_t(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of ``first - second`` over rows with both."""
    diff = F.col(first).cast("double") - F.col(second).cast("double")
    sums = df.groupBy(*by).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean_difference"),
                               F.stddev_samp(diff).alias("sd"))
    t = F.col("mean_difference") / (F.col("sd") / F.sqrt("n"))
    return (sums.select(*by, "n", "mean_difference", t.alias("t"),
                        (F.col("n") - 1).cast("double").alias("df"))
            .withColumn("p_value", _t_p("t", "df")))


def mcnemar(df: DataFrame, before: Column, after: Column, by: Sequence[str] = ()) -> DataFrame:
    """Continuity-corrected McNemar test on person-paired flags (one row per pair)."""
    b = F.count(F.when(before & ~after, 1)).alias("only_before")
    c = F.count(F.when(~before & after, 1)).alias("only_after")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), b, c)
    moved = F.col("only_before") + F.col("only_after")
    gap = F.abs(F.col("only_before") - F.col("only_after")) - 1
    statistic = F.when(moved > 0, F.when(gap < 0, 0.0).otherwise(F.pow(gap, 2) / moved))
    return (counts.withColumn("chi_square", statistic)
            .withColumn("p_value", chi2_p("chi_square", F.lit(1.0))))


def poisson_rate_ci(rates: DataFrame, events: str = "events", exposure: str = "person_years",
                    per: float = 1, conf: float = 0.95) -> DataFrame:
    """Exact Poisson limits of events per ``per`` units of exposure, per row."""
    limits = _interval(_poisson_per_time, conf)(F.col(events).cast("double"),
                                                F.col(exposure).cast("double"))
    return (rates.withColumn("__ci", limits)
            .withColumns({"lower": F.col("__ci.lower") * per, "upper": F.col("__ci.upper") * per})
            .drop("__ci"))


def binomial_ci(counts: DataFrame, k: str, n: str, conf: float = 0.95,
                null_p: float = 0.5) -> DataFrame:
    """Exact proportion limits and two-sided p-value against ``null_p``, per row."""
    @F.pandas_udf("double")
    def p_value(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([special.binomial_two_sided(int(a), int(b), null_p)
                          for a, b in zip(x, m)], dtype="float64")

    limits = _interval(special.binomial_interval, conf)(F.col(k).cast("double"),
                                                        F.col(n).cast("double"))
    return (counts.withColumn("proportion", F.col(k) / F.col(n)).withColumn("__ci", limits)
            .withColumns({"lower": F.col("__ci.lower"), "upper": F.col("__ci.upper"),
                          "p_value": p_value(k, n)}).drop("__ci"))


def poisson_compare(rates: DataFrame, group: str, levels: tuple[str, str],
                    events: str = "events", exposure: str = "person_years",
                    conf: float = 0.95) -> DataFrame:
    """Exact test that two Poisson rates are equal, with their ratio's limits.

    Conditional on the total, the first count is binomial.
    """
    cells = []
    for tag, level in zip("ab", levels):
        own = F.col(group) == level
        cells += [F.sum(F.when(own, F.col(events))).alias(f"events_{tag}"),
                  F.sum(F.when(own, F.col(exposure))).alias(f"exposure_{tag}")]
    one = rates.agg(*cells)

    @F.pandas_udf("rate_ratio double, lower double, upper double, p_value double")
    def close(xa: pd.Series, ta: pd.Series, xb: pd.Series, tb: pd.Series) -> pd.DataFrame:
        rows = []
        for a, s, b, t in zip(xa, ta, xb, tb):
            n, p0 = int(a + b), s / (s + t)
            low, high = special.binomial_interval(a, n, conf)
            rows.append((
                (a / s) / (b / t) if b else float("inf"),
                low / (1 - low) * t / s,
                high / (1 - high) * t / s if high < 1 else float("inf"),
                special.binomial_two_sided(int(a), n, p0)))
        return pd.DataFrame(rows, columns=["rate_ratio", "lower", "upper", "p_value"])

    return (one.withColumn("__t", close("events_a", "exposure_a", "events_b", "exposure_b"))
            .select("events_a", "exposure_a", "events_b", "exposure_b", "__t.*"))
