"""Survival curves, log-rank test and proportional hazards.

Persons are collapsed to counts per (stratum, time) before anything is ordered,
with map-side combine, so the ordered windows run over at most (distinct days x
strata) rows however many persons there are.  Running sums go by ranges of time, so finer times
only mean more ranges.  Curves, tests and regressions write their collapsed rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.functions import special
from anchorline.operators import scan
from anchorline.plans.stats import chi2_p

#: Collapsed rows that one task orders.
ROWS_PER_RANGE = 200_000


def _collapse(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """(by, time, events, exits); rows with no time are left out, a NULL event is censored."""
    hit = F.coalesce(F.col(event).cast("int"), F.lit(0))
    return (df.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("time"))
            .agg(F.sum(hit).alias("events"), F.count(F.lit(1)).alias("exits")))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = (),
                 conf: float = 0.95, store: str | None = None) -> DataFrame:
    """Product-limit curve per stratum with Greenwood error and log-scale limits.

    One row per stratum and distinct time.  Where the curve reaches 0 the error
    is undefined and the limits are NULL.  Both the curve and its variance are prefix scans over ranges of
    time: a range's totals of exits give those at risk in the next, and its product of survival and sum of variance
    are the next one's start.  Collapsed rows are written at once (to ``store`` or the shared folder).
    """
    cut = scan.ranges(_collapse(df, time, event, by), by, [F.col("time")], ROWS_PER_RANGE, store)
    left = scan.prefix_scan(cut, whole={"persons": "gone"}, gone=("sum", F.col("exits")))
    risk = left.withColumn("at_risk", F.col("persons") - F.col("gone") + F.col("exits")).drop("persons", "gone")
    died, n = F.col("events"), F.col("at_risk")
    variance = F.when(died > 0, F.when(n > died, died / (n * (n - died)))
                      .otherwise(F.lit(float("inf")))).otherwise(0.0)
    curve = scan.prefix_scan(replace(cut, rows=risk), survival=("product", 1 - died / n), variance=("sum", variance))
    z = special.normal_quantile(0.5 + conf / 2)
    s, se = F.col("survival"), F.sqrt("variance")
    known = s > 0
    return curve.select(
        *by, "time", "at_risk", "events", (F.col("exits") - died).alias("censored"), "survival",
        F.when(known, s * se).alias("std_err"),
        F.when(known, s * F.exp(-z * se)).alias("lower"),
        F.when(known, F.least(F.lit(1.0), s * F.exp(z * se))).alias("upper"))


def median_survival(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Persons, events and median with its limits, per stratum.

    The median is the first time the curve is at or below one half; if it stays
    exactly there, the middle of that flat stretch.
    """
    tol = 1.5e-8

    def crossing(column: str) -> Column:
        reach = F.min(F.when(F.col(column) < 0.5 + tol, F.col("time")))
        below = F.min(F.when(F.col(column) < 0.5 - tol, F.col("time")))
        return F.when(below.isNull(), reach.cast("double")).otherwise((reach + below) / 2.0)

    return curve.groupBy(*by).agg(
        F.max("at_risk").alias("persons"), F.sum("events").alias("events"),
        crossing("survival").alias("median"),
        crossing("lower").alias("median_lower"), crossing("upper").alias("median_upper"))


def km_at(curve: DataFrame, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Survival, its limits and the number at risk at fixed times.

    Each curve row is tested against the requested times in one aggregate: the
    step in force is the last at or before the time, and those at risk are the
    people who have not left before it.
    """
    at = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("at")
    rows = curve.select("*", at)
    reached = F.col("time") <= F.col("at")
    left = F.when(F.col("time") < F.col("at"), F.col("events") + F.col("censored")).otherwise(0)
    step = F.max(F.when(reached, F.struct("time", "survival", "lower", "upper")))
    out = rows.groupBy(*by, "at").agg(
        step.alias("step"), (F.max("at_risk") - F.sum(left)).alias("at_risk"))
    return out.select(*by, F.col("at").alias("time"), "at_risk",
                      *[F.when(F.col("step").isNull(), F.lit(1.0))
                        .otherwise(F.col(f"step.{c}")).alias(c)
                        for c in ("survival", "lower", "upper")])


#: Terms a regression may have: their sums per range, terms squared, travel to the driver.
MOST_LEVELS = 1_000


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct levels of a grouping column; a model has a term for each.

    A column with more than ``MOST_LEVELS`` of them (free text, an identifier) is an error.
    """
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has over {MOST_LEVELS} levels; group them before they become terms")
    return sorted(r[0] for r in found)


#: Where a coefficient without end is held: the weight of its level is nothing, or everything, to 13 digits.
FAR = 30.0
#: Numbers of a block of (event times x groups) that a task looks at together.
BLOCK = 1 << 19


def _log_rank_part(groups: int):
    """Sums over the event times of one range: per group a row of the covariance, observed, expected.

    Groups are numbers.  A group's risk set changes only where it loses somebody, so exits are put on the last event time that
    they still count for, and risk sets are built from the latest time back in blocks of ``BLOCK`` numbers.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        risk = np.zeros(groups)
        beyond = pdf["time"].isna().to_numpy()
        np.add.at(risk, pdf["g"].to_numpy()[beyond], pdf["exits"].to_numpy(float)[beyond])
        g, time, events, exits = (pdf[c].to_numpy()[~beyond] for c in ("g", "time", "events", "exits"))
        times = np.unique(time[events > 0])
        at = np.searchsorted(times, time, side="right") - 1     # -1: gone before the first event
        order = np.argsort(at, kind="stable")
        g, at, events, exits = g[order], at[order], events[order].astype(float), exits[order].astype(float)
        v, observed, expected = np.zeros((groups, groups)), np.zeros(groups), np.zeros(groups)
        step = max(1, BLOCK // groups)
        for top in range(len(times), 0, -step):
            low = max(0, top - step)
            rows = slice(*np.searchsorted(at, [low, top]))
            lost, dead = np.zeros((top - low, groups)), np.zeros((top - low, groups))
            np.add.at(lost, (at[rows] - low, g[rows]), exits[rows])
            np.add.at(dead, (at[rows] - low, g[rows]), events[rows])
            held = lost[::-1].cumsum(0)[::-1] + risk
            risk = held[0].copy()
            n, d = held.sum(1), dead.sum(1)
            share = held / n[:, None]
            spread = d * (n - d) / np.maximum(n - 1, 1)
            v -= share.T @ (share * spread[:, None])
            v[np.diag_indices(groups)] += (share * spread[:, None]).sum(0)
            observed += dead.sum(0)
            expected += (share * d[:, None]).sum(0)
        return pd.DataFrame({"g": np.arange(groups), "v": list(v), "observed": observed, "expected": expected})
    return run


def _log_rank_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's sums over all ranges."""
    v = pdf["v"].iloc[0].copy()
    for more in pdf["v"].iloc[1:]:
        v += more
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "v": [v], "observed": [pdf["observed"].sum()],
                         "expected": [pdf["expected"].sum()]})


def _chi_square(pdf: pd.DataFrame) -> pd.DataFrame:
    """The test from one row per group."""
    pdf = pdf.sort_values("g")
    gap = (pdf["observed"] - pdf["expected"]).to_numpy()
    used = np.flatnonzero(pdf["expected"].to_numpy() > 0)[:-1]
    chi = None
    if len(used):
        v = np.stack(pdf["v"].to_list())[np.ix_(used, used)]
        try:
            chi = float(gap[used] @ np.linalg.solve(v, gap[used]))
        except np.linalg.LinAlgError:       # a risk set without variance
            chi = float(gap[used] @ np.linalg.pinv(v, hermitian=True) @ gap[used])
    return pdf[["g", "observed", "expected"]].assign(chi_square=chi, df=float(len(used)))


def log_rank(df: DataFrame, time: str, event: str, group: str,
             levels: Sequence | None = None, store: str | None = None) -> DataFrame:
    """Observed and expected events per group, with the chi-square test.

    One row per group: persons, observed, expected, chi_square, df, p_value
    (the last three repeat on every row).  Ranges of time are summed apart, each from the groups' numbers that leave after
    it; a task holds a block of risk sets and one number per pair of groups, and so does the
    task that solves for the test.  Collapsed rows are written at once.
    """
    if levels is not None and len(set(levels)) < 2:
        raise ValueError("need at least two groups")
    kept = df.where(F.col(group).isin(list(levels)) if levels is not None else F.col(group).isNotNull())
    steps = _collapse(kept.withColumn("__group", F.col(group).cast("string")), time, event, ["__group"])
    cut = scan.ranges(steps, [], [F.col("time")], ROWS_PER_RANGE, store)
    rows = cut.rows
    persons = rows.groupBy("__group").agg(F.sum("exits").alias("persons"))
    names = sorted((r["__group"], r["persons"]) for r in persons.collect())     # one row per group
    if not names:
        return rows.sparkSession.createDataFrame([], f"`{group}` string, persons long, observed double, expected double, "
                                                     "chi_square double, df double, p_value double")
    numbers = rows.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], "g int, __group string, persons long")
    rows = rows.join(F.broadcast(numbers.select("g", "__group")), "__group").select(
        F.col(scan.PART).alias("part"), "g", F.col("time").cast("double").alias("time"), "events", "exits")
    if cut.parts > 1:
        # of every range and group: who leaves after it
        totals = rows.groupBy("part", "g").agg(F.sum("exits").alias("exits"))
        last = F.max("part").over(Window.partitionBy("g"))
        steps = totals.withColumn("last", last)
        every = steps.select("g", "last").distinct().select("g", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
        after = Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        later = (every.join(totals, ["g", "part"], "left").select("part", "g", F.sum("exits").over(after).alias("exits"))
                 .where("exits > 0"))
        rows = rows.unionByName(later.select("part", "g", F.lit(None).cast("double").alias("time"),
                                             F.lit(0).cast("long").alias("events"), "exits"))
    schema = "g int, v array<double>, observed double, expected double"
    sums = rows.groupBy("part").applyInPandas(_log_rank_part(len(names)), schema)
    if cut.parts > 1:
        sums = sums.groupBy("g").applyInPandas(_log_rank_sum, schema)
    test = sums.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        _chi_square, "g int, observed double, expected double, chi_square double, df double")
    return (test.join(F.broadcast(numbers), "g")
            .select(F.col("__group").alias(group), "persons", "observed", "expected", "chi_square", "df")
            .withColumn("p_value", chi2_p("chi_square", "df")))


def _tied(d: np.ndarray, s0: np.ndarray, t0: np.ndarray):
    """Sums over l = 0 .. d-1 of log(u), 1/u, f/u, 1/u^2, f/u^2, f^2/u^2 with f = l/d, u = s0 - f t0.

    Few deaths are summed; for many at one time the sum is an integral with end
    corrections (a constant amount of work), or, where u nearly vanishes at the end, summed
    there and integrated before.
    """
    def terms(f, s, t):
        u = s - f * t
        return np.stack([np.log(u), 1 / u, f / u, 1 / u ** 2, f / u ** 2, f * f / u ** 2])

    out = np.zeros((6, len(d)))
    nodes, weights = np.polynomial.legendre.leggauss(32)
    for i, (n, s, t) in enumerate(zip(d.astype(int).tolist(), s0.tolist(), t0.tolist())):
        if n <= 2048:
            out[:, i] = terms(np.arange(n) / n, s, t).sum(1)
            continue
        # the last 1024 terms one by one, the others on pieces that shrink towards the end
        out[:, i] = terms(np.arange(n - 1024, n) / n, s, t).sum(1)
        low = 0.0
        while low < n - 1024:
            high = min(low + (n - low) / 2, n - 1024.0)
            x = (low + high) / 2 + (high - low) / 2 * nodes
            # the integral from l - 1/2 to l + 1/2 is the term at l up to its second derivative / 24
            out[:, i] += (terms((x - 0.5) / n, s, t) * weights).sum(1) * (high - low) / 2
            low = high
    return out


def _cox_part(terms: int, betas: np.ndarray, later: dict):
    """Log likelihood, score and information of one time range at each of ``betas``."""
    upper = np.triu_indices(terms)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", ascending=False)
        x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), terms)
        times, t = np.unique(-pdf["time"].to_numpy(float), return_inverse=True)
        exits, events = pdf["exits"].to_numpy(float), pdf["events"].to_numpy(float)
        square = x[:, upper[0]] * x[:, upper[1]]
        rows = []
        for k, beta in enumerate(betas):
            xb = x @ beta
            w = np.exp(xb)
            each = np.concatenate([np.ones((len(x), 1)), x, square], axis=1) * w[:, None]
            risk, dead = np.zeros((len(times), each.shape[1])), np.zeros((len(times), each.shape[1]))
            np.add.at(risk, t, each * exits[:, None])
            np.add.at(dead, t, each * events[:, None])
            risk = risk.cumsum(0) + later.get((int(pdf["part"].iloc[0]), k), 0.0)
            d = np.bincount(t, events, len(times))
            some = d > 0
            d, risk, dead = d[some], risk[some], dead[some]
            s1, t1, s2, t2 = (m[:, c] for c in (slice(1, 1 + terms), slice(1 + terms, None)) for m in (risk, dead))
            logs, a1, a2, b1, b2, b3 = _tied(d, risk[:, 0], dead[:, 0])
            score = (x * events[:, None]).sum(0) - (s1 * a1[:, None] - t1 * a2[:, None]).sum(0)
            cross = s1.T @ (t1 * b2[:, None])
            outer = s1.T @ (s1 * b1[:, None]) - cross - cross.T + t1.T @ (t1 * b3[:, None])
            info = (s2 * a1[:, None] - t2 * a2[:, None]).sum(0) - outer[upper]
            rows.append((k, [float((xb * events).sum() - logs.sum()), *score.tolist(), *info.tolist()]))
        return pd.DataFrame(rows, columns=["k", "sums"])
    return run


def _cox_totals(terms: int, betas: np.ndarray):
    """Weighted sums over everybody of one time range, at each of ``betas``."""
    upper = np.triu_indices(terms)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), terms)
        each = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], axis=1)
        weight = np.exp(x @ betas.T) * pdf["exits"].to_numpy(float)[:, None]
        return pd.DataFrame({"part": pdf["part"].iloc[0], "k": range(len(betas)),
                             "sums": [(each.T @ weight[:, k]).tolist() for k in range(len(betas))]})
    return run


def _monotone_part(levels: np.ndarray, later: dict):
    """Of one time range: which levels (rows of ``levels``: signs over (1, x)) bound the likelihood.

    A level's likelihood rises without end downwards unless, at some event time, one of its own has the event
    while others are at risk; upwards unless one outside it has the event while it is at risk.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.ones((len(pdf), 1)), np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)], axis=1) @ levels.T
        times, t = np.unique(-pdf["time"].to_numpy(float), return_inverse=True)
        exits, events = pdf["exits"].to_numpy(float), pdf["events"].to_numpy(float)
        risk, dead = np.zeros((len(times), len(levels) + 1)), np.zeros((len(times), len(levels) + 1))
        every = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        np.add.at(risk, t, every * exits[:, None])
        np.add.at(dead, t, every * events[:, None])
        risk = risk.cumsum(0) + later.get(int(pdf["part"].iloc[0]), 0.0)
        inside, n, d_in, d = risk[:, :-1], risk[:, -1:], dead[:, :-1], dead[:, -1:]
        return pd.DataFrame({"level": range(len(levels)),
                             "down": ((d_in > 0) & (inside < n)).any(0), "up": ((d_in < d) & (inside > 0)).any(0)})
    return run


def cox_ph(df: DataFrame, time: str, event: str, covariates: Mapping[str, Sequence | None],
           tol: float = 1e-9, conf: float = 0.95, store: str | None = None) -> DataFrame:
    """Proportional hazards on categorical covariates, Efron ties.

    ``covariates`` maps a column to its levels, reference first (``None``: found,
    in sorted order); a covariate with one level has no term.  Persons collapse to (time, covariate
    pattern, counts), written once to ``store`` (a folder; by default one below the
    shared checkpoint folder).  A Newton step is two passes over its time ranges that
    try the whole step and its halves together; only p x p sums come to the driver.

    One row per term: coefficient, hazard ratio, standard error, z, p_value, limits, iterations
    and converged.  A level that no finite coefficient fits is found before the first step, by its likelihood: it
    rises without end (or says nothing) if no one in the level has the event while others are at risk, or nobody else while the
    level is.  Its coefficient is infinite and ``converged`` false; all others are those of the limit.  If
    it is the reference, so are all other levels of the covariate.  Without terms there are no rows.
    Jobs run while the query is built.
    """
    spark = df.sparkSession
    found = {c: list(v) if v is not None else levels_of(df, c) for c, v in covariates.items()}
    terms = [(f"{column}={level}", column, level) for column, levels in found.items() for level in levels[1:]]
    schema = ("term string, coef double, hazard_ratio double, std_err double, z double, p_value double, "
              "lower double, upper double, iterations int, converged boolean")
    if not terms:
        return spark.createDataFrame([], schema)
    p = len(terms)
    known = reduce(lambda a, b: a & b, [F.col(c).isin(v) for c, v in found.items()])
    dummies = F.array(*[(F.col(c) == level).cast("double") for _, c, level in terms])
    steps = _collapse(df.where(known), time, event, list(found)).select(
        F.col("time").cast("double").alias("time"), dummies.alias("x"), "events", "exits")
    patterns = scan.ranges(steps, [], [F.col("time")], ROWS_PER_RANGE, store).rows.withColumnRenamed(scan.PART, "part")
    upper = np.triu_indices(p)

    def sums(betas: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        totals = patterns.groupBy("part").applyInPandas(_cox_totals(p, betas), "part int, k int, sums array<double>")
        by_part: dict[int, np.ndarray] = {}
        for r in totals.collect():      # per range, not per time
            by_part.setdefault(r["part"], np.zeros((len(betas), len(r["sums"]))))[r["k"]] = r["sums"]
        later, running = {}, 0.0
        for part in sorted(by_part, reverse=True):
            later |= {(part, k): running if np.isscalar(running) else running[k] for k in range(len(betas))}
            running = running + by_part[part]
        parts = patterns.groupBy("part").applyInPandas(_cox_part(p, betas, later), "k int, sums array<double>")
        width = 1 + p + len(upper[0])
        rows = {r["k"]: np.array(r[1:]) for r in parts.groupBy("k").agg(
            *[F.sum(F.col("sums")[i]) for i in range(width)]).collect()}
        out = []
        for k in range(len(betas)):
            row = rows.get(k, np.zeros(width))
            info = np.zeros((p, p))
            info[upper] = row[1 + p:]
            out.append((row[0], row[1:1 + p], info + np.triu(info, 1).T))
        return out

    # levels by (1, x): a term's own dummy, and for a reference what the covariate's terms leave
    by_level, signs = [], []
    for column, values in found.items():
        mine = [i for i, (_, c, _) in enumerate(terms) if c == column]
        if mine:
            reference = np.zeros(p + 1)
            reference[0], reference[np.array(mine) + 1] = 1, -1
            by_level += [(mine, True), *[([i], False) for i in mine]]
            signs += [reference, *np.eye(p + 1)[np.array(mine) + 1]]
    levels = np.array(signs)
    later, running = {}, 0.0
    at_zero = patterns.groupBy("part").applyInPandas(_cox_totals(p, np.zeros((1, p))), "part int, k int, sums array<double>").collect()
    for r in sorted(at_zero, key=lambda r: -r["part"]):      # per range: the numbers at risk after it
        later[r["part"]] = running
        n = np.array(r["sums"][:p + 1])
        running = running + np.r_[levels @ n, n[0]]
    bound = {r["level"]: r for r in patterns.groupBy("part").applyInPandas(
        _monotone_part(levels, later), "level int, down boolean, up boolean")
        .groupBy("level").agg(F.max("down").alias("down"), F.max("up").alias("up")).collect()}
    beta, free = np.zeros(p), np.ones(p, bool)
    for i, (mine, is_reference) in enumerate(by_level):
        r = bound.get(i)
        if r is not None and not (r["down"] and r["up"]):
            sign = (1 if r["down"] else -1) * (-1 if is_reference else 1)
            beta[mine] = sign * FAR
            # against a separated reference the others keep their differences: one of them stands for all
            free[mine[:1]] = False
    endless = np.where(np.abs(beta) == FAR, np.copysign(np.inf, beta), 0.0)
    iterations = 0
    loglik, score, info = sums(beta[None, :])[0]
    while free.any():
        step = np.zeros(p)
        step[free] = np.linalg.pinv(info[np.ix_(free, free)], rcond=1e-13, hermitian=True) @ score[free]
        size = np.abs(step).max()
        step = step * min(1.0, 4.0 / size) if size > 0 else step    # a runaway combination moves in bounded steps
        tries = [step / 2 ** k for k in range(4)]
        results = sums(np.array([beta + t for t in tries]))
        best = max(range(4), key=lambda k: (results[k][0], -k) if np.isfinite(results[k][0]) else (-np.inf, -k))
        iterations += 1
        gained = results[best][0] - loglik
        if gained > 0:
            beta, (loglik, score, info) = beta + tries[best], results[best]
        if gained <= tol * abs(loglik):
            break
    # several levels together may still be without a finite fit: their information has vanished
    diagonal = np.diag(info)
    settled = free & (endless == 0) & ((diagonal > 1e-5 * max(1.0, diagonal.max())) | ((diagonal > 1e-9) & (np.abs(beta) < 8)))
    covariance = np.zeros((p, p))
    covariance[np.ix_(free, free)] = np.linalg.pinv(info[np.ix_(free, free)], rcond=1e-13, hermitian=True)
    z = special.normal_quantile(0.5 + conf / 2)
    rows = []
    for (name, _, _), b, far, var, ok in zip(terms, beta.tolist(), endless.tolist(), np.diag(covariance).tolist(), settled.tolist()):
        se = var ** 0.5 if ok and var > 0 else None
        b = far or b
        if se is None:
            rows.append((name, b, math.exp(b), None, None, None, 0.0, float("inf"), iterations, False))
        else:
            rows.append((name, b, math.exp(b), se, b / se, special.normal_two_sided(b / se),
                         math.exp(b - z * se), math.exp(b + z * se), iterations, True))
    return spark.createDataFrame(rows, schema)
