"""Rates, survival and test queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.catalogue import views as v
from anchorline.catalogue.events import (CLASSES, CODED, _AFTER, _CODED, _LONG, _POST, _PRE,
                                         _change, _composite, _long, _TYPED, _CAUSE)
from anchorline.catalogue.registry import Tables, query, with_
from anchorline.plans import cohort as c, outcome as o, rates as r, stats as st
from anchorline.plans import survival as sv
from anchorline.operators.tabulate import prevalence

CUT = "1996-01-01"


def followed(t: Tables) -> DataFrame:
    """Cohort with follow-up days and whether the person died."""
    out = c.drop_ended_before_index(c.follow_up(v.cohort(t)))
    return out.withColumn("died", F.col("dod").isNotNull())


# --- person-time -------------------------------------------------------------

_EXPOSED = """first_event AS (
  SELECT person_id, min(event_time) AS event_at FROM ep JOIN idx USING (person_id)
  WHERE {after} AND {coded} AND episode_sequence = 1 GROUP BY 1),
exposed AS (
  SELECT i.person_id, i.index_date, event_at IS NOT NULL AS had_event,
         CAST(CASE WHEN event_at IS NOT NULL THEN date_diff('day', i.index_date, event_at)
                   WHEN date_diff('day', i.index_date, k.dod) < 365 THEN date_diff('day', i.index_date, k.dod)
                   ELSE 365 END AS INTEGER) AS exposure_days
  FROM idx i LEFT JOIN first_event USING (person_id)
  LEFT JOIN (SELECT person_id, dod FROM cohort) k USING (person_id)
  WHERE k.dod IS NULL OR k.dod >= i.index_date)""".format(after=_AFTER, coded=_CODED)
_RATES = """rates AS (
  SELECT CASE WHEN index_date < TIMESTAMP '1996-01-01' THEN 'before' ELSE 'after' END AS period,
         count(*) AS persons, count(*) FILTER (WHERE had_event) AS events,
         sum(exposure_days) / 365.0 AS person_years FROM exposed GROUP BY 1)"""


def _exposed(t: Tables) -> DataFrame:
    deaths = v.cohort(t).select("person_id", "dod")
    people = (v.index_people(t).join(deaths, "person_id", "left")
              .where(F.col("dod").isNull() | (F.col("dod") >= F.col("index_date"))))
    events = o.first_event_after(v.episodes(t), v.index_people(t), v.DIAGNOSES, **CODED)
    return r.exposure_days(people, events.select("person_id", "event_time"))


def _rates(t: Tables) -> DataFrame:
    period = c.stratify_by_date(F.col("index_date"), CUT).alias("period")
    return r.incidence_rate(_exposed(t).select("had_event", "exposure_days", period), ["period"])


@query(with_(v.COHORT, v.IDX, v.EP, _EXPOSED) + """
SELECT person_id, index_date, had_event, exposure_days FROM exposed""")
def exposure_days(t: Tables) -> DataFrame:
    """Days at risk: to the event, else to death, else a year."""
    return _exposed(t).select("person_id", "index_date", "had_event", "exposure_days")


@query(with_(v.COHORT, v.IDX, v.EP, _CAUSE, _TYPED) + """
SELECT person_id, event_time AS event_at, date_diff('day', index_date, event_time)::INTEGER AS exposure_days
FROM typed JOIN idx USING (person_id)
UNION ALL SELECT person_id, NULL, CAST(CASE WHEN date_diff('day', i.index_date, dod) < 365
                                            THEN date_diff('day', i.index_date, dod) ELSE 365 END AS INTEGER)
FROM idx i LEFT JOIN (SELECT person_id, dod FROM cohort) USING (person_id)
WHERE person_id NOT IN (SELECT person_id FROM typed)""")
def exposure_per_event(t: Tables) -> DataFrame:
    """Exposure with one row per event, as the composite analysis counts it."""
    people = v.index_people(t).join(v.cohort(t).select("person_id", "dod"), "person_id", "left")
    rows = r.exposure_days(people, _composite(t), first_only=False)
    return rows.select("person_id", "event_at", "exposure_days")


@query(with_(v.COHORT, v.IDX, v.EP, _EXPOSED, _RATES) + """
SELECT period, persons, events, round(person_years, 6) AS person_years,
       round(events / person_years * 100, 6) AS rate FROM rates""")
def incidence_rate(t: Tables) -> DataFrame:
    """First coded event in the year after index, per 100 person-years, by period."""
    return _rates(t)


# Exact limits by bisection on the summed probability mass: shares nothing with
# the incomplete gamma / beta route on the Spark side.
_POIS = "list_sum(list_transform(range(0, {k}), lambda i: exp(i * ln({x}) - {x} - lgamma(i + 1))))"
_BISECT = """bis AS (
  WITH RECURSIVE b(grp, k, side, lo, hi, step) AS (
    SELECT {grp}, {k}, side, 1e-9, CAST({top} AS DOUBLE), 0 FROM {src}, (VALUES ('lower'), ('upper')) s(side)
    UNION ALL
    SELECT grp, k, side, CASE WHEN too_low THEN mid ELSE lo END, CASE WHEN too_low THEN hi ELSE mid END, step + 1
    FROM (SELECT *, (lo + hi) / 2 AS mid, CASE WHEN side = 'lower' THEN 1 - {cdf_below} < 0.025
                                               ELSE {cdf_to} > 0.025 END AS too_low
          FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE step < 60)))
  SELECT grp, max(CASE WHEN side = 'lower' THEN (lo + hi) / 2 END) AS lower,
         max(CASE WHEN side = 'upper' THEN (lo + hi) / 2 END) AS upper FROM b WHERE step = 60 GROUP BY 1)"""
_POIS_BIS = _BISECT.format(grp="period", k="events", top="events * 2 + 20", src="rates",
                           cdf_below=_POIS.format(k="k", x="m"), cdf_to=_POIS.format(k="k + 1", x="m"))


@query(with_(v.COHORT, v.IDX, v.EP, _EXPOSED, _RATES, _POIS_BIS) + """
SELECT period, events, round(person_years, 6) AS person_years,
       round(lower / person_years * 100, 4) AS lower, round(upper / person_years * 100, 4) AS upper
FROM rates JOIN bis ON period = grp""")
def rate_ci(t: Tables) -> DataFrame:
    """Exact Poisson limits of each stratum's own rate."""
    out = st.poisson_rate_ci(_rates(t), per=100)
    return out.select("period", "events", "person_years", F.round("lower", 4).alias("lower"),
                      F.round("upper", 4).alias("upper"))


_BIN = ("list_sum(list_transform(range(0, {k}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) "
        "+ i * ln(m) + (n - i) * ln(1 - m))))")
_BIN_BIS = _BISECT.format(
    grp="c_mktsegment", k="n_flagged, n", top="1 - 1e-9", src="counts",
    cdf_below=_BIN.format(k="k"), cdf_to=_BIN.format(k="k + 1")
).replace("b(grp, k, side", "b(grp, k, n, side").replace("SELECT grp, k, side, CASE", "SELECT grp, k, n, side, CASE")


@query(with_(v.COHORT, v.IDX, v.EP, _EXPOSED, _RATES, """two AS (
  SELECT max(CASE WHEN period = 'before' THEN events END) AS events_a,
         max(CASE WHEN period = 'before' THEN person_years END) AS exposure_a,
         max(CASE WHEN period = 'after' THEN events END) AS events_b,
         max(CASE WHEN period = 'after' THEN person_years END) AS exposure_b FROM rates),
mass AS (
  SELECT events_a, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) AS pr
  FROM (SELECT events_a, events_a + events_b AS n, exposure_a / (exposure_a + exposure_b) AS p,
               unnest(range(0, events_a + events_b + 1)) AS i FROM two))""",
             "tally AS (SELECT 'all' AS grp_all, events_a AS n_flagged, events_a + events_b AS n FROM two)",
             _BIN_BIS.replace("c_mktsegment", "grp_all").replace("FROM counts", "FROM tally")) + """
SELECT events_a, round(exposure_a, 6) AS exposure_a, events_b, round(exposure_b, 6) AS exposure_b,
       round((events_a / exposure_a) / (events_b / exposure_b), 6) AS rate_ratio,
       round(lower / (1 - lower) * exposure_b / exposure_a, 4) AS lower,
       round(upper / (1 - upper) * exposure_b / exposure_a, 4) AS upper,
       round((SELECT sum(pr) FROM mass WHERE pr <= (SELECT pr FROM mass WHERE i = events_a) * 1.0000001), 6) AS p_value
FROM two, bis""")
def rate_compare(t: Tables) -> DataFrame:
    """Exact comparison of the two periods' rates."""
    out = st.poisson_compare(_rates(t), "period", ("before", "after"))
    return out.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query(with_("""counts AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_flagged
  FROM customer GROUP BY 1)""", _BIN_BIS) + """
SELECT c_mktsegment, n, n_flagged, round(n_flagged / n, 6) AS proportion, round(lower, 6) AS lower,
       round(upper, 6) AS upper, round(list_sum(list_filter(mass, lambda m: m <= mass[n_flagged + 1] * 1.0000001)), 6) AS p_value
FROM counts JOIN bis ON c_mktsegment = grp
JOIN (SELECT c_mktsegment, list_transform(range(0, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + n * ln(0.5))) AS mass FROM counts) USING (c_mktsegment)""")
def proportion_ci(t: Tables) -> DataFrame:
    """Exact limits of a proportion per segment."""
    counts = prevalence(t("customer"), F.col("c_acctbal") < 0, ["c_mktsegment"])
    return st.binomial_ci(counts, "n_flagged", "n").drop("percent")


# --- survival ----------------------------------------------------------------

_KM = v.SURV + """,
obs_time AS (SELECT gender, fu_days AS time, died FROM followed WHERE fu_days IS NOT NULL),
steps AS (SELECT gender, time, count(*) AS exits, count(*) FILTER (WHERE died) AS events
          FROM obs_time GROUP BY 1, 2),
risk AS (SELECT s.*, CAST(sum(exits) OVER (PARTITION BY gender ORDER BY time DESC
                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM steps s),
raw_curve AS (
  SELECT gender, time, at_risk, events, exits - events AS censored,
         product(1 - events / at_risk) OVER w AS survival,
         sum(CASE WHEN events = at_risk THEN 0 ELSE events / (at_risk * (at_risk - events)) END) OVER w AS v
  FROM risk WINDOW w AS (PARTITION BY gender ORDER BY time ROWS UNBOUNDED PRECEDING)),
curve AS (
  SELECT *, CASE WHEN survival > 0 THEN survival * exp(-1.959963984540054 * sqrt(v)) END AS lower,
         CASE WHEN survival > 0 THEN least(1.0, survival * exp(1.959963984540054 * sqrt(v))) END AS upper
  FROM raw_curve)"""


def _curve(t: Tables) -> DataFrame:
    return sv.kaplan_meier(followed(t), "fu_days", "died", ["gender"])


@query(with_(_KM) + """SELECT gender, CAST(time AS INTEGER) AS time, at_risk, events, censored,
  round(survival, 6) AS survival, round(CASE WHEN survival > 0 THEN survival * sqrt(v) END, 6) AS std_err,
  round(lower, 6) AS lower, round(upper, 6) AS upper FROM curve""")
def kaplan_meier(t: Tables) -> DataFrame:
    """Product-limit curve by segment."""
    return _curve(t)


@query(with_(_KM) + """, moments AS (SELECT unnest([0.0, 500.0, 1000.0, 1500.0, 2000.0]) AS t),
grp AS (SELECT DISTINCT gender FROM curve)
SELECT g.gender, CAST(t AS DOUBLE) AS time,
  (SELECT count(*) FROM obs_time o WHERE o.gender = g.gender AND o.time >= t) AS at_risk,
  round(CASE WHEN s.survival IS NULL THEN 1.0 ELSE s.survival END, 6) AS survival,
  round(CASE WHEN s.survival IS NULL THEN 1.0 ELSE s.lower END, 6) AS lower,
  round(CASE WHEN s.survival IS NULL THEN 1.0 ELSE s.upper END, 6) AS upper
FROM (SELECT * FROM grp, moments) g ASOF LEFT JOIN curve s ON s.gender = g.gender AND g.t >= s.time""")
def km_at(t: Tables) -> DataFrame:
    """Survival and number at risk at fixed times."""
    return sv.km_at(_curve(t), [0, 500, 1000, 1500, 2000], ["gender"])


_CROSSING = """CAST(CASE WHEN min(CASE WHEN {c} < 0.5 - 1.5e-8 THEN time END) IS NULL
       THEN min(CASE WHEN {c} < 0.5 + 1.5e-8 THEN time END)
       ELSE (min(CASE WHEN {c} < 0.5 + 1.5e-8 THEN time END)
             + min(CASE WHEN {c} < 0.5 - 1.5e-8 THEN time END)) / 2.0 END AS DOUBLE)"""


@query(with_(_KM) + f"""SELECT gender, max(at_risk) AS persons, CAST(sum(events) AS BIGINT) AS events,
  {_CROSSING.format(c="survival")} AS median, {_CROSSING.format(c="lower")} AS median_lower,
  {_CROSSING.format(c="upper")} AS median_upper
FROM curve GROUP BY 1""")
def km_median(t: Tables) -> DataFrame:
    """Persons, events and median survival by segment."""
    return sv.median_survival(_curve(t), ["gender"])


# Gaussian elimination of the four-group covariance with the gap as last column;
# the chi-square is the sum of squared gaps over pivots.  Four degrees of freedom have a closed tail.
_ELIMINATE = ",\n".join(
    f"""m{k} AS (SELECT list_transform(m, lambda r, i: CASE WHEN i <= {k} THEN r ELSE
      list_transform(r, lambda x, j: x - r[{k}] / m[{k}][{k}] * m[{k}][j]) END) AS m FROM m{k - 1})""" for k in (1, 2, 3))


@query(with_(_KM, """pooled AS (SELECT time, sum(events) AS d FROM steps GROUP BY 1),
pooled_risk AS (SELECT p.time, d, (SELECT count(*) FROM obs_time o WHERE o.time >= p.time) AS n
                FROM pooled p WHERE d > 0),
shares AS (SELECT g.gender, p.time, d, n,
                  (SELECT count(*) FROM obs_time o WHERE o.time >= p.time AND o.gender = g.gender) / n AS share
           FROM pooled_risk p, (SELECT DISTINCT gender FROM obs_time) g),
per_group AS (SELECT gender, sum(d * share) AS expected FROM shares GROUP BY 1),
seen AS (SELECT gender, count(*) AS persons, CAST(count(*) FILTER (WHERE died) AS DOUBLE) AS observed
         FROM obs_time GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY gender) AS g FROM per_group JOIN seen USING (gender)),
cov AS (SELECT a.gender AS ga, b.gender AS gb,
               sum(CASE WHEN a.n > 1 THEN a.d * (a.n - a.d) / (a.n - 1) ELSE 0 END
                   * a.share * ((a.gender = b.gender)::INTEGER - b.share)) AS v
        FROM shares a JOIN shares b ON a.time = b.time GROUP BY 1, 2),
m0 AS (SELECT list(cells ORDER BY g) AS m FROM (
  SELECT x.g, list_append(list(v ORDER BY y.g), any_value(x.observed - x.expected)) AS cells
  FROM cov JOIN numbered x ON ga = x.gender JOIN numbered y ON gb = y.gender WHERE x.g <= 4 AND y.g <= 4 GROUP BY 1))""",
             _ELIMINATE, """chi AS (SELECT list_sum(list_transform(m, lambda r, i: r[5] * r[5] / r[i])) AS chi FROM m3)""") + """
SELECT gender, persons, observed, round(expected, 6) AS expected, round(chi, 6) AS chi_square, 4.0::DOUBLE AS df,
       round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value FROM numbered, chi""")
def log_rank_segments(t: Tables) -> DataFrame:
    """Log-rank test over five strata."""
    return sv.log_rank(followed(t), "fu_days", "died", "gender")


_PERIOD = v.SURV + """,
two AS (SELECT CASE WHEN index_date < DATE '1995-07-01' THEN 'before' ELSE 'after' END AS period,
               fu_days AS time, died FROM followed WHERE fu_days IS NOT NULL),
dt AS (SELECT time, count(*) AS d, count(*) FILTER (WHERE period = 'before') AS d1 FROM two WHERE died GROUP BY 1),
rt AS (SELECT *, (SELECT count(*) FROM two x WHERE x.time >= dt.time) AS n,
              (SELECT count(*) FROM two x WHERE x.time >= dt.time AND x.period = 'before') AS n1 FROM dt),
z AS (SELECT sum(d1) AS o1, sum(d * n1 / n) AS e1, sum(d) AS dd,
             sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS var FROM rt)"""
# Two-sided normal tail by Simpson's rule.
_NORMAL_P = """1 - 2 * (sqrt({x}) / 3000) / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 3001),
  lambda i: (CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
            * exp(-pow(sqrt({x}) * i / 3000, 2) / 2)))"""


@query(with_(_PERIOD) + f""", r AS (SELECT *, pow(o1 - e1, 2) / var AS chi FROM z)
SELECT 'before' AS period, (SELECT count(*) FROM two WHERE period = 'before') AS persons, CAST(o1 AS DOUBLE) AS observed, round(e1, 6) AS expected,
  round(chi, 6) AS chi_square, 1.0::DOUBLE AS df, round({_NORMAL_P.format(x="chi")}, 6) AS p_value FROM r
UNION ALL SELECT 'after', (SELECT count(*) FROM two WHERE period = 'after'), CAST(dd - o1 AS DOUBLE), round(dd - e1, 6), round(chi, 6), 1.0,
  round({_NORMAL_P.format(x="chi")}, 6) FROM r""")
def log_rank_periods(t: Tables) -> DataFrame:
    """Log-rank test between two periods of admission."""
    rows = followed(t).withColumn("period", c.stratify_by_date(F.col("index_date"), "1995-07-01"))
    return sv.log_rank(rows, "fu_days", "died", "period", ["before", "after"])


@query(with_(v.SURV) + """SELECT person_id, CAST(least(fu_days, 730) AS INTEGER) AS time,
  died AND fu_days <= 730 AS event FROM followed WHERE fu_days IS NOT NULL""")
def censor_two_years(t: Tables) -> DataFrame:
    """Follow-up cut at two years."""
    time, event = r.censor_at(F.col("fu_days"), F.col("died"), 730)
    return followed(t).where("fu_days IS NOT NULL").select(
        "person_id", time.alias("time"), event.alias("event"))


_NEWTON = """newton AS (
  WITH RECURSIVE b(k, beta, info) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT k + 1, beta + (sum(x) - sum(p)) / sum(p * (1 - p)), sum(p * (1 - p))
    FROM (SELECT k, beta, d1 / d AS x, s1 / s0 AS p
          FROM (SELECT b.k, b.beta, e.d, e.d1, (n1 - f * d1) * exp(beta) AS s1,
                       (n0 - f * d0) + (n1 - f * d1) * exp(beta) AS s0 FROM b CROSS JOIN e WHERE k < 12))
    GROUP BY k, beta)
  SELECT beta, info FROM b WHERE k = 12)"""


@query(with_(v.SURV, """ct AS (SELECT fu_days AS time, admission_service = 'O' AS x, died FROM followed WHERE fu_days >= 0),
dt AS (SELECT time, count(*) AS d, count(*) FILTER (WHERE x) AS d1 FROM ct WHERE died GROUP BY 1),
rt AS (SELECT dt.*, (SELECT count(*) FROM ct c WHERE c.time >= dt.time) AS n,
              (SELECT count(*) FROM ct c WHERE c.time >= dt.time AND x) AS n1 FROM dt),
e AS (SELECT n1, n - n1 AS n0, d1, d - d1 AS d0, d, unnest(range(0, d)) / d AS f FROM rt)""", _NEWTON) + f"""
SELECT 'admission_service=O' AS term, round(beta, 5) AS coef, round(exp(beta), 5) AS hazard_ratio,
       round(1 / sqrt(info), 5) AS std_err, round(z, 4) AS z, round({_NORMAL_P.format(x="z * z")}, 5) AS p_value,
       round(exp(beta - 1.959963984540054 / sqrt(info)), 4) AS lower,
       round(exp(beta + 1.959963984540054 / sqrt(info)), 4) AS upper, TRUE AS converged
FROM (SELECT *, beta * sqrt(info) AS z FROM newton)""")
def cox_one_term(t: Tables) -> DataFrame:
    """Hazard ratio of one two-level covariate, against Newton steps in SQL."""
    rows = followed(t).where(F.col("fu_days") >= 0)
    out = sv.cox_ph(rows, "fu_days", "died", {"admission_service": ["F", "O"]})
    return out.select("term", *[F.round(c, 5).alias(c) for c in ("coef", "hazard_ratio", "std_err", "p_value")],
                      *[F.round(c, 4).alias(c) for c in ("z", "lower", "upper")], "converged")


# Newton steps for several terms.  Terms are rows; a level without events has an endless coefficient, in whose limit its
# persons weigh nothing.  Sums over risk sets are kept by pairs of terms (0: the constant), steps by elimination.
_TERMS = v.SURV + """,
subject AS (SELECT row_number() OVER () AS id, fu_days AS time, died, admission_service, gender,
                  CAST(year(index_date) AS VARCHAR) AS year_of_admission FROM followed WHERE fu_days >= 0),
long AS (SELECT id, time, died, unnest(['admission_service', 'gender', 'year_of_admission']) AS c,
                unnest([admission_service, gender, year_of_admission]) AS level FROM subject),
levels AS (SELECT c, level, count(*) FILTER (WHERE died) AS events, row_number() OVER (PARTITION BY c ORDER BY level) AS place
           FROM long GROUP BY 1, 2),
term AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c, level) AS j, c, level FROM levels WHERE place > 1 AND events > 0),
kept AS MATERIALIZED (SELECT * FROM subject WHERE id NOT IN (
  SELECT id FROM long JOIN levels USING (c, level) WHERE place > 1 AND events = 0)),
x AS MATERIALIZED (SELECT id, 0 AS j FROM kept UNION ALL SELECT id, j FROM kept JOIN long USING (id) JOIN term USING (c, level)),
pairs AS MATERIALIZED (SELECT id, k.time, k.died, a.j, b.j AS k FROM x a JOIN x b USING (id) JOIN kept k USING (id)),
moment AS MATERIALIZED (SELECT time, count(*) AS d FROM kept WHERE died GROUP BY 1),
every AS (SELECT j FROM term UNION ALL SELECT 0),
b0 AS MATERIALIZED (SELECT j, CAST(0 AS DOUBLE) AS beta FROM term)"""
_STEP = """,
w{n} AS MATERIALIZED (SELECT id, exp(coalesce(sum(beta), 0)) AS w FROM x LEFT JOIN b{n} USING (j) GROUP BY 1),
s{n} AS (SELECT m.time, m.d, p.j, p.k, sum(w) AS s, coalesce(sum(w) FILTER (WHERE p.died AND p.time = m.time), 0) AS e
         FROM moment m JOIN pairs p ON p.time >= m.time JOIN w{n} USING (id) GROUP BY 1, 2, 3, 4),
q{n} AS MATERIALIZED (SELECT a.time, f, a.j, a.k, (a.s - f * a.e) / (o.s - f * o.e) AS q
         FROM (SELECT *, unnest(range(0, d)) / d AS f FROM s{n}) a JOIN (SELECT time, s, e FROM s{n} WHERE j = 0 AND k = 0) o USING (time)),
score{n} AS (SELECT j, (SELECT count(*) FROM x JOIN kept USING (id) WHERE died AND x.j = term.j)
                       - (SELECT sum(q) FROM q{n} WHERE q{n}.j = term.j AND q{n}.k = 0) AS u FROM term),
info{n} AS MATERIALIZED (SELECT a.j, b.j AS k, coalesce((SELECT sum(q) FROM q{n} WHERE q{n}.j = a.j AND q{n}.k = b.j), 0)
           - (SELECT sum(y.q * z.q) FROM q{n} y JOIN q{n} z ON y.time = z.time AND y.f = z.f
              WHERE y.j = a.j AND y.k = 0 AND z.j = b.j AND z.k = 0) AS v FROM term a CROSS JOIN term b),
m{n} AS (SELECT list(line ORDER BY j) AS m FROM (
  SELECT i.j, list_append(list(v ORDER BY k), any_value(u)) || list(CAST(i.j = k AS DOUBLE) ORDER BY k) AS line
  FROM info{n} i JOIN score{n} USING (j) GROUP BY i.j)),
solved{n} AS MATERIALIZED (
  WITH RECURSIVE g(p, m) AS (
    SELECT 1, m FROM m{n} UNION ALL
    SELECT p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda y: y / r[p])
                  ELSE list_transform(r, lambda y, c: y - r[p] / m[p][p] * m[p][c]) END) FROM g WHERE p <= len(m))
  SELECT m FROM g WHERE p = len(m) + 1),
b{after} AS MATERIALIZED (SELECT j, beta + (SELECT m[j][len(m) + 1] FROM solved{n}) AS beta FROM b{n})"""
_STEPS = 8


@query(with_(_TERMS + "".join(_STEP.format(n=n, after=n + 1) for n in range(_STEPS))) + f""",
fit AS (SELECT c || '=' || level AS term, beta, sqrt((SELECT m[j][len(m) + 1 + j] FROM solved{_STEPS - 1})) AS se
        FROM b{_STEPS} JOIN term USING (j)),
tested AS (SELECT *, beta / se AS z, pow(beta / se, 2) AS z2 FROM fit)
SELECT term, round(beta, 4) AS coef, round(exp(beta), 4) AS hazard_ratio, round(se, 4) AS std_err, round(z, 3) AS z,
       round({_NORMAL_P.format(x="z2")}, 4) AS p_value, round(exp(beta - 1.959963984540054 * se), 3) AS lower,
       round(exp(beta + 1.959963984540054 * se), 3) AS upper, TRUE AS converged FROM tested
UNION ALL SELECT c || '=' || level, '-Infinity'::DOUBLE, 0.0, NULL, NULL, NULL, 0.0, 'Infinity'::DOUBLE, FALSE
FROM levels WHERE place > 1 AND events = 0""")
def cox_ph(t: Tables) -> DataFrame:
    """Hazard ratios by service, gender and year of admission, against Newton steps in SQL."""
    rows = followed(t).where(F.col("fu_days") >= 0).withColumn(
        "year_of_admission", F.year("index_date").cast("string"))
    out = sv.cox_ph(rows, "fu_days", "died", {"admission_service": None, "gender": None, "year_of_admission": None})
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("coef", "hazard_ratio", "std_err", "p_value")],
                      *[F.round(c, 3).alias(c) for c in ("z", "lower", "upper")], "converged")


# --- tests -------------------------------------------------------------------

_T_P = """1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (abs(t) / 3000) / 3
  * list_sum(list_transform(range(0, 3001), lambda i: (CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
             * pow(1 + pow(abs(t) * i / 3000, 2) / df, -(df + 1) / 2)))"""


@query(with_("""g AS (
  SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS na, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS ma,
         var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS va,
         count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS nb, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS mb,
         var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS vb FROM customer)""",
             """w AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t,
  pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM g)""") + f"""
SELECT na AS n_a, round(ma, 6) AS mean_a, nb AS n_b, round(mb, 6) AS mean_b, round(t, 6) AS t,
       round(df, 6) AS df, round({_T_P}, 6) AS p_value FROM w""")
def welch_t(t: Tables) -> DataFrame:
    """Balances of two segments compared, unequal variances."""
    return st.welch_t(t("customer"), "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY"))


@query(with_(v.EI, _PRE, _POST, """s AS (
  SELECT count(*) AS n, avg(a.purchase - b.purchase) AS md, stddev_samp(a.purchase - b.purchase) AS sd
  FROM pair_pre a JOIN pair_post b ON a.person_id = b.person_id),
w AS (SELECT *, md / (sd / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS df FROM s)""") + f"""
SELECT n, round(md, 6) AS mean_difference, round(t, 6) AS t, df, round({_T_P}, 6) AS p_value FROM w""")
def paired_t(t: Tables) -> DataFrame:
    """Reading before against reading after, paired by person."""
    return st.paired_t(_change(t), "pre_purchase", "post_purchase")


_MC = " UNION ALL ".join(f"SELECT person_id, time_status, '{k}' AS drug_class, {k} AS taken FROM long"
                         for k in CLASSES)


@query(with_(_LONG, f"taken AS ({_MC})", """pairs AS (
  SELECT drug_class, count(*) AS pairs, count(*) FILTER (WHERE a.taken AND NOT b.taken) AS only_before,
         count(*) FILTER (WHERE NOT a.taken AND b.taken) AS only_after
  FROM taken a JOIN taken b USING (person_id, drug_class)
  WHERE a.time_status = 'pre_admission' AND b.time_status = 'admission' GROUP BY 1),
w AS (SELECT *, CASE WHEN only_before + only_after > 0 THEN pow(greatest(abs(only_before - only_after) - 1, 0), 2)
                / (only_before + only_after) END AS chi FROM pairs)""") + f"""
SELECT drug_class, pairs, only_before, only_after, round(chi, 6) AS chi_square,
       round({_NORMAL_P.format(x="chi")}, 6) AS p_value FROM w""")
def mcnemar(t: Tables) -> DataFrame:
    """Change in prescribing per class, paired by person."""
    from anchorline.operators.reshape import to_long
    long = to_long(_long(t), ["person_id", "time_status"], list(CLASSES), "drug_class", "taken")
    at = F.col("time_status")
    paired = long.groupBy("person_id", "drug_class").agg(
        F.max(F.when(at == "pre_admission", F.col("taken"))).alias("before"),
        F.max(F.when(at == "admission", F.col("taken"))).alias("after"))
    return st.mcnemar(paired, F.col("before"), F.col("after"), ["drug_class"])
