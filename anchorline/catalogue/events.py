"""Event queries: phenotypes, exposure, measurement, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.catalogue import views as v
from anchorline.catalogue.registry import Tables, query, with_
from anchorline.functions.dates import after, around, before, ever_after, ever_before, month_range
from anchorline.operators.codes import any_code_in, any_code_joined, any_code_prefix, label_codes, map_codes
from anchorline.operators.joins import (normalise_event, pair_readings, spread_join,
                                        stack_distinct)
from anchorline.plans import exposure as x, measure as m, outcome as o, phenotype as p

THRESHOLDS = {"purchase": 40, "view": 35}
CODED = dict(prefixes=["PROMO", "Brand#1"], filler=None)


# --- phenotypes --------------------------------------------------------------

_FIRST_PROMO = """promo AS (
  SELECT person_id, min(event_time) AS first_date FROM ep
  WHERE diagnosis_1 = 'PROMO' GROUP BY 1)"""


@query(with_(v.IDX, v.EP, _FIRST_PROMO) + """
SELECT i.person_id, CASE WHEN first_date < index_date THEN first_date END AS first_date,
       coalesce(first_date < index_date, FALSE) AS diagnosed
FROM idx i LEFT JOIN promo USING (person_id)""")
def diagnosis_before(t: Tables) -> DataFrame:
    """Ever coded before the index date; the whole cohort is kept."""
    out = p.diagnosis_before(v.index_people(t), v.episodes(t), {"PROMO"}, code="diagnosis_1")
    return out.select("person_id", "first_date", "diagnosed")


_TWO = v.EI + """,
lows AS (
  SELECT user_id AS person_id, event_type AS kind, list_reverse_sort(list(low)) AS low
  FROM (SELECT user_id, event_type, index_date, min(value) AS low FROM events JOIN ei ON user_id = person_id
        WHERE event_type IN ('purchase', 'view') AND value > 1 AND ts < index_date
          AND date_diff('year', ts, index_date) <= 2
        GROUP BY user_id, event_type, index_date, CAST(ts AS DATE)) GROUP BY 1, 2),
rule AS (
  SELECT person_id, kind, low[1] AS first_reading, low[2] AS second_reading,
         low[2] > CASE kind WHEN 'purchase' THEN 40 ELSE 35 END AS meets_rule
  FROM lows WHERE len(low) >= 2)"""


@query(with_(_TWO) + """
SELECT person_id, kind, round(first_reading, 6) AS first_reading,
       round(second_reading, 6) AS second_reading, meets_rule FROM rule""")
def two_reading_rule(t: Tables) -> DataFrame:
    """Two highest daily minima both over the kind's threshold."""
    return p.two_reading_rule(v.readings(t), v.event_index(t), THRESHOLDS, floor=1)


@query(with_(_TWO) + """
SELECT e.person_id, index_date, e.person_id IN (
  SELECT person_id FROM rule WHERE meets_rule
  UNION SELECT user_id FROM events JOIN ei ON user_id = person_id
  GROUP BY user_id, ei.index_date
  HAVING min(CASE WHEN event_type = 'error' THEN ts END) < ei.index_date) AS flag
FROM ei e""")
def combined_flag(t: Tables) -> DataFrame:
    """Condition by code or by measurement, as one flag over the cohort."""
    return p.flag_by_code_or_value(v.event_index(t), v.readings(t), {"error"}, THRESHOLDS, floor=1)


@query(with_(v.EI, """coded AS (
  SELECT person_id, ts, event_type AS code, CASE event_type WHEN 'view' THEN 'ex'
         WHEN 'click' THEN 'current' WHEN 'error' THEN 'never' END AS status,
         row_number() OVER (PARTITION BY person_id ORDER BY ts DESC, event_type DESC) AS rn
  FROM events JOIN ei ON user_id = person_id
  WHERE event_type IN ('view', 'click', 'error') AND ts < index_date)""") + """
SELECT e.person_id, c.code, c.ts AS coded_at, coalesce(c.status, 'missing') AS status
FROM ei e LEFT JOIN coded c ON e.person_id = c.person_id AND rn = 1""")
def latest_category(t: Tables) -> DataFrame:
    """Last labelled code before the index date, 'missing' for none."""
    labels = label_codes({"ex": t.codes("view"), "current": t.codes("click", "view"),
                          "never": t.codes("error")})
    out = p.latest_category(v.event_index(t), v.coded_events(t), labels)
    return out.select("person_id", "code", "coded_at", "status")


@query(with_(v.IDX, v.EP) + """
SELECT i.person_id, min(event_time) AS first_event, count(event_time) > 0 AS had_event
FROM idx i LEFT JOIN ep ON ep.person_id = i.person_id AND event_time < index_date
  AND date_diff('day', event_time, index_date) <= 365 AND site IN ('A', 'R')
  AND (diagnosis_1 IN ('PROMO', 'Brand#7') OR diagnosis_2 IN ('PROMO', 'Brand#7'))
GROUP BY 1""")
def prior_event_12m(t: Tables) -> DataFrame:
    """Coded episode in the 12 months before index, at either of two sites (one table, read once)."""
    out = p.event_within(v.index_people(t), v.episodes(t).where(F.col("site").isin(v.SITES)), v.DIAGNOSES, before(365),
                         codes={"PROMO", "Brand#7"}, filler=None)
    return out.select("person_id", "first_event", "had_event")


# --- drug exposure -----------------------------------------------------------

CLASSES = {"promo": "PROMO", "economy": "ECONO", "small": "SMALL", "standard": "STAND"}
ADMITTED = ["PROMO", "ECONO", "SMALL", "STAND", "MEDIU"]
WINDOWS = {"pre_admission": month_range(-6, -5), "admission": around(14),
           "post_admission": month_range(5, 6)}

_SQL_WINDOW = {
    "pre_admission": "event_time BETWEEN index_date - INTERVAL 6 MONTH AND index_date - INTERVAL 5 MONTH",
    "admission": "event_time BETWEEN index_date - INTERVAL 14 DAY AND index_date + INTERVAL 14 DAY",
    "post_admission": "event_time BETWEEN index_date + INTERVAL 5 MONTH AND index_date + INTERVAL 6 MONTH",
}


def _class_sql(status: str) -> str:
    flags = ",\n".join(f"bool_or(c = '{cls}') AS {name}" for name, cls in CLASSES.items())
    return f"""SELECT person_id, '{status}' AS time_status, {flags},
       CAST(count(DISTINCT c) AS INTEGER) AS n_classes
FROM (SELECT person_id, substring(chapter_code, 1, 5) AS c FROM ep JOIN idx USING (person_id)
      WHERE is_repeat AND chapter_code NOT LIKE 'LARGE%' AND {_SQL_WINDOW[status]}) GROUP BY 1"""


def _exposure(t: Tables, *statuses: str) -> DataFrame:
    drugs = x.classify_drugs(v.medications(t), v.drug_lookup(t), ADMITTED, class_len=5)
    return x.drug_exposure(drugs, v.index_people(t), {s: WINDOWS[s] for s in statuses}, CLASSES)


@query(with_(v.IDX, v.EP) + _class_sql("pre_admission"))
def drug_exposure_pre(t: Tables) -> DataFrame:
    """Class flags and count six to five months before index."""
    return _exposure(t, "pre_admission")


@query(with_(v.IDX, v.EP) + _class_sql("admission"))
def drug_exposure_at(t: Tables) -> DataFrame:
    """Class flags and count within 14 days of index."""
    return _exposure(t, "admission")


@query(with_(v.IDX, v.EP) + _class_sql("post_admission"))
def drug_exposure_post(t: Tables) -> DataFrame:
    """Class flags and count five to six months after index."""
    return _exposure(t, "post_admission")


_LONG = ",\n".join([v.COHORT, v.IDX, v.EP, "expo AS (" + "\nUNION ALL\n".join(
    _class_sql(s) for s in WINDOWS) + ")",
    "points AS (" + " UNION ALL ".join(f"SELECT '{s}' AS time_status" for s in WINDOWS) + ")",
    """long AS (
  SELECT i.person_id, time_status,
         """ + ", ".join(f"coalesce({c}, FALSE) AS {c}" for c in CLASSES) + """,
         coalesce(n_classes, 0) AS n_classes,
         coalesce(dod < i.index_date + INTERVAL 6 MONTH, FALSE) AS early_death
  FROM idx i CROSS JOIN points LEFT JOIN expo USING (person_id, time_status)
  LEFT JOIN (SELECT person_id, dod FROM cohort) k USING (person_id))"""])


def _long(t: Tables) -> DataFrame:
    deaths = v.cohort(t).select("person_id", "dod")
    people = v.index_people(t).join(deaths, "person_id", "left")
    return x.exposure_long(people, _exposure(t, *WINDOWS), list(WINDOWS), list(CLASSES))


@query(with_(_LONG) + "SELECT * FROM long")
def exposure_long(t: Tables) -> DataFrame:
    """Every person at every time point; all windows cut in one pass."""
    return _long(t)


@query(with_(_LONG) + " UNION ALL ".join(
    f"""SELECT '{c}' AS drug_class, time_status, count(*) AS n, count(*) FILTER ({c}) AS n_flagged,
  round(avg({c}::INTEGER) * 100, 6) AS percent FROM long
  WHERE NOT (time_status = 'post_admission' AND early_death) GROUP BY 2""" for c in CLASSES))
def share_prescribed(t: Tables) -> DataFrame:
    """Share of persons on each class at each time point, without those who died early after."""
    kept = _long(t).where(~((F.col("time_status") == "post_admission") & F.col("early_death")))
    return x.share_prescribed(kept, list(CLASSES))


@query(with_(_LONG, """labelled AS (
  SELECT time_status, CASE WHEN n_classes >= 3 THEN '3+' ELSE CAST(n_classes AS VARCHAR) END AS n_label
  FROM long WHERE NOT (time_status = 'post_admission' AND early_death))""") + """
SELECT time_status, n_label, count(*) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY time_status) AS BIGINT) AS total,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY time_status), 6) AS percent
FROM labelled GROUP BY 1, 2""")
def count_distribution(t: Tables) -> DataFrame:
    """Capped class counts within each time point, early deaths left out after index."""
    kept = _long(t).where(~((F.col("time_status") == "post_admission") & F.col("early_death")))
    return x.count_distribution(x.class_counts(kept), 3)


@query(with_(_LONG, """counted AS (
  SELECT person_id, CAST(economy AS INTEGER) + CAST(small AS INTEGER) + CAST(standard AS INTEGER) AS n
  FROM long WHERE time_status = 'admission')""") + """
SELECT CASE WHEN n >= 2 THEN '2+' ELSE CAST(n AS VARCHAR) END AS n_label,
       count(CASE WHEN c_acctbal >= 5000 THEN 1 END) AS above,
       count(CASE WHEN c_acctbal < 5000 THEN 1 END) AS below
FROM counted JOIN customer ON person_id = c_custkey GROUP BY 1""")
def count_by_control(t: Tables) -> DataFrame:
    """Classes at index, one left out, by control status."""
    counts = x.class_counts(_long(t).where(F.col("time_status") == "admission"),
                            excluding={"promo"}, flags=list(CLASSES))
    control = t("customer").select(F.col("c_custkey").alias("person_id"), F.when(
        F.col("c_acctbal") >= 5000, "above").otherwise("below").alias("control"))
    return x.count_by_control(counts, control, 2)


@query("""SELECT l_linenumber AS line, drug_code, count(*) AS n
FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand AS drug_code FROM part WHERE p_size > 25)
  ON l_partkey = p_partkey GROUP BY 1, 2""")
def map_codes_left(t: Tables) -> DataFrame:
    """Code mapping keeps rows whose code is not in the lookup."""
    lookup = t("part").where(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("drug_code"))
    rows = t("lineitem").select(F.col("l_linenumber").alias("line"),
                                F.col("l_partkey").cast("string").alias("drug_id"))
    mapped = map_codes(rows, lookup, "drug_id", "id", "drug_code")
    return mapped.groupBy("line", "drug_code").agg(F.count(F.lit(1)).alias("n"))


# --- paired measurements -----------------------------------------------------

PAIR = ("purchase", "view")
RANGES = {"purchase": (10, 400), "view": (2, 200)}


def _moments(t: Tables) -> DataFrame:
    """Readings rounded to half days, so two kinds share a moment."""
    ts = F.col("event_time")
    noon = F.make_dt_interval(F.lit(0), F.when(F.hour(ts) >= 12, 12).otherwise(0))
    value = F.floor(F.col("value")).cast("int")
    return v.readings(t).select("person_id", "kind", value.alias("value"),
                                (F.to_date(ts).cast("timestamp_ntz") + noon).alias("event_time"))


def _pair_ctes(tag: str, side: str) -> str:
    """By definition: a person's earliest moment with both readings in range, if the
    first reading there is also its day's lowest.

    A value that both kinds hold at one moment counts for the kind that sorts first.
    """
    return f"""held_{tag} AS (
  SELECT person_id, moment, value, min(kind) AS kind
  FROM (SELECT person_id, index_date, event_type AS kind, CAST(floor(value) AS INTEGER) AS value,
               time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') AS moment
        FROM events JOIN ei ON user_id = person_id
        WHERE event_type IN ('purchase', 'view') AND floor(value) > 1)
  WHERE {side} GROUP BY 1, 2, 3),
moments_{tag} AS (
  SELECT person_id, moment, list(value ORDER BY value) FILTER (kind = 'purchase' AND value > 10 AND value < 400) AS high,
         list(value ORDER BY value) FILTER (kind = 'view' AND value > 2 AND value < 200) AS low
  FROM held_{tag} GROUP BY 1, 2 HAVING len(high) > 0 AND len(low) > 0),
days_{tag} AS (
  SELECT person_id, CAST(moment AS DATE) AS day,
         min(struct_pack(a := high[1], b := moment, c := low[1])) AS lowest FROM moments_{tag} GROUP BY 1, 2),
pair_{tag} AS (
  SELECT person_id, lowest.b AS moment, lowest.a AS purchase, lowest.c AS view
  FROM days_{tag} JOIN (SELECT person_id, min(moment) AS earliest FROM moments_{tag} GROUP BY 1) USING (person_id)
  WHERE lowest.b = earliest)"""


_PRE = _pair_ctes("pre", "moment < index_date AND date_diff('day', moment, index_date) <= 365")
_POST = _pair_ctes("post", "moment > index_date AND date_diff('day', index_date, moment) <= 365")


def _pairs(t: Tables, bounds) -> DataFrame:
    return m.paired_reading(_moments(t), v.event_index(t), bounds, RANGES, PAIR, floor=1)


def _change(t: Tables) -> DataFrame:
    return m.paired_change(_moments(t), v.event_index(t), before(365), after(365), RANGES, PAIR, floor=1)


@query(with_(v.EI, _PRE) + """
SELECT person_id, moment AS reading_time, purchase, view FROM pair_pre""")
def paired_reading_pre(t: Tables) -> DataFrame:
    """Earliest pair in the year before index that is also its day's lowest."""
    return _pairs(t, before(365)).select("person_id", "reading_time", *PAIR)


@query(with_(v.EI, _POST) + """
SELECT person_id, moment AS reading_time, purchase, view FROM pair_post""")
def paired_reading_post(t: Tables) -> DataFrame:
    """The same in the year after index."""
    return _pairs(t, after(365)).select("person_id", "reading_time", *PAIR)


@query(with_(v.EI, _PRE, _POST) + """
SELECT a.person_id, a.purchase AS pre_purchase, a.view AS pre_view,
       CAST(CAST(a.moment AS DATE) AS TIMESTAMP) AS pre_date, b.purchase AS post_purchase,
       b.view AS post_view, CAST(CAST(b.moment AS DATE) AS TIMESTAMP) AS post_date,
       b.purchase - a.purchase AS purchase_difference, b.view - a.view AS view_difference
FROM pair_pre a JOIN pair_post b ON a.person_id = b.person_id""")
def before_after(t: Tables) -> DataFrame:
    """Persons with a pair on both sides, and the change."""
    return _change(t)


@query("""
WITH d AS (SELECT user_id AS person_id, CAST(ts AS DATE) AS day, event_type, min(value) AS low
           FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3)
SELECT a.person_id, CAST(a.day AS TIMESTAMP) AS day, round(a.low, 6) AS purchase, round(b.low, 6) AS view
FROM d a JOIN d b ON a.person_id = b.person_id AND a.day = b.day
WHERE a.event_type = 'purchase' AND b.event_type = 'view'""")
def pair_by_day(t: Tables) -> DataFrame:
    """Two daily measurements joined on person and day."""
    daily = p.daily_min(v.readings(t))
    sides = [daily.where(F.col("kind") == k).select("person_id", "day", F.col("low").alias(k))
             for k in PAIR]
    return pair_readings(*sides, ["person_id", "day"])


# --- outcomes ----------------------------------------------------------------

_AFTER = ("event_time > index_date AND date_diff('day', index_date, event_time) <= 365")
_CODED = "(diagnosis_1 LIKE 'PROMO%' OR diagnosis_1 LIKE 'Brand#1%' OR diagnosis_2 LIKE 'PROMO%' " \
         "OR diagnosis_2 LIKE 'Brand#1%')"
_CAUSE = """cause AS (
  SELECT person_id, index_date, CAST(end_date AS TIMESTAMP) AS event_time FROM (
    SELECT r.*, row_number() OVER (PARTITION BY person_id ORDER BY dod NULLS LAST,
             reg_date DESC NULLS LAST, end_date, cause_code_1, cause_code_4) AS rn
    FROM registry r) JOIN idx USING (person_id)
  WHERE rn = 1 AND (cause_code_1 LIKE '1-%' OR cause_code_1 LIKE '%HIGH%' OR cause_code_4 LIKE '%Q%')
    AND end_date > index_date AND date_diff('day', index_date, end_date) <= 365)"""


def _is_cause() -> Column:
    return (F.col("cause_code_1").startswith("1-") | F.col("cause_code_1").contains("HIGH")
            | F.col("cause_code_4").contains("Q"))


def _cause(t: Tables) -> DataFrame:
    return o.cause_death(v.registry(t), v.index_people(t), _is_cause())


@query(with_(v.SPELLS, v.PERSON, v.REGISTRY, v.IDX, _CAUSE) + "SELECT * FROM cause")
def cause_death(t: Tables) -> DataFrame:
    """Death from a cause within a year, one registry record per person."""
    return _cause(t)


@query(with_(v.IDX, v.EP) + f"""
SELECT person_id, index_date, min(event_time) AS event_time FROM ep JOIN idx USING (person_id)
WHERE {_AFTER} AND {_CODED} AND episode_sequence = 1 GROUP BY 1, 2""")
def first_event_after(t: Tables) -> DataFrame:
    """First coded opening episode in the year after index."""
    return o.first_event_after(v.episodes(t), v.index_people(t), v.DIAGNOSES, **CODED)


@query(with_(v.EI) + """
SELECT DISTINCT user_id AS person_id, ts AS event_time, event_type AS code
FROM events JOIN ei ON user_id = person_id WHERE event_type IN ('error', 'purchase')
  AND ts > index_date AND date_diff('day', index_date, ts) <= 365""")
def events_after(t: Tables) -> DataFrame:
    """Every coded event after index."""
    rows = o.events_after(v.coded_events(t), v.event_index(t), t.codes("error", "purchase"))
    return rows.select("person_id", "event_time", "code")


_SITE = """site_{s} AS (
  SELECT person_id, index_date, min(event_time) AS event_time FROM ep JOIN idx USING (person_id)
  WHERE site = '{s}' AND episode_sequence = 1 AND {after} AND {coded} GROUP BY 1, 2)"""


@query(with_(v.IDX, v.EP, *[_SITE.format(s=s, after=_AFTER, coded=_CODED) for s in "ANR"]) + """
SELECT person_id, index_date, min(event_time) AS event_time
FROM (SELECT * FROM site_A UNION ALL SELECT * FROM site_N UNION ALL SELECT * FROM site_R) GROUP BY 1, 2""")
def first_across_sources(t: Tables) -> DataFrame:
    """First event over three sites of one table: first per person and site, then overall, in one pass."""
    rows = v.episodes(t).where(F.col("site").isin("A", "N", "R"))
    return o.first_across_sources(o.first_event_after(rows, v.index_people(t), v.DIAGNOSES, **CODED))


_TYPED = """typed AS (
  SELECT person_id, event_time, 'death' AS event_type FROM cause
  UNION SELECT person_id, event_time, 'promo' FROM ep JOIN idx USING (person_id)
        WHERE diagnosis_1 IN ('PROMO', 'Brand#1') AND {after}
  UNION SELECT person_id, min(event_time), 'economy' FROM ep JOIN idx USING (person_id)
        WHERE site = 'R' AND diagnosis_1 LIKE 'ECONOMY%' AND episode_sequence = 1 AND {after}
        GROUP BY person_id)""".format(after=_AFTER)


def _composite(t: Tables) -> DataFrame:
    rules = {"promo": o.EventRule(["diagnosis_1"], codes={"PROMO", "Brand#1"}),
             "economy": o.EventRule(["diagnosis_1"], prefixes=["ECONOMY"], only=F.col("site") == "R",
                                    first_in_spell=True, first_only=True)}
    deaths = o.typed(o.death_record(v.registry(t), _is_cause()).withColumn("event_time", F.col("end_date")), "death")
    return o.tagged_events_after(v.episodes(t), v.index_people(t), rules, deaths)


@query(with_(v.SPELLS, v.PERSON, v.REGISTRY, v.IDX, v.EP, _CAUSE, _TYPED) + "SELECT * FROM typed")
def composite_outcome(t: Tables) -> DataFrame:
    """Three typed event sets, distinct."""
    return _composite(t)


@query(with_(v.SPELLS, v.PERSON, v.REGISTRY, v.IDX, v.EP, _CAUSE, _TYPED, """days AS (
  SELECT DISTINCT person_id, CAST(event_time AS DATE) AS event_date, event_type FROM typed)""") + """
SELECT a.person_id, CAST(a.event_date AS TIMESTAMP) AS event_date, a.event_type FROM days a
WHERE a.event_type = 'death' OR NOT EXISTS (
  SELECT 1 FROM days b WHERE b.person_id = a.person_id
    AND ((b.event_date > a.event_date AND date_diff('day', a.event_date, b.event_date) < 30)
         OR (b.event_date = a.event_date AND b.event_type = 'death')))""")
def drop_followed_events(t: Tables) -> DataFrame:
    """Events another event follows within 30 days are dropped, deaths never."""
    return o.drop_followed_events(_composite(t), {"promo", "economy"})


@query(with_(v.SPELLS, v.PERSON, v.REGISTRY, v.IDX, v.EP, _CAUSE, _TYPED) + """
SELECT person_id, index_date, event_time, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY event_time, event_type) AS rn
  FROM typed JOIN idx USING (person_id)
  WHERE event_type IN ('promo', 'economy') AND date_diff('day', index_date, event_time) >= 1)
WHERE rn = 1""")
def first_of_types(t: Tables) -> DataFrame:
    """First of two event types, the index day excluded."""
    return o.first_of(_composite(t), v.index_people(t), {"promo", "economy"})


@query("""SELECT DISTINCT * FROM (
  SELECT o_custkey AS person_id, o_orderdate AS event_time, 'order' AS event_type FROM orders
  UNION ALL SELECT user_id, ts, event_type FROM events WHERE event_type = 'purchase')""")
def normalised_union(t: Tables) -> DataFrame:
    """Differently named sources brought to one shape, distinct."""
    bought = t("events").where(F.col("event_type") == "purchase")
    return stack_distinct(
        normalise_event(t("orders"), "o_custkey", "o_orderdate", "order"),
        normalise_event(bought, "user_id", "ts", F.col("event_type")))


@query(with_(v.EI) + """
SELECT user_id AS person_id, count(*) FILTER (WHERE ts < index_date) AS n_before,
       count(*) FILTER (WHERE ts > index_date) AS n_after
FROM events JOIN ei ON user_id = person_id GROUP BY 1""")
def before_and_after_counts(t: Tables) -> DataFrame:
    """Events either side of the index moment (the index event itself in neither)."""
    people, rows = v.event_index(t), v.coded_events(t)
    met = spread_join(rows, people, ["person_id"])
    when, index = F.col("event_time"), F.col("index_date")
    return met.groupBy("person_id").agg(
        F.count(F.when(ever_before()(when, index), 1)).alias("n_before"),
        F.count(F.when(ever_after()(when, index), 1)).alias("n_after"))


# --- codes -------------------------------------------------------------------

@query(with_(v.EP) + """
SELECT person_id, event_time, diagnosis_1, diagnosis_2, count(*) AS n FROM ep
WHERE diagnosis_1 IN (SELECT p_brand FROM part WHERE p_brand LIKE 'Brand#1%' UNION SELECT 'PROMO')
   OR diagnosis_2 IN (SELECT p_brand FROM part WHERE p_brand LIKE 'Brand#1%' UNION SELECT 'PROMO')
GROUP BY 1, 2, 3, 4""")
def any_code_in_list(t: Tables) -> DataFrame:
    """Any positional code among one maker's brands, a list that comes as a table (with repeats)."""
    listed = t("part").where(F.col("p_brand").startswith("Brand#1")).select(
        F.col("p_brand").alias("code")).unionByName(t.codes("PROMO"))
    hits = any_code_in(v.episodes(t), v.DIAGNOSES, listed)
    return (hits.groupBy("person_id", "event_time", *v.DIAGNOSES)
            .agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber, count(*) AS n FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)
   OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)
   OR l_orderkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1, 2""")
def any_code_in_long_list(t: Tables) -> DataFrame:
    """Any of three ids in a list as long as half the part table, joined whatever its size."""
    listed = t("part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("code")).distinct()
    rows = t("lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), "l_linenumber",
                                F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier"))
    hits = any_code_joined(rows, ["part", "supplier", "order_id"], listed)
    return hits.groupBy("order_id", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(with_(v.EP) + """
SELECT diagnosis_1, diagnosis_2, count(*) AS n FROM ep
WHERE substring(rtrim(diagnosis_1, 'Y'), 1, 3) IN ('ECO', 'SMA')
   OR substring(rtrim(diagnosis_2, 'Y'), 1, 3) IN ('ECO', 'SMA') GROUP BY 1, 2""")
def any_code_in_truncated(t: Tables) -> DataFrame:
    """Codes trimmed of filler and cut to three characters before matching."""
    hits = any_code_in(v.episodes(t), v.DIAGNOSES, {"ECO", "SMA"}, prefix_len=3, filler="Y")
    return hits.groupBy(*v.DIAGNOSES).agg(F.count(F.lit(1)).alias("n"))


@query(with_(v.EP) + """
SELECT diagnosis_1, diagnosis_2, count(*) AS n FROM ep
WHERE diagnosis_1 LIKE 'Brand#1%' OR diagnosis_2 LIKE 'Brand#1%' OR diagnosis_1 LIKE 'SM%'
GROUP BY 1, 2""")
def any_code_prefix_list(t: Tables) -> DataFrame:
    """Any positional code with one of the prefixes."""
    hits = any_code_prefix(v.episodes(t), v.DIAGNOSES, ["Brand#1", "SM"])
    return hits.groupBy(*v.DIAGNOSES).agg(F.count(F.lit(1)).alias("n"))
