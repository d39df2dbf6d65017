"""Cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.catalogue import views as v
from anchorline.catalogue.registry import Tables, query, with_
from anchorline.operators.joins import assemble_master, attach, exclude, one_row_per, restrict_to
from anchorline.operators.select import sample_one_per, sample_per
from anchorline.operators.tabulate import n_persons
from anchorline.plans import cohort as c
from anchorline.plans.phenotype import derive_clinical_labels, near_death_flag

RULES = dict(excluded_dates=["1996-04-04", "1996-07-25", "1996-08-22", "1995-11-02"],
             min_age=55, min_days=42)


@query(with_(v.COHORT) + """
SELECT person_id, CAST(index_date AS TIMESTAMP) AS index_date,
       CAST(last_stop AS TIMESTAMP) AS last_stop, admission_service, postcode, gender,
       CAST(age_at_index AS INTEGER) AS age_at_index, CAST(stay_days AS INTEGER) AS stay_days
FROM cohort""")
def cohort_index(t: Tables) -> DataFrame:
    """First spell, last stop, age and length of stay per person."""
    out = c.build_cohort(v.spells(t), v.person(t), v.observation(t), v.SPELL_TYPES, v.BEFORE)
    return out.select("person_id", "index_date", "last_stop", "admission_service", "postcode",
                      "gender", "age_at_index", "stay_days")


_STEPS = [
    ("start", "TRUE"),
    ("known index date", "index_date NOT IN (DATE '1996-04-04', DATE '1996-07-25', "
                         "DATE '1996-08-22', DATE '1995-11-02')"),
    ("aged 55 or over", "age_at_index >= 55"),
    ("alive after 42 days", "(dod IS NULL OR date_diff('day', index_date, dod) > 42)"),
    ("stayed over 42 days", "stay_days > 42"),
]


@query(with_(v.COHORT) + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS step_no, '{name}' AS step, count(*) AS n FROM cohort WHERE "
    + " AND ".join(cond for _, cond in _STEPS[:i + 1]) for i, (name, _) in enumerate(_STEPS)))
def cohort_attrition(t: Tables) -> DataFrame:
    """Rows left after each exclusion, counted in one pass."""
    return c.apply_exclusions(v.cohort(t), c.entry_rules(**RULES))[1]


@query(with_(v.COHORT) + "SELECT person_id FROM cohort WHERE "
       + " AND ".join(cond for _, cond in _STEPS))
def cohort_kept(t: Tables) -> DataFrame:
    """Persons that pass every exclusion."""
    return c.apply_exclusions(v.cohort(t), c.entry_rules(**RULES))[0].select("person_id")


@query(with_(v.COHORT) + """
SELECT person_id, CAST(death_date AS TIMESTAMP) AS death_date, CAST(dod AS TIMESTAMP) AS dod
FROM cohort WHERE dod IS NOT NULL""")
def death_reconcile(t: Tables) -> DataFrame:
    """Recorded date of death, else the registry's latest."""
    return v.cohort(t).where("dod IS NOT NULL").select("person_id", "death_date", "dod")


@query(with_(v.COHORT) + """
SELECT person_id, CASE WHEN dod IS NULL AND ob_end IS NOT NULL THEN 'survived'
                       WHEN dod IS NOT NULL THEN 'died' ELSE 'lost to follow up' END AS end_of_fu_status,
       CAST(coalesce(dod, ob_end) AS TIMESTAMP) AS fu_end_date,
       CAST(coalesce(date_diff('day', index_date, dod), -1) AS INTEGER) AS mortality_days,
       CAST(coalesce(date_diff('day', index_date, coalesce(dod, ob_end)), -1) AS INTEGER) AS fu_days
FROM cohort WHERE coalesce(dod, ob_end) IS NULL OR index_date <= coalesce(dod, ob_end)""")
def follow_up_status(t: Tables) -> DataFrame:
    """End status, end date and length of follow-up (-1: none)."""
    out = c.drop_ended_before_index(c.follow_up(v.cohort(t)))
    return out.select("person_id", "end_of_fu_status", "fu_end_date",
                      F.coalesce("mortality_days", F.lit(-1)).alias("mortality_days"),
                      F.coalesce("fu_days", F.lit(-1)).alias("fu_days"))


@query(with_(v.COHORT) + """
SELECT person_id, CAST(last_stop AS TIMESTAMP) AS last_stop, CAST(ob_end AS TIMESTAMP) AS ob_end,
       CAST(date_diff('month', last_stop, ob_end) AS INTEGER) AS months_apart
FROM cohort WHERE dod IS NULL AND date_diff('month', last_stop, ob_end) BETWEEN -2 AND 2""")
def presumed_exit(t: Tables) -> DataFrame:
    """No death date, and observation ends near the last stop."""
    out = c.presumed_exit(v.cohort(t), v.observation(t))
    return out.select("person_id", "last_stop", "ob_end", "months_apart")


@query("""
SELECT c_custkey AS person_id,
       coalesce((SELECT CAST(CAST(floor(avg(s_acctbal) / 1000) AS INTEGER) AS VARCHAR) FROM supplier
                 WHERE s_nationkey = c_nationkey), 'missing') AS decile
FROM customer WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders
                     WHERE o_custkey = c_custkey AND o_orderstatus = 'P') <= 1""")
def area_index(t: Tables) -> DataFrame:
    """Persons' areas by their P orders, scored by all suppliers of the nation; several areas: person dropped."""
    people = t("customer").select(F.col("c_custkey").alias("person_id"),
                                  F.col("c_nationkey").cast("string").alias("nation"))
    moves = (t("orders").where(F.col("o_orderstatus") == "P")
             .select(F.col("o_custkey").alias("person_id"), "o_orderpriority").distinct())
    areas = people.join(moves, "person_id", "left").select(
        "person_id", F.concat_ws(" ", "nation", "o_orderpriority").alias("area"), "nation")
    scores = t("supplier").groupBy(F.col("s_nationkey").cast("string").alias("nation")).agg(
        F.floor(F.avg("s_acctbal") / 1000).cast("int").alias("decile"))
    index = areas.select("area", "nation").distinct().join(scores, "nation").select("area", "decile")
    return c.attach_area_index(people.select("person_id"), areas, index).select("person_id", "decile")


@query("""
WITH o AS (SELECT o_custkey, min(o_orderpriority) AS text FROM orders GROUP BY 1)
SELECT c_custkey AS person_id,
       CASE WHEN c_mktsegment = 'FURNITURE' AND text = '1-URGENT' THEN 'MACHINERY'
            WHEN c_mktsegment = 'FURNITURE' AND text = '2-HIGH' THEN 'BUILDING'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'FURNITURE' ELSE c_mktsegment END AS category
FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def resolve_category(t: Tables) -> DataFrame:
    """Segment, unless unknown (FURNITURE) and a second source can say more."""
    people = t("customer").select(F.col("c_custkey").alias("person_id"))
    primary = t("customer").where(F.col("c_mktsegment") != "HOUSEHOLD").select(
        F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("group"))
    second = t("orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min("o_orderpriority").alias("text"))
    recodes = {"1-URGENT": "MACHINERY", "2-HIGH": "BUILDING"}
    return c.resolve_category(people, primary, second, recodes, unknown="FURNITURE")


@query("""SELECT o_custkey AS person_id, arg_min(o_orderpriority, md5('7|' || o_custkey || '|' || o_orderpriority)) AS o_orderpriority
FROM orders GROUP BY 1""")
def sample_one_per_person(t: Tables) -> DataFrame:
    """A random, repeatable priority per person."""
    rows = t("orders").select(F.col("o_custkey").alias("person_id"), "o_orderpriority")
    return sample_one_per(rows, "person_id", "o_orderpriority", seed=7)


@query("""SELECT o_custkey AS person_id, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3|' || o_custkey || '|' || o_orderkey)) <= 3""")
def sample_three_per_person(t: Tables) -> DataFrame:
    """Three random orders per person, or all of fewer."""
    rows = t("orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    return sample_per(rows, "person_id", "o_orderkey", seed=3, n=3)


@query("""SELECT count(DISTINCT o_custkey) AS n_picked, count(DISTINCT o_custkey) AS n_valid FROM orders""")
def sample_is_valid(t: Tables) -> DataFrame:
    """One pick per person, and every pick is one of the person's own values."""
    rows = t("orders").select(F.col("o_custkey").alias("person_id"), "o_orderpriority")
    picked = sample_one_per(rows, "person_id", "o_orderpriority", seed=7)
    own = picked.join(rows.distinct(), ["person_id", "o_orderpriority"], "left_semi")
    return (picked.select("person_id", F.lit(0).alias("valid"))
            .unionByName(own.select("person_id", F.lit(1).alias("valid")))
            .agg(F.count(F.when(F.col("valid") == 0, 1)).alias("n_picked"),
                 F.sum("valid").alias("n_valid")))


@query(with_(v.COHORT) + """
SELECT CASE WHEN index_date < DATE '1996-01-01' THEN 'before' ELSE 'after' END AS period,
       CAST(year(index_date) AS INTEGER) AS index_year, count(*) AS n
FROM cohort GROUP BY 1, 2""")
def stratify_by_date(t: Tables) -> DataFrame:
    """Persons by calendar period and year of admission."""
    day = F.col("index_date")
    rows = v.cohort(t).select(c.stratify_by_date(day, "1996-01-01").alias("period"),
                              F.year(day).alias("index_year"))
    return rows.groupBy("period", "index_year").agg(F.count(F.lit(1)).alias("n"))


@query(with_(v.COHORT) + """
SELECT p_partkey AS person_id,
       CASE WHEN p_size BETWEEN 0 AND 10 THEN 'fit' WHEN p_size > 10 AND p_size <= 25 THEN 'mild'
            WHEN p_size > 25 AND p_size <= 40 THEN 'moderate' WHEN p_size > 40 AND p_size <= 49
            THEN 'severe' END AS frailty_band,
       CASE WHEN p_retailprice BETWEEN 910 AND 980 THEN round(p_retailprice, 6) END AS bmi,
       CASE WHEN p_retailprice IS NULL THEN 'missing' WHEN p_retailprice > 0 THEN 'yes' END AS reading_present,
       CASE WHEN (p_retailprice >= 950 AND p_size >= 30) OR (p_retailprice >= 930 AND p_size < 30)
            THEN 'above' ELSE 'below' END AS control
FROM part""")
def clinical_labels(t: Tables) -> DataFrame:
    """Band, cleaned measurement, presence and age-dependent target."""
    rows = t("part").select(F.col("p_partkey").alias("person_id"), F.col("p_size").alias("age"),
                            F.col("p_retailprice").alias("bmi"),
                            F.col("p_retailprice").alias("reading"))
    out = derive_clinical_labels(rows, "age", [0, 10, 25, 40, 49],
                                 ["fit", "mild", "moderate", "severe"], "bmi", (910, 980),
                                 "reading", "age", (30, 950, 930))
    return out.select("person_id", "frailty_band", "bmi", "reading_present", "control")


@query(with_(v.COHORT) + """
SELECT person_id, CAST(last_stop AS TIMESTAMP) AS last_stop, CAST(dod AS TIMESTAMP) AS dod,
       date_diff('day', last_stop, dod) <= 60 AS near_end
FROM cohort WHERE dod IS NOT NULL AND last_stop IS NOT NULL""")
def near_end_flag(t: Tables) -> DataFrame:
    """Last stop at most 60 days before (or after) the date of death."""
    known = v.cohort(t).where("dod IS NOT NULL AND last_stop IS NOT NULL")
    return known.select("person_id", "last_stop", "dod",
                        near_death_flag(F.col("last_stop"), F.col("dod")).alias("near_end"))


@query(with_(v.COHORT, v.IDX) + """
SELECT c_custkey AS person_id, CAST(cohort.index_date AS TIMESTAMP) AS index_date, n_orders,
       coalesce(n_urgent, 0) AS n_urgent
FROM customer LEFT JOIN cohort ON c_custkey = cohort.person_id
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT'
           GROUP BY 1) b ON c_custkey = b.o_custkey
WHERE n_orders IS NOT NULL""")
def master_table(t: Tables) -> DataFrame:
    """Person star: one row per person over several covariate tables."""
    people = t("customer").select(F.col("c_custkey").alias("person_id"))
    key = F.col("o_custkey").alias("person_id")
    orders = t("orders").groupBy(key).agg(F.count(F.lit(1)).alias("n_orders"))
    urgent = (t("orders").where(F.col("o_orderpriority") == "1-URGENT").groupBy(key)
              .agg(F.count(F.lit(1)).alias("n_urgent")))
    star = assemble_master(people, [v.cohort(t).select("person_id", "index_date"), orders])
    return attach(star, urgent, n_urgent=0).where("n_orders IS NOT NULL")


@query(with_(v.IDX) + """
SELECT o_custkey AS person_id, o_orderkey, 'kept' AS side FROM orders
WHERE o_custkey IN (SELECT person_id FROM idx WHERE index_date < TIMESTAMP '1996-01-01')
UNION ALL
SELECT o_custkey, o_orderkey, 'dropped' FROM orders
WHERE o_custkey NOT IN (SELECT person_id FROM idx WHERE index_date < TIMESTAMP '1996-01-01')""")
def restrict_and_exclude(t: Tables) -> DataFrame:
    """Semi and anti join against the cohort together give back every row once."""
    early = v.index_people(t).where(F.col("index_date") < F.lit("1996-01-01").cast("timestamp_ntz"))
    rows = t("orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    kept = restrict_to(rows, early).withColumn("side", F.lit("kept"))
    return kept.unionByName(exclude(rows, early).withColumn("side", F.lit("dropped")))


@query("SELECT o_custkey AS person_id, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    """Keys breaking a one-row-per-person contract."""
    return one_row_per(t("orders").select(F.col("o_custkey").alias("person_id")))


@query(with_(v.COHORT) + "SELECT count(DISTINCT person_id) AS n_persons FROM registry")
def distinct_persons(t: Tables) -> DataFrame:
    return n_persons(v.registry(t), "person_id")
