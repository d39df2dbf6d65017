"""The clinical entities, played by the driver's tables.

Each entity exists twice: as a DataFrame and as SQL text for the oracle.
Customers are persons, O/F orders their care spells, P orders a second registry,
line items their hospital episodes and drugs, user events their coded readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.catalogue.registry import Tables
from anchorline.plans.cohort import build_cohort, reconcile_death

SPELL_TYPES = ["O", "F"]
BEFORE = "1999-12-31"
SITES = ["A", "R"]
DIAGNOSES = ["diagnosis_1", "diagnosis_2"]

IDX = """idx AS (
  SELECT o_custkey AS person_id, min(o_orderdate) AS index_date, max(o_orderdate) AS last_day
  FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1)"""

EP = """ep AS (
  SELECT o_custkey AS person_id, l_shipdate AS event_time, l_linenumber AS episode_sequence,
         l_returnflag AS site, l_linestatus = 'O' AS is_repeat, p_type AS diagnosis_1,
         p_brand AS diagnosis_2, p_type || p_brand AS chapter_code, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

EI = """ei AS (
  SELECT user_id AS person_id, min(ts) AS index_date FROM events
  WHERE event_type = 'signup' GROUP BY 1)"""

SPELLS = """spells AS (
  SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderkey % 11 <> 0
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS end_date,
         o_orderstatus AS service_type, o_orderpriority AS postcode
  FROM orders)"""

PERSON = """person AS (
  SELECT c_custkey AS person_id, DATE '1925-01-01' + CAST(c_custkey * 37 % 12000 AS INTEGER) AS birth_date,
         CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0
              THEN DATE '1996-01-01' + CAST(c_custkey * 7 % 1500 AS INTEGER) END AS death_date,
         c_mktsegment AS gender
  FROM customer)"""

OBS = """obs AS (
  SELECT o_custkey AS person_id, max(CAST(o_orderdate AS DATE)) AS ob_end
  FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)"""

REGISTRY = """registry AS (
  SELECT o_custkey AS person_id,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS dod,
         CAST(o_orderdate AS DATE) + 7 AS reg_date, CAST(o_orderdate AS DATE) AS end_date,
         o_orderpriority AS cause_code_1, o_orderstatus AS cause_code_4
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'P' AND c_acctbal < 0)"""

COHORT = ",\n".join([SPELLS, PERSON, OBS, REGISTRY, """entry_spell AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id
                ORDER BY start_date NULLS FIRST, service_type, postcode) AS rn
    FROM spells WHERE service_type IN ('O', 'F')) WHERE rn = 1),
last_spell AS (
  SELECT person_id, max(end_date) AS last_stop FROM spells
  WHERE service_type IN ('O', 'F') GROUP BY 1),
death AS (
  SELECT person_id, coalesce(dod, reg_date) AS registry_date FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id
                ORDER BY dod DESC NULLS LAST, reg_date DESC NULLS LAST) AS rn
    FROM registry
    WHERE person_id IN (SELECT person_id FROM person WHERE death_date IS NULL)) WHERE rn = 1),
cohort AS (
  SELECT e.person_id, e.start_date AS index_date, l.last_stop, e.service_type AS admission_service,
         e.postcode, p.birth_date, p.death_date, p.gender, o.ob_end,
         date_diff('day', e.start_date, l.last_stop) AS stay_days,
         date_diff('year', p.birth_date, e.start_date) AS age_at_index,
         coalesce(p.death_date, d.registry_date) AS dod
  FROM entry_spell e JOIN last_spell l USING (person_id) LEFT JOIN person p USING (person_id)
  LEFT JOIN obs o USING (person_id) LEFT JOIN death d USING (person_id)
  WHERE e.start_date < DATE '1999-12-31')"""])

SURV = COHORT + """,
followed AS (
  SELECT *, date_diff('day', index_date, coalesce(dod, ob_end)) AS fu_days,
         dod IS NOT NULL AS died
  FROM cohort WHERE coalesce(dod, ob_end) IS NULL OR index_date <= coalesce(dod, ob_end))"""


def index_people(t: Tables) -> DataFrame:
    return (t("orders").where(F.col("o_orderstatus").isin(SPELL_TYPES))
            .groupBy(F.col("o_custkey").alias("person_id"))
            .agg(F.min("o_orderdate").alias("index_date"), F.max("o_orderdate").alias("last_day")))


def episodes(t: Tables) -> DataFrame:
    rows = (t("lineitem")
            .join(t("orders").select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t("part"), F.col("l_partkey") == F.col("p_partkey")))
    return rows.select(
        F.col("o_custkey").alias("person_id"), F.col("l_shipdate").alias("event_time"),
        F.col("l_linenumber").alias("episode_sequence"), F.col("l_returnflag").alias("site"),
        (F.col("l_linestatus") == "O").alias("is_repeat"), F.col("p_type").alias("diagnosis_1"),
        F.col("p_brand").alias("diagnosis_2"), "p_size")


def medications(t: Tables) -> DataFrame:
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"),
                              F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("person_id"), F.col("l_shipdate").alias("event_time"),
        F.col("l_partkey").cast("string").alias("drug_id"),
        (F.col("l_linestatus") == "O").alias("is_repeat"))


def drug_lookup(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("drug_code"),
                            F.concat("p_type", "p_brand").alias("chapter_code"))


def event_index(t: Tables) -> DataFrame:
    signups = t("events").where(F.col("event_type") == "signup")
    return signups.groupBy(F.col("user_id").alias("person_id")).agg(F.min("ts").alias("index_date"))


def readings(t: Tables) -> DataFrame:
    return t("events").select(F.col("user_id").alias("person_id"), F.col("ts").alias("event_time"),
                              F.col("event_type").alias("kind"), "value")


def coded_events(t: Tables) -> DataFrame:
    return t("events").select(F.col("user_id").alias("person_id"), F.col("ts").alias("event_time"),
                              F.col("event_type").alias("code"))


def spells(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    length = (F.col("o_orderkey") % 400).cast("int")
    return t("orders").select(
        F.col("o_custkey").alias("person_id"), day.alias("start_date"),
        F.when(F.col("o_orderkey") % 11 != 0, F.date_add(day, length)).alias("end_date"),
        F.col("o_orderstatus").alias("service_type"), F.col("o_orderpriority").alias("postcode"))


def person(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1925-01-01").cast("date"), (key * 37 % 12000).cast("int"))
    died = F.date_add(F.lit("1996-01-01").cast("date"), (key * 7 % 1500).cast("int"))
    return t("customer").select(
        key.alias("person_id"), born.alias("birth_date"),
        F.when((F.col("c_acctbal") < 0) & (key % 2 == 0), died).alias("death_date"),
        F.col("c_mktsegment").alias("gender"))


def observation(t: Tables) -> DataFrame:
    return (t("orders").where(F.col("o_orderstatus") == "P")
            .groupBy(F.col("o_custkey").alias("person_id"))
            .agg(F.to_date(F.max("o_orderdate")).alias("ob_end")))


def registry(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = t("orders").where(F.col("o_orderstatus") == "P").join(
        t("customer").where(F.col("c_acctbal") < 0), F.col("o_custkey") == F.col("c_custkey"),
        "left_semi")
    return rows.select(
        F.col("o_custkey").alias("person_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", day).alias("dod"),
        F.date_add(day, 7).alias("reg_date"), day.alias("end_date"),
        F.col("o_orderpriority").alias("cause_code_1"), F.col("o_orderstatus").alias("cause_code_4"))


def cohort(t: Tables) -> DataFrame:
    """Cohort with reconciled date of death."""
    base = build_cohort(spells(t), person(t), observation(t), SPELL_TYPES, BEFORE)
    return reconcile_death(base, registry(t))
