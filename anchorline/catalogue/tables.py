"""Selection, tabulation, reshaping and expression queries."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from anchorline.catalogue import views as v
from anchorline.catalogue.events import CLASSES, _LONG, _long
from anchorline.catalogue.registry import Tables, query, with_
from anchorline.functions import dates as d, text as x, values as val
from anchorline.operators import select as s, tabulate as tab
from anchorline.operators.reshape import collect_classes, to_long
from anchorline.session import written_folder
from anchorline.sources.codelists import clean_codelist, load_codelist
from anchorline.sources.tables import load, publish


def _orders(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey", "o_orderdate",
                              "o_orderstatus", "o_orderpriority", "o_totalprice")


# --- per-key selection -------------------------------------------------------

_PICK = """SELECT o_custkey AS person_id, o_orderkey, o_orderdate, o_orderpriority FROM (
  SELECT *, {rank} OVER (PARTITION BY o_custkey ORDER BY {order}) AS rn FROM orders) WHERE rn <= {n}"""
_SHOWN = ["person_id", "o_orderkey", "o_orderdate", "o_orderpriority"]


@query(_PICK.format(rank="row_number()", order="o_orderdate, o_orderkey, o_orderpriority, o_totalprice", n=1))
def first_per_person(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice")]
    return s.first_per(_orders(t), "person_id", order).select(*_SHOWN)


@query(_PICK.format(rank="row_number()", n=1, order="o_orderdate DESC, o_orderkey DESC, "
                    "o_orderpriority DESC, o_totalprice DESC"))
def last_per_person(t: Tables) -> DataFrame:
    return s.last_per(_orders(t), "person_id",
                      ["o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice"]).select(*_SHOWN)


@query("""SELECT o_custkey AS person_id, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
       CAST(rn AS INTEGER) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
                               ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2""")
def top_two_per(t: Tables) -> DataFrame:
    """Two largest per (person, kind)."""
    top = s.top_n_per(_orders(t), ["person_id", "o_orderstatus"],
                      [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, rank_as="nth")
    return top.select("person_id", "o_orderstatus", "o_totalprice", "nth")


@query("""SELECT o_custkey AS person_id, o_orderkey, CAST(rn AS INTEGER) AS date_rank FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC) AS rn
  FROM orders) WHERE rn <= 1""")
def rank_with_ties(t: Tables) -> DataFrame:
    """All rows sharing the person's latest month."""
    rows = _orders(t).withColumn("month", F.trunc("o_orderdate", "month"))
    return s.rank_per(rows, "person_id", "month", "date_rank").select(
        "person_id", "o_orderkey", "date_rank")


@query("""SELECT o_custkey AS person_id, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
           o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_latest_record(t: Tables) -> DataFrame:
    """Latest record wins, ties settled by price then key."""
    out = s.dedupe_latest(_orders(t), "person_id", ["o_orderdate", "o_totalprice"], ["o_orderkey"])
    return out.select("person_id", "o_orderkey", "o_orderdate")


@query("""SELECT user_id AS person_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
       CAST(floor(value) AS INTEGER) AS value, min(event_type) AS kind FROM events GROUP BY 1, 2, 3""")
def drop_duplicates(t: Tables) -> DataFrame:
    """One row per person, day and value; the first kind by name stays."""
    rows = t("events").select(F.col("user_id").alias("person_id"), F.to_date("ts").alias("day"),
                              F.floor("value").cast("int").alias("value"),
                              F.col("event_type").alias("kind"))
    return s.drop_exact_duplicates(rows, ["person_id", "day", "value"])


@query("""SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem
GROUP BY 1, 2 HAVING count(*) = 1""")
def keep_unique(t: Tables) -> DataFrame:
    """Only keys that occur once."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return s.keep_unique(rows, ["l_orderkey", "l_linenumber"])


_DAYS = """days AS (SELECT DISTINCT user_id AS person_id, CAST(ts AS DATE) AS day FROM events
  WHERE event_type = 'purchase')"""


def _days(t: Tables) -> DataFrame:
    return (t("events").where(F.col("event_type") == "purchase")
            .select(F.col("user_id").alias("person_id"), F.to_date("ts").alias("day")).distinct())


@query(with_(_DAYS) + """SELECT person_id, CAST(day AS TIMESTAMP) AS day, CAST(coalesce(date_diff('day',
  lag(day) OVER (PARTITION BY person_id ORDER BY day), day), -1) AS INTEGER) AS gap_days FROM days""")
def gap_to_previous(t: Tables) -> DataFrame:
    """Days since the person's previous purchase day (-1: first)."""
    return s.gap_to_previous(_days(t), "person_id", "day").withColumn(
        "gap_days", F.coalesce("gap_days", F.lit(-1)))


@query(with_(_DAYS) + """, n AS (SELECT day, count(*) AS buyers FROM days GROUP BY 1)
SELECT CAST(day AS TIMESTAMP) AS day, buyers,
       CAST(sum(buyers) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM n""")
def cumulative_total(t: Tables) -> DataFrame:
    """Running total over days, scanned by ranges."""
    per_day = _days(t).groupBy("day").agg(F.count(F.lit(1)).alias("buyers"))
    return s.cumulative(per_day, [], [F.col("day")], so_far=("sum", F.col("buyers")))


# --- tabulation --------------------------------------------------------------

@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS sd, round(min(c_acctbal), 6) AS min,
       round(max(c_acctbal), 6) AS max FROM customer GROUP BY 1""")
def describe_by_segment(t: Tables) -> DataFrame:
    return tab.describe_by(t("customer"), "c_acctbal", ["c_mktsegment"])


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1""")
def crosstab(t: Tables) -> DataFrame:
    return tab.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS percent
FROM orders GROUP BY 1, 2""")
def pct_within(t: Tables) -> DataFrame:
    """Priority within status, with the status total beside each row."""
    return tab.pct_within(t("orders"), ["o_orderpriority"], ["o_orderstatus"])


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_flagged,
       round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent
FROM customer GROUP BY 1""")
def prevalence(t: Tables) -> DataFrame:
    return tab.prevalence(t("customer"), F.col("c_acctbal") < 0, ["c_mktsegment"])


_Q = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS {n}"
               for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))


@query(with_(v.SURV) + f"""SELECT gender, count(fu_days) AS n, {_Q.format(c="CAST(fu_days AS DOUBLE)")}
FROM followed WHERE fu_days IS NOT NULL GROUP BY 1""")
def quantiles_by(t: Tables) -> DataFrame:
    """Quartiles of follow-up by stratum."""
    from anchorline.catalogue.survival import followed
    return tab.quantiles(followed(t), "fu_days", [0.25, 0.5, 0.75], ["gender"])


@query(f"""SELECT count(*) AS n, {_Q.format(c="l_extendedprice")},
       round(quantile_cont(l_extendedprice, 0.975), 6) AS q97_5 FROM lineitem""")
def quantiles_overall(t: Tables) -> DataFrame:
    """Exact quartiles of a continuous measure."""
    return tab.quantiles(t("lineitem"), "l_extendedprice", [0.25, 0.5, 0.75, 0.975])


@query("""SELECT CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 21
  ELSE floor((c_acctbal + 1000) / 550) + 1 END AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1""")
def histogram(t: Tables) -> DataFrame:
    """Equal-width bins."""
    return tab.histogram(t("customer"), "c_acctbal", -1000, 10000, 20)


def _summary_sql(parts: list[tuple[int, str, str, str, str]]) -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS variable, dep AS dependent, "
        f"{level} AS level, {value} AS value, {'TRUE' if cat else 'FALSE'} AS cat FROM base"
        for i, name, level, value, cat in parts)
    return f""", long AS ({rows}), g AS (
  SELECT position, variable, dependent, level, cat, count(*) AS n, avg(value) AS mean,
         stddev_samp(value) AS sd FROM long GROUP BY ALL)
SELECT position, variable, dependent, level, n, round(mean, 6) AS mean, round(sd, 6) AS sd,
       CASE WHEN cat THEN round(n * 100.0 / sum(n) OVER (PARTITION BY variable, dependent), 6) END AS percent
FROM g"""


@query("""WITH base AS (
  SELECT c_mktsegment AS dep, c_acctbal, CASE WHEN c_nationkey < 20 THEN n_name END AS nation,
         CASE WHEN c_acctbal < 0 THEN 'yes' ELSE 'no' END AS died
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""" + _summary_sql([
    (-1, "total", "'n'", "CAST(NULL AS DOUBLE)", ""),
    (0, "c_acctbal", "'mean'", "c_acctbal", ""),
    (1, "nation", "coalesce(nation, 'missing')", "CAST(NULL AS DOUBLE)", "y"),
    (2, "died", "died", "CAST(NULL AS DOUBLE)", "y")]))
def summary_table(t: Tables) -> DataFrame:
    """Mean (SD) and n (%) by segment, missing level and totals included."""
    base = (t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("nation", F.when(F.col("c_nationkey") < 20, F.col("n_name")))
            .withColumn("died", F.when(F.col("c_acctbal") < 0, "yes").otherwise("no")))
    return tab.summary_table(base, ["c_acctbal"], ["nation", "died"], "c_mktsegment",
                             na_include=True, totals=True)


@query("""WITH base AS (
  SELECT c_mktsegment AS dep, CASE WHEN c_nationkey < 20 THEN n_name END AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT dep, nation, count(*) AS n FROM base GROUP BY ALL),
t AS (SELECT dep, count(*) AS n FROM base GROUP BY 1)
SELECT CAST(-1 AS INTEGER) AS position, 'total' AS variable, dep AS dependent, 'n' AS level, n,
       round(n * 100.0 / sum(n) OVER (), 6) AS percent FROM t
UNION ALL SELECT 0, 'nation', dep, coalesce(nation, 'missing'), n,
       CASE WHEN nation IS NOT NULL THEN round(n * 100.0 / sum(CASE WHEN nation IS NOT NULL THEN n END)
                                               OVER (PARTITION BY dep), 6) END FROM g""")
def summary_without_missing(t: Tables) -> DataFrame:
    """Shares among the known levels, and columns' shares of all rows."""
    base = (t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("nation", F.when(F.col("c_nationkey") < 20, F.col("n_name"))))
    out = tab.summary_table(base, [], ["nation"], "c_mktsegment", na_include=True, totals=True,
                            na_to_p=False, column_totals=True)
    return out.drop("mean", "sd")


# --- sources and sinks -------------------------------------------------------

@query("SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders")
def publish_and_load(t: Tables) -> DataFrame:
    """A table published, replaced, refreshed from itself with partitions, and loaded again."""
    root = written_folder(t.spark)
    rows = t("orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    publish(rows.where("o_orderstatus = 'O'"), "copied_orders", root)
    publish(rows, "copied_orders", root)
    publish(load(t.spark, "copied_orders", root), "copied_orders", root, partition_by=["o_orderstatus"])
    return load(t.spark, "copied_orders", root)


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def cross_catalog_scan(t: Tables) -> DataFrame:
    """Tables of two databases joined by their three-part names, catalog.database.table."""
    # external tables over the given files, named after the folder that holds them
    found = {}
    for database, table in (("anchorline_people", "customer"), ("anchorline_records", "orders")):
        t.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        name = f"spark_catalog.{database}.{table}_{zlib.crc32(t.root.encode()):08x}"
        t.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{t.root}/{table}.parquet'")
        found[table] = load(t.spark, name)
    people, orders = found["customer"].select("c_custkey"), found["orders"].select("o_custkey", "o_orderkey")
    return (people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders")))


@query("""SELECT p_partkey::VARCHAR AS code, p_type AS coding_system, p_name AS term FROM part WHERE p_brand = 'Brand#1'""")
def codelist_from_csv(t: Tables) -> DataFrame:
    """A code list written as CSV and read back: codes stay text, quoted text stays whole."""
    path = written_folder(t.spark)
    (t("part").where("p_brand = 'Brand#1'")
     .select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("Code"), F.col("p_type").alias("System"),
             F.col("p_name").alias("Term"))
     .write.option("header", True).option("quoteAll", True).csv(path))
    return load_codelist(t.spark, path, "Code", "System", ["Term"]).withColumnRenamed("Term", "term")


# --- relational basics -------------------------------------------------------

@query("""SELECT o_orderkey AS key, o_custkey AS person_id, 'registry' AS source, CAST(NULL AS VARCHAR) AS note,
       round(o_totalprice / 30.44, 6) AS per_month, c_name, c_nationkey, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def projection(t: Tables) -> DataFrame:
    """Star minus columns, renames, constant and typed NULL columns, arithmetic."""
    people = t("customer").drop("c_acctbal").withColumnRenamed("c_mktsegment", "segment")
    rows = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("person_id"),
                              F.lit("registry").alias("source"), F.lit(None).cast("string").alias("note"),
                              (F.col("o_totalprice") / 30.44).alias("per_month"))
    return rows.join(people.withColumnRenamed("c_custkey", "person_id"), "person_id")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-04-04' AND TIMESTAMP '1999-12-31' AND o_orderstatus IN ('O', 'F')
  AND (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%HIGH%') AND o_totalprice > 1000
  AND o_orderdate NOT IN (TIMESTAMP '1996-07-25', TIMESTAMP '1996-08-22') AND o_custkey <> o_orderkey
  AND o_orderpriority <> '1-urgent' AND o_custkey IS NOT NULL""")
def filters(t: Tables) -> DataFrame:
    """Range, list, prefix, infix, negated, column-to-column, case-sensitive, not-null."""
    when, level = F.col("o_orderdate"), F.col("o_orderpriority")

    def at(day: str):
        return F.lit(day).cast("timestamp_ntz")

    kept = (when.between(at("1996-04-04"), at("1999-12-31")) & F.col("o_orderstatus").isin("O", "F")
            & (level.startswith("1-") | level.contains("HIGH")) & (F.col("o_totalprice") > 1000)
            & ~when.isin(at("1996-07-25"), at("1996-08-22")) & (F.col("o_custkey") != F.col("o_orderkey"))
            & (level != "1-urgent") & F.col("o_custkey").isNotNull())
    return t("orders").where(kept).select("o_orderkey", "o_custkey", "o_orderdate")


_SIDES = """early AS (SELECT o_custkey AS person_id, min(o_orderdate) AS first_o FROM orders
  WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
late AS (SELECT o_custkey AS person_id, max(o_orderdate) AS last_f FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '2000-01-01' GROUP BY 1)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows, when = _orders(t), F.col("o_orderdate")
    early = rows.where((F.col("o_orderstatus") == "O") & (when < F.lit("1996-01-01").cast("timestamp_ntz")))
    late = rows.where((F.col("o_orderstatus") == "F") & (when > F.lit("2000-01-01").cast("timestamp_ntz")))
    return (early.groupBy("person_id").agg(F.min(when).alias("first_o")),
            late.groupBy("person_id").agg(F.max(when).alias("last_f")))


@query(with_(_SIDES) + """SELECT 'both' AS side, person_id, first_o, last_f FROM early JOIN late USING (person_id)
UNION ALL SELECT 'left', person_id, first_o, last_f FROM early LEFT JOIN late USING (person_id)
UNION ALL SELECT 'either', person_id, first_o, last_f FROM early FULL JOIN late USING (person_id)""")
def inner_left_full(t: Tables) -> DataFrame:
    """Inner, left and full outer join of two one-row-per-person tables."""
    early, late = _sides(t)
    frames = [early.join(late, "person_id", how).withColumn("side", F.lit(name))
              for name, how in (("both", "inner"), ("left", "left"), ("either", "full"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(with_(_SIDES) + """SELECT person_id FROM early UNION SELECT person_id FROM late""")
def union_distinct(t: Tables) -> DataFrame:
    early, late = _sides(t)
    return early.select("person_id").union(late.select("person_id")).distinct()


@query("""SELECT count(*) AS n, count(*) AS n_ids FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)""")
def stable_ids(t: Tables) -> DataFrame:
    """One surrogate id per (person, date), without a global ranking."""
    keys = t("orders").select("o_custkey", "o_orderdate").distinct()
    ids = keys.withColumn("id", val.stable_id(F.col("o_custkey"), F.col("o_orderdate")))
    return ids.groupBy().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query("""SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer ORDER BY 2 DESC, 1""")
def ordered(t: Tables) -> DataFrame:
    """Presentation order over a whole table (range partitioned by Spark)."""
    return t("customer").select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(
        F.col("c_acctbal").desc(), "c_custkey")


# --- reshape -----------------------------------------------------------------

@query(with_(_LONG) + " UNION ALL ".join(
    f"SELECT person_id, time_status, '{c}' AS drug_class, {c} AS prescribed FROM long" for c in CLASSES))
def long_form(t: Tables) -> DataFrame:
    """Flag columns turned into rows."""
    return to_long(_long(t), ["person_id", "time_status"], list(CLASSES), "drug_class", "prescribed")


@query("""SELECT o_custkey AS person_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|')
  AS classes, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_classes FROM orders GROUP BY 1""")
def class_sets(t: Tables) -> DataFrame:
    """Distinct classes per person and their number."""
    out = collect_classes(_orders(t), ["person_id"], "o_orderpriority")
    return out.withColumn("classes", F.array_join("classes", "|"))


# --- expressions -------------------------------------------------------------

@query("""SELECT o_orderkey, o_custkey, o_totalprice_r AS price, years, months, days,
       CAST(month_back AS TIMESTAMP) AS month_back, CAST(day_on AS TIMESTAMP) AS day_on, parsed
FROM (SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice_r,
  CAST(date_diff('year', TIMESTAMP '1996-07-31', o_orderdate) AS INTEGER) AS years,
  CAST(date_diff('month', TIMESTAMP '1996-07-31', o_orderdate) AS INTEGER) AS months,
  CAST(date_diff('day', TIMESTAMP '1996-07-31', o_orderdate) AS INTEGER) AS days,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 6 MONTH AS month_back,
  o_orderdate + INTERVAL 14 DAY AS day_on, o_orderdate AS parsed FROM orders)""")
def scalar_dates(t: Tables) -> DataFrame:
    """Boundary differences, shifts and two text date formats."""
    base, when = F.lit("1996-07-31").cast("timestamp_ntz"), F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(when, "dd/MM/yyyy")).otherwise(
        F.date_format(when, "yyyy-MM-dd"))
    return t("orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"),
        d.years_between(base, when).alias("years"),
        d.months_between_calendar(base, when).alias("months"),
        d.days_between(base, when).alias("days"),
        d.shift_months(d.as_day(when), -6).alias("month_back"),
        d.shift_days(when, 14).alias("day_on"),
        d.as_datetime(d.parse_date(written, "dd/MM/yyyy", "yyyy-MM-dd")).alias("parsed"))


@query("""SELECT p_partkey, substring(p_brand, 1, instr(p_brand, '#')) AS kept,
       split_part(p_brand, '#', 1) AS cut, rtrim(p_type, 'Y') AS stripped,
       substring(p_type, 1, 3) AS prefix, replace(CAST(p_size AS VARCHAR) || '.' || p_type, '.', '') AS undotted
FROM part""")
def delimited_code(t: Tables) -> DataFrame:
    """Text before a delimiter, filler and dots removed, prefix."""
    kind, brand = F.col("p_type"), F.col("p_brand")
    return t("part").select(
        "p_partkey", x.up_to_delimiter(brand, "#").alias("kept"),
        x.up_to_delimiter(brand, "#", keep=False).alias("cut"),
        x.strip_filler(kind, "Y").alias("stripped"), x.code_prefix(kind, 3).alias("prefix"),
        x.remove_dots(F.concat_ws(".", F.col("p_size").cast("string"), kind)).alias("undotted"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 920 AND 960 THEN round(p_retailprice, 6) END AS cleaned,
       p_retailprice > 920 AND p_retailprice < 960 AS plausible,
       CASE p_type WHEN 'SMALL' THEN 'little' WHEN 'MEDIUM' THEN 'little' ELSE p_type END AS size_class,
       coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'missing') AS brand,
       CASE WHEN p_size >= 4 THEN '4+' ELSE CAST(p_size AS VARCHAR) END AS capped,
       CAST(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END AS INTEGER) AS position,
       coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER), -1) AS brand_no,
       coalesce(TRY_CAST(p_type AS INTEGER), -1) AS not_a_number,
       CASE WHEN p_size % 3 = 0 THEN TRUE WHEN p_size % 3 = 1 THEN FALSE END AS flag
FROM part""")
def value_expressions(t: Tables) -> DataFrame:
    """Range to NULL, recoding, explicit missing level, safe casts."""
    word = F.element_at(F.array(F.lit("yes"), F.lit("False"), F.lit("n/a")),
                        (F.col("p_size") % 3 + 1).cast("int"))
    price = F.col("p_retailprice")
    return t("part").select(
        "p_partkey", val.null_outside(price, 920, 960).alias("cleaned"),
        val.in_open_range(price, 920, 960).alias("plausible"),
        val.recode(F.col("p_type"), {"SMALL": "little", "MEDIUM": "little"}).alias("size_class"),
        val.level_or(F.when(F.col("p_size") > 5, F.col("p_brand")), "missing").alias("brand"),
        val.cap_level(F.col("p_size"), 4).alias("capped"),
        val.level_order(F.col("p_type"), ["SMALL", "MEDIUM", "LARGE"]).alias("position"),
        F.coalesce(val.safe_cast(F.substring_index("p_brand", "#", -1), "int"),
                   F.lit(-1)).alias("brand_no"),
        F.coalesce(val.safe_cast(F.col("p_type"), "int"), F.lit(-1)).alias("not_a_number"),
        val.truthy(word).alias("flag"))


@query("""SELECT DISTINCT replace(p_brand || '.' || p_type, '.', '') AS code, p_type AS coding_system
FROM part WHERE p_type = 'PROMO' AND p_brand || '.' || p_type <> 'Brand#3.PROMO'""")
def clean_codelist_rows(t: Tables) -> DataFrame:
    """One coding system, a dropped code, dots removed, distinct."""
    raw = t("part").select(F.concat_ws(".", "p_brand", "p_type").alias("code"),
                           F.col("p_type").alias("coding_system"))
    return clean_codelist(raw, "PROMO", exclude={"Brand#3.PROMO"})
