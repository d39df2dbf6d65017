import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline import schema as sc
from anchorline.functions.dates import after
from anchorline.operators import scan
from anchorline.operators import codes as cd, joins as j, reshape as rs, select as s, tabulate as t
from tests.support import rows


def test_conform_casts_and_checks(frame):
    raw = frame("pid string, at string, item string, rep string",
                ("7", "2020-01-02 03:04:05", "123", "true"), ("x", "never", None, "no"))
    got = sc.conform(raw, sc.MEDICATION, person_id="pid", event_time="at", drug_id="item",
                     is_repeat="rep")
    assert got.dtypes == [("person_id", "bigint"), ("event_time", "timestamp_ntz"),
                          ("drug_id", "string"), ("is_repeat", "boolean")]
    assert rows(got) == [(None, None, None, False), (7, "2020-01-02 03:04:05", "123", True)]
    with pytest.raises(ValueError):
        sc.conform(raw, sc.MEDICATION)
    with pytest.raises(ValueError):
        sc.require(raw, "person_id")


def test_selection(frame):
    df = frame("k long, d date, v long", (1, "2020-01-02", 5), (1, "2020-01-01", 7),
               (1, "2020-01-01", 6), (2, None, 9), (2, "2020-05-05", 1), (3, None, 4))
    assert rows(s.first_per(df, "k", [F.col("d").asc_nulls_last(), F.col("v")])) == [
        (1, "2020-01-01", 6), (2, "2020-05-05", 1), (3, None, 4)]
    assert rows(s.last_per(df, "k", ["d", "v"])) == [
        (1, "2020-01-02", 5), (2, "2020-05-05", 1), (3, None, 4)]
    assert rows(s.dedupe_latest(df, "k", ["d"], ["v"])) == rows(s.last_per(df, "k", ["d", "v"]))
    top = s.top_n_per(df, "k", [F.col("v").desc()], 2, rank_as="nth")
    assert rows(top.select("k", "v", "nth")) == [(1, 6, 2), (1, 7, 1), (2, 1, 2), (2, 9, 1), (3, 4, 1)]
    tied = s.rank_per(df, "k", "d", "r", descending=False)
    assert tied.columns == [*df.columns, "r"]
    assert rows(tied.select("k", "v", "r")) == [(1, 6, 1), (1, 7, 1), (2, 1, 1), (3, 4, 1)]
    second = s.rank_per(df, "k", "d", "r", 2, descending=False)
    assert rows(second.select("k", "v", "r")) == [(1, 6, 1), (1, 7, 1), (2, 1, 1), (2, 9, 2), (3, 4, 1)]
    assert rows(s.keep_unique(df, "k")) == [(3, None, 4)]
    assert rows(s.keep_unique(df.select("k"), "k")) == [(3,)]
    assert rows(s.drop_exact_duplicates(df, ["k"], keep=["v"])) == [
        (1, "2020-01-02", 5), (2, "2020-05-05", 1), (3, None, 4)]
    assert rows(s.drop_exact_duplicates(df.select("k"), ["k"])) == [(1,), (2,), (3,)]


def test_sampling_is_repeatable_and_uniform(spark):
    df = spark.range(4000).select(F.floor(F.col("id") / 4).alias("k"),
                                  (F.col("id") % 4).cast("string").alias("v"))
    pick = s.sample_one_per(df, "k", "v", seed=3)
    assert pick.count() == 1000
    assert rows(pick) == rows(s.sample_one_per(df.repartition(9), "k", "v", seed=3))
    assert rows(pick) != rows(s.sample_one_per(df, "k", "v", seed=4))
    counts = [r["n"] for r in t.group_count(pick, ["v"]).collect()]
    assert len(counts) == 4 and min(counts) > 180


def test_several_per_key(spark):
    rows_ = [(k, f"v{i % 40}") for k in range(5) for i in range(100)] + [(9, "only"), (9, None), (None, "x")]
    df = spark.createDataFrame(rows_, "k long, v string")
    got = rows(s.sample_per(df, "k", "v", seed=1, n=7))
    assert got == rows(s.sample_per(df.repartition(7), "k", "v", seed=1, n=7)) and len(set(got)) == len(got)
    assert {k: sum(r[0] == k for r in got) for k in {r[0] for r in got}} == {None: 1, 9: 1} | dict.fromkeys(range(5), 7)
    first = rows(s.sample_one_per(df, "k", "v", seed=1))
    assert set(first) <= set(got)


def test_gap_and_cumulative(frame):
    days = frame("k long, d date", (1, "2020-01-01"), (1, "2020-01-31"), (2, "2020-02-02"))
    assert rows(s.gap_to_previous(days, "k", "d")) == [
        (1, "2020-01-01", None), (1, "2020-01-31", 30), (2, "2020-02-02", None)]
    steps = frame("g string, x double", ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0))
    got = s.cumulative(steps, ["g"], [F.col("x")], total=("sum", F.col("x")), times=("product", F.col("x")))
    assert rows(got) == [("a", 1, 1, 1), ("a", 2, 3, 2), ("a", 3, 6, 6), ("b", 5, 5, 5)]


def test_joins(frame):
    events = frame("person_id long, event_time timestamp_ntz", (1, "2020-06-01"), (1, "2022-01-01"),
                   (2, "2020-06-01"), (None, "2020-06-01"))
    cohort = frame("person_id long, index_date date, arm string", (1, "2020-01-01", "x"), (3, "2020-01-01", "y"))
    got = j.anchored_window(events, cohort, after(365), carry=["arm"])
    assert rows(got) == [(1, "2020-06-01 00:00:00", "2020-01-01", "x")]
    assert rows(j.restrict_to(events, cohort).select("person_id")) == [(1,), (1,)]
    drop = frame("person_id long", (1,), (None,))
    assert rows(j.exclude(events, drop).select("person_id")) == [(None,), (2,)]
    facts = frame("person_id long, flag boolean, n long", (1, None, 4))
    assert rows(j.attach(cohort.select("person_id"), facts, flag=False, n=0)) == [(1, False, 4), (3, False, 0)]
    star = j.assemble_master(cohort, [facts, facts.select("person_id", F.col("n").alias("m"))])
    assert star.columns == ["person_id", "index_date", "arm", "flag", "n", "m"] and star.count() == 2
    with pytest.raises(ValueError, match="arm"):
        j.assemble_master(cohort, [facts, cohort.select("person_id", "arm")])
    with pytest.raises(Exception, match="more than one covariate row for person 1"):
        j.assemble_master(cohort, [facts.unionByName(facts)]).collect()
    assert rows(j.one_row_per(events)) == [(1, 2)]
    stacked = j.stack_sources(facts, cohort.select("person_id", "arm"))
    assert stacked.columns == ["person_id", "flag", "n", "arm"] and stacked.count() == 3
    with pytest.raises(ValueError):
        j.anchored_window(events.drop("event_time"), cohort, after(1))


def test_codes(frame):
    eps = frame("id long, d1 string, d2 string, d3 string", (1, "I21X", None, None), (2, "A00", "B", "W019"),
                (3, None, None, None), (4, "T14.2", "I2", None))
    listed = frame("code string", ("I21",), ("I21",), ("W01",), (None,))
    cols = ["d1", "d2", "d3"]
    for codes in (["I21", "W01"], listed):
        assert rows(cd.any_code_in(eps, cols, codes, filler="X").select("id")) == [(1,)]
        hits = cd.any_code_in(eps, cols, codes, prefix_len=3, filler="X")
        assert rows(hits.select("id")) == [(1,), (2,)] and hits.columns == eps.columns
    assert rows(cd.any_code_in(eps, cols, ["T14.2"], prefix_len=3).select("id")) == []
    assert rows(cd.any_code_prefix(eps, cols, ["I2", "B"]).select("id")) == [(1,), (2,), (4,)]
    assert rows(cd.code_in(eps, "d1", listed.union(frame("code string", ("A00",)))).select("id")) == [(2,)]
    lookup = frame("c long, chapter string", (5, "0206020A"), (5, "0206020B"), (6, "0204000"))
    meds = frame("drug string, q long", ("5", 1), ("9", 2))
    assert rows(cd.map_codes(meds, lookup, "drug", "c", "chapter")) == [
        ("5", 1, "0206020A"), ("5", 1, "0206020B"), ("9", 2, None)]
    labels = cd.label_codes({"ex": listed, "now": frame("code string", ("I21",), ("Z",))})
    assert rows(labels) == [("I21", "ex"), ("W01", "ex"), ("Z", "now")]


def test_reshape(frame):
    df = frame("p long, c string", (1, "A"), (1, "A"), (1, "B"), (2, None), (3, "Z"))
    assert rows(rs.collect_classes(df, ["p"], "c")) == [(1, ["A", "B"], 2), (3, ["Z"], 1)]
    flags = rs.classes_to_flags(df, ["p"], "c", {"a": "A", "b": "B"})
    assert rows(flags) == [(1, True, True, 2), (3, False, False, 1)]
    long = rs.to_long(flags, ["p"], ["a", "b"], "cls", "yes")
    assert rows(long)[:2] == [(1, "a", True), (1, "b", True)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("a", float(v)) for v in rng.exponential(size=700)]
    data += [("b", float(v)) for v in rng.integers(0, 9, size=333)]
    data += [(None, 4.0), (None, 8.0), ("c", None), ("d", 3.0)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in t.quantiles(df, "x", probs, ["g"], accuracy=20).collect()}
    assert set(got) == {"a", "b", "d", None}
    for g, r in got.items():
        values = [v for k, v in data if k == g and v is not None]
        want = np.quantile(values, probs)
        assert [r[t.quantile_name(p)] for p in probs] == pytest.approx(list(want))
        assert r["n"] == len(values)
    whole = t.quantiles(df, "x", [0.5], accuracy=50).first()
    assert whole["q50"] == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_quantiles_of_a_large_group_order_only_what_is_wanted(spark, monkeypatch):
    values = [(i * 7919 % 20_011) / 7 for i in range(20_011)] * 2 + [5.0] * 9_000
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    kept = []
    whole = scan.ranges
    monkeypatch.setattr(scan, "ranges", lambda *a, **k: kept.append(whole(*a, **k)) or kept[-1])
    probs = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = t.quantiles(df, "x", probs, accuracy=1000).first()
    assert [got[t.quantile_name(p)] for p in probs] == pytest.approx(list(np.quantile(values, probs)))
    assert kept[0].rows.count() < 1500
    plan = t.quantiles(df, "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_tables(frame):
    df = frame("arm string, sex string, x double", ("a", "F", 1.0), ("a", "F", 3.0), ("a", None, None),
               ("b", "M", 5.0))
    ct = t.crosstab(df, "arm", "sex", ["F", "M"])
    assert rows(ct) == [("a", 2, 0), ("b", 0, 1)]
    assert rows(t.pct_within(df, ["sex"], ["arm"])) == [
        ("a", None, 1, 3, pytest.approx(100 / 3)), ("a", "F", 2, 3, pytest.approx(200 / 3)), ("b", "M", 1, 1, 100.0)]
    prev = t.prevalence(df, F.col("x") > 2)
    assert rows(prev) == [(4, 2, 50.0)]
    steps = t.attrition(df, [("all", F.lit(True)), ("x>1", F.col("x") > 1), ("F", F.col("sex") == "F")])
    assert rows(steps) == [(0, "all", 4), (1, "x>1", 2), (2, "F", 1)]
    summary = t.summary_table(df, ["x"], ["sex"], "arm", na_include=True, totals=True)
    got = {(r["variable"], r["dependent"], r["level"]): r for r in summary.collect()}
    assert got["x", "a", "mean"]["mean"] == 2 and got["x", "a", "mean"]["n"] == 2
    assert got["x", "b", "mean"]["sd"] is None
    assert got["sex", "a", "missing"]["percent"] == pytest.approx(100 / 3)
    assert got["total", "a", "n"]["n"] == 3
    assert not t.summary_table(df, ["x"], ["sex"]).where("level = 'missing'").count()
    levels = frame("g string, x double", ("a", 1.0), ("missing", 1.0), (None, 1.0))
    shares = t.summary_table(levels, [], ["g"], na_include=True, na_to_p=False)
    assert sorted((r["level"], r["n"], r["percent"] or 0) for r in shares.collect()) == [
        ("a", 1, 50.0), ("missing", 1, 0), ("missing", 1, 50.0)]
    shares = t.summary_table(levels, [], ["g"], na_include=True)
    assert sorted((r["level"], r["n"], r["percent"]) for r in shares.collect()) == [
        (g, 1, pytest.approx(100 / 3)) for g in ("a", "missing", "missing")]
    hist = t.histogram(df, "x", 0, 4, 2)
    assert rows(hist) == [(1, 1), (2, 1), (3, 1)]
    assert rows(t.describe_by(df, "x")) == [(3, 3.0, 2.0, 1.0, 5.0)]
    assert t.n_persons(df, "arm").first()[0] == 2
