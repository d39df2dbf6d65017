import pytest
from pyspark.sql import functions as F

from anchorline.plans import cohort as c
from tests.support import rows

SPELL = "person_id long, start_date date, end_date date, service_type string, postcode string"
PERSON = "person_id long, birth_date date, death_date date, gender string"
REG = ("person_id long, dod date, reg_date date, end_date date, cause_code_1 string, "
       "cause_code_4 string")


@pytest.fixture(scope="module")
def spells(frame):
    return frame(
        SPELL,
        (1, "2018-01-10", "2018-03-01", "Nursing", "B"), (1, "2018-01-10", None, "Nursing", "A"),
        (1, "2017-01-01", "2017-02-01", "Home care", "C"), (1, "2018-06-01", "2019-06-01", "Residential", "D"),
        (2, "2018-05-01", None, "Residential", "E"), (3, "2019-12-31", "2020-12-31", "Nursing", "F"),
        (4, None, "2018-01-01", "Nursing", "G"), (4, "2018-02-01", "2018-08-01", "Nursing", "G"))


def test_build_cohort_edges(frame, spells):
    person = frame(PERSON, (1, "1950-12-31", None, "F"), (2, "1960-01-01", "2019-01-01", None))
    obs = frame("person_id long, ob_end date", (1, "2020-01-01"), (1, "2020-05-01"))
    got = c.build_cohort(spells, person, obs, ["Nursing", "Residential"], "2019-12-31")
    assert rows(got.select("person_id", "index_date", "last_stop", "postcode", "ob_end",
                           "stay_days", "age_at_index")) == [
        (1, "2018-01-10", "2019-06-01", "A", "2020-05-01", 507, 68),
        (2, "2018-05-01", None, "E", None, None, 58)]
    ignoring = c.build_cohort(spells, person, obs, ["Nursing"], "2019-12-31", null_start="ignore")
    assert [r[0] for r in rows(ignoring.select("person_id"))] == [1, 4]


def test_death_reconciliation(frame):
    cohort = frame("person_id long, death_date date", (1, "2019-01-01"), (2, None), (3, None), (4, None), (5, None))
    registry = frame(REG, (1, "2019-02-02", None, None, "", ""), (2, "2019-03-01", "2019-03-05", None, "", ""),
                     (2, None, "2021-01-01", None, "", ""), (2, "2019-02-01", "2019-09-09", None, "", ""),
                     (3, None, "2019-04-04", None, "", ""), (3, None, "2019-04-09", None, "", ""),
                     (4, None, None, None, "", ""), (9, "2019-01-01", None, None, "", ""))
    assert rows(c.reconcile_death(cohort, registry).select("person_id", "dod")) == [
        (1, "2019-01-01"), (2, "2019-03-01"), (3, "2019-04-09"), (4, None), (5, None)]


def test_exclusions_and_attrition(frame):
    df = frame("person_id long, index_date date, last_stop date, dod date, age_at_index int",
               (1, "2016-04-04", "2018-01-01", None, 80), (2, "2016-04-05", "2018-01-01", None, 64),
               (3, "2016-04-05", "2016-05-17", None, 65), (4, "2016-04-05", "2016-05-18", "2016-05-18", 65),
               (5, "2016-04-05", None, None, 90), (6, "2016-04-05", "2018-01-01", "2016-05-17", 90),
               (7, "2016-04-05", "2018-01-01", None, None))
    rules = c.entry_rules(["2016-04-04"], 65, 42)
    kept, lost = c.apply_exclusions(df, rules)
    assert rows(kept.select("person_id")) == [(4,)]
    assert [r[2] for r in rows(lost)] == [7, 6, 4, 3, 1]
    open_kept, _ = c.apply_exclusions(df, c.entry_rules(["2016-04-04"], 65, 42, open_stay="keep"))
    assert rows(open_kept.select("person_id")) == [(4,), (5,)]


def test_follow_up(frame):
    df = frame("person_id long, index_date date, dod date, ob_end date",
               (1, "2018-01-01", "2018-02-01", None), (2, "2018-01-01", None, "2019-01-01"),
               (3, "2018-01-01", None, None), (4, "2018-01-01", None, "2017-12-31"))
    got = c.follow_up(df)
    assert rows(got.select("person_id", "end_of_fu_status", "mortality_days", "fu_days")) == [
        (1, "died", 31, 31), (2, "survived", None, 365), (3, "lost to follow up", None, None),
        (4, "survived", None, -1)]
    assert rows(c.drop_ended_before_index(got).select("person_id")) == [(1,), (2,), (3,)]


def test_presumed_exit_counts_month_boundaries(frame):
    df = frame("person_id long, index_date date, last_stop date, dod date, ob_end date",
               (1, "2018-01-01", "2018-03-31", None, None), (2, "2018-01-01", "2018-03-31", None, None),
               (3, "2018-01-01", "2018-03-31", "2018-04-01", None), (4, "2018-01-01", None, None, None))
    obs = frame("person_id long, ob_end date", (1, "2018-05-31"), (2, "2018-06-01"), (3, "2018-04-01"),
                (4, "2018-04-01"))
    assert rows(c.presumed_exit(df, obs).select("person_id", "months_apart")) == [(1, 2)]


def test_area_and_category(frame):
    cohort = frame("person_id long", (1,), (2,), (3,), (4,))
    areas = frame("person_id long, area string", (1, "A"), (1, "B"), (2, "A"), (3, "Z"))
    index = frame("area string, decile int", ("A", 3), ("B", 4))
    got = c.attach_area_index(cohort, areas, index)
    assert rows(got.select("person_id", "decile")) == [(2, "3"), (3, "missing"), (4, "missing")]
    group = frame("person_id long, group string", (1, "Asian"), (2, "Missing"), (3, "Missing"))
    text = frame("person_id long, text string", (1, "White British"), (2, "White British"), (3, "Indian"))
    got = c.resolve_category(cohort, group, text, {"White British": "White"})
    assert rows(got) == [(1, "Asian"), (2, "White"), (3, "Missing"), (4, "Missing")]


def test_cut_day(frame):
    df = frame("d date", ("2019-03-19",), ("2019-03-20",), ("2019-03-21",))
    both = df.select("d", c.stratify_by_date(F.col("d"), "2019-03-20").alias("a"),
                     c.stratify_by_date(F.col("d"), "2019-03-20", "drop").alias("b"))
    assert [r[1:] for r in rows(both)] == [("before", "before"), ("after", None), ("after", "after")]
