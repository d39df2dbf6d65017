import pytest
from pyspark.sql import functions as F

from anchorline.functions.dates import after, around, before, month_range
from anchorline.plans import exposure as x, measure as m, outcome as o, phenotype as p, rates as r
from tests.support import rows

COHORT = "person_id long, index_date date, dod date"


@pytest.fixture(scope="module")
def cohort(frame):
    return frame(COHORT, (1, "2018-06-01", None), (2, "2018-06-01", "2018-09-09"),
                 (3, "2018-08-31", "2020-01-01"))


def test_diagnosis_before(frame, cohort):
    events = frame("person_id long, event_time timestamp_ntz, code string",
                   (1, "2018-06-01 00:00:00", "X"), (2, "2018-05-31 23:59:00", "X"), (2, "2018-07-01", "X"),
                   (3, "2017-01-01", "Y"), (9, "2017-01-01", "X"))
    got = p.diagnosis_before(cohort, events, frame("code string", ("X",), ("X",)))
    assert rows(got.select("person_id", "first_date", "diagnosed")) == [
        (1, None, False), (2, "2018-05-31 23:59:00", True), (3, None, False)]


def test_two_reading_rule(frame, cohort):
    def reading(person, day, kind, value):
        return (person, day, kind, value)
    events = frame("person_id long, event_time timestamp_ntz, kind string, value double",
                   reading(1, "2018-01-01 09:00:00", "systolic", 190.0), reading(1, "2018-01-01 10:00:00", "systolic", 150.0),
                   reading(1, "2018-02-01", "systolic", 141.0), reading(1, "2018-03-01", "systolic", 120.0),
                   reading(2, "2018-01-01", "systolic", 150.0), reading(2, "2018-02-01", "systolic", 140.0),
                   reading(2, "2015-12-31", "systolic", 200.0), reading(2, "2018-02-02", "other", 999.0),
                   reading(3, "2018-01-01", "diastolic", 99.0), reading(3, "2018-01-02", "diastolic", 9.0),
                   reading(3, "2018-09-01", "diastolic", 99.0))
    got = p.two_reading_rule(events, cohort, {"systolic": 140, "diastolic": 90}, floor=10)
    assert rows(got) == [(1, "systolic", 150.0, 141.0, True), (2, "systolic", 150.0, 140.0, False)]
    flags = p.combine_flags(cohort.select("person_id"), got.where("meets_rule"), got.where("meets_rule"))
    coded = events.unionByName(frame("person_id long, event_time timestamp_ntz, kind string, value double",
                                     (3, "2017-01-01", "C1", None), (2, "2030-01-01", "C1", None)))
    limits = {"systolic": 140, "diastolic": 90}
    one = p.flag_by_code_or_value(cohort.select("person_id", "index_date"), coded, {"C1"}, limits, floor=10)
    two = p.combine_flags(cohort.select("person_id", "index_date"), got.where("meets_rule"), p.diagnosis_before(
        cohort, coded, {"C1"}, code="kind").where("diagnosed"))
    assert rows(one) == rows(two) and {r["flag"] for r in one.collect()} == {True, False}
    assert rows(flags) == [(1, True), (2, False), (3, False)]


def test_latest_category(frame, cohort):
    events = frame("person_id long, event_time timestamp_ntz, code string", (1, "2018-01-01", "a"),
                   (1, "2018-05-01", "b"), (1, "2018-07-01", "a"), (2, "2018-01-01", "a"), (2, "2018-01-01", "b"),
                   (2, "2018-03-03", "zz"))
    labels = frame("code string, label string", ("a", "ex"), ("b", "never"))
    got = p.latest_category(cohort, events, labels)
    assert rows(got.select("person_id", "code", "status")) == [
        (1, "b", "never"), (2, "b", "never"), (3, None, "missing")]


def test_event_within(frame, cohort):
    eps = frame("person_id long, event_time timestamp_ntz, end_time timestamp_ntz, d1 string, d2 string",
                (1, "2017-06-01", "2017-06-02", "I63X", None), (1, "2017-05-20", "2017-05-30", "I63", None),
                (2, "2018-05-30", "2018-06-03", None, "I63"))
    got = p.event_within(cohort, eps, ["d1", "d2"], before(365), codes=["I63"], time="end_time", report="event_time")
    assert rows(got.select("person_id", "first_event", "had_event")) == [
        (1, "2017-06-01 00:00:00", True), (2, None, False), (3, None, False)]


def test_labels_and_flags(frame):
    df = frame("f double, bmi double, sys double, age int", (0.05, 9.0, 150.0, 80), (0.5, 30.0, 149.0, 80),
               (None, 71.0, 140.0, 79), (0.1, 10.0, None, 70))
    got = p.derive_clinical_labels(df, "f", [0, 0.0857, 0.999], ["fit", "frail"], "bmi", (10, 70), "sys", "age",
                                   (80, 150, 140))
    assert [tuple(r) for r in got.select("frailty_band", "bmi", "reading_present", "control").collect()] == [
        ("fit", None, "yes", "above"), ("frail", 30.0, "yes", "below"), (None, None, "yes", "above"),
        ("frail", 10.0, "missing", None)]
    near = frame("a date, b date", ("2020-01-01", "2020-03-01"), ("2020-01-01", "2020-03-02"), ("2020-01-01", None))
    got = near.select(p.near_death_flag(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r[0] for r in got] == [True, False, None]


def test_drug_exposure(frame, cohort):
    meds = frame("person_id long, event_time timestamp_ntz, drug_id string, is_repeat boolean",
                 (1, "2018-06-15", "10", True), (1, "2018-06-16", "11", True), (1, "2018-05-18", "11", True),
                 (1, "2018-06-01", "12", True), (1, "2018-06-01", "13", False), (1, "2018-06-01", "99", True),
                 (1, "2018-06-01", "14", True), (3, "2018-02-28", "10", True), (3, "2018-03-31", "11", True),
                 (3, "2018-04-01", "12", True), (3, "2019-02-28", "10", True))
    lookup = frame("drug_code long, chapter_code string", (10, "0206020A0"), (11, "0204000B0"), (12, "0205059Z0"),
                   (13, "0205051A0"), (14, "0301000A0"))
    flags = {"ccb": "0206020", "bb": "0204000"}
    prefixes = ["0206020", "0204000", "020505"]
    windows = {"pre": month_range(-6, -5), "at": around(14), "post": month_range(5, 6)}
    got = x.drug_exposure(x.classify_drugs(meds, lookup, prefixes), cohort, windows, flags)
    assert rows(got) == [(1, "at", True, True, 2 + 1), (3, "post", True, False, 1), (3, "pre", True, True, 2)]
    limited = x.drug_exposure(x.classify_drugs(meds, lookup, prefixes), cohort, windows, flags,
                              admitted={"at": ["0206020"], "pre": prefixes})
    assert rows(limited)[0] == (1, "at", True, False, 1)
    long = x.exposure_long(cohort, got, ["pre", "at", "post"], list(flags))
    assert long.count() == 9
    assert rows(long.where("person_id = 2").select("time_status", "early_death", "ccb", "n_classes")) == [
        ("at", True, False, 0), ("post", True, False, 0), ("pre", True, False, 0)]
    counts = x.class_counts(long)
    dist = x.count_distribution(counts, 2)
    assert {(a["time_status"], a["n_label"]): a["n"] for a in dist.collect()}["at", "0"] == 2
    without = x.class_counts(long, excluding=["bb"], flags=list(flags))
    assert sum(a["n_classes"] for a in without.collect()) == 3
    control = frame("person_id long, control string", (1, "above"), (2, "below"))
    table = x.count_by_control(counts.where("time_status = 'at'"), control, 2)
    assert rows(table) == [("0", 0, 1), ("2+", 1, 0)]


def test_paired_reading(frame, cohort):
    def pair(person, at, s, d):
        return [(person, at, "systolic", s), (person, at, "diastolic", d)]
    data = (pair(1, "2018-01-01 09:00:00", 150.0, 80.0) + pair(1, "2018-01-01 10:00:00", 140.0, 85.0)
            + pair(1, "2018-02-02", 120.0, 70.0) + pair(2, "2018-01-05", 130.0, 70.0)
            + pair(2, "2018-01-04", 70.0, 60.0) + pair(2, "2017-05-31", 130.0, 70.0)
            + pair(3, "2018-01-01", 90.0, 90.0) + [(3, "2018-03-01", "systolic", 120.0), (3, "2018-03-01", "systolic", 5.0)]
            + pair(3, "2018-09-01", 135.0, 75.0) + pair(3, "2018-09-02", 139.0, 79.0))
    events = frame("person_id long, event_time timestamp_ntz, kind string, value double", *data)
    ranges = {"systolic": (79, 230), "diastolic": (49, None)}
    shown = ["person_id", "reading_time", "systolic", "diastolic"]
    strict = m.paired_reading(events, cohort, before(365), ranges)
    assert rows(strict.select(shown)) == [(2, "2018-01-05 00:00:00", 130.0, 70.0)]
    loose = m.paired_reading(events, cohort, before(365), ranges, pick="earliest")
    assert rows(loose.select(shown)) == [(1, "2018-01-01 09:00:00", 150.0, 80.0), (2, "2018-01-05 00:00:00", 130.0, 70.0)]
    post = m.paired_reading(events, cohort, after(365), ranges)
    assert rows(post.select(shown)) == [(3, "2018-09-01 00:00:00", 135.0, 75.0)]
    both = m.before_after(loose, post.withColumn("person_id", F.lit(1).cast("long")))
    assert rows(both.select("systolic_difference", "diastolic_difference")) == [(-15.0, -5.0)]
    sides = {"pre": before(365), "post": after(365), "any": lambda t, i: t.isNotNull()}
    tagged = m.paired_sides(events, cohort, sides, ranges, pick="earliest")
    for tag, bounds in sides.items():
        own = m.paired_reading(events, cohort, bounds, ranges, pick="earliest")
        assert rows(tagged.where(F.col("side") == tag).drop("side")) == rows(own)
    more = events.unionByName(events.where("person_id = 2 AND event_time > '2018-01-01'").withColumn(
        "event_time", F.expr("make_timestamp_ntz(2018, 11, 5, 8, 0, 0)")).withColumn("value", F.col("value") - 4))
    change = m.paired_change(more, cohort, before(365), after(365), ranges, pick="earliest")
    old = m.before_after(m.paired_reading(more, cohort, before(365), ranges, pick="earliest"),
                         m.paired_reading(more, cohort, after(365), ranges, pick="earliest"))
    assert rows(change) == rows(old.select(change.columns)) and change.count()
    assert rows(m.plausible(events.where("person_id = 3"), "value", 10, 91).select("value"))[0] == (75.0,)


def test_outcomes(frame, cohort):
    eps = frame("person_id long, event_time timestamp_ntz, episode_sequence int, d1 string, d2 string, d3 string",
                (1, "2018-06-01 00:00:00", 1, "W01", None, None), (1, "2018-06-02", 2, "W01", None, None),
                (1, "2019-06-01", 1, "A", "B", "W0199"), (1, "2019-06-02", 1, "W01", None, None),
                (2, "2018-07-01", 1, "A", None, None), (3, "2018-09-01", 1, "S72X", None, None))
    cols = ["d1", "d2", "d3"]
    first = o.first_event_after(eps, cohort, cols, codes=["W01", "S72"], prefix_len=3)
    assert rows(first) == [(1, "2018-06-01", "2019-06-01 00:00:00"), (3, "2018-08-31", "2018-09-01 00:00:00")]
    spelled = o.first_event_after(eps, cohort, cols, prefixes=["W01"], first_in_spell=False)
    assert rows(spelled) == [(1, "2018-06-01", "2018-06-02 00:00:00")]
    assert rows(o.first_across_sources(first, spelled)) == [
        (1, "2018-06-01", "2018-06-02 00:00:00"), (3, "2018-08-31", "2018-09-01 00:00:00")]
    coded = frame("person_id long, event_time timestamp_ntz, code string", (1, "2018-07-01", "c"), (1, "2018-07-01", "c"),
                  (1, "2017-07-01", "c"))
    assert o.events_after(coded, cohort, ["c"]).count() == 2
    registry = frame("person_id long, dod date, reg_date date, end_date date, cause_code_1 string, cause_code_4 string",
                     (1, None, None, "2018-07-01", "J1", ""), (1, "2018-07-02", "2018-07-05", "2018-07-02", "I21", ""),
                     (1, "2018-07-02", "2018-07-04", "2018-07-02", "J1", ""),
                     (2, "2018-05-01", None, "2018-05-01", "I21", ""), (3, "2019-09-01", None, "2019-09-01", "I21", ""))
    died = o.cause_death(registry, cohort, F.col("cause_code_1").startswith("I"))
    assert rows(died) == [(1, "2018-06-01", "2018-07-02 00:00:00")]
    union = o.composite_outcome(o.typed(died, "cv death"), o.typed(coded, "mi"), o.typed(coded, "mi"))
    assert rows(union) == [(1, "2017-07-01 00:00:00", "mi"), (1, "2018-07-01 00:00:00", "mi"),
                           (1, "2018-07-02 00:00:00", "cv death")]


def test_drop_followed_events(frame):
    events = frame("person_id long, event_time timestamp_ntz, event_type string",
                   (1, "2020-01-01", "mi"), (1, "2020-01-30", "death"), (2, "2020-01-01", "mi"), (2, "2020-01-31", "death"),
                   (3, "2020-01-01 08:00:00", "stroke"), (3, "2020-01-01 09:00:00", "death"), (4, "2020-01-01", "mi"),
                   (4, "2020-01-20", "mi"), (4, "2020-03-01", "stroke"), (5, "2020-01-01", "mi"), (6, "2020-01-02", "stroke"),
                   (6, "2020-01-01", "death"))
    kept = o.drop_followed_events(events, {"mi", "stroke"})
    want = [(1, "2020-01-30", "death"), (2, "2020-01-01", "mi"), (2, "2020-01-31", "death"), (3, "2020-01-01", "death"),
            (4, "2020-01-20", "mi"), (4, "2020-03-01", "stroke"), (5, "2020-01-01", "mi"), (6, "2020-01-01", "death"),
            (6, "2020-01-02", "stroke")]
    assert rows(kept) == want
    again = o.drop_followed_events(kept.withColumnRenamed("event_date", "event_time"), {"mi", "stroke"})
    assert rows(again) == want


def test_first_of_and_exposure(frame, cohort):
    events = frame("person_id long, event_time timestamp_ntz, event_type string", (1, "2018-06-01 20:00:00", "fall"),
                   (1, "2018-06-11", "syncope"), (1, "2018-06-11", "fall"), (1, "2018-08-01", "fall"))
    first = o.first_of(events, cohort, {"fall", "syncope"})
    assert rows(first) == [(1, "2018-06-01", "2018-06-11 00:00:00", "fall")]
    people = frame(COHORT, (1, "2018-06-01", None), (2, "2018-06-01", "2019-05-31"), (3, "2018-06-01", "2019-06-01"),
                   (4, "2018-06-01", None))
    exposed = r.exposure_days(people, first)
    assert rows(exposed.select("person_id", "exposure_days", "had_event")) == [
        (1, 10, True), (2, 364, False), (3, 365, False), (4, 365, False)]
    each = r.exposure_days(people, events.where("event_time > '2018-06-02'"), first_only=False)
    assert rows(each.select("person_id", "exposure_days")) == [
        (1, 10), (1, 10), (1, 61), (2, 364), (3, 365), (4, 365)]
    rate = r.incidence_rate(exposed)
    assert rows(rate)[0][:2] == (4, 1) and rows(rate)[0][3] == pytest.approx(100 / (1104 / 365))


def test_censoring(frame):
    df = frame("t int, e boolean", (730, True), (731, True), (100, False), (None, True), (5, None))
    time, event = r.censor_at(F.col("t"), F.col("e"), 730)
    assert [tuple(a) for a in df.select(time.alias("t"), event.alias("e")).collect()] == [
        (730, True), (730, False), (100, False), (730, None), (5, False)]
