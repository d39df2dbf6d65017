"""Recognising conditions from codes and from repeated measurements."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import Bounds, as_datetime, days_between, ever_before, years_before
from anchorline.functions.values import bin_right_closed, null_outside
from anchorline.operators.codes import CodeList, any_code_in, any_code_prefix, code_in
from anchorline.operators.joins import anchored_window, attach, spread_join
from anchorline.operators.select import top_n_per
from anchorline.schema import INDEX, PERSON, TIME


def diagnosis_before(cohort: DataFrame, events: DataFrame, codes: CodeList,
                     code: str = "code", flag_as: str = "diagnosed",
                     date_as: str = "first_date") -> DataFrame:
    """Ever coded before the index date: first code date and flag, whole cohort kept.

    The first code anywhere must itself precede the index, which a minimum per
    person decides before any join with the cohort.
    """
    first = (code_in(events, code, codes).groupBy(PERSON)
             .agg(F.min(TIME).alias(date_as)))
    prior = F.when(F.col(date_as) < as_datetime(F.col(INDEX)), F.col(date_as))
    return (cohort.select(PERSON, INDEX).join(first, PERSON, "left")
            .withColumn(date_as, prior)
            .withColumn(flag_as, F.col(date_as).isNotNull()))


def daily_min(events: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """Lowest value per person, day and kind."""
    return (events.groupBy(PERSON, F.to_date(TIME).alias("day"), kind)
            .agg(F.min(value).alias("low")))


def two_reading_rule(events: DataFrame, cohort: DataFrame, thresholds: Mapping[str, float],
                     bounds: Bounds | None = None, floor: float | None = None) -> DataFrame:
    """The two highest daily minima per person and kind, and whether both exceed
    the kind's threshold.

    ``events`` has ``kind`` and ``value``; rows with another kind are ignored.
    Only persons with two reading days of a kind have a row.
    """
    usable = F.col("kind").isin(sorted(thresholds))
    if floor is not None:
        usable = usable & (F.col("value") > floor)
    recent = anchored_window(events.where(usable), cohort, bounds or years_before(2))
    ranked = top_n_per(daily_min(recent), [PERSON, "kind"],
                       [F.col("low").desc(), F.col("day")], 2, rank_as="nth")
    pairs = ranked.groupBy(PERSON, "kind").agg(
        F.max(F.when(F.col("nth") == 1, F.col("low"))).alias("first_reading"),
        F.max(F.when(F.col("nth") == 2, F.col("low"))).alias("second_reading"))
    limit = None
    for kind, at in thresholds.items():
        test = F.col("kind") == kind
        limit = F.when(test, F.lit(at)) if limit is None else limit.when(test, F.lit(at))
    both = (F.col("first_reading") > limit) & (F.col("second_reading") > limit)
    return pairs.where(F.col("second_reading").isNotNull()).withColumn("meets_rule", both)


def flag_by_code_or_value(cohort: DataFrame, events: DataFrame, codes: Collection[str], thresholds: Mapping[str, float],
                          bounds: Bounds | None = None, floor: float | None = None, flag_as: str = "flag") -> DataFrame:
    """Cohort with one boolean: first coded before the index date, or the two-reading rule holds.

    ``events`` has ``kind`` (a code or a measurement's name) and ``value``.  Codes and readings come from one scan and
    meet the cohort once.  An event is laid out as a code, a reading or both; per person, day and kind a code keeps
    its first time and a reading its lowest value, and of these the first code and the two highest readings
    settle the rules.  A code anywhere must itself precede the index, as in ``diagnosis_before``.
    """
    is_code = F.col("kind").isin(sorted(codes))
    usable = F.col("kind").isin(sorted(thresholds))
    if floor is not None:
        usable = usable & (F.col("value") > floor)
    window = (bounds or years_before(2))(F.col(TIME), F.col(INDEX))
    met = spread_join(events.where(is_code | usable), cohort.select(PERSON, INDEX), [PERSON])
    code = F.when(is_code, F.struct(F.lit(True).alias("code"), F.col(TIME).alias("at"), F.lit(None).cast("double").alias("value")))
    reading = F.when(usable & window, F.struct(F.lit(False).alias("code"), F.lit(None).cast("timestamp_ntz").alias("at"),
                                               F.col("value").cast("double").alias("value")))
    roles = met.select(PERSON, INDEX, "kind", F.to_date(TIME).alias("day"), F.inline(F.array_compact(F.array(code, reading))))
    # all codes are one kind: only the first of any counts
    daily = (roles.groupBy(PERSON, INDEX, "code", F.when(~F.col("code"), F.col("kind")).alias("kind"),
                           F.when(~F.col("code"), F.col("day")).alias("day"))
             .agg(F.min("at").alias("at"), F.min("value").alias("low")))
    ranked = top_n_per(daily, [PERSON, "code", "kind"], [F.col("low").desc(), F.col("day")], 2, rank_as="nth")
    limit = F.lit(None).cast("double")
    for kind, at in thresholds.items():
        limit = F.when(F.col("kind") == kind, F.lit(float(at))).otherwise(limit)
    # both of a kind's two highest over its limit: the lower of two is
    by_kind = ranked.groupBy(PERSON, "kind").agg(
        F.count("low").alias("n"), F.min("low").alias("least"),
        F.max(F.col("at") < as_datetime(F.col(INDEX))).alias("coded"))
    found = by_kind.where(F.col("coded") | ((F.col("n") == 2) & (F.col("least") > limit)))
    return combine_flags(cohort, found, flag_as=flag_as)


def combine_flags(cohort: DataFrame, *flagged: DataFrame, flag_as: str = "flag") -> DataFrame:
    """Cohort with one boolean: the person occurs in any of the ``flagged`` frames."""
    found = flagged[0].select(PERSON)
    for frame in flagged[1:]:
        found = found.unionByName(frame.select(PERSON))
    found = found.distinct().withColumn(flag_as, F.lit(True))
    return attach(cohort, found, **{flag_as: False})


def latest_category(cohort: DataFrame, events: DataFrame, labels: DataFrame,
                    missing: str = "missing", status_as: str = "status",
                    ties: Sequence[str] = ("code",)) -> DataFrame:
    """Last labelled code before the index date, one pass over the events.

    ``labels`` is (code, label) with one row per code.  Same-moment codes are
    settled by the greatest of ``ties``; persons without a code get ``missing``.
    """
    coded = spread_join(events, labels.select("code", "label"), ["code"])
    prior = anchored_window(coded, cohort, ever_before())
    latest = prior.groupBy(PERSON).agg(F.max(F.struct(TIME, *ties, "label")).alias("last"))
    facts = latest.select(PERSON, F.col("last.code").alias("code"),
                          F.col(f"last.{TIME}").alias("coded_at"),
                          F.col("last.label").alias(status_as))
    return attach(cohort.select(PERSON, INDEX), facts, **{status_as: missing})


def event_within(cohort: DataFrame, episodes: DataFrame, diagnosis_cols: Sequence[str],
                 bounds: Bounds, codes: CodeList | None = None,
                 prefixes: Sequence[str] = (), prefix_len: int | None = None,
                 filler: str | None = "X", flag_as: str = "had_event",
                 time: str = TIME, report: str | None = None) -> DataFrame:
    """Cohort with the earliest coded episode in a window, and a flag.

    ``time`` decides the window (say, the discharge); ``report`` names another
    column whose minimum is returned as ``first_event``.
    """
    coded = episodes
    if codes is not None:
        coded = any_code_in(coded, diagnosis_cols, codes, prefix_len, filler)
    if prefixes:
        coded = any_code_prefix(coded, diagnosis_cols, prefixes, filler)
    first = (anchored_window(coded, cohort, bounds, time=time).groupBy(PERSON)
             .agg(F.min(report or time).alias("first_event")))
    return (cohort.select(PERSON, INDEX).join(first, PERSON, "left")
            .withColumn(flag_as, F.col("first_event").isNotNull()))


def control_target(value: Column, age: Column, cut_age: int, old: float, young: float) -> Column:
    """'above'/'below' an age-dependent threshold; NULL without a value."""
    above = ((value >= old) & (age >= cut_age)) | ((value >= young) & (age < cut_age))
    return F.when(above, "above").when(~above, "below")


def presence(value: Column) -> Column:
    """'yes' for a positive value, 'missing' for none."""
    return F.when(value.isNull(), "missing").when(value > 0, "yes")


def derive_clinical_labels(df: DataFrame, frailty: str, breaks: Sequence[float],
                           labels: Sequence[str], bmi: str, bmi_range: tuple[float, float],
                           reading: str, age: str, target: tuple[int, float, float]) -> DataFrame:
    """Frailty band, cleaned body mass index, reading present/missing, control target."""
    return df.withColumns({
        "frailty_band": bin_right_closed(F.col(frailty), breaks, labels),
        bmi: null_outside(F.col(bmi), *bmi_range),
        "reading_present": presence(F.col(reading)),
        "control": control_target(F.col(reading), F.col(age), *target),
    })


def near_death_flag(reading_day: Column, death_day: Column, days: int = 60) -> Column:
    """Reading taken at most ``days`` before death; NULL for the living."""
    gap = days_between(reading_day, death_day)
    return F.when(gap <= days, True).when(gap > days, False)
