"""Outcome events after the index date."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.functions.dates import Bounds, after, days_between
from anchorline.operators.codes import CodeList, any_code_in, any_code_prefix, code_in
from anchorline.operators.joins import anchored_window, restrict_to, stack_sources
from anchorline.operators.select import first_per
from anchorline.schema import INDEX, OUTCOME_EVENT, PERSON, TIME, require

YEAR = after(365)


def episodes_after(episodes: DataFrame, cohort: DataFrame, diagnosis_cols: Sequence[str],
                   codes: CodeList | None = None, prefixes: Sequence[str] = (),
                   prefix_len: int | None = None, filler: str | None = "X",
                   first_in_spell: bool = True, bounds: Bounds = YEAR) -> DataFrame:
    """Coded episodes in the window after the index date.

    Codes are tested first, so only coded episodes reach the join.
    ``first_in_spell`` keeps the opening episode of a stay (later ones may be
    events that happened in hospital).
    """
    rows = episodes
    if first_in_spell:
        rows = rows.where(F.col("episode_sequence") == 1)
    if codes is not None:
        rows = any_code_in(rows, diagnosis_cols, codes, prefix_len, filler)
    if prefixes:
        rows = any_code_prefix(rows, diagnosis_cols, prefixes, filler)
    return anchored_window(rows, cohort, bounds)


def first_event_after(episodes: DataFrame, cohort: DataFrame, diagnosis_cols: Sequence[str],
                      **options: object) -> DataFrame:
    """First coded episode per person after the index date.

    The date alone is the outcome, so a minimum replaces the ranking.
    """
    found = episodes_after(episodes, cohort, diagnosis_cols, **options)
    return _earliest(found)


def _earliest(rows: DataFrame) -> DataFrame:
    """First time per person; grouped by the person alone, so what follows on
    the same key needs no second shuffle (a person has one index date)."""
    return rows.groupBy(PERSON).agg(F.min(INDEX).alias(INDEX), F.min(TIME).alias(TIME))


def events_after(events: DataFrame, cohort: DataFrame, codes: CodeList | None = None,
                 code: str = "code", bounds: Bounds = YEAR) -> DataFrame:
    """All coded events in the window (primary care keeps every one)."""
    rows = code_in(events, code, codes) if codes is not None else events
    return anchored_window(rows, cohort, bounds)


def first_across_sources(*sources: DataFrame) -> DataFrame:
    """First event per person over several sources' first events."""
    stacked = sources[0].select(PERSON, INDEX, TIME)
    for source in sources[1:]:
        stacked = stacked.unionByName(source.select(PERSON, INDEX, TIME))
    return _earliest(stacked)


def cause_death(registry: DataFrame, cohort: DataFrame, is_cause: Column,
                bounds: Bounds = YEAR) -> DataFrame:
    """Deaths from a cause within the window, one registry record per person.

    Duplicate records: the earliest known date of death wins, undated records
    come last, then the latest registration.
    """
    record = death_record(restrict_to(registry, cohort), is_cause)
    return anchored_window(record, cohort, bounds, time="end_date").select(
        PERSON, INDEX, F.col("end_date").cast("timestamp_ntz").alias(TIME))


def death_record(registry: DataFrame, is_cause: Column) -> DataFrame:
    """A person's one registry record, if it names the cause."""
    require(registry, PERSON, "dod", "reg_date", "end_date", "cause_code_1", "cause_code_4")
    order = [F.col("dod").asc_nulls_last(), F.col("reg_date").desc_nulls_last(),
             F.col("end_date").asc_nulls_last(), F.col("cause_code_1").asc_nulls_last(),
             F.col("cause_code_4").asc_nulls_last()]
    return first_per(registry, PERSON, order).where(is_cause)


@dataclass(frozen=True)
class EventRule:
    """Which episodes are events of a type.

    ``codes`` and ``prefixes`` are tested on any of ``columns``; ``only`` is a further condition; with
    ``first_in_spell`` an episode must open its stay, with ``first_only`` a person's first event counts alone.
    """

    columns: Sequence[str]
    codes: Collection[str] = ()
    prefixes: Sequence[str] = ()
    only: Column | None = None
    first_in_spell: bool = False
    first_only: bool = False

    def holds(self) -> Column:
        tests = [F.col(c).isin(sorted(self.codes)) for c in self.columns if self.codes]
        tests += [F.col(c).startswith(p) for c in self.columns for p in self.prefixes]
        hit = reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
        if self.first_in_spell:
            hit = hit & (F.col("episode_sequence") == 1)
        return hit if self.only is None else hit & self.only


def tagged_events_after(episodes: DataFrame, cohort: DataFrame, rules: Mapping[str, EventRule],
                        *others: DataFrame, bounds: Bounds = YEAR) -> DataFrame:
    """Distinct typed events in the window, for any number of types from one pass over the episodes.

    An episode is laid out once per type whose rule it meets; all types meet the cohort in one join and one
    aggregate settles both distinct events and first events.  ``others`` are further (person, time, type)
    events, such as deaths, that join the same way.
    """
    names = list(rules)
    tags = F.array_compact(F.array(*[F.when(rule.holds(), F.lit(name)) for name, rule in rules.items()]))
    rows = (episodes.withColumn("event_types", tags).where(F.size("event_types") > 0)
            .select(PERSON, F.col(TIME).cast("timestamp_ntz").alias(TIME), F.explode("event_types").alias("event_type")))
    for other in others:
        rows = rows.unionByName(other.select(PERSON, F.col(TIME).cast("timestamp_ntz").alias(TIME), "event_type"))
    near = anchored_window(rows, cohort, bounds)
    firsts = [name for name in names if rules[name].first_only]
    own = F.when(~F.col("event_type").isin(firsts), F.col(TIME)) if firsts else F.col(TIME)
    return (near.groupBy(PERSON, "event_type", own.alias("__own")).agg(F.min(TIME).alias(TIME))
            .select(PERSON, TIME, "event_type"))


def typed(events: DataFrame, event_type: str) -> DataFrame:
    """An outcome source in the contract (person, time, type)."""
    return events.select(PERSON, F.col(TIME).cast("timestamp_ntz").alias(TIME),
                         F.lit(event_type).alias("event_type"))


def composite_outcome(*typed_events: DataFrame) -> DataFrame:
    """Distinct typed events of several sources."""
    names = OUTCOME_EVENT.fieldNames()
    return stack_sources(*[e.select(*names) for e in typed_events]).distinct()


def drop_followed_events(events: DataFrame, types: Collection[str], days: int = 30) -> DataFrame:
    """Drop events of ``types`` that a later event of any type follows within ``days``.

    One row per (person, day, type) is made first; an earlier day's event is
    compared with the person's next distinct day, and a same-day event of a type
    outside ``types`` (a death) counts as following.  So of a fatal episode only
    the death remains.  Strictly fewer than ``days`` apart is "within".
    """
    daily = events.select(PERSON, F.to_date(TIME).alias("event_date"), "event_type").distinct()
    listed = F.col("event_type").isin(sorted(types))
    per_day = daily.groupBy(PERSON, "event_date").agg(
        F.collect_set("event_type").alias("kinds"),
        F.max(~listed).alias("has_other"))
    by_day = Window.partitionBy(PERSON).orderBy("event_date")
    next_day = F.lead("event_date").over(by_day)
    soon = F.coalesce(days_between(F.col("event_date"), next_day) < days, F.lit(False))
    marked = per_day.withColumn("followed", soon | F.col("has_other"))
    return (marked.select(PERSON, "event_date", "followed", F.explode("kinds").alias("event_type"))
            .where(~(F.col("followed") & listed)).drop("followed"))


def first_of(events: DataFrame, cohort: DataFrame, types: Collection[str] | None = None,
             min_days: int = 1) -> DataFrame:
    """Person's first event of any type, the index day excluded.

    Same-moment events are settled by the type's name.
    """
    rows = events.where(F.col("event_type").isin(sorted(types))) if types else events
    later = anchored_window(rows, cohort, lambda t, i: days_between(i, t) >= min_days)
    first = F.min(F.struct(TIME, "event_type")).alias("e")
    return (later.groupBy(PERSON).agg(F.min(INDEX).alias(INDEX), first)
            .select(PERSON, INDEX, F.col(f"e.{TIME}").alias(TIME),
                    F.col("e.event_type").alias("event_type")))
