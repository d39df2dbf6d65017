"""Cohort building: who is in, when they start, how long they are followed."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import days_between, months_between_calendar, years_between
from anchorline.functions.values import level_or, recode
from anchorline.operators.joins import attach
from anchorline.operators.select import keep_unique
from anchorline.operators.tabulate import attrition
from anchorline.schema import INDEX, PERSON, require


def spell_bounds(spells: DataFrame, service_types: Collection[str],
                 null_start: str = "drop") -> DataFrame:
    """First start, its service and postcode, and last stop per person.

    Ties on the first start are settled by service, then postcode.  A spell with
    no start sorts first, so by default its person gets no index date and falls
    to the date filter; ``null_start="ignore"`` skips such spells.
    """
    require(spells, PERSON, "start_date", "end_date", "service_type", "postcode")
    chosen = spells.where(F.col("service_type").isin(sorted(service_types)))
    if null_start == "ignore":
        chosen = chosen.where(F.col("start_date").isNotNull())
    entry = F.min(F.struct("start_date", "service_type", "postcode")).alias("entry")
    return chosen.groupBy(PERSON).agg(entry, F.max("end_date").alias("last_stop")).select(
        PERSON, F.col("entry.start_date").alias(INDEX),
        "last_stop",
        F.col("entry.service_type").alias("admission_service"),
        F.col("entry.postcode").alias("postcode"))


def build_cohort(spells: DataFrame, person: DataFrame, observation: DataFrame,
                 service_types: Collection[str], before: str,
                 null_start: str = "drop") -> DataFrame:
    """One row per person admitted before a date, with demographics.

    Age is in calendar-year boundaries: a birthday later in the year counts.
    """
    bounds = spell_bounds(spells, service_types, null_start)
    bounds = bounds.where(F.col(INDEX) < F.lit(before).cast("date"))
    people = person.select(PERSON, "birth_date", "death_date", "gender")
    seen = observation.groupBy(PERSON).agg(F.max("ob_end").alias("ob_end"))
    out = bounds.join(people, PERSON, "left").join(seen, PERSON, "left")
    return out.withColumns({
        "stay_days": days_between(F.col(INDEX), F.col("last_stop")),
        "age_at_index": years_between(F.col("birth_date"), F.col(INDEX)),
    })


def apply_exclusions(df: DataFrame, rules: Sequence[tuple[str, Column]],
                     ) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, attrition table).  A NULL outcome fails."""
    keep = F.lit(True)
    for _, rule in rules:
        keep = keep & rule
    return df.where(keep), attrition(df, [("start", F.lit(True)), *rules])


def entry_rules(excluded_dates: Collection[str], min_age: int, min_days: int,
                open_stay: str = "drop") -> list[tuple[str, Column]]:
    """The study's exclusions in order; expects ``dod`` already reconciled.

    Persons without a death date pass the death rule.  A stay with no end fails
    the stay rule unless ``open_stay="keep"``.
    """
    stay = days_between(F.col(INDEX), F.col("last_stop")) > min_days
    if open_stay == "keep":
        stay = stay | F.col("last_stop").isNull()
    unknown = [F.lit(d).cast("date") for d in sorted(excluded_dates)]
    return [
        ("known index date", ~F.to_date(INDEX).isin(unknown)),
        (f"aged {min_age} or over", F.col("age_at_index") >= min_age),
        (f"alive after {min_days} days",
         F.col("dod").isNull() | (days_between(F.col(INDEX), F.col("dod")) > min_days)),
        (f"stayed over {min_days} days", stay),
    ]


def reconcile_death(cohort: DataFrame, registry: DataFrame,
                    recorded: str = "death_date") -> DataFrame:
    """Add ``dod``: the recorded date, else the registry's latest.

    Within the registry the latest date of death wins and a registration date
    only stands in when no record has one.  Two maxima say exactly that, and
    unlike a ranking they combine before the shuffle.
    """
    latest = registry.groupBy(PERSON).agg(
        F.coalesce(F.max("dod"), F.max("reg_date")).alias("__registry"))
    return (cohort.join(latest, PERSON, "left")
            .withColumn("dod", F.coalesce(recorded, "__registry")).drop("__registry"))


def follow_up(df: DataFrame) -> DataFrame:
    """Mortality days, end status, end date and duration of follow-up.

    As the study coded it: 'survived' is everyone without a death but with an
    observation end, so 'lost to follow up' means no observation end at all.
    """
    require(df, INDEX, "dod", "ob_end")
    dod, end = F.col("dod"), F.col("ob_end")
    status = (F.when(dod.isNull() & end.isNotNull(), "survived")
              .when(dod.isNotNull(), "died").otherwise("lost to follow up"))
    fu_end = F.coalesce(dod, end)
    return df.withColumns({
        "mortality_days": days_between(F.col(INDEX), dod),
        "end_of_fu_status": status,
        "fu_end_date": fu_end,
        "fu_days": days_between(F.col(INDEX), fu_end),
    })


def drop_ended_before_index(df: DataFrame) -> DataFrame:
    """Remove persons whose follow-up ends before it starts; unknown ends stay."""
    return df.where(F.col("fu_end_date").isNull() | (F.col(INDEX) <= F.col("fu_end_date")))


def presumed_exit(cohort: DataFrame, observation: DataFrame, months: int = 2) -> DataFrame:
    """Persons with no death date whose observation ends near their last stop."""
    gap = months_between_calendar(F.col("last_stop"), F.col("ob_end"))
    open_cases = cohort.where(F.col("dod").isNull()).drop("ob_end")
    return (open_cases.join(observation.select(PERSON, "ob_end"), PERSON, "left")
            .withColumn("months_apart", gap)
            .where(F.col("months_apart").between(-months, months)))


def attach_area_index(cohort: DataFrame, person_area: DataFrame, area_index: DataFrame,
                      missing: str = "missing") -> DataFrame:
    """Person's area and its decile as text; persons with several areas drop out.

    Areas are reduced to one row per person before the index is met, and persons
    without an area do not meet it at all, so no area holds more than its residents.
    """
    residents = keep_unique(person_area.select(PERSON, "area").distinct(), PERSON)
    several = person_area.select(PERSON).distinct().join(residents, PERSON, "left_anti")
    placed = residents.where("area IS NOT NULL").join(
        area_index.select("area", "decile").dropDuplicates(["area"]), "area", "left")
    return (cohort.select(PERSON).join(several, PERSON, "left_anti").join(placed, PERSON, "left")
            .select(PERSON, "area", level_or(F.col("decile").cast("string"), missing).alias("decile")))


def resolve_category(cohort: DataFrame, primary: DataFrame, secondary: DataFrame,
                     recodes: Mapping[str, str], unknown: str = "Missing") -> DataFrame:
    """Best available category from two one-row-per-person sources.

    The primary group stands unless it is the ``unknown`` label and the
    secondary text is one of ``recodes``; no primary row gives ``unknown``.
    ``primary`` has (person, group), ``secondary`` (person, text).
    """
    both = attach(attach(cohort, primary.select(PERSON, "group")),
                  secondary.select(PERSON, "text"))
    second = F.when(F.col("text").isin(sorted(recodes)), recode(F.col("text"), recodes))
    best = (F.when((F.col("group") == unknown) & second.isNotNull(), second)
            .otherwise(F.coalesce("group", F.lit(unknown))))
    return both.withColumn("category", best).drop("group", "text")


def stratify_by_date(column: Column, cut: str, boundary: str = "after") -> Column:
    """'before'/'after' a date; the cut day itself goes 'after', or to NULL
    with ``boundary="drop"``."""
    day, at = F.to_date(column), F.lit(cut).cast("date")
    later = day >= at if boundary == "after" else day > at
    return F.when(day < at, "before").when(later, "after")
