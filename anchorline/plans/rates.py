"""Person-time and incidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import days_between
from anchorline.operators.joins import spread_join
from anchorline.schema import INDEX, PERSON, TIME, require


def exposure_days(cohort: DataFrame, events: DataFrame, cap: int = 365,
                  first_only: bool = True) -> DataFrame:
    """Days at risk per person: to the event, else to a death within ``cap``, else ``cap``.

    ``events`` has (person, time).  With ``first_only`` (default) a person counts
    once, with the earliest event; otherwise once per event, as the composite
    analysis coded it.  The whole cohort is kept; other columns are carried.
    """
    require(cohort, PERSON, INDEX, "dod")
    if first_only:
        first = events.groupBy(PERSON).agg(F.min(TIME).alias("event_at"))
        joined = cohort.join(first, PERSON, "left")
    else:
        # Inner join plus the event-free rest: unlike an outer join this lets
        # adaptive execution split a person with very many events.
        rows = events.select(PERSON, F.col(TIME).alias("event_at"))
        hit = spread_join(rows, cohort, [PERSON]).select(*cohort.columns, "event_at")
        rest = cohort.join(rows.select(PERSON).distinct(), PERSON, "left_anti")
        joined = hit.unionByName(rest, allowMissingColumns=True)
    to_event = days_between(F.col(INDEX), F.col("event_at"))
    to_death = days_between(F.col(INDEX), F.col("dod"))
    days = (F.when(F.col("event_at").isNotNull(), to_event)
            .when(to_death < cap, to_death).otherwise(F.lit(cap)))
    return joined.withColumns({"exposure_days": days,
                               "had_event": F.col("event_at").isNotNull()})


def incidence_rate(exposure: DataFrame, by: Sequence[str] = (), per: float = 100,
                   year_days: float = 365) -> DataFrame:
    """Events, person-years and events per ``per`` person-years; each stratum its own."""
    out = exposure.groupBy(*by).agg(
        F.count(F.lit(1)).alias("persons"),
        F.count(F.when(F.col("had_event"), 1)).alias("events"),
        (F.sum("exposure_days") / F.lit(float(year_days))).alias("person_years"))
    return out.withColumn("rate", F.col("events") / F.col("person_years") * per)


def censor_at(time: Column, event: Column, horizon: int) -> tuple[Column, Column]:
    """(time, event) with follow-up cut at ``horizon``; an event on the day counts."""
    kept = F.coalesce(event, F.lit(False)) & (time <= horizon)
    return F.least(time, F.lit(horizon)), F.when(time.isNotNull(), kept)
