"""Drug (or product) classes in windows around the index date."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from anchorline.functions.dates import Bounds, shift_months
from anchorline.functions.values import cap_level
from anchorline.operators.codes import map_codes
from anchorline.operators.joins import attach, spread_join
from anchorline.operators.reshape import classes_to_flags, to_long
from anchorline.operators.tabulate import crosstab, pct_within, prevalence
from anchorline.schema import INDEX, PERSON, TIME, require


def classify_drugs(meds: DataFrame, lookup: DataFrame, prefixes: Sequence[str] | None = None,
                   class_len: int = 7, repeat_only: bool = True) -> DataFrame:
    """Medication rows with a ``drug_class`` cut from the mapped chapter code.

    ``lookup`` is (drug_code, chapter_code).  Rows outside the admitted code
    ``prefixes``, unmapped rows and (by default) one-off items are dropped.
    """
    rows = meds.where(F.col("is_repeat")) if repeat_only else meds
    mapped = map_codes(rows, lookup, "drug_id", "drug_code", "chapter_code")
    chapter = F.col("chapter_code")
    if prefixes:
        admitted = F.lit(False)
        for prefix in prefixes:
            admitted = admitted | chapter.startswith(prefix)
        mapped = mapped.where(admitted)
    return mapped.withColumn("drug_class", F.substring(chapter, 1, class_len))


def drug_exposure(meds: DataFrame, cohort: DataFrame, windows: Mapping[str, Bounds],
                  flags: Mapping[str, str], drug_class: str = "drug_class",
                  admitted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Class flags and distinct class count per person and time point.

    All windows are cut in one pass: the medications meet the cohort once and
    each row is tagged with the time points it falls in.  ``admitted`` limits a
    time point to chapter-code prefixes of its own.
    """
    require(meds, PERSON, TIME, drug_class)
    require(cohort, PERSON, INDEX)
    tags = []
    for status, bounds in windows.items():
        hit = bounds(F.col(TIME), F.col(INDEX))
        if admitted and status in admitted:
            allowed = F.lit(False)
            for prefix in admitted[status]:
                allowed = allowed | F.col("chapter_code").startswith(prefix)
            hit = hit & allowed
        tags.append(F.when(hit, F.lit(status)))
    met = spread_join(meds, cohort.select(PERSON, INDEX), [PERSON])
    tagged = met.select(PERSON, drug_class, F.explode(F.array_compact(F.array(*tags)))
                        .alias("time_status"))
    return classes_to_flags(tagged, [PERSON, "time_status"], drug_class, flags)


def exposure_long(cohort: DataFrame, exposure: DataFrame, statuses: Sequence[str],
                  flags: Collection[str], early_months: int = 6) -> DataFrame:
    """Every person at every time point; no row means not prescribed.

    ``early_death`` marks death within ``early_months`` of the index date.
    """
    points = F.explode(F.array(*[F.lit(s) for s in statuses])).alias("time_status")
    early = F.coalesce(F.col("dod") < shift_months(F.col(INDEX), early_months), F.lit(False))
    frame = cohort.select(PERSON, early.alias("early_death"), points)
    facts = exposure.select(PERSON, "time_status", *flags, "n_classes")
    return attach(frame, facts, (PERSON, "time_status"),
                  **{f: False for f in flags}, n_classes=0)


def class_counts(long: DataFrame, excluding: Collection[str] = (),
                 flags: Collection[str] = ()) -> DataFrame:
    """Number of classes per person and time point, leaving some classes out.

    With ``excluding``, counts the remaining ``flags`` instead of ``n_classes``.
    """
    if not excluding:
        return long.select(PERSON, "time_status", F.col("n_classes"))
    kept = [f for f in flags if f not in excluding]
    total = sum((F.col(f).cast("int") for f in kept), F.lit(0))
    return long.select(PERSON, "time_status", total.alias("n_classes"))


def share_prescribed(long: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Persons, persons on the class and percent, per class and time point.

    ``long`` has a row per person and time point with a boolean per class.
    """
    taken = to_long(long, [PERSON, "time_status"], list(classes), "drug_class", "taken")
    return prevalence(taken, F.col("taken"), ["drug_class", "time_status"])


def count_distribution(counts: DataFrame, cap: int) -> DataFrame:
    """Persons and percent per capped class count within each time point."""
    labelled = counts.withColumn("n_label", cap_level(F.col("n_classes"), cap))
    return pct_within(labelled, ["n_label"], ["time_status"])


def count_by_control(counts: DataFrame, control: DataFrame, cap: int,
                     levels: Sequence[str] = ("above", "below")) -> DataFrame:
    """Capped class count by control status, persons with both known."""
    joined = counts.join(control.select(PERSON, "control"), PERSON)
    return crosstab(joined.withColumn("n_label", cap_level(F.col("n_classes"), cap)),
                    "n_label", "control", levels)
