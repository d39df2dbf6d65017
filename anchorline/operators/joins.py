"""Joins around the one-row-per-person cohort.

No broadcast hints: Catalyst broadcasts a side it measures under
``autoBroadcastJoinThreshold`` (again at run time with exact shuffle sizes), and
otherwise sort-merges.  Event tables always sit on the side adaptive execution
may split, and join through :func:`spread_join`, so a person with a third of
all events is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import Bounds, Reach
from anchorline.schema import INDEX, PERSON, TIME, require


_HASH, _BIN, _SALT = "__key_hash", "__time_bin", "__salt"


def bucketed_on(df: DataFrame, on: Sequence[str]) -> bool:
    """Whether a catalog table under ``df`` is bucketed by exactly the key's columns."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() != "LogicalRelation" or leaf.catalogTable().isEmpty():
            continue
        spec = leaf.catalogTable().get().bucketSpec()
        if spec.isDefined() and spec.get().bucketColumnNames().mkString(",") == ",".join(on):
            return True
    return False


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join rows that may hold hot keys to a table with few rows per key.

    Adaptive execution splits a hot key's partition only if both inputs of the
    join are fresh shuffles and what follows does not rely on their layout.  A
    lookup that is itself an aggregate, or a ``groupBy`` on the key above the
    join, would take that away.  A hash of the key as an extra join key keeps
    it: the layout (key, hash) satisfies neither, so the lookup gets a shuffle of
    its own and the aggregate above combines partially, then shuffles its few
    partial rows.  ``how`` must preserve the rows: inner, left, left_semi or left_anti.

    Rows read from a table bucketed on the key keep their layout instead: such a
    join, and aggregates on the key above it, need no shuffle of them.
    """
    if bucketed_on(rows, on):
        return rows.join(lookup, list(on), how)

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn(_HASH, F.xxhash64(*on))
    return hashed(rows).join(hashed(lookup), [*on, _HASH], how).drop(_HASH)


def restrict_to(df: DataFrame, keep: DataFrame, key: str = PERSON) -> DataFrame:
    """Rows whose key occurs in ``keep`` (never multiplies rows)."""
    return spread_join(df, keep.select(key), [key], "left_semi")


def exclude(df: DataFrame, drop: DataFrame, key: str = PERSON) -> DataFrame:
    """Rows whose key does not occur in ``drop``; safe when ``drop`` holds NULLs."""
    return spread_join(df, drop.select(key), [key], "left_anti")


def anchored_window(events: DataFrame, cohort: DataFrame, bounds: Bounds,
                    time: str = TIME, carry: Sequence[str] = (), year_column: str | None = None,
                    bin_days: int | None = None) -> DataFrame:
    """Events inside a window around their person's index date.

    Inner join on the person, so the cohort restriction and the date filter
    happen in one step.  Adds the index date and the ``carry`` cohort columns.

    With ``year_column``, the events' partition column that holds their year, only years that the cohort's
    earliest and latest index dates can reach are read.  With ``bin_days`` the join key is (person,
    bin of so many days): a cohort row is laid out once per bin its window touches, and a person's events are dealt out by
    time whatever the settings of adaptive execution.  Both need ``bounds`` that know their reach.
    """
    require(events, PERSON, time)
    require(cohort, PERSON, INDEX, *carry)
    anchors = cohort.select(PERSON, INDEX, *carry)
    first, last = (bounds.first, bounds.last) if isinstance(bounds, Reach) else (None, None)
    if year_column is not None:
        for edge, days, within in ((F.min, first, lambda year, end: year >= end), (F.max, last, lambda year, end: year <= end)):
            if days is not None:
                end = cohort.agg(F.year(F.date_add(F.to_date(edge(INDEX)), days)).alias("year"))
                events = events.where(within(F.col(year_column), end.scalar()))
    on = [PERSON]
    if bin_days is not None:
        if first is None or last is None:
            raise ValueError("bins need bounds that reach a known number of days both ways")

        def bin_of(day: Column) -> Column:
            return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bin_days).cast("int")
        index_day = F.to_date(INDEX)
        touched = F.sequence(bin_of(F.date_add(index_day, first)), bin_of(F.date_add(index_day, last)))
        anchors = anchors.where(F.col(INDEX).isNotNull()).withColumn(_BIN, F.explode(touched))
        events = events.withColumn(_BIN, bin_of(F.to_date(time)))
        on = [PERSON, _BIN]
    return spread_join(events, anchors, on).where(bounds(F.col(time), F.col(INDEX))).drop(_BIN)


def hot_keys(rows: DataFrame, key: str, share: float = 1 / 64) -> DataFrame:
    """One row with one array: keys that own at least ``share`` of the rows, by a frequent-items sketch.

    The sketch overstates no key, so nothing else is listed; a key just above the share may be missing.
    """
    most = int(1 / share)
    sketch = F.expr(f"approx_top_k(`{key}`, {most}, {64 * most})").alias("top")
    counted = rows.agg(F.count(F.col(key)).alias("n"), sketch)
    hot = F.filter("top", lambda x: x["count"] >= F.col("n") * share)
    return counted.select(F.transform(hot, lambda x: x["item"]).alias("hot"))


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join rows to a look-up on one key, measured hot keys dealt over ``salts`` copies of their look-up rows.

    Reads the rows once more to find the hot keys; all other keys are joined as they are.  Does not rely on
    adaptive execution.  Rows that agree in every column stay together.  ``how`` must preserve the rows: inner, left, left_semi or left_anti.
    """
    hot = hot_keys(rows, key).scalar()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    dealt = rows.withColumn(_SALT, F.when(F.array_contains(hot, F.col(key)), spread).otherwise(0))
    copies = F.when(F.array_contains(hot, F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(lookup.withColumn(_SALT, F.explode(copies)), [key, _SALT], how).drop(_SALT)


def attach(cohort: DataFrame, facts: DataFrame, on: Sequence[str] = (PERSON,),
           **defaults: object) -> DataFrame:
    """Left join one-row-per-key facts; unmatched (or NULL) facts take a default."""
    out = cohort.join(facts, list(on), "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(value))
                            for name, value in defaults.items()}) if defaults else out


def assemble_master(cohort: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """Person star: the cohort left-joined to covariate tables, one row per person.

    A column that two tables share is an error.  So is a person with two rows in a covariate
    table, found while the plan runs: the table is grouped by person for the join anyway.
    """
    out = cohort
    for table in tables:
        facts = [c for c in table.columns if c != PERSON]
        clash = sorted(set(facts) & set(out.columns))
        if clash:
            raise ValueError(f"covariate columns already present: {', '.join(clash)}")
        row = F.first(F.struct(*[F.col(f"`{c}`") for c in facts])).alias("__row")
        once = table.groupBy(PERSON).agg(row, F.count(F.lit(1)).alias("__n"))
        checked = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
            F.raise_error(F.concat(F.lit("more than one covariate row for person "), F.col(PERSON).cast("string"))))
        once = once.select(PERSON, checked.alias("__row")).select(PERSON, "__row.*")
        out = out.join(once, PERSON, "left")
    return out


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group keys where NULL is a group like any other."""
    side = right.select(*[F.col(k).alias(f"__{k}_r") for k in keys],
                        *[c for c in right.columns if c not in keys])
    match = reduce(lambda a, b: a & b,
                   [F.col(k).eqNullSafe(F.col(f"__{k}_r")) for k in keys])
    return left.join(side, match).drop(*[f"__{k}_r" for k in keys])


def one_row_per(df: DataFrame, key: str = PERSON) -> DataFrame:
    """Keys that break the one-row-per-key contract, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def pair_readings(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two measurements taken at the same moment (inner join on person and time)."""
    return first.join(second, list(keys), "inner")


def stack_sources(*frames: DataFrame) -> DataFrame:
    """Same-shape extracts stacked by column name; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def stack_distinct(*frames: DataFrame) -> DataFrame:
    return stack_sources(*frames).distinct()


def normalise_event(df: DataFrame, person: str, when: str, event_type: str | Column) -> DataFrame:
    """Differently named sources brought to (person, time, type) before stacking."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    return df.select(F.col(person).alias(PERSON),
                     F.col(when).cast("timestamp_ntz").alias(TIME),
                     kind.alias("event_type"))
