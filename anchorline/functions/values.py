"""Value clean-up, recoding and binning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def safe_cast(column: Column, dtype: str) -> Column:
    """NULL instead of an error where text is not a ``dtype``."""
    return column.try_cast(dtype)


def truthy(column: Column) -> Column:
    """'true'/'yes'/'1' (any case) or a boolean, as a boolean."""
    return column.cast("string").try_cast("boolean")


def null_outside(column: Column, low: float, high: float) -> Column:
    """Keep the row, drop the implausible value (bounds are plausible)."""
    return F.when(column.between(low, high), column)


def in_open_range(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Plausibility predicate with exclusive bounds."""
    cond = column.isNotNull()
    if low is not None:
        cond = cond & (column > low)
    if high is not None:
        cond = cond & (column < high)
    return cond


def level_or(column: Column, level: str) -> Column:
    """NULL becomes an explicit level."""
    return F.coalesce(column, F.lit(level))


def recode(column: Column, mapping: Mapping[str, object]) -> Column:
    """Rename or collapse levels; unmapped levels stay, NULL stays NULL."""
    if not mapping:
        return column
    out = None
    for old, new in mapping.items():
        out = F.when(column == old, new) if out is None else out.when(column == old, new)
    return out.otherwise(column)


def cap_level(count: Column, cap: int) -> Column:
    """Counts as labels, with everything from ``cap`` up folded into 'cap+'."""
    return F.when(count >= cap, F.lit(f"{cap}+")).otherwise(count.cast("string"))


def level_order(column: Column, levels: Sequence[str]) -> Column:
    """Sort key of a level; unknown levels and NULL come last."""
    out = F.lit(len(levels))
    for i in reversed(range(len(levels))):
        out = F.when(column == levels[i], F.lit(i)).otherwise(out)
    return out


def bin_right_closed(column: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(b0, b1], (b1, b2], ...`` with ``b0`` itself in the first bin."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    cond = column.between(breaks[0], breaks[1])
    out = F.when(cond, labels[0])
    for low, high, label in zip(breaks[1:-1], breaks[2:], labels[1:]):
        out = out.when((column > low) & (column <= high), label)
    return out


def stable_id(*columns: Column) -> Column:
    """Surrogate id from the row key; needs no global ranking."""
    return F.xxhash64(*columns)
