"""Code and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_filler(code: Column, filler: str = "X") -> Column:
    """Drop trailing filler characters ('I21X' -> 'I21')."""
    return F.rtrim(code, F.lit(filler))


def code_prefix(code: Column, length: int) -> Column:
    return F.substring(code, 1, length)


def up_to_delimiter(text: Column, delimiter: str, keep: bool = True) -> Column:
    """Text up to the first delimiter, delimiter included unless ``keep`` is off.

    Without a delimiter the kept form is empty, as ``substring(x, 1, 0)`` is.
    """
    if not keep:
        return F.substring_index(text, delimiter, 1)
    return F.substring(text, F.lit(1), F.instr(text, F.lit(delimiter)))


def remove_dots(code: Column) -> Column:
    return F.replace(code, F.lit("."), F.lit(""))
