"""Code lists: matching and mapping."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.text import code_prefix, strip_filler
from anchorline.operators.joins import salted_join, spread_join

#: A list of at most so many codes becomes a literal set.
LITERAL_CODES = 10_000

CodeList = Collection[str] | DataFrame
"""Literal codes, or a DataFrame whose first column holds them."""


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _prepared(column: str, prefix_len: int | None, filler: str | None) -> Column:
    code = F.col(column)
    if filler:
        code = strip_filler(code, filler)
    return code_prefix(code, prefix_len) if prefix_len else code


def any_code_in(df: DataFrame, columns: Sequence[str], codes: CodeList,
                prefix_len: int | None = None, filler: str | None = None) -> DataFrame:
    """Rows where any of the positional code columns is in the list.

    Literal codes compile to hashed set probes, with no join, and so does a DataFrame list counted
    to hold at most ``LITERAL_CODES``.  A longer one meets the rows in one semi join:
    each row is laid out once per distinct code it holds (NULLs aside), and
    rows that hit by several codes are brought back to one.
    """
    if isinstance(codes, DataFrame):
        listed = codes.select(F.col(codes.columns[0]).alias("__code")).where("__code IS NOT NULL").distinct()
        found = listed.limit(LITERAL_CODES + 1).collect()
        if len(found) > LITERAL_CODES:
            return any_code_joined(df, columns, codes, prefix_len, filler)
        codes = [r[0] for r in found]
        if not codes:
            return df.where(F.lit(False))
    values = sorted(set(codes))
    return df.where(_any([_prepared(c, prefix_len, filler).isin(values) for c in columns]))


def any_code_joined(df: DataFrame, columns: Sequence[str], listed: DataFrame,
                    prefix_len: int | None = None, filler: str | None = None) -> DataFrame:
    """:func:`any_code_in` for a list of any length, by one semi join."""
    listed = listed.select(F.col(listed.columns[0]).alias("__code")).where("__code IS NOT NULL").distinct()
    held = F.array_distinct(F.array_compact(F.array(*[_prepared(c, prefix_len, filler) for c in columns])))
    laid_out = df.withColumns({"__row": F.monotonically_increasing_id(), "__held": held}).select(
        "*", F.explode("__held").alias("__code")).drop("__held")
    hits = spread_join(laid_out, listed, ["__code"], "left_semi")
    return hits.dropDuplicates(["__row"]).select(*df.columns)


def any_code_prefix(df: DataFrame, columns: Sequence[str], prefixes: Sequence[str],
                    filler: str | None = None) -> DataFrame:
    """Rows where any code column starts with one of the prefixes."""
    return df.where(_any([_prepared(c, None, filler).startswith(p)
                          for c in columns for p in prefixes]))


def code_in(df: DataFrame, column: str, codes: CodeList, measured: bool = False) -> DataFrame:
    """Single-column restriction; semi join, so repeated codes do no harm (``measured``: see ``map_codes``)."""
    if not isinstance(codes, DataFrame):
        return df.where(F.col(column).isin(sorted(set(codes))))
    listed = codes.select(F.col(codes.columns[0]).alias(column))
    if measured:
        return salted_join(df, listed, column, "left_semi").select(*df.columns)
    return spread_join(df, listed, [column], "left_semi").select(*df.columns)


def map_codes(df: DataFrame, lookup: DataFrame, column: str, lookup_code: str,
              *carry: str, measured: bool = False) -> DataFrame:
    """Bring lookup columns to each row by code; unmapped rows keep NULLs.

    A code the lookup lists several times yields one row per listing.  With ``measured`` the rows are read
    once more to find codes that own a large share of them, and these are dealt over salted copies.
    """
    side = lookup.select(F.col(lookup_code).cast("string").alias(column), *carry)
    if measured:
        return salted_join(df, side, column, "left")
    return spread_join(df, side, [column], "left")


def label_codes(lists: Mapping[str, DataFrame]) -> DataFrame:
    """One (code, label) row per code; the earlier list wins a code in several."""
    frames = [codes.select(F.col(codes.columns[0]).alias("code"),
                           F.struct(F.lit(i).alias("priority"), F.lit(label).alias("label")).alias("pick"))
              for i, (label, codes) in enumerate(lists.items())]
    stacked = reduce(DataFrame.unionByName, frames)
    return (stacked.where(F.col("code").isNotNull()).groupBy("code")
            .agg(F.min("pick").alias("pick")).select("code", F.col("pick.label").alias("label")))


def label_by_values(column: Column, groups: Mapping[str, Collection[str]]) -> Column:
    """Searched CASE over literal code groups; a code in none gives NULL."""
    out = None
    for label, values in groups.items():
        hit = column.isin(sorted(values))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out
