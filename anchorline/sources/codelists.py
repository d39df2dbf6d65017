"""Code lists from CSV; a code is always text, never a number."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from anchorline.functions.text import remove_dots


def load_codelist(spark: SparkSession, path: str, code_col: str,
                  system_col: str | None = None, keep: Collection[str] = ()) -> DataFrame:
    """(code[, coding_system][, kept columns]) from a CSV with a header.

    Every column is read as a string, so long ids and leading zeros survive,
    and text is trimmed.  Use :func:`damaged_codes` to list ids a spreadsheet
    already turned into scientific notation.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", False).option("inferSchema", False).csv(path))
    wanted = [F.trim(F.col(f"`{code_col}`")).alias("code")]
    if system_col:
        wanted.append(F.trim(F.col(f"`{system_col}`")).alias("coding_system"))
    wanted += [F.trim(F.col(f"`{c}`")).alias(c) for c in keep]
    typed = raw.select(*[F.col(f"`{c}`").cast(T.StringType()).alias(c) for c in raw.columns])
    return typed.select(*wanted).where(F.col("code") != "")


def code_frame(spark: SparkSession, codes: Collection[str]) -> DataFrame:
    """Literal codes as a one-column table.

    Built from literals, so Catalyst knows how small it is and broadcasts it; a
    frame made from Python rows has no known size and would shuffle the events.
    """
    values = F.array(*[F.lit(c) for c in sorted(set(codes))])
    return spark.range(1).select(F.explode(values).alias("code"))


def clean_codelist(codes: DataFrame, system: str | None = None, exclude: Collection[str] = (),
                   strip_dots: bool = True) -> DataFrame:
    """One coding system, minus dropped codes, dots removed, distinct.

    ``exclude`` is compared before dots go, as the lists are written.
    """
    out = codes
    if system is not None:
        out = out.where(F.col("coding_system") == system)
    if exclude:
        out = out.where(~F.col("code").isin(sorted(exclude)))
    if strip_dots:
        out = out.withColumn("code", remove_dots(F.col("code")))
    return out.dropDuplicates(["code"])


def damaged_codes(codes: DataFrame) -> DataFrame:
    """Codes in scientific notation: they can match no real id."""
    return codes.where(F.col("code").rlike(r"^[0-9](\.[0-9]+)?[Ee]\+?[0-9]+$"))
