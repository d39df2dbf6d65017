"""Wide to long, and set membership to flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def collect_classes(df: DataFrame, key: Sequence[str], column: str,
                    classes_as: str = "classes") -> DataFrame:
    """Sorted distinct classes per key and their number; NULL is not a class.

    Rows are made distinct first, so what is collected per key is bounded by the
    number of classes, not by the number of records.
    """
    distinct = df.where(F.col(column).isNotNull()).select(*key, column).distinct()
    return (distinct.groupBy(*key).agg(F.sort_array(F.collect_list(column)).alias(classes_as))
            .withColumn("n_classes", F.size(classes_as)))


def classes_to_flags(df: DataFrame, key: Sequence[str], column: str,
                     mapping: Mapping[str, str]) -> DataFrame:
    """One boolean per flag in ``mapping`` (flag -> class) plus the distinct count.

    The count covers classes that have no flag of their own.
    """
    flags = [F.max(F.col(column) == cls).alias(flag) for flag, cls in mapping.items()]
    distinct = df.where(F.col(column).isNotNull()).select(*key, column).distinct()
    return distinct.groupBy(*key).agg(*flags, F.count(F.lit(1)).cast("int").alias("n_classes"))
