"""Query registry: a callable and, where it can be said in SQL, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from anchorline.sources.codelists import code_frame
from anchorline.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read lazily."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        return load(self.spark, name, self.root)

    def codes(self, *values: str) -> DataFrame:
        """A literal code list (a study parameter) as a DataFrame."""
        return code_frame(self.spark, values)


def present(df: DataFrame) -> DataFrame:
    """Dates as timestamps and doubles to 6 places, so engines compare equal."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        out.append(column.alias(field.name))
    return df.select(*out)


def query(sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under its own name."""
    def register(function: Callable[[Tables], DataFrame]):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(function(Tables(spark, sf_dir)))

        run.__name__, run.__doc__ = name, function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function
    return register


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
