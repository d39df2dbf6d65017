"""Table scans and full-refresh sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load(spark: SparkSession, name: str, root: str | None = None,
         schema: StructType | None = None) -> DataFrame:
    """A catalog table (``db.t`` or ``catalog.db.t``), or ``root/name.parquet``.

    A ``schema`` spares files the look-up of their own.
    """
    if root is None:
        return spark.table(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(os.path.join(root, f"{name}.parquet"))


def publish(df: DataFrame, name: str, root: str | None = None,
            partition_by: Sequence[str] = (), bucket_by: str | None = None,
            buckets: int = 0, at_least: int = 0) -> int:
    """Replace a table with ``df``; the number of rows it now has.

    The new table is written beside the old one, read back and counted, and only then takes its
    name: a failed job, or a result of fewer than ``at_least`` rows, leaves the old table as it was, and a table may
    be refreshed from itself.

    Event tables read by many plans should be bucketed by person (catalog
    tables) so later joins and aggregates on the person need no shuffle of
    them, or partitioned by event year so date windows prune files.
    """
    if root is not None and bucket_by:
        raise ValueError("bucketing needs a catalog table")
    if bucket_by and buckets < 1:
        raise ValueError("bucket_by needs a number of buckets")
    spark, tag = df.sparkSession, uuid.uuid4().hex
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if root is not None:
        staged, old, path = (os.path.join(root, f) for f in (f".{name}.{tag}.new", f".{name}.{tag}.old", f"{name}.parquet"))
        writer.save(staged)
        rows = _counted(spark.read.schema(df.schema).parquet(staged), name, at_least, lambda: _folder(spark, staged).delete())
        replaced = _folder(spark, path).rename(old)
        if not _folder(spark, staged).rename(path):
            if replaced:
                _folder(spark, old).rename(path)
            raise OSError(f"{staged} could not be moved to {path}")
        _folder(spark, old).delete()
        return rows
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    # renamed within its database
    database, table = name.rpartition(".")[::2]
    within = f"{database}." if database else ""
    staged, old = f"{within}{table}__{tag}_new", f"{within}{table}__{tag}_old"
    writer.saveAsTable(staged)
    rows = _counted(spark.table(staged), name, at_least, lambda: spark.sql(f"DROP TABLE {staged}"))
    replaced = spark.catalog.tableExists(name)
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return rows


def _counted(staged: DataFrame, name: str, at_least: int, undo) -> int:
    rows = staged.count()
    if rows < at_least:
        undo()
        raise ValueError(f"{name} would have {rows} rows, fewer than {at_least}; it was left as it is")
    return rows


class _folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.here = self.path(path)
        self.system = self.here.getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(self, to: str) -> bool:
        return self.system.exists(self.here) and self.system.rename(self.here, self.path(to))

    def delete(self) -> None:
        self.system.delete(self.here, True)
