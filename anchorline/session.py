"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# A person, code or order may own a large share of all rows.  Joins keyed on it
# are split at run time by adaptive execution; "force" lets Spark add the one
# extra shuffle that is needed when an aggregate on the same key follows.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings; all are run-time SQL settings."""
    for name, value in ADAPTIVE.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def written_folder(spark: SparkSession, store: str | None = None) -> str:
    """A new folder below ``store``, or below the shared folder ``spark.checkpoint.dir`` names.

    Only a local master, whose tasks all see this machine's disk, may do without either.
    """
    shared = store or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or pass store")
        shared = f"{tempfile.gettempdir()}/anchorline"
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, store: str | None = None, instead_of: DataFrame | None = None,
            partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back, lineage cut.

    A lost executor costs the tasks it ran since, not the steps before.  ``instead_of`` names an
    earlier written step that nothing needs any more once this one stands; its files go.
    """
    spark = df.sparkSession
    path = written_folder(spark, store)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a step that ``written`` returned; no plan may read it afterwards."""
    path = _FOLDERS.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_session(name: str = "anchorline", cpus: int | str = "*",
                  partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # no Python call-site lookup per column expression while building plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune_session(spark)
