"""Tables written to the cluster's shared folder, to cut lineage and to fix a layout.

Everything goes to ``spark.checkpoint.dir`` of the session. Staged tables are
managed tables of one scratch namespace located there, so dropping a table also
removes its files and a lost executor never loses staged data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

NAMESPACE = "windowmatch_stage"

LOCAL_DIR = "/tmp/checkpoints"

_staged: dict[str, list[str]] = {}
_paths: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only for a local run that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{LOCAL_DIR}/{context.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/windowmatch/{label}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def fresh_table(spark: SparkSession, label: str) -> str:
    """A free table name in the scratch namespace."""
    spark.sql(
        f"CREATE NAMESPACE IF NOT EXISTS {NAMESPACE} "
        f"LOCATION '{shared_dir(spark)}/windowmatch/{NAMESPACE}'"
    )
    name = f"{NAMESPACE}.{label}_{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    name = fresh_table(spark, label)
    df.write.format("parquet").saveAsTable(name)
    return spark.table(name)


class Scratch:
    """Staged tables that go when the block ends, also if it fails."""

    def __enter__(self) -> Scratch:
        self.names: list[tuple[SparkSession, str]] = []
        return self

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        staged = stage(df, label)
        spark = df.sparkSession
        self.names.append((spark, _staged[spark.sparkContext.applicationId][-1]))
        return staged

    def __exit__(self, *failure) -> None:
        for spark, name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            _staged[spark.sparkContext.applicationId].remove(name)


def _placed(spark: SparkSession, path: str):
    """A path for Hadoop, and its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str):
    """The URI of a path, with the scheme of its file system."""
    place, system = _placed(spark, path)
    return system.makeQualified(place).toUri()


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _placed(spark, path)
    return system.exists(place)


def release(spark: SparkSession) -> None:
    """Drop every table this application staged, and remove its other files."""
    application = spark.sparkContext.applicationId
    for name in _staged.pop(application, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _paths.pop(application, []):
        place, system = _placed(spark, path)
        system.delete(place, True)
