"""Session settings that the operators rely on."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing (a local session, as in tests) a temporary folder is
    made, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = spark.conf.get("lectern.local.folder", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.local.folder", folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder on the way; results that
    were not written elsewhere cannot be computed any more without running again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder: lineage ends there, and the
    loss of an executor costs nothing that was written."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(own_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: columns can be pruned
    and filters pushed down, and later stages do not repeat its work."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` returned, once nothing will read them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over enough partitions to keep all cores busy, for steps whose cost is CPU
    and not bytes: small partitions would be coalesced, and run on few cores."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def spread_thin(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are cores, as
    small tables have; the rows of larger ones are not moved."""
    enough = df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism
    return df if enough else spread(df)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a session that was started
    without it on their path: as a zip file handed out by Spark, once per application."""
    root = Path(__file__).resolve().parent.parent
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in [*on_path, Path.cwd()] or spark.conf.get("lectern.shipped", None):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted((root / "lectern").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    target = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"  # on the driver; Spark sends it on
    target.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set("lectern.shipped", "yes")
