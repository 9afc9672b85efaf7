"""Session helpers: defaults for local runs, shipping the package to Python workers, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Tables that :func:`stored` made in this process and nobody deleted yet.
_made: list[str] = []
#: How tables are written where the shared folder is one of the local file system: Hadoop's usual class runs ``chmod``
#: in a process of its own several times a file, which for that moment has the executor's memory, and adds a checksum
#: file; the plain one does neither. No other file system reads these.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench: UTC, AQE on, small shuffles."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers that start elsewhere than in the repository."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a private one where it is unset and the master is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="gridweave-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        context.setCheckpointDir(local)
        named = context.getCheckpointDir()
    return named


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    The written table survives the loss of executors, so what is computed from it
    never has to repeat (or repeat differently) what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridweave-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").options(**PLAIN_FILES)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridweave_path = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_gridweave_path", None)
    if path:
        _delete(df.sparkSession, path)


def stored_alone(make, partition_by: list[str] | None = None) -> DataFrame:
    """Store the DataFrame that ``make`` returns, and delete the tables that were stored on the way to it."""
    before = set(_made)
    out = stored(make(), partition_by)
    for path in [p for p in _made if p not in before and p != out._gridweave_path]:
        _delete(out.sparkSession, path)
    return out
