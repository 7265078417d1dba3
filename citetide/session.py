"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Settings the library expects. Adaptive execution splits skewed shuffle partitions that stay below
#: the share at which :mod:`citetide.operators.skew` salts a key, and merges small ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app_name: str = "citetide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings; ``conf`` uses ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {name.replace("__", "."): value for name, value in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named in ``spark.checkpoint.dir``, which every executor
    can reach. Where none is named, a local master gets a temporary folder and any other master an error,
    since executors would then write to disks that the readers cannot see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="citetide-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pin(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read on from there.

    The rows are computed once and fixed, the lineage is cut, a lost executor re-reads files instead of
    recomputing, and the planner knows the table's real size. With ``partition_by`` a filter on these columns reads
    only its own files. :func:`unpin` deletes the table once nothing reads it any more.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.pinned_path = path
    return table


def unpin(*tables: DataFrame) -> None:
    """Delete tables made by :func:`pin`; frames that still read them fail afterwards."""
    for table in tables:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.pinned_path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
