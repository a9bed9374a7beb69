"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "skygauge", cores: str | None = None) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own configuration."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage.

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster);
    a temporary one is made only where the session names none.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, whose executors share the driver's disk, may do without one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """New folder for a hand-over table below the session's checkpoint folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def land(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a new folder and read it back: cuts lineage, and the size of the rows is known to later joins.

    With ``by`` the folder has one folder per value of these columns, and filters on them prune files.
    """
    path = scratch_dir(df.sparkSession, label)
    w = df.write.partitionBy(*by) if by else df.write
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
