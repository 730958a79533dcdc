"""Session factory, table loading and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", app: str = "spectraloom", **conf: str) -> SparkSession:
    """A session with the settings the library assumes (UTC, AQE with skew joins, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data folder; ``columns`` narrows the scan explicitly."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_checkpoints(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    The folder a cluster names in ``spark.checkpoint.dir`` is used as it is. Only where that is
    unset and the master is local (tests) a folder of this machine is made; on a cluster that would
    lose the data with the machine, so it is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = context.master
    if not named and master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on the cluster {master}")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "spectraloom-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so a lost executor costs no recomputation."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, by the columns ``partition_by``.

    For data that is read again and again in parts: a filter on those columns reads only its files.
    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_checkpoints(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is: the join is then shuffled, with AQE's skew handling."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
