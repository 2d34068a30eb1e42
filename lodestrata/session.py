"""Session construction, lineage cutting and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestrata")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without it a local session gets a temporary one, a cluster an error: executors must
    share the folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lodestrata-checkpoints")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session's spark.checkpoint.dir names (see shared_folder)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan of few files over the session's cores before CPU-heavy Python; wide scans stay as they are."""
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(want, *keys)


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in every Python worker, once per context."""
    import shutil

    context = spark.sparkContext
    if not getattr(context, "_lodestrata_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        into = tempfile.mkdtemp(prefix="lodestrata-")
        archive = shutil.make_archive(os.path.join(into, "lodestrata_src"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._lodestrata_shipped = True
    return spark
