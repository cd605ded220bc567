"""Session helpers. On a cluster the session's own settings always win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("dialoom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back to a scratch folder locally."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="dialoom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once to reliable storage; later readers and lost executors reread it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut_lineage, but as a compressed table: smaller where rows repeat their keys, though spread anew."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> str:
    """As stored(), in buckets by key; the name of the table. A join by these keys reads it as it lies, without a shuffle.

    Whoever asked for the table drops it, which leaves its files in the checkpoint folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(parts, *keys).write.option("compression", "zstd").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}")
     .bucketBy(parts, *keys).saveAsTable(table, format="parquet"))
    return table


def together(df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
    """As stored(), of rows that lie in so many parts by key already, and lie so again when they are read.

    They are not shuffled to be written. The table stays in the session's catalog, as its reader is lazy.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}")
     .bucketBy(parts, *keys).saveAsTable(table, format="parquet"))
    return spark.table(table)
