"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that a data directory may hold, one Parquet file or folder each.
TABLES = ("chunks", "documents", "pull_requests", "commit_log", "file_changes", "repo_index_state", "index_runs", "pack_budgets", "embeddings", "events")


def local_session(cores: int = 8, shuffle: int = 8, name: str = "corpusloom", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table NAME of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it.

    Only on one machine a temporary folder is made and set where that setting is absent; executors of a cluster would each
    write to their own, so there its absence is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def saved(df: DataFrame, what: str = "part") -> DataFrame:
    """Cut the lineage of DF: write it as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the table survives the loss of any executor; unlike an RDD checkpoint it is columnar and
    compressed, so a later reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.setdefault(id(spark), []).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: dict[int, list[tuple[SparkSession, str]]] = {}


def discard_saved(spark: SparkSession) -> None:
    """Delete the tables that saved() wrote in this session; call it when their results have been stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _, path in _written.pop(id(spark), []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """More partitions where the scan gives fewer than the cluster has cores (one large row group), for work that costs more
    than a shuffle of its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < cores else df
