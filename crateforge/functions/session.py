"""Session helpers: reading tables, shared scratch folder, materialised cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all work is done on this machine
    (tests, bench) a folder of it is made, and removed when Python ends. On a
    cluster the setting is demanded: executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.crateforge.scratch", "")
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="crateforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.crateforge.scratch", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, unlike a cached or
    locally checkpointed frame.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._crateforge_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._crateforge_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even partitions for work that is heavy for its bytes.

    Adaptive execution merges partitions by size and would give a few megabytes
    of rows for a Python function to one task; an explicit number is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
