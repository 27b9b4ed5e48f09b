"""Tables that cut a job's lineage, in the folder that the cluster shares."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; in one of this machine only where that is unset and all tasks run in this process,
    as in tests. Elsewhere a missing setting is an error, as a local folder would lose data."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")

        base = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    _made.append(f"{base}/{name}-{uuid4().hex}")
    return _made[-1]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once and read again."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove_made(spark: SparkSession) -> int:
    """Deletes the folders that this process has made, for when their results are no longer read; returns how many there were."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
