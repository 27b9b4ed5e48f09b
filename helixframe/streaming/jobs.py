"""Structured Streaming jobs: files of variant lines that arrive over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.sites import is_single, is_transition
from helixframe.sources.scratch import saved
from helixframe.sources.vcf import parse_lines


def arriving_lines(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Lines of files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def ingest(lines: DataFrame, path: str, checkpoint: str):
    """Writes new sites only: a key (chrom, pos, id) that was seen is dropped, also after a restart. VCF has no event time, so
    the state grows with the distinct keys; it is kept by RocksDB on executors' disks where the session says so."""
    return sites_of_lines(lines).dropDuplicates(KEY).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(lines: DataFrame) -> DataFrame:
    """(filter, n, n_ts) over all lines so far."""
    v = parse_lines(lines)
    alt = F.get("alts", F.lit(0))
    return v.groupBy(F.coalesce(F.array_join("filters", ";"), F.lit(".")).alias("filter")).agg(F.count("*").alias("n"), F.count_if((F.size("alts") == 1) & is_single(F.col("ref"), alt) & is_transition(F.col("ref"), alt)).alias("n_ts"))


def run_counts(lines: DataFrame, table: str, checkpoint: str):
    """Keeps running_counts in an in-memory table of the session: one row per FILTER value."""
    return running_counts(lines).writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


KEY = ["chrom", "pos", "id"]


def add_new(rows: DataFrame, target: str, key: list[str] | None = None) -> int:
    """Adds the rows to the table `target` whose key it has not yet, of rows that share a key one; returns how many. Rows that are
    there already are ignored, so a load that broke off, or a file that comes again, can simply be loaded again. Only the
    keys of the partitions that rows fall in are read. Rows with a null in the key are kept apart by it like any value."""
    key = key or KEY
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_last() for c in rows.columns if c not in key and rows.schema[c].dataType.typeName() not in ("map",)] or [F.lit(0)]
    # Stored, so that lines are parsed and put in order once, not for each of the passes below.
    own = saved(rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k"), "batch")
    if exists(spark, target):
        chroms = [r[0] for r in own.select("chrom").distinct().limit(1001).collect()]  # of a genome, or all partitions
        have = spark.read.parquet(target)
        if len(chroms) <= 1000:
            have = have.where(F.col("chrom").isin([c for c in chroms if c is not None]) | F.col("chrom").isNull())
        there = have.select(*[F.col(c).alias(f"__{c}") for c in key])
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
        own = saved(own.join(there, on, "left_anti"), "new")
    own.repartitionByRange("chrom", *[c for c in key if c != "chrom"]).write.mode("append").partitionBy("chrom").parquet(target)
    return own.count()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path has files that Spark would read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(at))


def ingest_dir(lines: DataFrame, target: str, checkpoint: str):
    """Loads the lines of files that arrive in a folder into `target`, by chromosome, each site (chrom, pos, id) once. Batches are
    compared with the table itself, so no state grows, also not over restarts, and a batch that is run again adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        add_new(sites_of_lines(rows), target)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sites_of_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).select("chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref", F.array_join("alts", ",").alias("alts"), "qual")
