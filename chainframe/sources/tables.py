"""Bounded scans, checks of what is read, and snapshot writes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for what jobs hand on: spark.checkpoint.dir, or the checkpoint folder that the caller has set.

    Only where Spark is one process and neither is set, a folder of this machine takes its place; on a cluster that fails.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in the checkpoint folder, for what is read after the call; unlike a checkpoint's, its size is known."""
    path = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of an iteration, as Parquet in the shared checkpoint folder; they are deleted at the end of the block.

    Unlike a checkpoint a table has the size that it has: sizes that are only estimated multiply with every join of every round, until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{checkpoint_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Steps:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def scan_range(df: DataFrame, columns: Sequence[str], position: str, lo: int, hi: int) -> DataFrame:
    """The named columns of rows with lo <= position < hi; both reach the Parquet scan."""
    return df.where((F.col(position) >= lo) & (F.col(position) < hi)).select(*columns)


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, lo: int, hi: int, parts: int, **options: str) -> DataFrame:
    """A remote table in ``parts`` bounded reads along a numeric column."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lo, upperBound=hi, numPartitions=parts, **options)
    return read.load().where((F.col(column) >= lo) & (F.col(column) < hi))


def prune_by_date(df: DataFrame, partition: str, lo: str, hi: str) -> DataFrame:
    """Rows of the date partitions lo to hi, both included."""
    return df.where((F.col(partition) >= F.lit(lo).cast("date")) & (F.col(partition) <= F.lit(hi).cast("date")))


def zone_map(df: DataFrame, partition: str, position: str) -> DataFrame:
    """partition, lo, hi, unplaced: the least and greatest position in each partition, and how many of its rows have none. One row a partition."""
    return df.groupBy(partition).agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count_if(F.col(position).isNull()).alias("unplaced"))


def prune_proven(df: DataFrame, zones: DataFrame, partition: str, position: str, lo: int, hi: int) -> DataFrame:
    """Rows with lo <= position < hi; partitions that the zone map shows to hold none of them are not opened.

    A partition is left out only by what its rows say, not by its name, so a row under a wrong date is found. A partition that the map doesn't name, as it was written later, is
    opened; one that was written to since must be mapped again. The map is one row a partition and is read by the driver, which hands the names of what can be left out to the scan.
    Rows without a position are in no range.
    """
    empty = zones.where(F.col(partition).isNotNull() & (F.col("lo").isNull() | (F.col("hi") < lo) | (F.col("lo") >= hi))).select(partition)
    names = [x[0] for x in empty.collect()]
    rows = df.where(F.coalesce(~F.col(partition).isin(names), F.lit(True))) if names else df
    return rows.where((F.col(position) >= lo) & (F.col(position) < hi))


def read_snapshot(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files joined by column name; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def read_cache(spark: SparkSession, root: str, bucket: str, position: str, lo: int, hi: int, size: int) -> DataFrame:
    """Rows lo <= position < hi of a table partitioned by position // size; other partitions are not opened."""
    df = spark.read.parquet(root)
    return df.where((F.col(bucket) >= lo // size) & (F.col(bucket) <= (hi - 1) // size)).where((F.col(position) >= lo) & (F.col(position) < hi))


def scan_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``; the planner broadcasts the keys only if they are small."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def assert_schema(df: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """df if every expected column is there with one of its allowed types; else fails before anything is read."""
    found = dict(df.dtypes)
    wrong = {c: found.get(c, "missing") for c, kinds in expected.items() if found.get(c) not in kinds}
    if wrong or len(found) != len(df.columns):
        raise ValueError(f"columns don't fit: {wrong or 'a name occurs twice'}")
    return df


def write_snapshot(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """Sorted files in a new folder; fails if it exists."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def write_results(tables: Mapping[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")


def missing_shards(plan: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned shards of which no finished one exists; fails if a key is finished more than once."""
    if done.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("a shard is finished more than once")
    return plan.join(done.select(*on), list(on), "left_anti")


def row_digest(columns: Sequence[str]) -> Column:
    """60 bits of a hash of a row's columns as text, nulls told apart; the order in which the columns are named doesn't matter."""
    whole = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def shard_manifest(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, n, digest: rows of each shard and the sum of their hashes, the same for the same rows in any order. A null is a shard of its own."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.sum(row_digest(df.columns)).alias("digest"))


def compare_shards(planned: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, status of two manifests: REUSE where a finished shard has the planned rows, CHANGED where it has others, MISSING, or EXTRA where nothing is planned."""
    names = list(on)
    one = planned.select(*names, F.struct("n", "digest").alias("_p"))
    two = done.select(*[F.col(c).alias(f"_{c}") for c in names], F.struct("n", "digest").alias("_d"))
    both = one.join(two, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "full_outer")
    status = F.when(F.col("_d").isNull(), "MISSING").when(F.col("_p").isNull(), "EXTRA").when(F.col("_p") == F.col("_d"), "REUSE").otherwise("CHANGED")
    return both.select(*[F.when(F.col("_p").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names], status.alias("status"))


def refresh_shards(source: DataFrame, root: str, on: Sequence[str]) -> DataFrame:
    """Writes the shards of ``source`` that ``root``, partitioned by ``on``, lacks or holds with other rows; returns what was found: on, status.

    A finished shard is reused only if what is on disk now has the rows that are planned. Only partitions that are written change; those that aren't planned stay.
    The status is a checkpoint, taken before anything is written.
    """
    spark = source.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    finished = spark.read.schema(source.schema).parquet(root) if there else source.limit(0)
    status = checkpoint(compare_shards(shard_manifest(source, on), shard_manifest(finished, on), on))
    stale = status.where("status in ('MISSING', 'CHANGED')").select(*[F.col(c).alias(f"_{c}") for c in on])
    rows = source.join(stale, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*on).parquet(root)
    return status


def assert_max_rows(df: DataFrame, limit: int) -> DataFrame:
    """df if it has at most ``limit`` rows; else fails. Never cuts. Tasks count what they read; see write_guarded() for a count on the way."""
    if df.count() > limit:
        raise ValueError(f"more than {limit} rows")
    return df


def write_guarded(df: DataFrame, path: str, most_rows: int, rules: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Writes df to a new folder if it has at most ``most_rows`` rows and no row breaks a rule; else fails and leaves nothing.

    ``rules``: name -> what may not hold of a row. All is counted while rows are written, without a second read; the counts are returned. The folder gets its name last.
    """
    spark, seen = df.sparkSession, Observation()
    broken = {name: F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in (rules or {}).items()}
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *broken.values())
    whole, made = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-{uuid.uuid4().hex}"))
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(whole):
        raise ValueError(f"{path} exists")
    watched.write.parquet(made.toString())
    counts = dict(seen.get)
    wrong = [name for name in broken if counts[name]]
    if counts["rows"] > most_rows or wrong:
        fs.delete(made, True)
        raise ValueError(f"{counts['rows']} rows of at most {most_rows}, broken: {wrong}")
    fs.rename(made, whole)
    return counts
