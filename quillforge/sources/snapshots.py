"""Deterministic partitioned snapshots with a manifest, verified reads, and monthly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.operators.ordered import newest_wins


def write_shards(df: DataFrame, path: str, partition: str | list[str], order: list[str], keep_others: bool = True) -> DataFrame:
    """Write df partitioned by columns, rows in order inside each file, and return the manifest (file, bytes, sha256).

    Partitions that the new data have are replaced as a whole; others stay, or with keep_others false are removed as stale."""
    spark = df.sparkSession
    by = [partition] if isinstance(partition, str) else partition
    (df.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keep_others else "static").partitionBy(*by).parquet(path))
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a data file: its path below the snapshot, bytes and SHA-256, computed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", path.rstrip("/").rsplit("/", 1)[-1] + "/"), -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """file and problem (ok, missing, mismatch, unlisted) of every file in the manifest or in the folder."""
    e = expected.select(F.col("file").alias("f"), F.col("sha256").alias("want"))
    both = manifest(spark, path).join(e, F.col("file") == F.col("f"), "full")
    problem = F.when(F.col("file").isNull(), "missing").when(F.col("f").isNull(), "unlisted").when(F.col("sha256") != F.col("want"), "mismatch").otherwise("ok")
    return both.select(F.coalesce("file", "f").alias("file"), problem.alias("problem"))


def verified_scan(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all files that match the manifest, and the report; files with a problem are left out and listed.

    Only file names come to the driver."""
    report = verify(spark, path, expected)
    good = [f"{path.rstrip('/')}/{r['file']}" for r in report.where("problem = 'ok'").select("file").toLocalIterator()]
    rows = spark.read.option("basePath", path).parquet(*good) if good else None
    return rows, report


def scan(spark: SparkSession, path: str, order: list[str] | None = None, **equal: list) -> DataFrame:
    """Rows whose columns take one of the given values, in order: partition columns prune files, others are pushed into the scan."""
    rows = spark.read.parquet(path)
    for column, values in equal.items():
        rows = rows.where(F.col(column).isin(values))
    return rows.orderBy(*order) if order else rows


def write_month(df: DataFrame, path: str, month: str) -> None:
    """One month of history, replacing what the same month had."""
    df.withColumn("month", F.lit(month)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_history(spark: SparkSession, path: str, identity: list[str]) -> DataFrame:
    """The newest month of each identity; copies inside that month all stay."""
    return newest_wins(spark.read.parquet(path).withColumn("month", F.col("month").cast("string")), identity, "month")


def row_count_check(before: int, now: int, share: float = 0.7) -> None:
    """A build with far fewer rows than the one before is refused."""
    if now < before * share:
        raise ValueError(f"{now} rows after {before}: under {share:.0%}")


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write df as csv (with header), jsonl (nulls left out) or markdown (a table, one part with its own head for each task)."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind == "markdown":
        cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit(""))
        head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        first = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy(F.monotonically_increasing_id())) == 1
        rows = df.select(first.alias("_first"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
        rows.select(F.explode(F.when(F.col("_first"), F.array(*map(F.lit, head), "line")).otherwise(F.array("line"))).alias("value")).write.text(path)
    else:
        raise ValueError(f"no such kind of export: {kind}")
