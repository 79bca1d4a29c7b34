"""What the operators of this subpackage share: inputs, cut points in the shared folder, ranges of an ordering."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.session import BROADCAST_ROWS, sent_if_small, shared_folder, ship_package, shuffle_partitions, table  # noqa: F401

#: Words as the result contracts define them: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tuned(spark: SparkSession, rows: int = 512) -> None:
    """Documents can be long: keep Arrow batches to a few hundred rows, so that a Python task's memory stays bounded."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and a lost executor only repeats
    the tasks that were running. The folder's owner removes it with the application's other checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _constant(values: list[int]) -> Column:
    """An array of longs, as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_bucket(col: Column, bounds: list) -> Column:
    """How many cut points are at or below the value; a null comes after every value.

    Every sqrt(n)-th cut point is compared first, then those of one stretch: about 3 sqrt(n) comparisons a row. The cut
    points are one constant of the plan, however many there are."""
    if not bounds:
        return F.when(col.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = math.isqrt(len(bounds) - 1) + 1

    def at_or_below(cuts: Column) -> Column:
        return F.aggregate(cuts, F.lit(0), lambda n, b: n + F.when(b <= col, 1).otherwise(0))

    cuts, heads = _constant(bounds), at_or_below(_constant(bounds[::step]))
    found = F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * step + at_or_below(F.slice(cuts, (heads - 1) * step + 1, F.lit(step))))
    return F.when(col.isNull(), F.lit(len(bounds) + 1)).otherwise(found)


#: Parts that the rows of one very frequent doc_id, or those without one, are dealt into.
PARTS = 64


def in_ranges(docs: DataFrame, n: int) -> tuple[DataFrame, list[Column]]:
    """docs (doc_id, text) with `_range`, about n ranges of equal counts, and the order of rows inside a range: by doc_id, a
    hash of the text, the text. Ranges in ascending order, so read, give all rows in that order, null doc_ids last.

    Cut points come from an n-point sketch of doc_id. A doc_id that fills ranges of its own is cut by the hash."""
    rows, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    n = max(1, min(n, rows // 64))
    points = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], min(0.1, 0.25 / n)) if n > 1 and known else []
    points = [int(p) for p in points]
    frequent = sorted({p for p, q in zip(points, points[1:]) if p == q})
    part = F.least(F.lit(PARTS - 1), F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * PARTS)).cast("long")
    # a frequent doc_id is a cut point, so its rows come first in their range
    number = range_bucket(F.col("doc_id"), sorted(set(points))).cast("long") * (PARTS + 1)
    many_nulls = (rows - known) * n > rows
    if frequent or many_nulls:
        split = F.col("doc_id").isNull() if many_nulls else F.lit(False)
        split = split | F.coalesce(F.array_contains(_constant(frequent or [0]), F.col("doc_id")) & F.lit(bool(frequent)), F.lit(False))
        number = number + F.when(split, part).otherwise(F.lit(PARTS))
    return docs.withColumn("_range", number), [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]


#: A key that holds at least one of so many rows is hot; there are at most so many hot keys.
HOT_KEYS = 2_000


def join_keys(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left-joined with per_key, which has one row for each value of `key` and in column `n` how many rows hold it.

    Keys that hold at least a HOT_KEYS-th of the total number of rows are sent to all tasks; there can't be more than
    HOT_KEYS. Rows of such keys are then dealt out evenly, under keys of their own that nothing on the right has."""
    values = [c for c in per_key.columns if c != key]
    least = max(2, -(-total // HOT_KEYS))
    hot = per_key.where(F.col(n) >= least).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left").withColumn("_place", F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))).drop("_hot_key")
    cold = per_key.where(F.col(n) < least).select(F.col(key).alias("_cold_key"), F.least(F.col(n), F.lit(-1)).cast("long").alias("_cold_place"), F.struct(*values).alias("_cold"))
    # the right side's place is always -1: a hot row's key and place together are equal to none
    both = marked.join(cold, (marked[key] == F.col("_cold_key")) & (F.col("_place") == F.col("_cold_place")), "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*[rows[c] for c in rows.columns], *[found[c].alias(c) for c in values])
