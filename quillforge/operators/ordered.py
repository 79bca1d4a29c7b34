"""Operators over an order: samples, newest-wins, streaks, stage times, spans, budgets, pages.

Each partitions by an entity; none sorts a whole table in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.session import shared_folder


def hash_sample(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The n distinct keys of each group that come first by md5: the same on every run and in every engine."""
    distinct = df.select(*by, key).distinct().withColumn("key_hash", F.md5(F.col(key).cast("string")))
    w = Window.partitionBy(*by).orderBy("key_hash", key)
    return distinct.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def first_per_key_then_sample(df: DataFrame, by: list[str], key: str, record: str, n: int) -> DataFrame:
    """One row per (group, key), that of the smallest record; then n keys of each group by md5."""
    one = df.groupBy(*by, key).agg(F.min(record).alias(record))
    w = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string")), key)
    return one.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def newest_wins(df: DataFrame, identity: list[str], period: str) -> DataFrame:
    """All rows of each identity's newest period; copies inside that period all stay."""
    newest = df.groupBy(*identity).agg(F.max(period).alias("_newest"))
    return df.join(newest, identity).where(F.col(period) == F.col("_newest")).drop("_newest")


def latest_declaration(df: DataFrame, entity: list[str], seq: list[str], declares: Column, evidence: Column, columns: list[str]) -> DataFrame:
    """Per entity the last declaring row's columns, and is_current: no evidence came after it."""
    order = F.struct(*seq)
    agg = df.groupBy(*entity).agg(F.max(F.when(declares, F.struct(order.alias("o"), F.struct(*columns).alias("d")))).alias("_d"), F.max(F.when(evidence, order)).alias("_e"))
    return agg.where("_d IS NOT NULL").select(*entity, "_d.d.*", (F.col("_e").isNull() | (F.col("_d.o") > F.col("_e"))).alias("is_current"))


def longest_streak(df: DataFrame, entity: list[str], seq: list[str], progress: Column) -> DataFrame:
    """Per entity: events, the longest run of rows without progress, and the run at the end."""
    w = Window.partitionBy(*entity).orderBy(*seq)
    island = F.sum(F.when(progress, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("_island", island).groupBy(*entity, "_island").agg(F.count(F.when(~progress, 1)).alias("_run"), F.count("*").alias("_all"))
    return runs.groupBy(*entity).agg(F.sum("_all").alias("events"), F.max("_run").alias("longest_streak"), F.max_by("_run", "_island").alias("last_streak"))


def stage_times(df: DataFrame, entity: list[str], stage: str, ts: str, seq: list[str]) -> DataFrame:
    """Each row starts a stage that the next row of the entity ends; the last ends at the entity's last time. Seconds, 1 digit."""
    w = Window.partitionBy(*entity).orderBy(*seq)
    last = F.max(ts).over(Window.partitionBy(*entity))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    length = F.greatest(F.lit(0), micros(F.coalesce(F.lead(ts).over(w), last)) - micros(F.col(ts)))
    return df.withColumn("seconds", F.floor(length / 100000 + 0.5) / 10).select(*entity, stage, *seq, "seconds")


def turn_deltas(df: DataFrame, entity: list[str], seq: list[str], value: str) -> DataFrame:
    """Each row with the value before it and the change; null before the first."""
    before = F.lag(value).over(Window.partitionBy(*entity).orderBy(*seq))
    return df.withColumn("before", before).withColumn("change", F.col(value) - before)


def novel_lengths(df: DataFrame, entity: list[str], seq: str, begin: str, end: str, width: int) -> DataFrame:
    """Each span's length less its overlap with every earlier span of the entity (not merged: what is covered twice is
    taken off twice), at least 0.

    Spans are put into stretches of `width` and meet in the first stretch that both reach, so only spans that lie near each
    other are paired. (entity, seq) names a span."""
    cell = lambda x: F.floor(x / width)
    cells = df.where(F.col(end) > F.col(begin)).withColumn("_from", cell(F.col(begin))).withColumn("_cell", F.explode(F.sequence(cell(F.col(begin)), cell(F.col(end) - 1))))
    earlier = cells.select(*[F.col(e).alias(f"_{e}") for e in entity], F.col(seq).alias("_seq"), F.col(begin).alias("_a"), F.col(end).alias("_b"), F.col("_from").alias("_from_b"), F.col("_cell").alias("_cell_b"))
    on = (F.col("_cell") == F.col("_cell_b")) & (F.col("_seq") < F.col(seq)) & (F.col("_cell") == F.greatest("_from", "_from_b"))
    for e in entity:
        on = on & (F.col(e) == F.col(f"_{e}"))
    pairs = cells.join(earlier, on & (F.col("_b") > F.col(begin)) & (F.col("_a") < F.col(end)))
    taken = pairs.groupBy(*entity, seq).agg(F.sum(F.least("_b", end) - F.greatest("_a", begin)).alias("_taken"))
    out = df.join(taken, [*entity, seq], "left")
    return out.select(*df.columns, F.greatest(F.lit(0), F.col(end) - F.col(begin) - F.coalesce("_taken", F.lit(0))).alias("novel"))


def stage_states(df: DataFrame, entity: list[str], stage: str, stages: list[str], ts: str, seq: list[str]) -> DataFrame:
    """For every entity and stage: state and seconds (one digit, never negative).

    The first event of a stage starts it. The start of a later stage ends every earlier one that runs, and what has not
    begun by then is skipped for good. A stage that no later one ends is running, up to the entity's last event; stages that
    wait or are skipped have no seconds."""
    order = F.struct(*seq)
    events = df.where(F.col(stage).isin(stages))
    firsts = events.groupBy(*entity, stage).agg(F.min(F.struct(order.alias("o"), F.col(ts).alias("t"))).alias("first"))
    last = df.groupBy(*entity).agg(F.max(ts).alias("_last"))
    grid = last.select(*entity, "_last", F.posexplode(F.array(*map(F.lit, stages))).alias("_place", stage))
    both = grid.join(firsts, [*entity, stage], "left")
    later = Window.partitionBy(*entity).orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_next", F.min("first").over(later))
    begun, ended = F.col("first").isNotNull(), F.col("_next").isNotNull()
    state = F.when(ended & (~begun | (F.col("_next.o") < F.col("first.o"))), "skipped").when(~begun, "waiting").when(ended, "done").otherwise("running")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    length = F.greatest(F.lit(0), micros(F.when(state == "done", F.col("_next.t")).otherwise(F.col("_last"))) - micros(F.col("first.t")))
    return both.select(*entity, stage, state.alias("state"), F.when(state.isin("done", "running"), F.floor(length / 100000 + 0.5) / 10).alias("seconds"))


def within_budget(df: DataFrame, entity: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The rows of each entity taken in order until their sizes exceed the budget (the prefix rule)."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def evicted(df: DataFrame, entity: list[str], age_order: list[Column], size: str, cap: int, keep: int = 0, pinned: Column | None = None) -> DataFrame:
    """The rows of each entity that go, oldest first, so that what stays fits the cap. The newest `keep` rows and pinned ones
    never go, but their sizes count."""
    upto = Window.partitionBy(*entity).orderBy(*age_order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    # pinned rows stay whatever their age: they come before all others when room is dealt out
    room = Window.partitionBy(*entity).orderBy(F.desc("_held"), *age_order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_age", F.row_number().over(upto)).withColumn("_held", held | (F.col("_age") <= keep))
    return rows.withColumn("kept_bytes", F.sum(size).over(room)).where((F.col("kept_bytes") > cap) & ~F.col("_held")).drop("_age", "_held")


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page (limit 1 to 200, offset from 0) with the exact total on each row."""
    limit, offset = min(max(limit, 1), 200), max(offset, 0)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def first_when(df: DataFrame, entity: list[str], seq: str, condition: Column) -> DataFrame:
    """Per entity the smallest seq at which the condition holds; null if never."""
    return df.groupBy(*entity).agg(F.min(F.when(condition, F.col(seq))).alias("first_seq"))


def preferred(df: DataFrame, key: list[str], preference: str, tie: str) -> DataFrame:
    """One row per key: the smallest preference, then tie."""
    w = Window.partitionBy(*key).orderBy(preference, tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_candidates(df: DataFrame, key: list[str], group: list[str], score: str, tie: str, hints: str, n: int) -> DataFrame:
    """Per key the best-scored row's score and tie value, its occurrences and the union of hints; then n keys a group."""
    best = df.groupBy(*key).agg(F.max(score).alias(score), F.min_by(tie, F.struct(-F.col(score), tie)).alias(tie), F.count("*").alias("occurrences"), F.array_join(F.sort_array(F.collect_set(hints)), ",").alias("hints"))
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.desc("occurrences"), *key)
    return best.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= n)


def positions(df: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """df with position, from 1, in the order of all its rows, which no task sees as a whole: rows are dealt into ranges of the
    order, written in the shared folder, counted, and numbered inside their range. Rows equal in the order are numbered
    arbitrarily."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + F.col("_i")).select(*df.columns, "position")


def liveness(events: DataFrame, run: str, ts: str, begins: Column, ends: Column, now: Column, fresh_seconds: int) -> DataFrame:
    """run, state, quiet_seconds: finished (its last event ends it), active (the last event is fresh), orphan (it never began),
    interrupted; the first that applies."""
    last = F.struct(F.col(ts).alias("t"), F.coalesce(ends, F.lit(False)).alias("e"))
    per = events.groupBy(run).agg(F.max(last).alias("_l"), F.max(F.coalesce(begins, F.lit(False))).alias("_b"))
    quiet = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_l.t").cast("timestamp"))) / 1_000_000)
    state = F.when(F.col("_l.e"), "finished").when(quiet <= fresh_seconds, "active").when(~F.col("_b"), "orphan").otherwise("interrupted")
    return per.select(run, state.alias("state"), quiet.alias("quiet_seconds"))
