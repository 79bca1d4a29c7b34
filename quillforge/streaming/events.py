"""Structured Streaming over files of events: state machines, exact rate limits, first-seen rows.

Events land as immutable files. Each run reads what is new (availableNow), keeps state in its checkpoint, and appends to a
table; replaying all files from an empty checkpoint gives the same table. Entity states do not depend on the order of the
files. Rate limits are exact over the files of one batch in any order; a batch's decisions stay as they are when a later batch
brings earlier events, so all files of a run belong in one batch (files_per_batch = None).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillforge.session import shared_folder, ship_package

#: The time of an event without one, in microseconds.
BEFORE_ALL = -(1 << 62)


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 8) -> DataFrame:
    """A table's files as a stream, under the schema that the table has now; with None all files are one batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all files that are there, each batch once, and return the table so far. With mode update each batch's rows are
    kept as they were then, with batch_id."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/table"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, n: batch.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def first_seen(stream: DataFrame, key: list[str]) -> DataFrame:
    """Each key once: the row with which it came first."""
    return stream.dropDuplicates(key)


def entity_states(stream: DataFrame, entity: str, ts: str, seq: str, kind: str, done: str, failed: str) -> DataFrame:
    """One row per entity and batch in which it had events: n_events, n_done, n_failed, state, last_seq.

    State machine: idle, running after any event, done after a `done` event, failed after a `failed` one; running again after
    any other. state and last_seq are those of the event with the greatest (ts, seq) so far, whichever batch brought it; a null
    ts comes before all others."""
    ship_package(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, n_done, n_failed, name, last, at = state.get if state.exists else (0, 0, 0, "idle", -1, None)
        newest = None if at is None else (at, last)
        for rows in frames:
            times = rows[ts].astype("datetime64[us]")
            times = times.astype("int64").where(times.notna(), BEFORE_ALL)
            for k, s, t in zip(rows[kind], rows[seq], times, strict=True):
                n, n_done, n_failed = n + 1, n_done + (k == done), n_failed + (k == failed)
                if newest is None or (int(t), int(s)) > newest:
                    newest = (int(t), int(s))
                    name = "done" if k == done else "failed" if k == failed else "running"
        at, last = newest
        state.update((n, n_done, n_failed, name, last, at))
        yield pd.DataFrame({entity: [key[0]], "n_events": [n], "n_done": [n_done], "n_failed": [n_failed], "state": [name], "last_seq": [last]})

    kinds = "n_events long, n_done long, n_failed long, state string, last_seq long"
    key = f"{entity} {stream.schema[entity].dataType.simpleString()}"
    return stream.select(entity, ts, seq, kind).groupBy(entity).applyInPandasWithState(step, f"{key}, {kinds}", f"{kinds}, at long", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    columns = [c for c in updates.columns if c not in (*key, "batch_id")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select(*key, "r.*")


def rate_limited(stream: DataFrame, token: str, ts: str, seq: str, limit: int, seconds: float) -> DataFrame:
    """token, seq, ts, accepted: an event is accepted if fewer than `limit` accepted ones lie in the `seconds` before it.

    Rejected events do not count, so this is not a sliding window count. Events of a batch are put in order of (ts, seq), so the
    stream must bring events that may be out of order in one batch. State is at most `limit` times a token."""
    ship_package(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([ts, seq])
        accepted = []
        for t in rows[ts].astype("datetime64[us]").astype("int64"):
            taken = [x for x in taken if x > t - seconds * 1e6]
            accepted.append(len(taken) < limit)
            if accepted[-1]:
                taken.append(int(t))
        state.update((taken,))
        yield pd.DataFrame({token: key[0], seq: rows[seq].to_numpy(), ts: rows[ts].to_numpy(), "accepted": accepted})

    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (token, seq, ts))
    return stream.select(token, ts, seq).groupBy(token).applyInPandasWithState(step, f"{schema}, accepted boolean", "taken array<long>", "append", GroupStateTimeout.NoTimeout)
