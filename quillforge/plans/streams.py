"""Streaming queries over the events, and snapshots written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillforge.plans.registry import Registry
from quillforge.session import shared_folder, table
from quillforge.sources import snapshots as S
from quillforge.streaming import events as E

R = Registry()


@R.query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT user_id, count(*) AS n_events, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_done, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_failed,
  max(CASE WHEN i = 1 THEN CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END END) AS state, max(CASE WHEN i = 1 THEN event_id END) AS last_seq FROM o GROUP BY 1
""")
def stream_entity_states(spark, sf_dir):
    stream = E.stream_table(spark, sf_dir, "events")
    return E.latest(E.run_to_table(E.entity_states(stream, "user_id", "ts", "event_id", "event_type", "purchase", "error"), "update"), ["user_id"])


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    stream = E.stream_table(spark, sf_dir, "events").select("user_id", "event_type")
    return E.run_to_table(E.first_seen(stream, ["user_id", "event_type"]))


@R.query()
def stream_rate_limit(spark, sf_dir):
    """At most 3 accepted events a user in 12 hours; rejected ones do not count, which SQL cannot express without recursion.
    All files are one batch, as the files of a table need not be in order of time."""
    stream = E.stream_table(spark, sf_dir, "events", files_per_batch=None)
    return E.run_to_table(E.rate_limited(stream, "user_id", "ts", "event_id", 3, 12 * 3600))


@R.query("SELECT user_id, min(event_id) AS seq, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def single_flight(spark, sf_dir):
    """One compute per key: the keys are made distinct before the expensive step, and its result is shared by all who wait."""
    return table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("seq"), F.count("*").alias("n"))


@R.query("SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1")
def snapshot_roundtrip(spark, sf_dir):
    """Events as daily shards with a manifest, read back through its verification."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    listed = S.write_shards(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), path, "day", ["event_id"])
    rows, _ = S.verified_scan(spark, path, listed)
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@R.query("""
WITH h AS (SELECT user_id, event_type, substr(ts::DATE::VARCHAR, 1, 7) || CASE WHEN day(ts) <= 15 THEN '-a' ELSE '-b' END AS month, value FROM events), m AS (SELECT user_id, event_type, max(month) AS month FROM h GROUP BY ALL)
SELECT user_id, event_type, month, count(*) AS n, max(value) AS top FROM h JOIN m USING (user_id, event_type, month) GROUP BY ALL
""")
def history_newest(spark, sf_dir):
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.concat(F.date_format("ts", "yyyy-MM"), F.when(F.dayofmonth("ts") <= 15, "-a").otherwise("-b")).alias("half"))
    e.withColumnRenamed("half", "month").repartition("month").write.partitionBy("month").parquet(path)
    return S.read_history(spark, path, ["user_id", "event_type"]).groupBy("user_id", "event_type", "month").agg(F.count("*").alias("n"), F.max("value").alias("top"))
