"""Queries over the event log and other ordered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import ordered as O
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


@R.query("""
WITH k AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders), r AS (SELECT *, md5(o_custkey::VARCHAR) AS key_hash, row_number() OVER (PARTITION BY y ORDER BY md5(o_custkey::VARCHAR), o_custkey) AS sample_rank FROM k)
SELECT * FROM r WHERE sample_rank <= 5
""")
def hash_sample_per_year(spark, sf_dir):
    return O.hash_sample(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey"), ["y"], "o_custkey", 5)


@R.query("""
WITH k AS (SELECT year(o_orderdate) AS y, o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(o_custkey::VARCHAR), o_custkey) AS sample_rank FROM k)
SELECT * FROM r WHERE sample_rank <= 10
""")
def dedup_then_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey", "o_orderkey")
    return O.first_per_key_then_sample(orders, ["y"], "o_custkey", "o_orderkey", 10)


@R.query("""
WITH e AS (SELECT *, ts::DATE AS day FROM events), m AS (SELECT user_id, event_type, max(day) AS day FROM e GROUP BY ALL)
SELECT event_id, user_id, event_type, day, value FROM e JOIN m USING (user_id, event_type, day)
""")
def newest_month_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")
    return O.newest_wins(e, ["user_id", "event_type"], "day")


@R.query("""
WITH d AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'click') AS d, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click') AS event_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS value,
  max((ts, event_id)) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id, event_id, value, e IS NULL OR d > e AS is_current FROM d WHERE d IS NOT NULL
""")
def latest_valid_declaration(spark, sf_dir):
    kind = F.col("event_type")
    return O.latest_declaration(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind == "click", kind == "error", ["event_id", "value"])


@R.query("""
WITH i AS (SELECT user_id, event_type <> 'purchase' AS idle, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, g, count(CASE WHEN idle THEN 1 END) AS run, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS events, max(run) AS longest_streak, arg_max(run, g) AS last_streak FROM r GROUP BY 1
""")
def no_progress_streak(spark, sf_dir):
    return O.longest_streak(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")


@R.query("""
WITH l AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), max(ts) OVER (PARTITION BY user_id)) AS nx FROM events)
SELECT user_id, event_type, ts, event_id, floor(greatest(0, epoch_us(nx) - epoch_us(ts))::DOUBLE / 100000 + 0.5) / 10 AS seconds FROM l
""")
def stage_durations(spark, sf_dir):
    return O.stage_times(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", ["ts", "event_id"])


STAGES = ["view", "click", "signup", "purchase"]


@R.query(f"""
WITH s AS (SELECT unnest({STAGES}) AS event_type, unnest(range({len(STAGES)})) AS place), u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1),
f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, s.event_type, last, first, min(first) OVER (PARTITION BY u.user_id ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nx FROM u CROSS JOIN s LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = s.event_type),
t AS (SELECT *, CASE WHEN nx IS NOT NULL AND (first IS NULL OR nx < first) THEN 'skipped' WHEN first IS NULL THEN 'waiting' WHEN nx IS NOT NULL THEN 'done' ELSE 'running' END AS state FROM g)
SELECT user_id, event_type, state, CASE WHEN state IN ('done', 'running') THEN floor(greatest(0, epoch_us(CASE WHEN state = 'done' THEN nx[1] ELSE last END) - epoch_us(first[1]))::DOUBLE / 100000 + 0.5) / 10 END AS seconds FROM t
""")
def stage_states(spark, sf_dir):
    return O.stage_states(table(spark, sf_dir, "events"), ["user_id"], "event_type", STAGES, "ts", ["ts", "event_id"])


@R.query("""
WITH r AS (SELECT user_id, event_id, ts, length(props) + floor(value)::BIGINT AS size, event_type = 'purchase' AS pinned, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events),
h AS (SELECT *, pinned OR age <= 5 AS held FROM r),
k AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY held DESC, ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM h)
SELECT user_id, event_id, size, kept::BIGINT AS kept_bytes FROM k WHERE kept > 2000 AND NOT held
""")
def evicted_but_pinned(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("size", F.length("props") + F.floor("value"))
    gone = O.evicted(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], "size", 2_000, keep=5, pinned=F.col("event_type") == "purchase")
    return gone.select("user_id", "event_id", "size", "kept_bytes")


@R.query("SELECT event_id, user_id, ts, value, lag(value) OVER w AS before, value - lag(value) OVER w AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def turn_delta(spark, sf_dir):
    return O.turn_deltas(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")


@R.query("""
WITH s AS (SELECT event_id, user_id, json_extract_string(props, '$.k')::INT AS a, json_extract_string(props, '$.k')::INT + floor(value)::BIGINT AS b FROM events)
SELECT s.event_id, s.user_id, s.a, s.b, greatest(0, s.b - s.a - coalesce(sum(CASE WHEN e.event_id IS NOT NULL THEN least(e.b, s.b) - greatest(e.a, s.a) END), 0))::BIGINT AS novel
FROM s LEFT JOIN s e ON e.user_id = s.user_id AND e.event_id < s.event_id AND e.b > s.a AND e.a < s.b GROUP BY s.event_id, s.user_id, s.a, s.b
""")
def novel_span_length(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("a"), (k + F.floor("value")).alias("b"))
    return O.novel_lengths(spans, ["user_id"], "event_id", "a", "b", 50)


@R.query("""
WITH t AS (SELECT conv_id, turn, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM conversations) SELECT conv_id, turn, chars, running::BIGINT AS running FROM t WHERE running <= 1500
""")
def context_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return O.within_budget(turns, ["conv_id"], [F.desc("turn")], "chars", 1500)


@R.query("""
WITH t AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS kept FROM documents) SELECT source, doc_id, n_chars, kept::BIGINT AS kept_bytes FROM t WHERE kept > 100000
""")
def oldest_evicted(spark, sf_dir):
    return O.evicted(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("doc_id")], "n_chars", 100_000)


@R.query("SELECT conv_id, min(CASE WHEN role = 'assistant' THEN turn END) AS first_seq FROM conversations GROUP BY 1")
def first_answer(spark, sf_dir):
    return O.first_when(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant")


@R.query("""
WITH c AS (SELECT p_brand, p_type, p_size, p_partkey, p_retailprice, 's' || (p_partkey % 4) AS hint FROM part),
b AS (SELECT p_brand, p_type, p_size, max(p_retailprice) AS p_retailprice, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, count(*) AS occurrences, string_agg(DISTINCT hint, ',' ORDER BY hint) AS hints FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, occurrences DESC, p_brand, p_type, p_size) AS candidate_rank FROM b)
SELECT * FROM r WHERE candidate_rank <= 12
""")
def dedup_best_candidate(spark, sf_dir):
    c = table(spark, sf_dir, "part").withColumn("hint", F.concat(F.lit("s"), (F.col("p_partkey") % 4).cast("string")))
    return O.best_candidates(c, ["p_brand", "p_type", "p_size"], ["p_brand"], "p_retailprice", "p_partkey", "hint", 12)


@R.query("""
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pref FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY pref, o_orderkey) AS i FROM o) SELECT o_custkey, y, o_orderkey, o_orderstatus, pref FROM r WHERE i = 1
""")
def preference_union(spark, sf_dir):
    pref = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderstatus", pref.alias("pref"))
    return O.preferred(orders, ["o_custkey", "y"], "pref", "o_orderkey")
