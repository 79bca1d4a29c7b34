"""Queries that measure runs, resources and agreement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillforge.functions.text import value_shape
from quillforge.operators import metrics as M
from quillforge.plans.registry import Registry
from quillforge.session import shared_folder, table
from quillforge.sources.readers import read_delimited

R = Registry()


@R.query(r"""
WITH t AS (SELECT p_type, CASE p_partkey % 5 WHEN 0 THEN replace(p_retailprice::VARCHAR, '.', ',') WHEN 1 THEN format('{:,}', p_partkey * 7) WHEN 2 THEN p_name WHEN 3 THEN ' ' || p_size || ' ' END AS x FROM part),
n AS (SELECT p_type, x, CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?') THEN replace(trim(x), ',', '')::DOUBLE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+,[0-9]{1,2}') THEN replace(trim(x), ',', '.')::DOUBLE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+(\.[0-9]+)?') THEN trim(x)::DOUBLE END AS v FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM n WHERE v IS NOT NULL),
q AS (SELECT p_type, max(n) AS n, max(CASE WHEN i = round_even((n - 1) * 0.05::DOUBLE, 0) THEN v END) AS p5, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95::DOUBLE, 0) THEN v END) AS p95 FROM r GROUP BY 1)
SELECT c.p_type, n_texts, coalesce(n, 0) AS n, p5, p50, p95 FROM (SELECT p_type, count(x) AS n_texts FROM t GROUP BY 1) c LEFT JOIN q USING (p_type)
""")
def text_distribution(spark, sf_dir):
    k = F.col("p_partkey")
    x = F.when(k % 5 == 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).when(k % 5 == 1, F.format_number(k * 7, 0)).when(k % 5 == 2, F.col("p_name")).when(k % 5 == 3, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    return M.text_distribution(table(spark, sf_dir, "part").select("p_type", x.alias("x")), ["p_type"], "x")


@R.query("""
WITH r AS (SELECT o_orderpriority AS resource, CASE WHEN o_orderkey % 31 = 0 THEN 'n/a' WHEN o_orderkey % 43 = 0 AND o_orderpriority = '1-URGENT' THEN '1/' || o_custkey ELSE o_orderdate::DATE::VARCHAR END AS d, CASE WHEN o_orderkey % 100 >= CASE o_orderpriority WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 19 ELSE 1 END THEN o_custkey END AS k FROM orders),
f AS (SELECT resource, try_cast(d AS DATE) IS NOT NULL AS p, k IS NOT NULL AS k, regexp_replace(regexp_replace(d, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape FROM r),
c AS (SELECT resource, count(*) AS n, count(CASE WHEN p THEN 1 END) AS np, count(CASE WHEN NOT k THEN 1 END) AS nu FROM f GROUP BY 1),
s AS (SELECT resource, shape, count(*) AS c, row_number() OVER (PARTITION BY resource ORDER BY count(*) DESC, shape) AS i FROM f WHERE NOT p GROUP BY 1, 2), l AS (SELECT resource, string_agg(shape || ':' || c, '|' ORDER BY i) AS shapes FROM s WHERE i <= 3 GROUP BY 1)
SELECT c.resource, n, floor(np::DOUBLE / n * 100 * 100 + 0.5) / 100 AS parsed_pct, floor(nu::DOUBLE / n * 100 * 100 + 0.5) / 100 AS unkeyed_pct,
  CASE WHEN np::DOUBLE / n < 0.95 THEN 'unparsed' WHEN nu::DOUBLE / n > CASE WHEN c.resource = '5-LOW' THEN 0.2 ELSE 0.01 END THEN 'unkeyed' ELSE 'ok' END AS verdict, coalesce(shapes, '') AS shapes FROM c LEFT JOIN l USING (resource)
""")
def quality_gate(spark, sf_dir):
    o, kind = F.col("o_orderkey"), F.col("o_orderpriority")
    d = F.when(o % 31 == 0, "n/a").when((o % 43 == 0) & (kind == "1-URGENT"), F.concat(F.lit("1/"), F.col("o_custkey").cast("string"))).otherwise(F.to_date("o_orderdate").cast("string"))
    k = F.when(o % 100 >= F.when(kind == "2-HIGH", 2).when(kind == "5-LOW", 19).otherwise(1), F.col("o_custkey"))
    r = table(spark, sf_dir, "orders").select(kind.alias("resource"), d.alias("d"), k.alias("k"))
    parsed = F.col("d").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.col("d").try_cast("date").isNotNull()
    return M.quality_gate(r, "resource", parsed, F.col("k").isNotNull(), value_shape(F.col("d")), 0.95, {"5-LOW": 0.2}, 0.01, 3)


@R.query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, md5(p_name || '/' || coalesce(p_type, '')) AS mark FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def once_per_tuple(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    mark = F.md5(F.concat("p_name", F.lit("/"), F.coalesce("p_type", F.lit(""))))
    return M.once_per_tuple(lines.join(part, "l_partkey"), ["p_name", "p_type"], "mark", mark).drop("p_name", "p_type")


_RUNS = """
e AS (SELECT conv_id, turn, role, text, length(text) AS chars, CASE WHEN role <> 'system' AND conv_id % 5 <> 0 THEN length(text) * CASE WHEN role = 'user' THEN 1 ELSE 4 END END AS cost FROM conversations),
f AS (SELECT conv_id, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) > 1 AS again FROM e WHERE role = 'user'), p AS (SELECT conv_id, count(CASE WHEN again THEN 1 END) AS repeats FROM f GROUP BY 1),
g AS (SELECT conv_id, count(*) AS events, count(CASE WHEN role = 'user' THEN 1 END) AS asks, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, count(DISTINCT role) AS kinds, sum(chars)::BIGINT AS chars, sum(CASE WHEN role = 'assistant' THEN chars END)::BIGINT AS answer_chars, max(chars) AS longest,
  min(CASE WHEN role = 'assistant' THEN turn END) AS first_answer, count(cost) AS priced, sum(cost)::BIGINT AS cost FROM e GROUP BY 1),
m AS (SELECT g.*, coalesce(repeats, 0) AS repeats, floor(answers::DOUBLE / nullif(asks, 0) * 10000 + 0.5) / 10000 AS answer_rate, floor(coalesce(repeats, 0)::DOUBLE / nullif(asks, 0) * 10000 + 0.5) / 10000 AS repeat_rate, floor(answer_chars::DOUBLE / nullif(answers, 0) * 10000 + 0.5) / 10000 AS mean_answer,
  floor(cost::DOUBLE / nullif(answers, 0) * 10000 + 0.5) / 10000 AS cost_per_answer FROM g LEFT JOIN p USING (conv_id))
"""
METRICS = ["events", "asks", "answers", "chars", "answer_chars", "first_answer", "cost", "repeats", "answer_rate", "repeat_rate", "mean_answer", "cost_per_answer"]


def _metrics(spark, sf_dir):
    role = F.col("role")
    cost = F.when((role != "system") & (F.col("conv_id") % 5 != 0), F.length("text") * F.when(role == "user", 1).otherwise(4))
    return M.run_metrics(table(spark, sf_dir, "conversations").withColumn("cost", cost), "conv_id", "turn", "role", "text", "cost", ["user"], ["assistant"])


@R.query(f"WITH {_RUNS} SELECT * FROM m")
def run_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@R.query(f"""
WITH {_RUNS}, l AS ({" UNION ALL ".join(f"SELECT '{x}' AS metric, {x}::DOUBLE AS v FROM m" for x in METRICS)})
SELECT metric, count(v) AS n, sum(v::DECIMAL(38,6))::DOUBLE AS total, floor(sum(v::DECIMAL(38,6))::DOUBLE / nullif(count(v), 0) * 10000 + 0.5) / 10000 AS mean, median(v) AS median, min(v) AS lowest, max(v) AS highest FROM l GROUP BY 1
""")
def batch_metrics(spark, sf_dir):
    return M.batch_metrics(_metrics(spark, sf_dir), METRICS)


@R.query("""
WITH r AS (SELECT user_id, 'c' || user_id % 4 AS config, count(*) AS n, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1), b AS (SELECT *, unnest([config, 'overall']) AS c FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY ok, c ORDER BY user_id) AS i FROM b)
SELECT c AS config, count(CASE WHEN ok THEN 1 END) AS runs, sum(CASE WHEN ok THEN n END)::BIGINT AS total, floor(avg(CASE WHEN ok THEN n END) * 10000 + 0.5) / 10000 AS mean, median(CASE WHEN ok THEN n END)::DOUBLE AS median, count(CASE WHEN NOT ok THEN 1 END) AS incomplete,
  coalesce(string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (NOT ok AND i <= 5), '') AS incomplete_runs FROM i GROUP BY 1
""")
def stats_by_config(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("event_type") == "purchase").alias("ok"))
    runs = runs.withColumn("config", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
    return M.stats_by_config(runs, "config", "user_id", "n", F.col("ok"), 5)


@R.query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN length(text) % 8 END AS item FROM conversations), f AS (SELECT conv_id, item, min(turn) AS turn FROM t WHERE item IS NOT NULL GROUP BY 1, 2), n AS (SELECT conv_id, turn, count(*) AS k FROM f GROUP BY 1, 2),
s AS (SELECT turn, coalesce(sum(k) OVER (PARTITION BY conv_id ORDER BY turn), 0)::DOUBLE / 8 AS share FROM (SELECT DISTINCT conv_id, turn FROM t) LEFT JOIN n USING (conv_id, turn))
SELECT turn, count(*) AS runs, floor(avg(share) * 10000 + 0.5) / 10000 AS mean_coverage, floor(median(share) * 10000 + 0.5) / 10000 AS median_coverage FROM s GROUP BY 1
""")
def turn_curve(spark, sf_dir):
    return M.turn_curve(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") != "system", F.length("text") % 8), 8)


@R.query("""
WITH q AS (SELECT event_type AS backend, CASE WHEN json_extract_string(props, '$.k')::INT % 4 > 0 THEN json_extract_string(props, '$.k')::INT % 10 + 1 END AS rank, floor(value)::INT AS ms, CASE WHEN event_type <> 'error' THEN user_id % 3 END AS cost, value > 50 AS ok FROM events),
a AS (SELECT backend, count(*) AS queries, count(rank) AS ans, count(CASE WHEN ok THEN 1 END) AS acc, median(rank)::DOUBLE AS median_rank, sum(cost) AS cost, count(cost) AS priced FROM q GROUP BY 1),
r AS (SELECT backend, ms, row_number() OVER (PARTITION BY backend ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY backend) AS n FROM q), p AS (SELECT backend, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0) THEN ms END) AS p50_latency, max(CASE WHEN i = round_even((n - 1) * 0.95::DOUBLE, 0) THEN ms END) AS p95_latency FROM r GROUP BY 1)
SELECT backend, queries, floor(ans::DOUBLE / queries * 10000 + 0.5) / 10000 AS answered, floor(acc::DOUBLE / queries * 10000 + 0.5) / 10000 AS accepted, median_rank, p50_latency, p95_latency, floor(cost::DOUBLE / nullif(priced, 0) * 1000 * 100 + 0.5) / 100 AS cost_per_1000, floor(acc::DOUBLE / nullif(cost, 0) * 10000 + 0.5) / 10000 AS accepted_per_cost FROM a JOIN p USING (backend)
""")
def search_backends(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.when(k % 4 > 0, k % 10 + 1).alias("rank"), F.floor("value").cast("int").alias("ms"), F.when(F.col("event_type") != "error", F.col("user_id") % 3).alias("cost"), (F.col("value") > 50).alias("ok"))
    return M.backend_metrics(q, "backend", "rank", "ms", "cost", F.col("ok"))


@R.query("""
WITH l AS (SELECT o_orderstatus, 'priority' AS facet, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderstatus, 'late', CASE WHEN o_orderkey % 4 = 0 THEN 'late' END FROM orders UNION ALL SELECT o_orderstatus, 'year', year(o_orderdate)::VARCHAR FROM orders),
c AS (SELECT o_orderstatus, facet, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT o_orderstatus, facet, sum(n)::BIGINT AS n, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS counts FROM c GROUP BY 1, 2
""")
def facets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return M.facets(o, ["o_orderstatus"], {"priority": F.col("o_orderpriority"), "late": F.when(F.col("o_orderkey") % 4 == 0, "late"), "year": F.year("o_orderdate")})


@R.query("""
WITH s AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS i FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS total, string_agg(l_partkey::VARCHAR, ',' ORDER BY i) FILTER (i <= 40) AS listed FROM s GROUP BY 1
""")
def capped_lists(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return M.capped(per, ["l_suppkey"], "l_partkey", [F.desc("q"), F.col("l_partkey")], 40)


@R.query(r"""
WITH e AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS seq, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::INT::VARCHAR WHEN 1 THEN ' ' || l_quantity::INT || '.0' WHEN 2 THEN CASE WHEN l_quantity > 25 THEN 'About ' || l_quantity::INT ELSE format('{:,}', l_quantity::INT * 1000) END ELSE l_quantity::INT * 1000 || '.00' END AS x FROM lineitem),
i AS (SELECT *, CASE WHEN regexp_full_match(trim(x), '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?') THEN 'num:' || replace(trim(x), ',', '')::DOUBLE ELSE 'txt:' || lower(trim(x)) END AS id FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, id ORDER BY seq, l_suppkey, x) AS i, count(*) OVER (PARTITION BY l_partkey, id) AS copies FROM i) SELECT l_partkey, count(*) AS facts, sum(copies)::BIGINT AS statements, max(copies) AS most, min(seq) AS first_seq FROM r WHERE i = 1 GROUP BY 1
""")
def fact_dedup(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.when(n % 4 == 0, q.cast("string")).when(n % 4 == 1, F.concat(F.lit(" "), q.cast("string"), F.lit(".0"))).when((n % 4 == 2) & (q > 25), F.concat(F.lit("About "), q.cast("string"))).when(n % 4 == 2, F.format_number(q * 1000, 0)).otherwise(F.concat((q * 1000).cast("string"), F.lit(".00")))
    e = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + n).alias("seq"), text.alias("x"))
    return M.first_of_fact(e, ["l_partkey"], "x", "seq").groupBy("l_partkey").agg(F.count("*").alias("facts"), F.sum("copies").alias("statements"), F.max("copies").alias("most"), F.min("seq").alias("first_seq"))


@R.query("""
WITH v AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::INT // 40 END AS v FROM events), b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT event_type, count(CASE WHEN v = p THEN 1 END) AS agree, count(CASE WHEN v <> p THEN 1 END) AS disagree, count(CASE WHEN v IS NOT NULL AND p IS NULL THEN 1 END) AS no_earlier, count(CASE WHEN v IS NULL THEN 1 END) AS not_stated FROM b GROUP BY 1
""")
def against_earlier(spark, sf_dir):
    v = F.when(F.col("event_type") != "error", F.floor(F.get_json_object("props", "$.k").cast("int") / 40))
    return M.against_earlier(table(spark, sf_dir, "events").withColumn("v", v), ["user_id"], ["ts", "event_id"], "v", ["event_type"])


@R.query("""
WITH r AS (SELECT p_partkey, [p_type, p_brand, CASE WHEN p_size > 25 THEN p_name END] AS a, CASE WHEN p_partkey % 3 > 0 THEN ['small', p_brand, p_type, p_size::VARCHAR] END AS b FROM part), c AS (SELECT p_partkey, list_filter(list_concat(a, coalesce(b, [])), lambda x: x IS NOT NULL) AS l FROM r)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS items FROM c
""")
def united_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a, b = F.array("p_type", "p_brand", F.when(F.col("p_size") > 25, F.col("p_name"))), F.when(F.col("p_partkey") % 3 > 0, F.array(F.lit("small"), "p_brand", "p_type", F.col("p_size").cast("string")))
    return M.united(part, ["p_partkey"], [a, b]).select("p_partkey", F.array_join("items", ",").alias("items"))


_WRITTEN = """w AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE year(o_orderdate)::VARCHAR END AS year, o_orderpriority AS priority, CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS customers FROM orders)"""


def _written(spark, sf_dir):
    """Orders as a delimited file in the shared folder, read back as texts."""
    o = F.col("o_orderkey")
    w = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.when(o % 50 != 0, F.year("o_orderdate").cast("string")).alias("year"), F.col("o_orderpriority").alias("priority"), F.when(o % 20 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customers"))
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    w.write.option("header", True).option("sep", ";").csv(path)
    return M.grouped_sums(read_delimited(spark, path), ["status", "priority"], ["customers"], F.col("year").try_cast("int"), 1998)


@R.query(f"WITH {_WRITTEN} SELECT status, priority, count(*) AS rows, sum(try_cast(customers AS BIGINT))::BIGINT AS customers FROM w WHERE year = '1998' GROUP BY 1, 2")
def delimited_sums(spark, sf_dir):
    return _written(spark, sf_dir)[0]


@R.query(f"WITH {_WRITTEN} SELECT count(CASE WHEN year = '1998' THEN 1 END) AS of_year, count(CASE WHEN year <> '1998' THEN 1 END) AS other_years, count(*) - count(year) AS no_year FROM w")
def delimited_years(spark, sf_dir):
    return _written(spark, sf_dir)[1]
