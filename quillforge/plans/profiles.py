"""Statistics by group: profiles, ranks, majorities, cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.functions.text import value_shape
from quillforge.operators import metrics as M
from quillforge.operators import aggregates as A
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


@R.query("""
WITH l AS (SELECT p_brand, p_type, l_extendedprice AS v, CASE WHEN l_quantity > 0 THEN l_quantity ELSE 1.0 END AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT p_brand, p_type, v, sum(w) OVER (PARTITION BY p_brand, p_type ORDER BY v) AS run, sum(w) OVER (PARTITION BY p_brand, p_type) / 2 AS half FROM l)
SELECT a.p_brand, a.p_type, a.rows, a.weight, min(CASE WHEN run >= half THEN v END) AS l_extendedprice_median, min(v) AS l_extendedprice_min, max(v) AS l_extendedprice_max
FROM r JOIN (SELECT p_brand, p_type, count(*) AS rows, sum(w) AS weight FROM l GROUP BY ALL) a USING (p_brand, p_type) GROUP BY ALL
""")
def weighted_median_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    return A.weighted_profile(lines.join(part, lines.l_partkey == part.p_partkey), ["p_brand", "p_type"], ["l_extendedprice"], "l_quantity")


def _delays(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select("o_orderpriority", "l_returnflag", F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))


_DELAYS = "SELECT o_orderpriority, l_returnflag, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@R.query(f"""
WITH d AS ({_DELAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, l_returnflag ORDER BY days) AS i, count(*) OVER (PARTITION BY o_orderpriority, l_returnflag) AS n FROM d)
SELECT o_orderpriority, l_returnflag, max(n) AS n, max(CASE WHEN i = greatest(1, ceil(n * 0.25)) THEN days END) AS p25, max(CASE WHEN i = greatest(1, ceil(n * 0.5)) THEN days END) AS p50,
  max(CASE WHEN i = greatest(1, ceil(n * 0.75)) THEN days END) AS p75 FROM r GROUP BY ALL
""")
def nearest_rank_ages(spark, sf_dir):
    return A.nearest_rank(_delays(spark, sf_dir), ["o_orderpriority", "l_returnflag"], "days", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@R.query(f"""
WITH d AS ({_DELAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY days) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM d)
SELECT o_orderpriority, max(n) AS n, max(CASE WHEN i = round_even((n - 1) * 0.05::DOUBLE, 0) THEN days END) AS p5, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0) THEN days END) AS p50,
  max(CASE WHEN i = round_even((n - 1) * 0.95::DOUBLE, 0) THEN days END) AS p95 FROM r GROUP BY ALL
""")
def rounded_index_percentiles(spark, sf_dir):
    return A.rounded_index(_delays(spark, sf_dir), ["o_orderpriority"], "days", {"p5": 0.05, "p50": 0.5, "p95": 0.95})


_VOTES = """
v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes FROM orders GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY o_custkey)::BIGINT AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority) AS rank FROM v)
"""


@R.query(f"""
WITH {_VOTES}
SELECT o_custkey, max(CASE WHEN rank = 1 THEN o_orderpriority END) AS majority, max(votes) AS majority_n, max(n) AS n, floor(max(votes)::DOUBLE / max(n) * 10000 + 0.5) / 10000 AS share,
  string_agg(CASE WHEN rank <= 3 THEN o_orderpriority || ':' || votes END, '|' ORDER BY rank) AS top_values FROM r GROUP BY o_custkey
""")
def majority_topk(spark, sf_dir):
    return A.majority(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@R.query(f"""
WITH {_VOTES}, s AS (SELECT o_custkey, max(n) AS n, max(votes) AS votes, max(CASE WHEN rank = 1 THEN o_orderpriority END) AS a, max(CASE WHEN rank = 2 THEN o_orderpriority END) AS b FROM r GROUP BY o_custkey)
SELECT o_custkey, n, CASE WHEN votes::DOUBLE / n >= 0.4 THEN a END AS standard, CASE WHEN NOT votes::DOUBLE / n >= 0.4 THEN concat_ws('|', a, b) END AS alternatives FROM s WHERE n >= 5
""")
def majority_threshold(spark, sf_dir):
    return A.majority_decision(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", 5, 0.4)


@R.query("""
WITH v AS (SELECT p_brand, p_type, count(*) AS votes FROM part GROUP BY ALL), r AS (SELECT *, sum(votes) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, p_type) AS k FROM v)
SELECT p_brand, p_type AS dominant, votes, floor(votes::DOUBLE / n * 10000 + 0.5) / 10000 AS share FROM r WHERE k = 1
""")
def dominant_value(spark, sf_dir):
    return A.dominant(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


def _profile_sql(columns: list[str], weight: str, source: str) -> str:
    one = """SELECT '{c}' AS column_name, CASE WHEN count(v) = 0 THEN 'empty' ELSE 'mapped' END AS state,
      CASE WHEN count(v) = 0 THEN NULL WHEN count(try_cast(v AS DOUBLE)) = 0 THEN 'TEXT' WHEN count(try_cast(v AS DOUBLE)) < count(v) THEN 'MIXED' WHEN count(CASE WHEN NOT regexp_matches(v, '^[+-]?[0-9]+$') THEN 1 END) > 0 THEN 'REAL' ELSE 'INTEGER' END AS value_type,
      floor((count(*) - count(v))::DOUBLE / count(*) * 100 * 10 + 0.5) / 10 AS null_pct, count(DISTINCT v) AS distinct_values,
      floor(sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) / sum(w) * 100 * 10 + 0.5) / 10 AS weighted_pct
      FROM (SELECT nullif(trim({c}::VARCHAR), '') AS v, CASE WHEN {w} > 0 THEN {w}::DOUBLE ELSE 0.0 END AS w FROM {s})"""
    return " UNION ALL ".join(one.format(c=c, w=weight, s=source) for c in columns)


@R.query(_profile_sql(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "o_custkey", "orders"))
def column_profile(spark, sf_dir):
    return A.column_profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "o_custkey")


@R.query("""
SELECT regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT regexp_replace(regexp_replace(props, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g'), event_type, count(*) FROM events GROUP BY ALL
""")
def value_shapes(spark, sf_dir):
    names = table(spark, sf_dir, "customer").groupBy(value_shape(F.col("c_name")).alias("shape"), "c_mktsegment").agg(F.count("*").alias("n"))
    props = table(spark, sf_dir, "events").groupBy(value_shape(F.col("props")).alias("shape"), F.col("event_type").alias("c_mktsegment")).agg(F.count("*").alias("n"))
    return names.unionByName(props)


@R.query("""
WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT y, n::DOUBLE / sum(n) OVER () AS share FROM c) SELECT min(y) AS coverage_start FROM s WHERE share >= 0.15
""")
def coverage_start(spark, sf_dir):
    return A.coverage_start(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y", 0.15)


_COHORTS = """
x AS (SELECT l_orderkey, min(year(l_shipdate)) AS end_year FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
m AS (SELECT o_orderpriority, year(o_orderdate) AS cohort, end_year, end_year IS NOT NULL AS cancelled, CASE WHEN end_year >= year(o_orderdate) THEN end_year - year(o_orderdate) END AS age FROM orders LEFT JOIN x ON o_orderkey = l_orderkey),
cs AS (SELECT min(cohort) AS coverage_start FROM (SELECT cohort, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM m GROUP BY 1) WHERE share >= 0.1),
ref AS (SELECT max(cohort) + 1 AS ref_year FROM m),
a AS (SELECT o_orderpriority, cohort, count(*) AS size, count(CASE WHEN cancelled THEN 1 END) AS cancelled, count(CASE WHEN cancelled AND end_year IS NOT NULL THEN 1 END) AS dated, count(CASE WHEN cancelled AND end_year < cohort THEN 1 END) AS bad_dates,
  count(CASE WHEN age <= 0 THEN 1 END) AS a0, count(CASE WHEN age <= 1 THEN 1 END) AS a1, count(CASE WHEN age <= 2 THEN 1 END) AS a2, count(CASE WHEN age <= 3 THEN 1 END) AS a3, count(CASE WHEN age <= 4 THEN 1 END) AS a4, count(CASE WHEN age <= 5 THEN 1 END) AS a5,
  quantile_disc(age, 0.25) AS p25, quantile_disc(age, 0.5) AS p50, quantile_disc(age, 0.75) AS p75 FROM m GROUP BY ALL),
s AS (SELECT *, CASE WHEN size < 430 THEN 'cohort_too_small' WHEN cohort < coverage_start THEN 'before_coverage' WHEN cancelled > 0 AND dated::DOUBLE / cancelled < 0.95 THEN 'undated' ELSE 'served' END AS status FROM a, cs, ref)
"""


def _cohorts(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min(F.year("l_shipdate")).alias("end_year"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("cohort"))
    members = orders.join(ends, orders.o_orderkey == ends.l_orderkey, "left").withColumn("is_cancelled", F.col("end_year").isNotNull())
    start = A.coverage_start(orders, "cohort", 0.1)
    start = start.crossJoin(orders.agg((F.max("cohort") + 1).alias("last")))
    return A.cohort_survival(members, ["o_orderpriority"], "cohort", "end_year", "is_cancelled", F.col("last"), range(6), 430, start)


@R.query(f"""
WITH {_COHORTS}
SELECT o_orderpriority, cohort, size, cancelled, dated, bad_dates, status, p25, p50, p75,
  concat_ws('|', CASE WHEN ref_year - cohort >= 1 THEN '0:' || (floor(a0::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END, CASE WHEN ref_year - cohort >= 2 THEN '1:' || (floor(a1::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END,
    CASE WHEN ref_year - cohort >= 3 THEN '2:' || (floor(a2::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END, CASE WHEN ref_year - cohort >= 4 THEN '3:' || (floor(a3::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END,
    CASE WHEN ref_year - cohort >= 5 THEN '4:' || (floor(a4::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END, CASE WHEN ref_year - cohort >= 6 THEN '5:' || (floor(a5::DOUBLE / size * 10000 + 0.5) / 10000)::DECIMAL(9,4) END) AS shares
FROM s WHERE status = 'served'
""")
def cohort_survival(spark, sf_dir):
    return _cohorts(spark, sf_dir).where("status = 'served'")


@R.query(f"WITH {_COHORTS} SELECT o_orderpriority, cohort, size, cancelled, status FROM s WHERE status <> 'served'")
def cohort_withheld(spark, sf_dir):
    return _cohorts(spark, sf_dir).where("status <> 'served'").select("o_orderpriority", "cohort", "size", "cancelled", "status")


@R.query("""
WITH t AS (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS unit FROM lineitem), g AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM t GROUP BY 1)
SELECT CASE WHEN d = 1 THEN '1' WHEN d <= 3 THEN '2-3' ELSE '>3' END AS bucket, count(*) AS keys, sum(n)::BIGINT AS rows FROM g GROUP BY 1
""")
def distinct_buckets(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("d"))
    bucket = F.when(F.col("d") == 1, "1").when(F.col("d") <= 3, "2-3").otherwise(">3")
    return per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


@R.query("""
WITH o AS (SELECT l_partkey, l_returnflag AS source, CASE l_linenumber % 2 WHEN 0 THEN 'size' ELSE 'type' END AS field, l_linestatus AS route, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN (l_quantity::INT % 25 + 1)::VARCHAR ELSE CASE WHEN l_suppkey % 9 > 0 THEN p_type ELSE 'OTHER' END END AS offer, p_size::VARCHAR AS size, CASE WHEN p_partkey % 10 > 0 THEN p_type END AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT source, field, route, offer, CASE field WHEN 'size' THEN size ELSE type END AS truth FROM o), g AS (SELECT source, field, route, count(*) AS runs, count(CASE WHEN offer = truth THEN 1 END) AS agree, count(CASE WHEN offer <> truth THEN 1 END) AS disagree, count(CASE WHEN offer IS NULL THEN 1 END) AS no_offer FROM t WHERE truth IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, agree >= 5 AND disagree * 8 <= agree AS proposed FROM g
""")
def agreement_tally(spark, sf_dir):
    """What lines say of their part, by source, field and route, against what the part's own row says."""
    n = F.col("l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_type")).alias("type"), "p_type")
    field = F.when(n % 2 == 0, "size").otherwise("type")
    offer = F.when(n == 7, None).when(n % 2 == 0, (F.col("l_quantity").cast("int") % 25 + 1).cast("string")).otherwise(F.when(F.col("l_suppkey") % 9 > 0, F.col("p_type")).otherwise("OTHER"))
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_returnflag").alias("source"), field.alias("field"), F.col("l_linestatus").alias("route"), offer.alias("offer"), F.when(field == "size", F.col("size")).otherwise(F.col("type")).alias("truth"))
    return M.agreement(rows, ["source", "field", "route"], "offer", "truth", 5, 8)


@R.query("""
WITH u AS (SELECT event_type, user_id, count(*) AS n, sum(value::DECIMAL(18,4)) AS total FROM events GROUP BY ALL),
o AS (SELECT coalesce(event_type, 'overall') AS config, count(*) AS runs, sum(n)::BIGINT AS n, sum(total)::DOUBLE AS total, avg(n) AS mean_n, median(n) AS median_n FROM u GROUP BY ROLLUP (event_type))
SELECT config, runs, n, total, floor(mean_n * 10000 + 0.5) / 10000 AS mean_n, median_n::DOUBLE AS median_n FROM o
""")
def run_stats_by_config(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    stats = runs.rollup("event_type").agg(F.count("*").alias("runs"), F.sum("n").alias("all"), F.sum("total").cast("double").alias("total"), A.half_up(F.avg("n"), 4).alias("mean_n"), F.median("n").alias("median_n"))
    return stats.select(F.coalesce("event_type", F.lit("overall")).alias("config"), "runs", F.col("all").alias("n"), "total", "mean_n", "median_n")


@R.query("""
WITH p(event_type, price) AS (VALUES ('click', 2), ('view', 1), ('purchase', 30), ('signup', 12))
SELECT event_type, count(*) AS calls, sum(length(props))::BIGINT AS units, sum(length(props) * price)::BIGINT AS cost FROM events LEFT JOIN p USING (event_type) GROUP BY 1
""")
def usage_cost(spark, sf_dir):
    prices = spark.createDataFrame([("click", 2), ("view", 1), ("purchase", 30), ("signup", 12)], "event_type string, price int")
    e = table(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.length("props")).alias("units"), F.sum(F.length("props") * F.col("price")).alias("cost"))
