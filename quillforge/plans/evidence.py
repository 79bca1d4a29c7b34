"""Queries that extract, admit, rank and reuse evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import evidence as V
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()

RULES = {"license_version": (r"(?:version|Version) ([0-9]+(?:\.[0-9]+)?)", 1.0, 4.0), "cc_version": (r"CC BY(?:-NC)? ([0-9]+\.[0-9]+)", 1.0, 4.0), "phone_area": (r"\+1 \(([0-9]{3})\)", 200.0, 799.0)}


def _harvest_sql() -> str:
    each = """SELECT doc_id, line_no, '{f}' AS field, unnest(regexp_extract_all(line, '{p}', 1)) AS raw, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM l"""
    parts = " UNION ALL ".join(each.format(f=f, p=p, lo=lo, hi=hi) for f, (p, lo, hi) in RULES.items())
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), h AS ({parts})
      SELECT doc_id, line_no::INT AS line_no, field, raw, try_cast(raw AS DOUBLE) AS value, try_cast(raw AS DOUBLE) BETWEEN lo AND hi AS plausible FROM h"""


@R.query(_harvest_sql())
def harvest_numbers(spark, sf_dir):
    return V.harvest(table(spark, sf_dir, "documents"), "doc_id", "text", RULES)


@R.query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity > 1900 AS implausible, l_shipdate < o_orderdate AS before_order, l_discount > 0.08 AS policy, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT concat_ws(',', CASE WHEN policy THEN 'policy' END, CASE WHEN implausible THEN 'implausible' END, CASE WHEN before_order THEN 'before_order' END, CASE WHEN duplicate THEN 'duplicate' END) AS reasons,
  CASE WHEN policy THEN 'policy' WHEN implausible THEN 'implausible' WHEN before_order THEN 'before_order' WHEN duplicate THEN 'duplicate' END AS first_reason FROM e)
SELECT reasons, first_reason, count(*) AS n FROM r GROUP BY 1, 2
""")
def admission_reasons(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate")
    copies = F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))
    e = lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("copies", copies)
    rules = {"policy": F.col("l_discount") > 0.08, "implausible": F.col("l_extendedprice") / F.col("l_quantity") > 1900, "before_order": F.col("l_shipdate") < F.col("o_orderdate"), "duplicate": F.col("copies") > 1}
    return e.select(V.reasons(rules).alias("reasons"), V.first_reason(rules).alias("first_reason")).groupBy("reasons", "first_reason").agg(F.count("*").alias("n"))


@R.query("""
SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events
""")
def preceding_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    out = V.preceding(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("value")), "last_click")
    return out.select("event_id", "user_id", "event_type", "last_click")


@R.query("""
WITH w AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT user_id, event_type, max((ts, value)) AS m, arg_max(ts, (ts, value)) AS fts, arg_max(value, (ts, value)) AS fv FROM events WHERE date_diff('day', ts::DATE, DATE '2024-01-30') <= 2 GROUP BY 1, 2)
SELECT user_id, event_type, fts AS fact_ts, fv AS fact_value FROM w LEFT JOIN f USING (user_id, event_type)
""")
def fact_reuse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return V.reusable(e.select("user_id", "event_type", "ts", "value"), e.select("user_id", "event_type").distinct(), ["user_id", "event_type"], "ts", F.lit("2024-01-30").cast("date"), 2)


@R.query("""
WITH c AS (SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS solved, min(role) AS kind FROM conversations GROUP BY 1)
SELECT kind, count(*) AS samples, sum(turns)::BIGINT AS turns, sum(solved)::BIGINT AS solved, floor(sum(solved)::DOUBLE / nullif(sum(turns), 0) * 1000 + 0.5) / 1000 AS ratio FROM c GROUP BY 1 HAVING count(*) >= 5
""")
def cluster_yield(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("solved"), F.min("role").alias("kind"))
    return V.yields(c, ["kind"], "turns", "solved", 5)


@R.query("""
WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
SELECT user_id, count(CASE WHEN gap > 86400000000 THEN 1 END) + 1 AS sessions, floor(max(gap) / 1000000.0)::BIGINT AS longest_gap FROM g GROUP BY 1
""")
def interrupted_runs(spark, sf_dir):
    return V.interrupted(table(spark, sf_dir, "events"), ["user_id"], "ts", 86_400)


@R.query("""
WITH t AS (SELECT p_partkey, p_brand, CASE WHEN p_size = 10 THEN 'exact_size' WHEN p_type LIKE 'E%' THEN 'type_e' WHEN p_name LIKE '%1%' THEN 'name_one' ELSE NULL END AS rule FROM part)
SELECT p_brand, rule, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT p_partkey)), 1, 8), ',') AS examples FROM t GROUP BY 1, 2
""")
def rule_coverage(spark, sf_dir):
    rules = [("exact_size", F.col("p_size") == 10), ("type_e", F.col("p_type").like("E%")), ("name_one", F.col("p_name").like("%1%"))]
    return V.rule_coverage(table(spark, sf_dir, "part"), "p_brand", "p_partkey", rules, 8)


@R.query("""
WITH s AS (SELECT source, count(*) AS documents, count(quality) AS labelled, sum(quality)::BIGINT AS good, median(n_chars)::DOUBLE AS median_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, floor(labelled::DOUBLE / documents * 10000 + 0.5) / 10000 AS labelled_share, floor(good::DOUBLE / nullif(labelled, 0) * 10000 + 0.5) / 10000 AS good_share FROM s
""")
def backend_metrics(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    s = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.sum("quality").alias("good"), F.median("n_chars").alias("median_chars"))
    share = lambda a, b: F.floor(F.col(a) / F.nullif(F.col(b), F.lit(0)) * 10000 + 0.5) / 10000
    return s.select("*", share("labelled", "documents").alias("labelled_share"), share("good", "labelled").alias("good_share"))


@R.query("""
WITH b AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT s, 'TYPE ' || s AS canonical FROM (SELECT DISTINCT p_type AS s FROM part WHERE p_type < 'P'))
SELECT coalesce(canonical, '_unmapped') AS canonical, sum(n)::BIGINT AS rows, count(DISTINCT p_type) AS spellings, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS written FROM b LEFT JOIN m ON p_type = s GROUP BY 1
""")
def make_stats(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mapping = part.where("p_type < 'P'").select("p_type").distinct().withColumn("canonical", F.concat(F.lit("TYPE "), "p_type"))
    both = part.join(F.broadcast(mapping), "p_type", "left")
    return both.groupBy(F.coalesce("canonical", F.lit("_unmapped")).alias("canonical")).agg(F.count("*").alias("rows"), F.countDistinct("p_type").alias("spellings"), F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("written"))


@R.query("""
WITH y AS (SELECT year(o_orderdate) AS y, o_orderstatus AS field, o_custkey FROM orders), t AS (SELECT y, count(*) AS n FROM y GROUP BY 1),
m AS (SELECT y, o_custkey, row_number() OVER (PARTITION BY y ORDER BY count(*) DESC, o_custkey) AS i FROM y GROUP BY y, o_custkey)
SELECT y.y, field, count(*) AS returned, floor(count(*)::DOUBLE / max(n) * 1000 + 0.5) / 10 AS pct, (SELECT string_agg(o_custkey::VARCHAR, ',' ORDER BY i) FROM m WHERE m.y = y.y AND i <= 15) AS top_15 FROM y JOIN t ON t.y = y.y GROUP BY y.y, field
""")
def coverage_by_year(spark, sf_dir):
    from pyspark.sql import Window

    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("field"), "o_custkey")
    total = y.groupBy("y").agg(F.count("*").alias("n"))
    makers = y.groupBy("y", "o_custkey").agg(F.count("*").alias("c"))
    makers = makers.withColumn("i", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("c"), "o_custkey"))).where("i <= 15")
    top = makers.groupBy("y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "o_custkey"))), lambda x: x["o_custkey"].cast("string")), ",").alias("top_15"))
    per = y.groupBy("y", "field").agg(F.count("*").alias("returned"))
    return per.join(total, "y").join(top, "y").select("y", "field", "returned", (F.floor(F.col("returned") / F.col("n") * 1000 + 0.5) / 10).alias("pct"), "top_15")


@R.query()
def closest_names(spark, sf_dir):
    """Matching-block ratios have no SQL form; a test compares them with difflib over all pairs."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_name")
    return V.closest(part, part.withColumnRenamed("p_name", "other"), "p_brand", "p_name", "other", 3)


@R.query("""
WITH t AS (SELECT conv_id, turn, substr(text, 1, 600) AS excerpt FROM conversations WHERE length(trim(text)) > 0),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, excerpt ORDER BY turn) AS copy FROM t),
o AS (SELECT conv_id, excerpt, row_number() OVER w AS place, 1200 - coalesce(sum(length(excerpt)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM u WHERE copy = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, place, substr(excerpt, 1, room::BIGINT) AS excerpt FROM o WHERE place <= 3 AND (length(excerpt) <= room OR room >= 200)
""")
def conversation_excerpts(spark, sf_dir):
    return V.excerpts(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], "text", 3, 1_200, 600)
