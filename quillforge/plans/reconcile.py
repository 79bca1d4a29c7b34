"""Queries that reconcile what was read with what should be there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillforge.operators.aggregates import join_null_safe
from quillforge.plans.registry import Registry
from quillforge.session import table
from quillforge.sources.html import visible_text
from quillforge.sources.readers import challenge_page

R = Registry()


@R.query("""
WITH p AS (SELECT event_id // 1000 AS page, count(*) AS n FROM events GROUP BY 1), t AS (SELECT count(*) AS total FROM events)
SELECT count(*) AS pages, sum(n)::BIGINT AS rows, max(total) AS total, sum(n) = max(total) AS exact, abs(sum(n) - max(total))::DOUBLE / max(total) <= 0.02 AS near, arg_max(n, page) < 1000 AS ended_short FROM p, t
""")
def paged_completeness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    pages = e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.count("*").alias("n"))
    one = pages.agg(F.count("*").alias("pages"), F.sum("n").alias("rows"), F.max_by("n", "page").alias("last"))
    total = e.agg(F.count("*").alias("total"))
    both = one.crossJoin(F.broadcast(total))  # one row each
    return both.select("pages", "rows", "total", (F.col("rows") == F.col("total")).alias("exact"), (F.abs(F.col("rows") - F.col("total")) / F.col("total") <= 0.02).alias("near"), (F.col("last") < 1000).alias("ended_short"))


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('R', 'F'), ('A', 'F')) d(f, s) WHERE f = l_returnflag AND s = l_linestatus) GROUP BY 1, 2")
def dictionary_check(spark, sf_dir):
    known = spark.createDataFrame([("R", "F"), ("A", "F")], "l_returnflag string, l_linestatus string")
    used = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(known), ["l_returnflag", "l_linestatus"], "left_anti")


@R.query("""
WITH m AS (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING count(*) >= 13), u AS (SELECT p_brand, p_type, count(*) AS n FROM part ANTI JOIN m USING (p_brand, p_type) GROUP BY 1, 2)
SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM u
""")
def mapping_unresolved(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    rest = part.join(part.where("n >= 13").select("p_brand", "p_type"), ["p_brand", "p_type"], "left_anti")
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))


@R.query("""
WITH v AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_type END AS v FROM part)
SELECT p_partkey, v, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN v IS NULL THEN 0 WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END, try_cast(v AS DOUBLE) NULLS FIRST, v NULLS FIRST, p_partkey) AS place FROM v
""")
def typed_order(spark, sf_dir):
    """Null before number before text; numbers by value."""
    k = F.col("p_partkey") % 3
    v = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.col("p_type")).alias("v"))
    number = F.expr("try_cast(v as double)")
    tag = F.when(F.col("v").isNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    w = Window.partitionBy("p_brand").orderBy(tag, number.asc_nulls_first(), F.col("v").asc_nulls_first(), "p_partkey")
    return v.select("p_partkey", "v", F.row_number().over(w).alias("place"))


@R.query("""
WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders GROUP BY 1)
SELECT c_custkey, 1995 + c_nationkey % 9 AS target_year, CASE WHEN lo IS NULL THEN 'no_catalogue' WHEN 1995 + c_nationkey % 9 BETWEEN lo - 1 AND hi + 1 THEN 'in_period' ELSE 'out_of_period' END AS status FROM customer LEFT JOIN c ON o_custkey = c_custkey
""")
def period_gate(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    t = table(spark, sf_dir, "customer").select("c_custkey", (F.lit(1995) + F.col("c_nationkey") % 9).alias("target_year"))
    both = t.join(c, t.c_custkey == c.o_custkey, "left")
    status = F.when(F.col("lo").isNull(), "no_catalogue").when(F.col("target_year").between(F.col("lo") - 1, F.col("hi") + 1), "in_period").otherwise("out_of_period")
    return both.select("c_custkey", "target_year", status.alias("status"))


@R.query("""
WITH l AS (SELECT o_custkey, max(o_orderdate)::DATE AS newest FROM orders GROUP BY 1) SELECT o_custkey, newest, date_diff('day', newest, DATE '2001-08-01') AS age_days, date_diff('day', newest, DATE '2001-08-01') > 730 AS stale FROM l
""")
def stale_publications(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("newest"))
    age = F.date_diff(F.lit("2001-08-01").cast("date"), F.col("newest"))
    return newest.select("o_custkey", "newest", age.alias("age_days"), (age > 730).alias("stale"))


@R.query("""
WITH a AS (SELECT p_brand, p_type, sum(p_size)::BIGINT AS sizes FROM part WHERE p_size <= 30 GROUP BY 1, 2), b AS (SELECT p_brand, p_type, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS prices FROM part WHERE p_size > 20 AND p_size < 24 GROUP BY 1, 2)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_type, b.p_type) AS p_type, sizes, prices FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_type = b.p_type
""")
def split_query_rejoin(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.where("p_size <= 30").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("sizes"))
    b = part.where("p_size > 20 AND p_size < 24").groupBy("p_brand", "p_type").agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("prices"))
    return a.join(b, ["p_brand", "p_type"], "full")


@R.query("""
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, NULL, p_brand FROM part
""")
def mixed_version_union(spark, sf_dir):
    """Rows of several versions of a table: columns are united, what a version lacks is null."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return c.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@R.query("""
WITH a AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)
SELECT length(t) < 1500 AS short, length(t) < 1500 AND regexp_matches(t, '(?i)captcha|verify you are human|access denied|enable javascript|attention required') AS challenge, count(*) AS n FROM a GROUP BY ALL
""")
def challenge_pages(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(visible_text(F.col("html")).alias("t"))
    return t.groupBy((F.length("t") < 1500).alias("short"), challenge_page(F.col("t"), 1500).alias("challenge")).agg(F.count("*").alias("n"))


@R.query("""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), f(field, term) AS (VALUES ('license', 'license'), ('email', '@mail'), ('password', 'password='), ('phone', '+1 ('))
SELECT doc_id, field, (length(t) - length(replace(t, term, ''))) // length(term) AS hits, position(term IN t)::INT AS first_at FROM d, f WHERE contains(t, term)
""")
def inspect_documents(spark, sf_dir):
    """All fields of a document in one pass over its text."""
    terms = {"license": "license", "email": "@mail", "password": "password=", "phone": "+1 ("}
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    n = lambda w: ((F.length("t") - F.length(F.replace("t", F.lit(w)))) / len(w)).cast("long")
    hits = F.array(*[F.struct(F.lit(f).alias("field"), n(w).alias("hits"), F.locate(w, F.col("t")).alias("first_at")) for f, w in terms.items()])
    return d.select("doc_id", F.explode(F.filter(hits, lambda x: x["hits"] > 0)).alias("h")).select("doc_id", "h.*")


@R.query("""
WITH k AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), n AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT o_orderkey, o_custkey, c_mktsegment, c_custkey IS NULL AS not_found FROM k LEFT JOIN n ON o_custkey = c_custkey
""")
def lookup_not_found(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(True).alias("_f"))
    return join_null_safe(k, n, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment", F.col("_f").isNull().alias("not_found"))
