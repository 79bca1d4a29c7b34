"""Queries that put rule ladders on rows and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.functions import numbers as N
from quillforge.operators import rules as L
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


@R.query("""
WITH c AS (SELECT CASE WHEN l_tax IS NULL THEN 'not_checkable' WHEN l_tax <= 0.08 THEN 'consistent' ELSE 'suspicious' END AS tax, CASE WHEN l_shipdate IS NULL OR o_orderdate IS NULL THEN 'not_checkable' WHEN l_shipdate >= o_orderdate THEN 'consistent' ELSE 'suspicious' END AS dates,
  CASE WHEN l_returnflag <> 'R' THEN 'not_checkable' WHEN l_linestatus = 'F' THEN 'consistent' ELSE 'suspicious' END AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT tax, dates, returned, count(*) AS n FROM c GROUP BY ALL
""")
def consistency_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    e = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    c = e.select(
        L.three_way(F.col("l_tax").isNotNull(), F.col("l_tax") <= 0.08).alias("tax"),
        L.three_way(F.col("l_shipdate").isNotNull() & F.col("o_orderdate").isNotNull(), F.col("l_shipdate") >= F.col("o_orderdate")).alias("dates"),
        L.three_way(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F").alias("returned"),
    )
    return c.groupBy("tax", "dates", "returned").agg(F.count("*").alias("n"))


BANDS = [("Brand#11", 10.0, 60.0), ("Brand#12", 30.0, 90.0), ("Brand#22", 5.0, 500.0)]


@R.query(f"""
WITH b(p_brand, lo, hi) AS (VALUES {", ".join(map(str, BANDS))}), r AS (SELECT p_brand, p_retailprice / p_size BETWEEN lo AND hi AS ok FROM part LEFT JOIN b USING (p_brand)) SELECT p_brand, ok AS band_ok, count(*) AS n FROM r GROUP BY ALL
""")
def band_filter(spark, sf_dir):
    bands = spark.createDataFrame(BANDS, "p_brand string, lo double, hi double")
    return L.in_band(table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size"), bands, "p_brand", F.col("p_retailprice") / F.col("p_size")).groupBy("p_brand", "band_ok").agg(F.count("*").alias("n"))


@R.query("""
WITH p AS (SELECT *, round(p_retailprice * 100)::BIGINT AS cents FROM part), e AS (SELECT a.p_partkey AS target, CASE WHEN abs(a.p_size - b.p_size) > 3 THEN 'model_family' WHEN a.p_type <> b.p_type THEN 'generation' WHEN abs(a.cents - b.cents) > 20000 THEN 'body_powertrain' WHEN a.p_partkey <> b.p_partkey THEN 'exact_technical_variant' ELSE 'exact_market_trim' END AS level FROM p a JOIN p b USING (p_brand))
SELECT target, level, count(*) AS candidates FROM e GROUP BY ALL
""")
def binding_ladder(spark, sf_dir):
    """How many rows of its maker bind to a target at each level; counted, without making a pair of rows."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), "p_brand", "p_type", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    narrower = [(["p_brand"], {}), (["p_brand"], {"p_size": 3}), (["p_brand", "p_type"], {"p_size": 3}), (["p_brand", "p_type"], {"p_size": 3, "cents": 20_000}), (["target"], {})]
    levels = ["model_family", "generation", "body_powertrain", "exact_technical_variant", "exact_market_trim"]
    return L.counts_by_level(part, part, "target", dict(zip(levels, narrower, strict=True)))


#: How much each signal of a page counts when candidates are put in order.
PAGE_WEIGHTS = {"length": 2.0, "secure": 1.0, "german": 1.5, "table": 1.0, "long_address": 0.5, "document": 0.5, "referred": 0.5, "old_year": -1.0, "depth": 0.5, "abroad": -3.0}


@R.query(f"""
WITH s AS (SELECT page_id, least(1.0, length(html) / 10000.0) AS length, (url LIKE 'https%')::INT AS secure, contains(html, 'lang="de"')::INT AS german, contains(html, '<table')::INT AS "table", least(length(url), 24) / 24 AS long_address,
  (url LIKE '%.pdf')::INT AS document, contains(url, 'ref')::INT AS referred, contains(url, '19')::INT AS old_year, page_id % 6 AS depth, (page_id % 11 = 0)::INT AS abroad FROM pages)
SELECT page_id, floor(({" + ".join(f'"{k}"::DOUBLE * ({v})' for k, v in PAGE_WEIGHTS.items())}) * 1000 + 0.5) / 1000 AS score FROM s
""")
def routing_scores(spark, sf_dir):
    url, html = F.col("url"), F.col("html")
    has = lambda c, x: F.contains(c, F.lit(x))
    signals = {
        "secure": url.startswith("https"),
        "depth": F.col("page_id") % 6,
        "abroad": F.col("page_id") % 11 == 0,
        "german": has(html, 'lang="de"'),
        "table": has(html, "<table"),
        "length": F.least(F.lit(1.0), F.length(html) / 10000.0),
        "long_address": F.least(F.length(url), F.lit(24)) / 24,
        "document": url.endswith(".pdf"),
        "referred": has(url, "ref"),
        "old_year": has(url, "19"),
    }
    return table(spark, sf_dir, "pages").select("page_id", L.weighted_signals(PAGE_WEIGHTS, signals).alias("score"))


@R.query("""
WITH f AS (SELECT source, lang, count(*) AS attempts, count(quality) AS found, count(DISTINCT quality) AS vals, count(CASE WHEN lang = 'en' THEN 1 END) AS home FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT source, lang, CASE WHEN attempts = 0 THEN 'policy_blocked' WHEN vals > 1 THEN 'conflicting' WHEN attempts >= 10 AND found * 5 < attempts THEN 'low_yield' WHEN found > 0 AND home > 0 THEN 'candidate_rich_local' WHEN found > 0 THEN 'foreign_only' ELSE 'true_missing' END AS triage FROM f
""")
def tail_triage(spark, sf_dir):
    from quillforge.operators.evidence import first_reason

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    f = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("attempts"), F.count("quality").alias("found"), F.countDistinct("quality").alias("vals"), F.count_if(F.col("lang") == "en").alias("home"))
    rules = {
        "policy_blocked": F.col("attempts") == 0,
        "conflicting": F.col("vals") > 1,
        "low_yield": (F.col("attempts") >= 10) & (F.col("found") * 5 < F.col("attempts")),
        "candidate_rich_local": (F.col("found") > 0) & (F.col("home") > 0),
        "foreign_only": F.col("found") > 0,
        "true_missing": F.lit(True),
    }
    return f.select("source", "lang", first_reason(rules).alias("triage"))


@R.query("SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*)")
def single_value_inference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return L.single_values(orders, ["o_custkey", "y"], "o_orderstatus")


@R.query("""
WITH r AS (SELECT user_id, event_type, value, event_id, row_number() OVER w AS i, first_value(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id)),
d AS (SELECT user_id, event_type, value, min(i) AS i FROM r WHERE value <> f GROUP BY ALL)
SELECT r.user_id, r.event_type, max(f) AS value, arg_min(event_id, r.i) AS source, coalesce((SELECT string_agg(d.value::DECIMAL(18,2)::VARCHAR, '|' ORDER BY d.i) FROM d WHERE d.user_id = r.user_id AND d.event_type = r.event_type), '') AS alternatives,
  string_agg(DISTINCT CASE WHEN value = f THEN event_id::VARCHAR END, '|' ORDER BY CASE WHEN value = f THEN event_id::VARCHAR END) AS attributions FROM r GROUP BY r.user_id, r.event_type
""")
def final_assembly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = L.assemble(e, ["user_id", "event_type"], "value", [F.desc("ts"), F.asc("event_id")], "event_id")
    return out.withColumn("value", F.col("value").cast("double"))


@R.query("""
WITH t AS (SELECT p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'even' END AS a, CASE WHEN p_size > 25 THEN 'large' END AS b, CASE WHEN p_retailprice > 900 THEN 'dear' END AS c FROM part)
SELECT p_brand, p_type, count(*) AS rows, concat_ws(',', CASE WHEN count(c) = count(*) THEN 'dear' END, CASE WHEN count(a) = count(*) THEN 'even' END, CASE WHEN count(b) = count(*) THEN 'large' END) AS common,
  concat_ws(',', CASE WHEN count(c) > 0 THEN 'dear' END, CASE WHEN count(a) > 0 THEN 'even' END, CASE WHEN count(b) > 0 THEN 'large' END) AS seen FROM t GROUP BY 1, 2
""")
def matched_key_sets(spark, sf_dir):
    names = F.concat_ws(",", F.when(F.col("p_size") % 2 == 0, "even"), F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 900, "dear"))
    return L.key_sets(table(spark, sf_dir, "part").select("p_brand", "p_type", names.alias("names")), ["p_brand", "p_type"], "names")


@R.query("""
WITH a AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT count(*) AS keys, count(CASE WHEN a.s = b.s THEN 1 END) AS same, count(CASE WHEN len(list_intersect(a.s, b.s)) > 0 THEN 1 END) AS touching, floor(count(CASE WHEN len(list_intersect(a.s, b.s)) > 0 THEN 1 END)::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS rate FROM a JOIN b USING (l_partkey)
""")
def code_agreement(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias(name))
    both = side("R", "a").join(side("N", "b"), "l_partkey")
    touching = F.count_if(F.arrays_overlap("a", "b"))
    return both.agg(F.count("*").alias("keys"), F.count_if(F.col("a") == F.col("b")).alias("same"), touching.alias("touching"), N.half_up(touching / F.count("*"), 4).alias("rate"))


@R.query("""
SELECT l_partkey, count(*) AS n, max(v - 25.0) <= min(v + 25.0) AS rounding_equivalent, min(v) AS lo, max(v) AS hi FROM (SELECT l_partkey, floor(l_extendedprice / l_quantity) AS v FROM lineitem) GROUP BY 1
""")
def rounding_equivalence(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_partkey", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("v"))
    return v.groupBy("l_partkey").agg(F.count("*").alias("n"), N.intervals_overlap(F.col("v"), F.lit(25.0)).alias("rounding_equivalent"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@R.query("""
SELECT event_id, unnest(['$.k', '$.a.b.c.d.e.f', '$.a.b.l[0]', '$.a.b.l[1][0]', '$.a.b.l[1][1].x', '$.n', '$."p.q"']) AS path, unnest([json_extract_string(props, '$.k'), event_id::VARCHAR, '1', '2', event_type, NULL, 'true']) AS value FROM events
""")
def json_leaves(spark, sf_dir):
    """Objects and arrays of any depth; keys with points; empty containers have no leaf."""
    deep = F.concat(F.lit(', "a": {"b": {"c": {"d": {"e": {"f": '), F.col("event_id").cast("string"), F.lit('}}}, "l": [1, [2, {"x": "'), F.col("event_type"), F.lit('"}], [], {}]}}, "n": null, "p.q": true}'))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}$", ""), deep).alias("props"))
    return L.leaves(e, ["event_id"], "props")


@R.query("""
WITH s AS (SELECT doc_id, length(regexp_replace(text, '[^äöüßÄÖÜ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0) AS de, length(regexp_replace(text, '[^éèêçÉÈÊÇ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0) AS fr, lang FROM documents)
SELECT lang, CASE WHEN coalesce(de, 0) > 0.01 AND coalesce(de, 0) > coalesce(fr, 0) THEN 'de' WHEN coalesce(fr, 0) > 0.01 THEN 'fr' ELSE 'other' END AS market, count(*) AS n FROM s GROUP BY ALL
""")
def text_market(spark, sf_dir):
    from quillforge.functions.text import script_share

    s = table(spark, sf_dir, "documents").select("lang", script_share(F.col("text"), "äöüßÄÖÜ").alias("de"), script_share(F.col("text"), "éèêçÉÈÊÇ").alias("fr"))
    market = F.when((F.col("de") > 0.01) & (F.col("de") > F.col("fr")), "de").when(F.col("fr") > 0.01, "fr").otherwise("other")
    return s.groupBy("lang", market.alias("market")).agg(F.count("*").alias("n"))


@R.query("""
WITH c AS (SELECT user_id, max(event_id) AS cursor FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, user_id, event_type FROM events LEFT JOIN c USING (user_id) WHERE cursor IS NULL OR event_id > cursor
""")
def cursor_after(spark, sf_dir):
    """What each run has not shown yet: its events after the last one that was read, its last purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    cursors = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("cursor"))
    return L.after_cursor(e, cursors, ["user_id"], "event_id", "cursor")
