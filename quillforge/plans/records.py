"""Queries over stored snapshots, exports and page metadata, and over states, spans and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillforge.functions import numbers as N
from quillforge.functions import text as T
from quillforge.operators import evidence as V
from quillforge.operators import joins as J
from quillforge.operators import metrics as M
from quillforge.operators import ordered as O
from quillforge.operators import statements as S
from quillforge.plans.registry import Registry
from quillforge.session import shared_folder, table
from quillforge.sources import html as H
from quillforge.sources import snapshots

R = Registry()


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _yearly(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))


@R.query("""
SELECT 'rows' AS what, year(o_orderdate)::VARCHAR AS part, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1996 GROUP BY 2
UNION ALL SELECT CASE WHEN y = 1996 THEN 'mismatch' ELSE 'ok' END, y::VARCHAR, 1 FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) UNION ALL SELECT 'missing', '1900', 1
""")
def degraded_scan(spark, sf_dir):
    """A snapshot of which one shard fails its check and one is not there: the rest is served, the bad ones are listed."""
    path = _folder(spark, "snapshot")
    kept = snapshots.write_shards(_yearly(spark, sf_dir), path, "y", ["o_orderkey"])
    expected = kept.withColumn("sha256", F.when(F.contains("file", F.lit("y=1996")), "0").otherwise(F.col("sha256"))).select("file", "sha256")
    expected = expected.union(spark.createDataFrame([("y=1900/part-0.parquet", "1")], "file string, sha256 string"))
    rows, report = snapshots.verified_scan(spark, path, expected)
    served = rows.groupBy(F.lit("rows").alias("what"), F.col("y").cast("string").alias("part")).agg(F.count("*").alias("n"))
    return served.union(report.groupBy(F.col("problem").alias("what"), F.regexp_extract("file", "y=([0-9]+)", 1).alias("part")).agg(F.count("*").alias("n")))


@R.query("SELECT year(o_orderdate)::INT AS y, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1")
def rebuilt_shards(spark, sf_dir):
    """A second build without the late years: their shards are stale and go."""
    path, rows = _folder(spark, "shards"), _yearly(spark, sf_dir)
    snapshots.write_shards(rows, path, "y", ["o_orderkey"])
    snapshots.write_shards(rows.where("y < 1999"), path, "y", ["o_orderkey"], keep_others=False)
    return spark.read.parquet(path).groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


@R.query("""
WITH s AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'a|b ' || s_nationkey END AS note FROM supplier)
SELECT 'csv' AS kind, s_suppkey::VARCHAR AS id, s_name AS name, note FROM s UNION ALL SELECT 'jsonl', s_suppkey::VARCHAR, s_name, note FROM s UNION ALL SELECT 'markdown', s_suppkey::VARCHAR, s_name, coalesce(replace(note, '|', '\\|'), '') FROM s
""")
def exports(spark, sf_dir):
    """The same rows written in each form and read back."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("a|b "), F.col("s_nationkey").cast("string"))).alias("note"))
    paths = {kind: _folder(spark, kind) for kind in ("csv", "jsonl", "markdown")}
    for kind, path in paths.items():
        snapshots.export(s, path, kind)
    columns = [F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "note"]
    csv = spark.read.option("header", True).csv(paths["csv"]).select(F.lit("csv").alias("kind"), *columns)
    jsonl = spark.read.schema("s_suppkey long, s_name string, note string").json(paths["jsonl"]).select(F.lit("jsonl").alias("kind"), *columns)
    form = r"^\| ([0-9]+) \| (.*) \| (.*) \|$"
    lines = spark.read.text(paths["markdown"]).where(F.col("value").rlike(form))
    markdown = lines.select(F.lit("markdown").alias("kind"), *[F.regexp_extract("value", form, i).alias(c) for i, c in enumerate(("id", "name", "note"), 1)])
    return csv.union(jsonl).union(markdown)


@R.query(r"""
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'a & "b" ' || page_id END AS description, CASE page_id % 4 WHEN 0 THEN '{"@type":"Car","y":' || page_id || '}|[{"a":1,"b":2}]' WHEN 1 THEN '{"@type":"Car","y":' || page_id || '}' ELSE '' END AS blocks, 'price=' || page_id || '|name=blue one' AS properties FROM pages
""")
def page_metadata(spark, sf_dir):
    """Pages with metadata put in: meta elements in both orders of attributes, JSON-LD blocks (one is broken), microdata."""
    n = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    description = F.concat(F.lit("a &amp; &quot;b&quot; "), n)
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<META name="description" content="'), description, F.lit('">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<meta content="'), description, F.lit('" property="description"/>'))).otherwise("")
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    car = block(F.concat(F.lit('{"y": '), n, F.lit(', "@type": "Car"}')))
    data = F.when(k == 0, F.concat(car, block(F.lit('[{"b": 2, "a": 1}]')))).when(k == 1, F.concat(block(F.lit('{"y": ')), car)).otherwise(block(F.lit("none")))
    micro = F.concat(F.lit('<meta itemprop="price" content="'), n, F.lit('"><b class="x" itemprop="name"> blue one </b>'))
    page = F.concat(head, data, micro, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", H.meta(page, "description").alias("description"), F.array_join(H.json_ld(page), "|").alias("blocks"), F.array_join(F.slice(H.microdata(page), 1, 2), "|").alias("properties"))


@R.query("""
WITH s AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS i FROM part), g AS (SELECT * FROM s WHERE i <= 4)
SELECT g.p_partkey, count(*) AS siblings, min(p.p_retailprice) AS lowest, max(p.p_retailprice) AS highest FROM g JOIN part p USING (p_brand, p_type) GROUP BY 1
""")
def sample_against_catalogue(spark, sf_dir):
    """A sample of the catalogue joined with the catalogue itself."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    picked = part.join(F.broadcast(O.hash_sample(part, ["p_brand"], "p_partkey", 4).select("p_partkey")), "p_partkey")  # four rows a brand
    both = picked.select("p_partkey", "p_brand", "p_type").join(part.drop("p_partkey"), ["p_brand", "p_type"])
    return both.groupBy("p_partkey").agg(F.count("*").alias("siblings"), F.min("p_retailprice").alias("lowest"), F.max("p_retailprice").alias("highest"))


@R.query("""
WITH a AS (SELECT DISTINCT p_brand AS make, unnest([upper(p_brand), upper(p_brand) || '1', upper(p_brand) || '0']) AS alias FROM part),
t AS (SELECT p_partkey AS target, p_brand AS make, 1995 + p_size % 8 AS y FROM part), s AS (SELECT p_partkey AS id, upper(trim(p_brand)) AS make, CASE WHEN p_partkey % 5 > 0 THEN 1994 + p_partkey % 9 END AS y FROM part)
SELECT target, count(DISTINCT id) AS candidates, min(id) AS first_id FROM t JOIN a USING (make) JOIN s ON s.make = alias AND s.y BETWEEN t.y - 1 AND t.y + 1 GROUP BY 1
""")
def alias_candidates(spark, sf_dir):
    """Targets meet the source's rows under any alias of their maker (Brand#1 is also Brand#11), in a window of years."""
    k, brand = F.col("p_partkey"), F.upper("p_brand")
    part = table(spark, sf_dir, "part")
    aliases = part.select("p_brand").distinct().select(F.col("p_brand").alias("make"), F.explode(F.array(brand, F.concat(brand, F.lit("1")), F.concat(brand, F.lit("0")))).alias("alias"))
    targets = part.select(k.alias("target"), F.col("p_brand").alias("make"), (1995 + F.col("p_size") % 8).alias("y"))
    rows = part.select(k.alias("id"), T.spelling(F.col("p_brand")).alias("alias"), F.when(k % 5 > 0, 1994 + k % 9).cast("int").alias("y"))
    return J.alias_window(targets, rows, aliases, "target", "id", "make", "y", 1)


@R.query(r"""
WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?i:license|version|mail)|(?:[0-9]+[.][0-9]+)', 0) AS ts FROM documents), x AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM f),
w AS (SELECT *, regexp_full_match(token, '(?i:license|version|mail)') AS is_label FROM x), o AS (SELECT *, last_value(CASE WHEN is_label THEN lower(token) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS owner FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, token AS value, owner FROM o WHERE NOT is_label
""")
def value_owners(spark, sf_dir):
    return S.value_owners(table(spark, sf_dir, "documents"), "doc_id", "text", "(?i:license|version|mail)", "[0-9]+[.][0-9]+")


@R.query("""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), a(field, alias, value) AS (VALUES ('license', 'mit license', 'MIT'), ('license', 'apache license', 'APACHE'), ('license', 'cc by', 'CC'), ('license', 'cc by-nc', 'CC-NC'), ('contact', '@mail', 'yes'), ('contact', '+1 (', 'phone')),
h AS (SELECT doc_id, field, value, position(alias IN t) AS pos, length(alias) AS size FROM d, a WHERE contains(t, alias)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY pos, size DESC, value) AS i FROM h)
SELECT doc_id, field, value, pos::INT AS "at" FROM r WHERE i = 1
""")
def dictionary_values(spark, sf_dir):
    words = {"license": {"mit license": "MIT", "apache license": "APACHE", "cc by": "CC", "cc by-nc": "CC-NC"}, "contact": {"@mail": "yes", "+1 (": "phone"}}
    return S.dictionary_values(table(spark, sf_dir, "documents"), "doc_id", "text", words)


@R.query(r"""
WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS h, regexp_extract(lower(url), '^[a-z]+://[^/]+/([a-z-]+)(?:/|$)', 1) AS seg, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages),
l AS (SELECT *, regexp_extract(h, '[.]([a-z]+)$', 1) AS tld, coalesce(length(regexp_replace(t, '[^äöüßÄÖÜ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '[^\p{L}]', '', 'g')), 0), 0) AS de FROM p)
SELECT page_id, CASE WHEN tld = 'org' THEN 'world' WHEN seg = 'fr' THEN 'france' WHEN seg = 'en' THEN 'britain' WHEN de >= 0.03 THEN 'germany' END AS market, CASE WHEN tld = 'org' THEN 'tld' WHEN seg IN ('fr', 'en') THEN 'path' WHEN de >= 0.03 THEN 'text' END AS "by" FROM l
""")
def page_markets(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    m = S.market(F.col("url"), title, {"org": "world"}, {"fr": "france", "en": "britain"}, {"germany": "äöüßÄÖÜ"}, 0.03)
    return table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", "m.market", "m.by")


@R.query("""
WITH d AS (SELECT doc_id, text, translate(translate(text, '‘’“”‐‑‒–—' || chr(160) || chr(9) || chr(10) || chr(13), '''''""-----    '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, length(t) = length(text) AS same_length FROM d
""")
def length_preserving(spark, sf_dir):
    t = T.same_length(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), (F.length(t) == F.length("text")).alias("same_length"))


@R.query("""
WITH p AS (SELECT p_partkey, 60.0::DOUBLE + p_size * 4 AS r, CASE p_partkey % 3 WHEN 0 THEN 'kw' WHEN 1 THEN 'hp' ELSE 'bhp' END AS u, (60.0 + p_size * 4) / CASE p_partkey % 6 WHEN 0 THEN 1.35962 WHEN 1 THEN 1.0 WHEN 3 THEN 1.34102 WHEN 4 THEN 1.01387 ELSE 1.5 END::DOUBLE AS v FROM part),
g AS (SELECT p_partkey, r, d.place, d.name, abs(v * d.k - r) AS gap FROM p JOIN (VALUES (0, 'kw', 'kw_metric', 1.35962::DOUBLE), (1, 'kw', 'kw_mechanical', 1.34102::DOUBLE), (2, 'hp', 'hp_metric', 1.0::DOUBLE), (3, 'hp', 'hp_mechanical', 1.01387::DOUBLE)) d(place, u, name, k) USING (u)),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY gap, place) AS i FROM g) SELECT p.p_partkey, CASE WHEN b.gap <= greatest(2.0, p.r * 0.01) THEN name END AS definition FROM p LEFT JOIN b ON b.p_partkey = p.p_partkey AND i = 1
""")
def power_definitions(spark, sf_dir):
    k = F.col("p_partkey")
    r = F.lit(60.0) + F.col("p_size") * 4
    unit = F.when(k % 3 == 0, "kw").when(k % 3 == 1, "hp").otherwise("bhp")
    v = r / F.when(k % 6 == 0, 1.35962).when(k % 6 == 1, 1.0).when(k % 6 == 3, 1.34102).when(k % 6 == 4, 1.01387).otherwise(1.5)
    return table(spark, sf_dir, "part").select("p_partkey", N.power_definition(r, v, unit).alias("definition"))


@R.query("""
WITH l AS (SELECT p_brand, l_quantity > 10 AS a, CASE WHEN l_linenumber <> 7 THEN l_discount < 0.08 END AS b, CASE WHEN l_returnflag <> 'N' THEN l_tax > 0.01 END AS c FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT *, a AS k1, a AND coalesce(b, true) AS k2 FROM l)
SELECT p_brand, 'quantity' AS step, count(*) AS before, count(CASE WHEN a THEN 1 END) AS after, count(CASE WHEN NOT a THEN 1 END) AS dropped, 0 AS unknown FROM f GROUP BY 1
UNION ALL SELECT p_brand, 'discount', count(CASE WHEN k1 THEN 1 END), count(CASE WHEN k2 THEN 1 END), count(CASE WHEN k1 AND NOT b THEN 1 END), count(CASE WHEN k1 AND b IS NULL THEN 1 END) FROM f GROUP BY 1
UNION ALL SELECT p_brand, 'tax', count(CASE WHEN k2 THEN 1 END), count(CASE WHEN k2 AND coalesce(c, true) THEN 1 END), count(CASE WHEN k2 AND NOT c THEN 1 END), count(CASE WHEN k2 AND c IS NULL THEN 1 END) FROM f GROUP BY 1
""")
def selection_steps(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    steps = {"quantity": F.col("l_quantity") > 10, "discount": F.when(F.col("l_linenumber") != 7, F.col("l_discount") < 0.08), "tax": F.when(F.col("l_returnflag") != "N", F.col("l_tax") > 0.01)}
    return M.selection_steps(lines, ["p_brand"], steps)


@R.query("SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def arrival_positions(spark, sf_dir):
    """Events of all producers in one order of arrival, numbered without a task that sees them all."""
    return O.positions(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], 16).drop("ts")


@R.query("""
WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max((ts, event_type = 'purchase')) AS l, bool_or(event_type = 'signup') AS b FROM events GROUP BY 1), q AS (SELECT user_id, l, b, floor((epoch_us(now) - epoch_us(l[1])) / 1000000.0)::BIGINT AS quiet FROM l, n)
SELECT user_id, CASE WHEN l[2] THEN 'finished' WHEN quiet <= 14400 THEN 'active' WHEN NOT b THEN 'orphan' ELSE 'interrupted' END AS state, quiet AS quiet_seconds FROM q
""")
def liveness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return O.liveness(e, "user_id", "ts", kind == "signup", kind == "purchase", e.agg(F.max("ts")).scalar(), 14_400)


@R.query("""
WITH n AS (SELECT max(ts)::DATE AS now FROM events) SELECT user_id, json_extract_string(props, '$.k')::INT % 10 AS route, count(*) AS attempts, max(ts) AS newest FROM events, n GROUP BY 1, 2, now HAVING NOT bool_or(event_type = 'purchase') AND date_diff('day', max(ts)::DATE, now) <= 7
""")
def dead_routes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("route", F.get_json_object("props", "$.k").cast("int") % 10)
    return V.dead_routes(e, ["user_id", "route"], "ts", F.col("event_type") == "purchase", e.agg(F.max("ts")).scalar().cast("date"), 7)


@R.query("""
WITH x AS (SELECT s_suppkey AS item, unnest(['R', 'A', 'N', 'Z']) AS field, s_suppkey % 10 = 0 AS na FROM supplier), e AS (SELECT l_suppkey AS item, l_returnflag AS field, CASE WHEN l_linenumber > l_suppkey % 8 THEN (l_suppkey % 3 + (l_suppkey % 11 = 0 AND l_quantity > 25)::INT)::BIGINT END AS v, l_suppkey % 4 > 0 AND l_tax < 0.03 AS sc, l_suppkey % 5 > 0 AND l_linestatus = 'F' AS mk, l_suppkey % 7 = 0 AND l_returnflag = 'A' AS wk FROM lineitem),
g AS (SELECT item, field, count(*) AS al, count(v) AS n, count(CASE WHEN v IS NOT NULL AND NOT wk THEN 1 END) AS solid, count(DISTINCT CASE WHEN sc AND mk THEN v END) AS vals, count(CASE WHEN mk THEN v END) AS here, count(CASE WHEN sc AND mk THEN v END) AS served FROM e GROUP BY 1, 2)
SELECT x.item, x.field, coalesce(n, 0) AS n, CASE WHEN na THEN 'not_applicable' WHEN al IS NULL THEN 'missing' WHEN n = 0 THEN 'unresolved' WHEN solid = 0 THEN 'weak_provenance' WHEN vals > 1 THEN 'conflicting' WHEN served = 0 AND here > 0 THEN 'variant_not_exact' WHEN served = 0 THEN 'foreign_market_only' ELSE 'ok' END AS state FROM x LEFT JOIN g USING (item, field)
""")
def expected_states(spark, sf_dir):
    expected = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.explode(F.array(*map(F.lit, "RANZ"))).alias("field"), (F.col("s_suppkey") % 10 == 0).alias("na"))
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("field"), F.when(F.col("l_linenumber") > F.col("l_suppkey") % 8, F.col("l_suppkey") % 3 + ((F.col("l_suppkey") % 11 == 0) & (F.col("l_quantity") > 25)).cast("long")).alias("v"), ((F.col("l_suppkey") % 4 > 0) & (F.col("l_tax") < 0.03)).alias("sc"), ((F.col("l_suppkey") % 5 > 0) & (F.col("l_linestatus") == "F")).alias("mk"), ((F.col("l_suppkey") % 7 == 0) & (F.col("l_returnflag") == "A")).alias("wk")
    )
    return V.expected_states(expected, e, ["item", "field"], "v", F.col("sc"), F.col("mk"), F.col("wk"), "na")


@R.query("SELECT s_suppkey::VARCHAR AS id, CASE s_suppkey % 3 WHEN 0 THEN 'דגם' WHEN 1 THEN 'רכב ₪' ELSE s_name END AS name FROM supplier")
def code_page_file(spark, sf_dir):
    """A file in a one-byte code page, recognised by not being UTF-8."""
    from quillforge.sources.readers import code_page, read_delimited

    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, "דגם").when(k == 1, "רכב ₪").otherwise(F.col("s_name"))
    read, meant = code_page("cp1255")
    path = _folder(spark, "hebrew")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.translate(name, meant, read).alias("name")).coalesce(1).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_delimited(spark, path, "cp1255")


@R.query("""
WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents), f(term) AS (VALUES ('license'), ('version'), ('mail'), ('@')), h AS (SELECT doc_id, text, position(term IN t) - 1 AS p, length(term) AS l FROM d, f WHERE contains(t, term)),
s AS (SELECT *, greatest(p - 30, 0) AS a, least(p + l + 30, length(text)) AS b FROM h), r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b, p ROWS UNBOUNDED PRECEDING) AS place FROM r), z AS (SELECT doc_id, place, min(a) AS a, max(b) AS b, count(*) AS hits, any_value(text) AS text FROM g GROUP BY 1, 2),
q AS (SELECT *, sum(b - a) OVER (PARTITION BY doc_id ORDER BY place) AS total FROM z) SELECT doc_id, place::BIGINT AS place, a::INT AS start, substr(text, a + 1, b - a) AS snippet, hits FROM q WHERE total <= 150
""")
def merged_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    low = F.lower("text")
    hits = F.array(*[F.struct((F.locate(w, low) - 1).alias("p"), F.lit(len(w)).alias("l")) for w in ("license", "version", "mail", "@")])
    return V.merged_snippets(d.select("doc_id", "text", F.explode(F.filter(hits, lambda h: h["p"] >= 0)).alias("h")).select("doc_id", "text", "h.*"), ["doc_id"], "p", "l", "text", 30, 150)


@R.query("""
WITH b AS (SELECT p_partkey, p_partkey % 6 AS level, p_partkey % 11 = 0 AS vetoed, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS value FROM part), o AS (SELECT l_partkey AS p_partkey, l_returnflag || l_linestatus AS source, CASE WHEN l_linenumber > 2 THEN l_quantity::INT END AS offer FROM lineitem),
g AS (SELECT p_partkey, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM b JOIN o USING (p_partkey) WHERE level >= 2 AND NOT vetoed AND offer = value GROUP BY 1)
SELECT b.*, CASE WHEN names IS NOT NULL THEN greatest(level, 4) ELSE level END AS new_level, coalesce(names, '') AS backed_by FROM b LEFT JOIN g USING (p_partkey)
""")
def corroborated(spark, sf_dir):
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select("p_partkey", (k % 6).alias("level"), (k % 11 == 0).alias("vetoed"), F.when(k % 7 > 0, F.col("p_size")).alias("value"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("source"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity").cast("int")).alias("offer"))
    return V.corroborated(b, o, ["p_partkey"], "level", "vetoed", "value", 2, 4, 0)


@R.query("""
WITH o AS (SELECT s_suppkey AS item, unnest(['power', 'mass', 'range', 'price']) AS field, unnest([s_suppkey % 3, s_suppkey % 4, s_suppkey % 5, s_suppkey % 6]) AS v, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS cycle FROM supplier), f AS (SELECT item, field, nullif(v, 0) AS v, cycle FROM o), r(field, cyc, needs) AS (VALUES ('range', 'new', 'power'), ('range', NULL, 'mass'), ('mass', 'old', 'range')),
u AS (SELECT f.item, f.field, min(needs) AS needs FROM f JOIN r ON r.field = f.field AND (cyc IS NULL OR cyc = cycle) WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.item = f.item AND x.field = needs AND x.v IS NOT NULL) GROUP BY 1, 2)
SELECT item, field, v, cycle, CASE WHEN field = 'price' THEN 'never_offered' WHEN v IS NULL THEN 'not_offered' WHEN needs IS NOT NULL THEN 'requires:' || needs ELSE 'admitted' END AS reason FROM f LEFT JOIN u USING (item, field)
""")
def withheld_offers(spark, sf_dir):
    k = F.col("s_suppkey")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(k % n, F.lit(0)).alias("v")) for f, n in (("power", 3), ("mass", 4), ("range", 5), ("price", 6))])
    offers = table(spark, sf_dir, "supplier").select(k.alias("item"), F.explode(cells).alias("c"), F.when(k % 2 == 0, "old").otherwise("new").alias("cycle")).select("item", "c.field", "c.v", "cycle")
    requires = spark.createDataFrame([("range", "new", "power"), ("range", None, "mass"), ("mass", "old", "range")], "field string, cycle string, needs string")
    return V.withheld(offers, ["item"], "field", "v", ["price"], requires, "cycle")


@R.query("""
WITH c AS (SELECT DISTINCT l_partkey AS item, l_linenumber AS v FROM lineitem), d AS (SELECT l_partkey AS item, l_linenumber AS v, bool_or(l_returnflag = 'A') AS ok, min(l_shipdate::DATE::VARCHAR) AS why FROM (SELECT l_partkey, l_linenumber + (l_discount > 0.05)::INT AS l_linenumber, l_returnflag, l_shipdate FROM lineitem WHERE l_tax > 0.05 AND l_partkey % 3 > 0) GROUP BY 1, 2),
w AS (SELECT DISTINCT item FROM d WHERE ok) SELECT item, CASE WHEN ok THEN 'accepted' WHEN NOT ok THEN 'rejected' WHEN w.item IS NOT NULL THEN 'superseded' ELSE 'open' END AS kind, v, CASE WHEN NOT ok THEN why END AS reason FROM c LEFT JOIN d USING (item, v) LEFT JOIN w USING (item) UNION ALL SELECT item, 'missed', v, NULL FROM d ANTI JOIN c USING (item, v) WHERE ok
""")
def feedback_examples(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("v"), "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    decided = lines.where("l_tax > 0.05 AND item % 3 > 0").withColumn("v", F.col("v") + (F.col("l_discount") > 0.05).cast("int")).groupBy("item", "v").agg(F.max(F.col("l_returnflag") == "A").alias("accepted"), F.min(F.to_date("l_shipdate").cast("string")).alias("reason"))
    return V.feedback(lines, decided, ["item"], "v")
