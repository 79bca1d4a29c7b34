"""Queries over texts, pages and scalar values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillforge.functions import numbers as N
from quillforge.functions import text as T
from quillforge.plans.registry import Registry
from quillforge.session import table
from quillforge.sources import html as H

R = Registry()


@R.query("""
SELECT c_custkey, nullif(upper(trim(regexp_replace('  ' || c_name || '  ' || c_mktsegment || ' ', '\\s+', ' ', 'g'))), '') AS identity, regexp_replace(upper(c_name), '[^0-9A-Z]+', ' ', 'g') AS model FROM customer
""")
def identity_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  "), "c_name", F.lit("  "), "c_mktsegment", F.lit(" "))
    return c.select("c_custkey", T.ascii_identity(raw).alias("identity"), T.model_key(F.col("c_name")).alias("model"))


_WRITTEN = """CASE l_linenumber % 5 WHEN 0 THEN l_quantity::INT || ',5' WHEN 1 THEN l_quantity::INT || '.25' WHEN 2 THEN l_quantity::INT || ',' || lpad((l_quantity::INT * 7)::VARCHAR, 3, '0') || '.5' WHEN 3 THEN 'about ' || l_quantity::INT ELSE '-' || l_quantity::INT END"""


@R.query(f"""
WITH t AS (SELECT DISTINCT {_WRITTEN} AS written FROM lineitem)
SELECT written, CASE WHEN regexp_matches(written, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?$') THEN replace(written, ',', '')::DOUBLE WHEN regexp_matches(written, '^[+-]?[0-9]+,[0-9]{{1,2}}$') THEN replace(written, ',', '.')::DOUBLE
  WHEN regexp_matches(written, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN written::DOUBLE END AS number, pow(10.0, -length(regexp_extract(written, '\\.([0-9]+)$', 1))) AS last_digit FROM t
""")
def locale_numbers(spark, sf_dir):
    q, line = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    s = q.cast("string")
    written = F.when(line == 0, F.concat(s, F.lit(",5"))).when(line == 1, F.concat(s, F.lit(".25"))).when(line == 2, F.concat(s, F.lit(","), F.lpad((q * 7).cast("string"), 3, "0"), F.lit(".5"))).when(line == 3, F.concat(F.lit("about "), s)).otherwise(F.concat(F.lit("-"), s))
    t = table(spark, sf_dir, "lineitem").select(written.alias("written")).distinct()
    return t.select("written", N.locale_number(F.col("written")).alias("number"), N.last_digit(F.col("written")).alias("last_digit"))


@R.query("""
SELECT p_partkey, floor(p_retailprice * 0.745699872 * 10 + 0.5) / 10 AS kw, floor(p_retailprice * 0.45359237 + 0.5) AS kg, floor(p_size * 25.4::DOUBLE + 0.5) AS mm, floor(100.0 / nullif(p_size::DOUBLE, 0) * 10 + 0.5) / 10 AS l100,
  least(abs(p_size * 1.35962 - 40), abs(p_size * 1.34102 - 40)) <= greatest(2.0, 0.4) AS forty_horses FROM part
""")
def unit_convert(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.convert(price, "hp_to_kw").alias("kw"), N.convert(price, "lb_to_kg").alias("kg"), N.convert(size, "in_to_mm").alias("mm"), N.convert(size, "kml_to_l100").alias("l100"), N.power_agrees(F.lit(40.0), size, "kw").alias("forty_horses")
    )


@R.query("SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal) / 50 + 0.500000001) * 50 AS rounded, sign(c_acctbal) * floor(abs(c_acctbal) / 0.25 + 0.500000001) * 0.25 AS quarters FROM customer")
def round_to_step(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", N.round_to_step(b, 50.0).alias("rounded"), N.round_to_step(b, 0.25).alias("quarters"))


FLAGS = ("abs", "esp", "airbag", "camera", "heat", "roof")


@R.query(
    "SELECT p_partkey, concat_ws(',', "
    + ", ".join(f"CASE WHEN (p_size >> {i}) & 1 = 1 THEN '{f}=' || ((p_partkey >> {i}) & 1) END" for i, f in enumerate(sorted(FLAGS)))
    + ") AS flags, bit_count(p_size & 63)::INT AS stated FROM part"
)
def bitmask_decode(spark, sf_dir):
    """A flag is absent unless it is stated; stated flags are 0 or 1."""
    names = F.array(*[F.lit(f) for f in sorted(FLAGS)])
    values = F.array(*[F.when(F.getbit(F.col("p_size"), F.lit(i)) == 1, F.getbit(F.col("p_partkey"), F.lit(i)).cast("int")) for i in range(len(FLAGS))])
    decoded = F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull())
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", decoded.alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return part.select("p_partkey", F.array_join(entries, ",").alias("flags"), F.bit_count(F.col("p_size").bitwiseAND(F.lit(63))).alias("stated"))


@R.query("""
WITH h AS (SELECT doc_id, lower(text) AS t, text FROM documents)
SELECT doc_id, (length(t) - length(replace(t, 'license', ''))) // 7 AS hits, position('license' IN t)::INT AS first_at, substr(text, greatest(1, position('license' IN t) - 20), 47) AS snippet FROM h WHERE contains(t, 'license')
""")
def find_in_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("t"))
    at = F.locate("license", F.col("t"))
    hit = docs.where(F.contains("t", F.lit("license")))
    return hit.select("doc_id", F.regexp_count("t", F.lit("license")).cast("long").alias("hits"), at.alias("first_at"), F.substring(F.col("text"), F.greatest(F.lit(1), at - 20), F.lit(47)).alias("snippet"))


@R.query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT doc_id, trim(line) AS line FROM s WHERE trim(line) <> '')
SELECT doc_id, count(*) AS segments, max(length(line)) AS longest, count(DISTINCT line) AS distinct_lines FROM l GROUP BY 1
""")
def document_segments(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("segments"), F.max(F.length("line")).cast("long").alias("longest"), F.countDistinct("line").alias("distinct_lines"))


@R.query("""
WITH l AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1) AS a FROM pages)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title, len(a) AS n_links, a[1] AS first_link, len(list_distinct(a)) AS distinct_links FROM l
""")
def page_titles_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.links(F.col("html")).alias("a"))
    return p.select("page_id", "title", F.size("a").cast("long").alias("n_links"), F.get("a", F.lit(0)).alias("first_link"), F.size(F.array_distinct("a")).cast("long").alias("distinct_links"))


@R.query("""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM b)
SELECT page_id, length(t) AS chars, md5(t) AS text_md5, substr(t, 1, 60) AS beginning FROM c
""")
def page_visible_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"), F.substring("t", 1, 60).alias("beginning"))


POLICY = [("example.org", "allowed"), ("example.net", "identity_only"), ("blog.tionsh.example.net", "blocked"), ("m.ththth.example.net", "allowed")]


@R.query(f"""
WITH p(domain, policy) AS (VALUES {", ".join(map(str, POLICY))}), h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages),
j AS (SELECT page_id, host, arg_max(domain, length(domain)) AS domain, arg_max(policy, length(domain)) AS policy FROM h LEFT JOIN p ON host = domain OR suffix(host, '.' || domain) GROUP BY 1, 2)
SELECT page_id, host, domain AS entry, coalesce(policy, 'blocked') AS policy FROM j
""")
def url_policy(spark, sf_dir):
    """Each host's suffixes are looked up in the policy: an equi-join, whatever the number of entries; the longest wins."""
    policy = spark.createDataFrame(POLICY, "domain string, policy string")
    hosts = table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))
    parts = F.split("host", r"\.")
    suffixes = hosts.select("page_id", "host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    found = suffixes.join(F.broadcast(policy), "domain").groupBy("page_id").agg(F.max_by(F.struct("domain", "policy"), F.length("domain")).alias("p"))
    return hosts.join(found, "page_id", "left").select("page_id", "host", F.col("p.domain").alias("entry"), F.coalesce("p.policy", F.lit("blocked")).alias("policy"))


@R.query("""
WITH l AS (SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1), 1) AS i, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages),
s AS (SELECT page_id, i, link, 5 * contains(lower(link), 'the')::INT + 3 * contains(lower(link), 'and')::INT + 2 * contains(lower(link), '.pdf')::INT AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS place FROM s WHERE score > 0) SELECT page_id, i::INT AS position, link, score, place FROM r WHERE place <= 15
""")
def link_ranking(spark, sf_dir):
    l = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("i", "link"))
    low = F.lower("link")
    score = sum((F.when(F.contains(low, F.lit(word)), points).otherwise(0) for word, points in (("the", 5), ("and", 3), (".pdf", 2))), F.lit(0))
    s = l.select("page_id", (F.col("i") + 1).alias("position"), "link", score.alias("score")).where("score > 0")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "position"))).where("place <= 15")


@R.query(
    "SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(92) + 'n', chr(10))}')) AS {k}" for k, p in T.REDACTIONS.items())
    + " FROM documents WHERE "
    + " OR ".join(f"regexp_matches(text, '{p.replace(chr(92) + 'n', chr(10))}')" for p in T.REDACTIONS.values())
)
def redaction_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in T.REDACTIONS.items()])
    return found.where(" OR ".join(f"{k} > 0" for k in T.REDACTIONS))


@R.query("SELECT event_type, json_extract_string(props, '$.k')::INT // 10 AS decade, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,int>"))
    return e.groupBy("event_type", F.floor(F.col("p")["k"] / 10).alias("decade")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@R.query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.t, b.t)) AS shared_terms, len(a.t) AS terms FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def term_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("t"))
    after = F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return w.withColumn("next", after).where("next IS NOT NULL").select("conv_id", "turn", F.size(F.array_intersect("t", "next")).cast("long").alias("shared_terms"), F.size("t").cast("long").alias("terms"))


@R.query("SELECT source, substr(md5(source || ':' || lang), 1, 12) AS group_id, count(*) AS docs, sum(n_chars)::BIGINT AS chars, max(sha256(text)) AS last_sha FROM documents GROUP BY 1, 2")
def content_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", F.substring(F.md5(F.concat_ws(":", "source", "lang")), 1, 12).alias("group_id")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max(F.sha2("text", 256)).alias("last_sha"))
