"""Queries over single values: spellings, codes, dates, quotes; and over files that Spark writes from the tables and reads back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.functions import numbers as N
from quillforge.functions import text as T
from quillforge.operators import evidence as V
from quillforge.operators import joins as J
from quillforge.plans.registry import Registry
from quillforge.session import shared_folder, table
from quillforge.sources import readers, snapshots

R = Registry()


@R.query("""
WITH p AS (SELECT p_partkey, p_size, 100 + p_partkey % 320 AS w, 15 + p_size * 2 AS a, 9 + p_partkey % 17 AS r, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k < 3 AND w BETWEEN 105 AND 395 AND a BETWEEN 20 AND 95 AND r BETWEEN 10 AND 24 THEN w || '/' || a || ' R' || r END AS tyre FROM p
""")
def tyre_sizes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    w, a, r = (c.cast("string") for c in (100 + F.col("p_partkey") % 320, 15 + F.col("p_size") * 2, F.lpad((9 + F.col("p_partkey") % 17).cast("string"), 2, "0")))
    text = F.when(k == 0, F.concat(w, F.lit("/"), a, F.lit(" r "), r, F.lit(" 91v"))).when(k == 1, F.concat(w, F.lit("/"), a, F.lit("zr"), r, F.lit("XL"))).when(k == 2, F.concat(w, F.lit(" / "), a, F.lit("-"), r)).otherwise(F.concat(w, F.lit("/"), a, F.lit("R"), r, F.lit(" or so")))
    return table(spark, sf_dir, "part").select("p_partkey", T.tyre_size(text).alias("tyre"))


@R.query("""
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 4 THEN y END::INT AS year, CASE WHEN k < 4 THEN m END::INT AS month, CASE WHEN y % 100 < 10 THEN 2000 + y % 100 ELSE y END::INT AS full_year FROM o
""")
def year_months(spark, sf_dir):
    k, day = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    parts = {n: f(day).cast("string") for n, f in (("y", F.year), ("m", F.month), ("d", F.day))}
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.concat_ws("/", parts["d"], parts["m"], parts["y"])).when(k == 2, F.date_format(day, "yyyyMM")).when(k == 3, F.concat_ws("-", parts["y"], parts["m"]))
        .when(k == 4, F.concat(parts["y"], F.lit("-13"))).otherwise(F.concat(F.lit("in "), parts["y"]))
    )
    short = F.when(F.year(day) % 100 < 10, (F.year(day) % 100).cast("string")).otherwise(parts["y"])
    return table(spark, sf_dir, "orders").select("o_orderkey", N.year_month(text).alias("v"), N.full_year(short).alias("full_year")).select("o_orderkey", "v.year", "v.month", "full_year")


@R.query(r"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || '-' || p_type || '_' || p_size || '.x ' ELSE p_name END AS t, p_type || '.' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' (EU 7)' ELSE ' b' END AS c FROM part)
SELECT p_partkey, trim(regexp_replace(upper(translate(t, '-_.', '   ')), '\s+', ' ', 'g')) AS trim_key, upper(regexp_replace(regexp_replace(c, '\(.*$', ''), '[.\s]+', '', 'g')) AS code FROM p
""")
def trim_and_code_keys(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit("-"), F.col("p_type"), F.lit("_"), size, F.lit(".x "))).otherwise(F.col("p_name"))
    c = F.concat(F.col("p_type"), F.lit("."), size, F.when(k % 3 == 0, " (EU 7)").otherwise(" b"))
    return table(spark, sf_dir, "part").select("p_partkey", T.trim_key(t).alias("trim_key"), T.code_form(c).alias("code"))


@R.query("""
WITH l AS (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS line FROM documents), m AS (SELECT regexp_replace(line, '[0-9][0-9.,]*', '#', 'g') AS pattern FROM l WHERE regexp_matches(line, '[0-9]'))
SELECT pattern, count(*) AS lines FROM m GROUP BY 1 HAVING count(*) > 1
""")
def quote_patterns(spark, sf_dir):
    """Words that differ in their numbers only."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[\n ]")).alias("line")).where(F.col("line").rlike("[0-9]")).distinct()
    return lines.groupBy(T.masked_numbers(F.col("line")).alias("pattern")).agg(F.count("*").alias("lines")).where("lines > 1")


@R.query("""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' WHEN abs(v - w) <= greatest(v * 0.01, CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 0.5 END) + 1e-9 THEN 'matched' ELSE 'veto' END AS verdict FROM (SELECT p_partkey, 900.0::DOUBLE + p_size * 20 AS v, CASE WHEN p_partkey % 2 = 0 THEN round((900 + p_size * 20 + p_partkey % 90) / 100.0) * 100 ELSE 900 + p_size * 20 + p_partkey % 20 END::DOUBLE AS w FROM part)
""")
def rounding_tolerance(spark, sf_dir):
    """A size in cm3 against one stated in litres with one digit, or in cm3: the stated rounding counts where it is coarser."""
    k = F.col("p_partkey")
    v = F.lit(900.0) + F.col("p_size") * 20
    coarse = F.round((v + k % 90) / 100, 0) * 100
    w = F.when(k % 2 == 0, coarse).otherwise(v + k % 20)
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 9 != 0, v).alias("v"), w.alias("w"), (k % 2 == 0).alias("litres"))
    # the last stated digit in cm3: litres with one decimal give 100
    verdict = F.when(F.col("litres"), F.when(F.col("v").isNull(), "unknown").otherwise(N.tolerance_equal(F.col("v") / 1000, F.col("w") / 1000, 0.01, F.format_number(F.col("w") / 1000, 1)))).otherwise(N.tolerance_equal(F.col("v"), F.col("w"), 0.01, F.col("w").cast("int").cast("string")))
    return part.select("p_partkey", verdict.alias("verdict"))


@R.query("""
WITH RECURSIVE p AS (SELECT p_brand, p_size, p_name, lower(p_type) AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
k AS (SELECT DISTINCT p_brand, n FROM (SELECT p_brand, a AS n FROM p WHERE p_size % 2 = 0 UNION ALL SELECT p_brand, b FROM p WHERE p_size % 3 = 0 UNION ALL SELECT p_brand, p_name FROM p WHERE p_size % 5 = 0 UNION ALL SELECT p_brand, t FROM p WHERE p_size % 2 = 1 UNION ALL SELECT p_brand, p_name || ' ' || t FROM p WHERE p_size % 7 = 0)),
x AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 4 = 0 THEN p_name || ' ' || t || ' ' || p_name ELSE p_name || ' ' || t END AS x FROM p),
w(p_brand, x, rest, parts) AS (SELECT p_brand, x, x || ' ', []::VARCHAR[] FROM x UNION ALL SELECT w.p_brand, x, substr(rest, length(k.n) + 2), list_append(parts, k.n) FROM w JOIN k ON k.p_brand = w.p_brand AND starts_with(rest, k.n || ' ')),
f AS (SELECT p_brand, x, count(*) AS ways, any_value(parts) AS parts FROM w WHERE rest = '' GROUP BY 1, 2)
SELECT p_brand, x, CASE WHEN ways = 1 AND len(parts) > 1 THEN array_to_string(list_filter(parts, lambda v, i: list_position(parts, v) = i), '|') END AS parts FROM x LEFT JOIN f USING (p_brand, x)
""")
def one_way_splits(spark, sf_dir):
    """Texts of several names of a brand; names that are known are parts, wholes, or ambiguous with each other."""
    size, kind = F.col("p_size"), F.lower("p_type")
    part = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    both = F.concat("p_name", F.lit(" "), kind)
    known = [part.where(where).select("p_brand", n.alias("n")) for where, n in ((size % 2 == 0, word(1)), (size % 3 == 0, word(2)), (size % 5 == 0, F.col("p_name")), (size % 2 == 1, kind), (size % 7 == 0, both))]
    names = part.select("p_brand", F.when(size % 4 == 0, F.concat(both, F.lit(" "), "p_name")).otherwise(both).alias("x")).distinct()
    return J.split_one_way(names, "x", reduce(DataFrame.unionByName, known), "n", ["p_brand"])


_ADMITTED = r"""
d AS (SELECT doc_id, text, regexp_extract(text, '([A-Z][A-Za-z]+ [A-Za-z ]{0,40}[0-9]\.[0-9])', 1) AS q FROM documents), e AS (SELECT doc_id, text, q, try_cast(regexp_extract(q, '([0-9]\.[0-9])$', 1) AS DOUBLE) AS n FROM d WHERE q <> ''),
s AS (SELECT doc_id // 3 AS item, doc_id * 2 + c AS seq, CASE WHEN doc_id % 19 = 0 THEN -1 ELSE doc_id END AS source, CASE WHEN doc_id % 23 = 0 THEN 'colour' WHEN doc_id % 2 = 0 THEN 'version' ELSE 'release' END AS field, CASE WHEN doc_id % 7 = 0 AND c = 1 THEN n + 1 ELSE n END AS value, CASE WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN 'kg' WHEN doc_id % 2 = 1 THEN 'v' END AS unit,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 AND c = 1 THEN q || ' never said' WHEN c = 1 THEN upper(replace(q, ' ', '  ')) WHEN doc_id % 17 = 0 THEN regexp_extract(e.text, '[A-Za-z]+') || ' … ' || right(q, 3) ELSE split_part(q, ' ', 1) || ' ... ' || right(q, 3) END AS quote FROM e CROSS JOIN (VALUES (0), (1)) t(c))
"""


_PLAIN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"


@R.query(rf"""
WITH {_ADMITTED}, z AS (SELECT s.*, d.text, ' ' || array_to_string(regexp_extract_all(lower(d.text), '{_PLAIN}'), ' ') || ' ' AS body, regexp_split_to_array(quote, '\.\.\.|…') AS parts FROM s LEFT JOIN d ON d.doc_id = source),
f AS (SELECT *, array_to_string(regexp_extract_all(lower(parts[1]), '{_PLAIN}'), ' ') AS f1, coalesce(array_to_string(regexp_extract_all(lower(parts[2]), '{_PLAIN}'), ' '), '') AS f2 FROM z),
g AS (SELECT *, CASE WHEN f2 = '' THEN contains(body, ' ' || f1 || ' ') ELSE regexp_matches(body, ' ' || regexp_escape(f1) || ' (?:.{{0,' || greatest(0, 398 - length(f1) - length(f2)) || '}} )?' || regexp_escape(f2) || ' ') END AS stands FROM f),
r AS (SELECT *, CASE WHEN field = 'colour' THEN 'unknown_field' WHEN text IS NULL THEN 'no_source' WHEN quote IS NULL THEN 'no_quote' WHEN NOT stands THEN 'quote_not_in_source' WHEN value IS NULL OR len(list_filter(regexp_extract_all(quote, '[0-9]+(?:\.[0-9]+)?'), lambda x: abs(x::DOUBLE - value) < 1e-9)) = 0 THEN 'value_not_in_quote'
  WHEN unit IS DISTINCT FROM CASE field WHEN 'release' THEN 'v' END THEN 'unit_differs' WHEN value NOT BETWEEN 1 AND 3.5 THEN 'implausible' END AS reason FROM g)
SELECT item, seq, source, field, value, coalesce(reason, CASE WHEN seq > min(CASE WHEN reason IS NULL THEN seq END) OVER (PARTITION BY item, field, value) THEN 'duplicate' ELSE 'admitted' END) AS reason FROM r
""")
def evidence_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = docs.select("doc_id", "text", F.regexp_extract("text", r"([A-Z][A-Za-z]+ [A-Za-z ]{0,40}[0-9]\.[0-9])", 1).alias("q")).where("q <> ''").withColumn("n", F.regexp_extract("q", r"([0-9]\.[0-9])$", 1).cast("double"))
    d, c = F.col("doc_id"), F.col("c")
    s = q.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.floor(d / 3).alias("item"), (d * 2 + c).alias("seq"), F.when(d % 19 == 0, -1).otherwise(d).alias("source"), F.when(d % 23 == 0, "colour").when(d % 2 == 0, "version").otherwise("release").alias("field"),
        F.when((d % 7 == 0) & (c == 1), F.col("n") + 1).otherwise(F.col("n")).alias("value"), F.when((d % 2 == 1) & (d % 5 == 0), "kg").when(d % 2 == 1, "v").alias("unit"),
        F.when(d % 11 == 0, None).when((d % 13 == 0) & (c == 1), F.concat("q", F.lit(" never said"))).when(c == 1, F.upper(F.replace("q", F.lit(" "), F.lit("  ")))).when(d % 17 == 0, F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(" … "), F.right("q", F.lit(3)))).otherwise(F.concat(F.split_part("q", F.lit(" "), F.lit(1)), F.lit(" ... "), F.right("q", F.lit(3)))).alias("quote"),
    )
    fields = spark.createDataFrame([("version", None, 1.0, 3.5), ("release", "v", 1.0, 3.5)], "field string, field_unit string, lo double, hi double")
    return V.admit(s, docs.withColumnRenamed("doc_id", "source"), "source", "text", fields, ["item"], "seq").drop("unit", "quote")


@R.query("SELECT user_id, count(*) AS events, max(event_id) AS last_seq, count(DISTINCT event_type) AS kinds FROM events WHERE event_type <> 'error' GROUP BY 1")
def event_files(spark, sf_dir):
    """Events as JSON lines, some of them torn, written and read back."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("record_id"), F.col("props").alias("payload")))
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e.select(F.when(F.col("event_type") == "error", F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    back = readers.read_events(spark, path)
    return back.groupBy(F.col("record_id").cast("long").alias("user_id")).agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.countDistinct("kind").alias("kinds"))


@R.query("SELECT c_custkey::VARCHAR AS row_id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, c_acctbal * 1000 AS balance, NULL::VARCHAR AS colour FROM customer")
def mapped_columns(spark, sf_dir):
    """A delimited file under other headers, read by a map of columns, blanks as nulls and a scaled number."""
    k = F.col("c_custkey")
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select(k.alias("Row Id"), F.when(k % 3 > 0, F.col("c_mktsegment")).otherwise(" ").alias(" SEGMENT "), F.col("c_acctbal").alias("Saldo")).write.option("header", True).option("sep", ";").csv(path)
    found, outcome = readers.resolve_columns(readers.read_delimited(spark, path), {"row_id": ["row id"], "segment": [], "balance": ["Balance (EUR)", "saldo"], "colour": []}, frozenset({"colour"}))
    if outcome["colour"] != "absent":
        raise ValueError("the file has no such column")
    return readers.canonical(found, {"balance": 1000.0})


@R.query("SELECT o_orderkey, year(o_orderdate)::INT AS y, substr(o_orderpriority, 1, 1) AS initial, o_totalprice FROM orders WHERE year(o_orderdate) IN (1996, 1999) AND substr(o_orderpriority, 1, 1) IN ('1', '4') AND o_totalprice > 100000")
def pruned_scan(spark, sf_dir):
    """A snapshot in shards by year and initial: only the shards asked for are read, in order of row ids."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).alias("initial"), "o_totalprice")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    snapshots.write_shards(o, path, ["y", "initial"], ["o_orderkey"])
    rows = snapshots.scan(spark, path, order=["o_orderkey"], y=[1996, 1999], initial=["1", "4"]).where("o_totalprice > 100000")
    return rows.select("o_orderkey", F.col("y").cast("int").alias("y"), F.col("initial").cast("string").alias("initial"), "o_totalprice")


@R.query("""
WITH p AS (SELECT 'm' || page_id % 12 AS map, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages), i(name, child) AS (SELECT 'root' || k % 2, 'm' || k FROM range(12) t(k) WHERE k <> 7 UNION ALL SELECT 'root0', 'gone' UNION ALL SELECT 'root1', 'deep' UNION ALL SELECT 'deep', 'm7')
SELECT DISTINCT 'root0' AS root, url FROM i JOIN p ON map = child WHERE name = 'root0' UNION SELECT DISTINCT 'root1', url FROM i JOIN p ON map = child WHERE name IN ('root1', 'deep')
""")
def sitemap_walk(spark, sf_dir):
    """Sitemaps of all pages, two indexes over them, one of which has another index below it."""
    entry = lambda tag, c: F.concat(F.lit(f"<{tag}><loc>"), c, F.lit(f"</loc></{tag}>"))
    whole = lambda tag, body: F.concat(F.lit(f'<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit(f"</{tag}>"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("url"))
    maps = urls.groupBy(F.concat(F.lit("m"), (F.col("page_id") % 12).cast("string")).alias("name")).agg(whole("urlset", F.array_join(F.collect_list(entry("url", F.col("url"))), "")).alias("xml"))
    children = {"root0": ["m0", "m2", "m4", "m6", "m8", "m10", "gone"], "root1": ["m1", "m3", "m5", "m9", "m11", "deep"], "deep": ["m7"]}
    indexes = spark.createDataFrame([(n, "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in cs)) for n, cs in children.items()], "name string, body string").select("name", whole("sitemapindex", F.col("body")).alias("xml"))
    return readers.sitemap_pages(maps.union(indexes), "name", "xml", ["root0", "root1"])
