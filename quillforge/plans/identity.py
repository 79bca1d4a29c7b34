"""Queries that tell what rows are about: filters, keys, codes, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.functions.text import host
from quillforge.operators import identity as I
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


@R.query("""
SELECT o_custkey, count(*) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders WHERE CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END BETWEEN 1997 AND 1999 GROUP BY 1
""")
def year_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("y"))
    return I.in_years(o, "y", 1997, 1999).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


#: spelling, canonical maker, family that gates it (null: none). Brand#13 is known by both.
MAKERS = [("brand#1", "ONE", None), (" BRAND#2 ", "TWO", None), ("Brand#3", "THREE", "widget"), ("Brand#3", "THREE", "Ring"), ("brand#4", "FOUR", "blue"), ("Brand#13", "THIRTEEN", None), ("Brand#13", "GATED", "nut")]
_MAKERS = ", ".join(f"('{s}', '{c}', {'NULL' if f is None else repr(f)})" for s, c, f in MAKERS)


@R.query(f"""
WITH m(s, c, f) AS (VALUES {_MAKERS}), p AS (SELECT *, upper(trim(CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) ELSE p_brand || ' ' END)) AS sp, ' ' || regexp_replace(upper(CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END), '[^A-Z0-9]+', ' ', 'g') || ' ' AS t FROM part),
a AS (SELECT p_partkey, (SELECT min(c) FROM m WHERE f IS NULL AND upper(trim(s)) = sp) AS plain, (SELECT min(c) FROM m WHERE f IS NOT NULL AND upper(trim(s)) = sp) AS gated, (SELECT count(*) FROM m WHERE f IS NOT NULL AND upper(trim(s)) = sp AND contains(t, ' ' || upper(f) || ' ')) AS hits FROM p)
SELECT p_partkey, coalesce(plain, CASE WHEN hits > 0 THEN gated END) AS canonical FROM a WHERE plain IS NOT NULL OR hits > 0
""")
def maker_filter(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, F.lower("p_brand")).otherwise(F.concat("p_brand", F.lit(" "))).alias("make"), F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")).alias("model"))
    makers = spark.createDataFrame(MAKERS, "spelling string, canonical string, family string")
    return I.by_maker(p, "make", "model", makers).select("p_partkey", "canonical")


ALIASES = ["mit", "CC BY", "gnu general", "x+y"]


@R.query(r"SELECT doc_id FROM documents WHERE regexp_matches(upper(text), '(^|[^A-Z0-9])(GNU GENERAL|CC BY|X\+Y|MIT)($|[^A-Z0-9])')")
def model_aliases(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(I.names_any(F.col("text"), ALIASES)).select("doc_id")


#: maker, rule, place; makers without rules have none.
CODE_RULES = [("Brand#1", "exact_va", 1), ("Brand#2", "toyota_style", 1), ("Brand#3", "dotless_va", 1), ("Brand#4", "second_token_t", 1), ("Brand#4", "exact_va", 2), ("Brand#5", "dotless_va", 2), ("Brand#5", "exact_va", 1)]
_CODES = f"""
rl(make, rule, place) AS (VALUES {", ".join(map(str, CODE_RULES))}),
t AS (SELECT p_partkey, p_brand AS make, CASE WHEN p_partkey % 17 = 0 THEN '.' WHEN p_partkey % 3 = 0 THEN 'lf' || p_size || 'e r' || p_size || 'ew' WHEN p_partkey % 3 = 1 THEN p_size || '.98' ELSE 'va' || p_size END AS code FROM part),
r AS (SELECT p_partkey AS row_id, p_brand AS make, CASE WHEN p_partkey % 2 = 1 THEN 'VA' || p_size ELSE p_size || '98' END AS variant, CASE p_partkey % 3 WHEN 0 THEN 'va' || p_size || ' (EU)' WHEN 1 THEN p_size || '.9 8' END AS version, 'R' || p_size || 'EW' AS approval FROM part WHERE p_brand <> 'Brand#9')
"""


@R.query(f"""
WITH {_CODES}, b AS (SELECT *, regexp_replace(upper(code), '[.\\s]+', '', 'g') AS bare, string_split_regex(trim(upper(code)), '\\s+') AS tok FROM t), c AS (SELECT *, CASE WHEN length(bare) >= 2 THEN bare END AS want, CASE WHEN len(tok) = 2 AND length(tok[2]) >= 4 THEN tok[2] END AS sec FROM b),
q AS (SELECT *, regexp_replace(upper(variant), '[.\\s]+', '', 'g') AS va, regexp_replace(upper(version), '[.\\s]+', '', 'g') AS ve, regexp_replace(regexp_replace(upper(version), '\\s*\\([^()]*\\)\\s*$', ''), '[.\\s]+', '', 'g') AS ves FROM r),
h AS (SELECT p_partkey, rule, place, row_id, CASE rule WHEN 'exact_va' THEN CASE WHEN want = va THEN 0 END WHEN 'toyota_style' THEN CASE WHEN want = ves OR want = va THEN 0 END WHEN 'dotless_va' THEN CASE WHEN want = va THEN 0 WHEN want = ve THEN 1 END
  WHEN 'second_token_t' THEN CASE WHEN sec = approval THEN 0 WHEN sec = va THEN 1 END END AS rk FROM c JOIN rl USING (make) JOIN q USING (make) WHERE want IS NOT NULL),
n AS (SELECT p_partkey, place, rule, rk, count(DISTINCT row_id) AS k FROM h WHERE rk IS NOT NULL GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY place, rk) AS i FROM n)
SELECT c.p_partkey, CASE WHEN want IS NULL THEN 'no_code' WHEN c.make NOT IN (SELECT make FROM r) THEN 'no_rows' WHEN c.make NOT IN (SELECT make FROM rl) THEN 'no_rule' WHEN f.k IS NOT NULL THEN 'match' ELSE 'no_match' END AS status, f.rule, coalesce(f.k, 0) AS rows
FROM c LEFT JOIN f ON f.p_partkey = c.p_partkey AND i = 1
""")
def type_codes(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "make")
    code = F.when(k % 17 == 0, ".").when(k % 3 == 0, F.concat(F.lit("lf"), size, F.lit("e r"), size, F.lit("ew"))).when(k % 3 == 1, F.concat(size, F.lit(".98"))).otherwise(F.concat(F.lit("va"), size))
    targets = part.select("p_partkey", "make", code.alias("code"))
    rows = part.where("make <> 'Brand#9'").select(
        F.col("p_partkey").alias("row_id"), "make", F.when(k % 2 == 1, F.concat(F.lit("VA"), size)).otherwise(F.concat(size, F.lit("98"))).alias("variant"),
        F.when(k % 3 == 0, F.concat(F.lit("va"), size, F.lit(" (EU)"))).when(k % 3 == 1, F.concat(size, F.lit(".9 8"))).alias("version"), F.concat(F.lit("R"), size, F.lit("EW")).alias("approval"),
    )
    return I.by_type_code(targets, rows, spark.createDataFrame(CODE_RULES, "make string, rule string, place int"), "p_partkey", "row_id", "make")


@R.query(r"""
WITH g AS (SELECT p_partkey, p_brand, p_name || ' ' || p_size || ' kWh ' || (p_partkey % 200) AS nm, split_part(p_name, ' ', 2) || '-' || p_size AS fam, CASE WHEN p_partkey % 8 <> 0 THEN '20' || lpad((p_partkey % 25)::VARCHAR, 2, '0') END AS y, CASE WHEN p_partkey % 6 > 1 THEN p_size * 4 WHEN p_partkey % 6 = 1 THEN 0 END AS co2,
  CASE WHEN p_type = 'SMALL' THEN 'electric' WHEN p_type <> 'LARGE' THEN 'petrol' END AS fuel, CASE p_partkey % 3 WHEN 0 THEN 'E1*' WHEN 1 THEN 'A7' END AS ap, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 5 END AS au, p_retailprice AS wt FROM part),
w AS (SELECT *, regexp_extract_all(lower(nm), '[a-z0-9]+') AS ws FROM g)
SELECT p_partkey, upper(trim(p_brand)) AS key_maker, trim(regexp_replace(upper(fam), '[^0-9A-Z]+', ' ', 'g')) AS key_model, array_to_string(ws, ' ') AS key_words, array_to_string(list_transform(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]{2,3}') AND try_cast(x AS INT) BETWEEN 30 AND 150), lambda x: try_cast(x AS INT)), ',') AS key_battery, y::INT AS key_year,
  CASE WHEN co2 > 0 THEN co2 END AS key_co2, coalesce(fuel = 'electric', NULL) OR co2 IS NULL OR co2 <= 0 AS no_co2, CASE WHEN ap LIKE 'E%' THEN 'european' WHEN ap LIKE 'A%' THEN 'american' ELSE 'unknown' END AS key_route, CASE au WHEN 1 THEN 'automatic' WHEN 0 THEN 'manual' END AS key_transmission, wt AS key_weight FROM w
""")
def target_keys(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    g = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.concat_ws(" ", "p_name", size, F.lit("kWh"), (k % 200).cast("string")).alias("nm"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-"), size).alias("fam"),
        F.when(k % 8 != 0, F.concat(F.lit("20"), F.lpad((k % 25).cast("string"), 2, "0"))).alias("y"), F.when(k % 6 > 1, F.col("p_size") * 4).when(k % 6 == 1, 0).alias("co2"),
        F.when(F.col("p_type") == "SMALL", "electric").when(F.col("p_type") != "LARGE", "petrol").alias("fuel"), F.when(k % 3 == 0, "E1*").when(k % 3 == 1, "A7").alias("ap"), F.when(k % 5 < 3, k % 5).alias("au"), F.col("p_retailprice").alias("wt"),
    )
    keys = I.target_keys(g, "p_brand", "nm", "fam", "y", "co2", "fuel", "ap", "au", "wt")
    return keys.drop("p_brand", "nm", "fam", "y", "co2", "fuel", "ap", "au", "wt")


@R.query("""
WITH f AS (SELECT p_partkey, unnest(['range', 'tank', 'gears']) AS field FROM part), v AS (SELECT p_partkey, 'type' AS wf, p_type AS wv FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part), rl(field, wf, wv) AS (VALUES ('range', 'type', 'LARGE'), ('tank', 'type', 'SMALL'), ('gears', 'type', 'SMALL'), ('gears', 'size', '7')),
h AS (SELECT p_partkey, field, min(wf || '=' || wv) AS r FROM v JOIN rl USING (wf, wv) GROUP BY 1, 2) SELECT p_partkey, field, r AS not_applicable FROM f LEFT JOIN h USING (p_partkey, field)
""")
def not_applicable(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fields = part.select("p_partkey", F.explode(F.array(*map(F.lit, ("range", "tank", "gears")))).alias("field"))
    own = F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value")))
    values = part.select("p_partkey", F.explode(own).alias("v")).select("p_partkey", "v.*")
    rules = spark.createDataFrame([("range", "type", "LARGE"), ("tank", "type", "SMALL"), ("gears", "type", "SMALL"), ("gears", "size", "7")], "field string, when_field string, when_value string")
    return I.not_applicable(fields, rules, ["p_partkey"], "field", "when_field", "when_value", values)


#: regex, class, group that holds the gears, gearbox
GEARBOXES = [(r"auto\(av-?s?([0-9]+)\)", "automatic", 1, "cvt"), (r"auto\(s?([0-9]+)\)", "automatic", 1, None), (r"a([0-9]+)", "automatic", 1, None), (r"manual ([0-9]+)-speed", "manual", 1, None), (r"av", "automatic", None, "cvt")]


@R.query(r"""
WITH c AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Auto(AV-S' || p_size % 9 || ')' WHEN 1 THEN ' auto(s' || p_size % 10 || ')' WHEN 2 THEN 'A' || p_size % 10 WHEN 3 THEN 'Manual ' || p_size % 7 || '-speed' WHEN 4 THEN 'AV' WHEN 5 THEN 'A' || p_size || 'x' END AS code FROM part), t AS (SELECT *, lower(trim(code)) AS t FROM c)
SELECT p_partkey, CASE WHEN regexp_full_match(t, 'auto\(av-?s?([0-9]+)\)|auto\(s?([0-9]+)\)|a([0-9]+)|av') THEN 'automatic' WHEN regexp_full_match(t, 'manual ([0-9]+)-speed') THEN 'manual' END AS class,
  CASE WHEN regexp_full_match(t, 'auto\(av-?s?([0-9]+)\)|auto\(s?([0-9]+)\)|a([0-9]+)|manual ([0-9]+)-speed') THEN regexp_extract(t, '([0-9]+)', 1)::INT END AS gears, CASE WHEN regexp_full_match(t, 'auto\(av-?s?([0-9]+)\)|av') THEN 'cvt' END AS gearbox FROM t
""")
def transmissions(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda n: (size % n).cast("string")
    code = (
        F.when(k % 7 == 0, F.concat(F.lit("Auto(AV-S"), s(9), F.lit(")"))).when(k % 7 == 1, F.concat(F.lit(" auto(s"), s(10), F.lit(")"))).when(k % 7 == 2, F.concat(F.lit("A"), s(10)))
        .when(k % 7 == 3, F.concat(F.lit("Manual "), s(7), F.lit("-speed"))).when(k % 7 == 4, "AV").when(k % 7 == 5, F.concat(F.lit("A"), size.cast("string"), F.lit("x")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", I.transmission(code, GEARBOXES).alias("t")).select("p_partkey", F.col("t.class").alias("class"), "t.gears", "t.gearbox")


@R.query("""
WITH c AS (SELECT p_partkey, lower(trim(p_type)) AS t, ' ' || regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g') || ' ' AS m FROM part), e AS (SELECT *, concat_ws(',', CASE WHEN t IN ('small', 'economy') THEN 'compact' END, CASE WHEN t IN ('large') THEN 'wide' END) AS eq,
  concat_ws(',', CASE WHEN contains(m, ' SMALL ') OR contains(m, ' ECONOMY ') OR contains(m, ' RING ') THEN 'compact' END, CASE WHEN contains(m, ' LARGE ') OR contains(m, ' RED WIDGET ') THEN 'wide' END) AS wi FROM c)
SELECT p_partkey, coalesce(nullif(eq, ''), nullif(wi, '')) AS class FROM e
""")
def value_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    classes = {"compact": ["Small", "economy", "ring"], "wide": ["LARGE", "red widget"]}
    return part.select("p_partkey", I.value_class(F.col("p_type"), classes, F.col("p_name")).alias("class"))


@R.query(r"""
WITH q AS (SELECT event_id, user_id, '  Price  of ' || upper(event_type) || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END AS q, CASE WHEN event_id % 4 > 0 THEN ['B.com', ' a.org', 'b.COM'] END AS d, CASE WHEN event_id % 2 = 0 THEN user_id % 3 END AS n FROM events),
s AS (SELECT *, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) || '|' || CASE WHEN d IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(d, lambda x: lower(trim(x))))), ',') END || '|limit=' || coalesce(n, 10) || '|user=' || user_id % 20 AS sig FROM q)
SELECT sig AS signature, count(*) AS calls, min(event_id) AS first_call FROM s GROUP BY 1
""")
def call_signatures(spark, sf_dir):
    e = F.col("event_id")
    q = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("  Price  of "), F.upper("event_type"), F.when(e % 3 == 0, " ").otherwise("")).alias("q"), F.when(e % 4 > 0, F.array(*map(F.lit, ("B.com", " a.org", "b.COM")))).alias("d"), F.coalesce(F.when(e % 2 == 0, F.col("user_id") % 3), F.lit(10)).alias("n"), (F.col("user_id") % 20).alias("u")
    )
    return q.groupBy(I.query_signature(F.col("q"), F.col("d"), {"limit": F.col("n"), "user": F.col("u")}).alias("signature")).agg(F.count("*").alias("calls"), F.min("event_id").alias("first_call"))


@R.query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host, CASE page_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' END AS brand FROM pages), p AS (SELECT *, string_split(host, '.') AS ps FROM h),
o AS (SELECT *, coalesce(brand = 'one' AND ps[len(ps) - 1] = 'example', false) AS own FROM p)
SELECT page_id, CASE WHEN host = '' THEN 'no_url' WHEN host LIKE '%.gov' OR host = 'gov' THEN 'government' WHEN coalesce(brand = 'two' AND host LIKE '%.example.net', false) OR own AND ps[1] IN ('media', 'press', 'newsroom') AND len(ps) > 2 THEN 'official_media'
  WHEN own AND ps[len(ps)] IN ('org') THEN 'official_importer' WHEN own THEN 'official_manufacturer' WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'publisher' ELSE 'unknown' END AS class FROM o
""")
def source_classes(spark, sf_dir):
    brand = F.when(F.col("page_id") % 3 == 0, "one").when(F.col("page_id") % 3 == 1, "two")
    kind = I.source_class(host(F.col("url")), brand, ["gov"], {"two": ["example.net"]}, {"one": ["example"]}, ["org"], {"publisher": ["example.org"]})
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("class"))


@R.query(r"""
WITH s AS (SELECT s_suppkey, n_name || CASE s_suppkey % 7 WHEN 0 THEN ' Motors Ltd. of all' WHEN 1 THEN ' 2000 line' WHEN 2 THEN '' WHEN 3 THEN ' Automobiles' WHEN 4 THEN ' A.G. plus' WHEN 5 THEN ' é' ELSE ' G.m.b.H.' END AS make FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT *, string_split_regex(trim(upper(strip_accents(replace(make, '.', '')))), ' +') AS ws FROM s), u AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], '[0-9]') OR ws[i] IN ('AG', 'GMBH', 'LTD', 'INC', 'CO', 'CORP', 'SPA', 'SA', 'SE', 'KG', 'NV', 'BV', 'PLC', 'LLC')) AS stops FROM t),
k AS (SELECT s_suppkey, make, array_to_string(list_transform(list_filter(CASE WHEN len(stops) > 0 THEN ws[1:stops[1] - 1] ELSE ws END, lambda w: w NOT IN ('THE', 'GROUP', 'MOTORS', 'MOTOR', 'AUTOMOBILES', 'AUTOMOTIVE')), lambda w: regexp_replace(w, '[^0-9A-Z]', '', 'g')), '') AS key FROM u), n AS (SELECT regexp_replace(upper(n_name), '[^0-9A-Z]', '', 'g') AS key, n_name AS canonical FROM nation)
SELECT s_suppkey, make, canonical FROM k LEFT JOIN n USING (key)
""")
def canonical_makers(spark, sf_dir):
    """Spellings with legal forms, years, accents and fillers behind a name; some have more than the name, and stay unknown."""
    k = F.col("s_suppkey") % 7
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    tail = F.when(k == 0, " Motors Ltd. of all").when(k == 1, " 2000 line").when(k == 2, "").when(k == 3, " Automobiles").when(k == 4, " A.G. plus").when(k == 5, " é").otherwise(" G.m.b.H.")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("s_suppkey", F.concat("n_name", tail).alias("make"))
    return I.canonical_makers(rows, "make", nation.withColumnRenamed("n_name", "canonical"))
