"""Queries about what texts state, and the JSON that carries it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import evidence as V
from quillforge.operators import statements as S
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()

_VERSION = "([0-9][.][0-9])"


@R.query(f"""
WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '{_VERSION}', 1) AS vs, string_split_regex(text, '{_VERSION}') AS ps FROM documents), h AS (SELECT doc_id, ps, unnest(vs) AS v, unnest(range(len(vs))) AS place FROM b WHERE len(vs) > 0),
n AS (SELECT doc_id, place, v, lower(right(ps[place + 1], 40) || ' ' || v || ' ' || left(ps[place + 2], 30)) AS near FROM h),
f AS (SELECT *, regexp_matches(near, '(^|[^a-z0-9])(cc by nc|nc)($|[^a-z0-9])') AS x, regexp_matches(near, '(^|[^a-z0-9])(or|and)($|[^a-z0-9])') AS a, regexp_matches(near, '(^|[^a-z0-9])(license|licensed|version)($|[^a-z0-9])') AS r FROM n)
SELECT doc_id, place::INT AS place, v AS value, CASE WHEN x THEN 'excluded' WHEN a AND NOT r THEN 'unclear' WHEN NOT r THEN 'unsupported' ELSE 'accepted' END AS verdict FROM f
""")
def hits_in_context(spark, sf_dir):
    return S.hits_in_context(table(spark, sf_dir, "documents"), "doc_id", "text", _VERSION, 40, 30, ["cc by nc", "nc"], ["license", "licensed", "version"], ["or", "and"])


@R.query("""
WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 < 3 THEN (length(text) * (turn % 4 + 1) // 5)::INT END AS pos FROM conversations), s AS (SELECT *, CASE WHEN pos IS NULL OR pos >= length(text) THEN 0 ELSE pos - length(regexp_extract(substr(text, 1, pos), '([^.;!?]*)$', 1)) END AS a, CASE WHEN pos IS NULL OR pos >= length(text) THEN length(text) ELSE pos + length(regexp_extract(substr(text, pos + 1), '^([^.;!?]*)', 1)) END AS b FROM p)
SELECT conv_id, turn, a::INT AS start, b::INT AS "end", substr(text, a + 1, b - a) AS clause FROM s
""")
def clauses(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = F.when(F.col("turn") % 4 < 3, F.floor(F.length("text") * (F.col("turn") % 4 + 1) / 5).cast("int"))
    return c.select("conv_id", "turn", S.clause_around(F.col("text"), at, ".;!?").alias("c")).select("conv_id", "turn", "c.*")


@R.query(r"""
WITH t AS (SELECT o_orderkey, 'Model ' || year(o_orderdate) || CASE o_orderkey % 5 WHEN 0 THEN ' built 1997-2001' WHEN 1 THEN ', $2005.50 net' WHEN 2 THEN ' and ' || 1990 + o_custkey % 20 WHEN 3 THEN ' no 20011' ELSE ' 12,1998 then' END AS x FROM orders),
a AS (SELECT o_orderkey, regexp_replace(x, '(^|[^0-9])(?:19|20)[0-9]{2} ?[-/–] ?(?:19|20)[0-9]{2}($|[^0-9])', '\1 \2', 'g') AS x FROM t), b AS (SELECT o_orderkey, regexp_replace(x, '[$€£₪] ?[0-9][0-9.,]*|[0-9][0-9.,]* ?[$€£₪%]|[0-9]*[.,][0-9]+', ' ', 'g') AS x FROM a),
y AS (SELECT o_orderkey, list_transform(regexp_extract_all(' ' || regexp_replace(x, '[^0-9]+', '  ', 'g') || ' ', ' ((?:19|20)[0-9]{2}) ', 1), lambda v: v::INT) AS ys FROM b)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(ys, lambda v: v BETWEEN 1995 AND 2004))), ',') AS years FROM y
""")
def stated_years(spark, sf_dir):
    o = F.col("o_orderkey")
    tail = F.when(o % 5 == 0, " built 1997-2001").when(o % 5 == 1, ", $2005.50 net").when(o % 5 == 2, F.concat(F.lit(" and "), (1990 + F.col("o_custkey") % 20).cast("string"))).when(o % 5 == 3, " no 20011").otherwise(" 12,1998 then")
    x = F.concat(F.lit("Model "), F.year("o_orderdate").cast("string"), tail)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.stated_years(x, 1995, 2004), ",").alias("years"))


@R.query("""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::DATE || 'T10:00:00' WHEN 1 THEN 'soon' END AS st, CASE WHEN o_orderkey % 6 IN (1, 2) THEN (o_orderdate::DATE + 1)::VARCHAR WHEN o_orderkey % 6 = 3 THEN '2001-02-31' END AS me, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN d + 1 WHEN 3 THEN d + 2 WHEN 4 THEN d + 3 END AS date, CASE k WHEN 0 THEN 'structured' WHEN 1 THEN 'meta' WHEN 2 THEN 'meta' WHEN 3 THEN 'url' WHEN 4 THEN 'text' END AS source FROM d
""")
def document_dates(spark, sf_dir):
    k, day = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    text_of = lambda n: F.date_add(day, n).cast("string")
    structured = F.when(k == 0, F.concat(text_of(0), F.lit("T10:00:00"))).when(k == 1, "soon")
    meta = F.when(k.isin(1, 2), text_of(1)).when(k == 3, "2001-02-31")
    url = F.when(k == 3, F.concat(F.lit("https://a.example/"), F.date_format(F.date_add(day, 2), "yyyy/MM/dd"), F.lit("/x?2001/01/01"))).otherwise("https://a.example/2001/13/40/")
    text = F.when(k == 4, F.concat(F.lit("on 1999-01-01 it was\n 2000-99-01 x\n "), text_of(3), F.lit(" \n2001-01-01"))).otherwise("no date")
    d = table(spark, sf_dir, "orders").select("o_orderkey", S.document_date(structured, meta, url, text).alias("d"))
    return d.select("o_orderkey", "d.date", "d.source")


@R.query("""
WITH w AS (SELECT p_partkey, p_size % 10 AS n, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN CASE WHEN (n * 6) % 12 = 0 THEN n * 6 // 12 END WHEN 2 THEN n WHEN 3 THEN n END::INT AS years, CASE k WHEN 0 THEN n * 1000 + 100000 WHEN 2 THEN 90000 END AS km, CASE WHEN k = 1 AND (n * 6) % 12 <> 0 OR k = 4 THEN NULL ELSE k = 3 END AS unlimited FROM w
""")
def warranties(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 10
    s = lambda c: c.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Warranty: "), s(n), F.lit(" Years / "), F.format_number(n * 1000 + 100_000, 0), F.lit(" km"))).when(k == 1, F.concat(s(n * 6), F.lit(" months of cover")))
        .when(k == 2, F.concat(s(n), F.lit("yrs, 90.000km"))).when(k == 3, F.concat(s(n), F.lit(" year, unlimited mileage, not 5,000 km"))).otherwise("100,000 km only")
    )
    return table(spark, sf_dir, "part").select("p_partkey", S.warranty(text).alias("w")).select("p_partkey", "w.years", "w.km", "w.unlimited")


@R.query("SELECT doc_id, substr(text, 1001, 500) AS part, 1000 AS \"offset\", length(text) AS total, CASE WHEN length(text) > 1500 THEN 1500 END AS next FROM documents")
def chunked_read(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.chunk(F.col("text"), 1000, 500).alias("c")).select("doc_id", "c.*")


@R.query("""
WITH o AS (SELECT p_partkey, p_partkey % 12 AS k, '{"a":{"x":' || p_size || ',"y":null},"m":["' || p_type || '",' || p_partkey || '],"z":true}' AS j FROM part)
SELECT p_partkey, CASE WHEN k <= 6 THEN j WHEN k = 7 THEN '[1,' || j || ']' WHEN k = 8 THEN p_partkey::VARCHAR WHEN k = 9 THEN '{"first":1}' END AS canonical FROM o
""")
def canonical_json(spark, sf_dir):
    """Model output around JSON: whole, in fences of either case, after braces or a broken fence, with words around it; arrays and
    single values; broken ones."""
    k, size = F.col("p_partkey") % 12, F.col("p_size").cast("string")
    one = F.concat(F.lit('{"z": true, "m": ["'), F.col("p_type"), F.lit('", '), F.col("p_partkey").cast("string"), F.lit('], "a": {"y": null, "x": '), size, F.lit("}}"))
    around = lambda before, after: F.concat(F.lit(before), one, F.lit(after))
    forms = [
        one, around("\n  ", " \t"), around("Here it is:\n```json\n", "\n```\nDone."), around("Use {x}: ```JSON ", "``` {y}"), around("```\n{broken\n```\n```", "```"), around("It is ", ", as said."),
        around("```json\nnothing``` so ", " then"), around("```[1, ", "]```"), F.col("p_partkey").cast("string"), F.concat(F.lit('```{"first": 1}``` ```'), one, F.lit("```")), around("{", ""), F.lit(" \n"),
    ]
    text = F.coalesce(*[F.when(k == i, form) for i, form in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", S.lenient_json(text).alias("canonical"))


@R.query("""
SELECT p_partkey, '{' || concat_ws(',', CASE WHEN p_size > 10 THEN '"size":' || p_size END, '"type":"' || p_type || '"', CASE WHEN p_partkey % 4 > 1 THEN '"name":"' || p_name || '"' END) || '}' AS fact FROM part
""")
def facts_without_empty(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "  ").when(k % 4 == 1, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.without_empty({"size": F.when(F.col("p_size") > 10, F.col("p_size")), "type": F.col("p_type"), "name": name, "none": F.lit("")}).alias("fact"))


@R.query("""
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), f(field, label, pattern) AS (VALUES ('license', 'licen', '(?:version|by(?:-nc)?) [0-9]'), ('phone', '+1', '[+]1 [(][0-9]{3}[)]'), ('mail', 'mail', '[a-z0-9.]+@[a-z0-9.-]+'))
SELECT field, count(*) AS documents, min(doc_id) AS first_doc FROM l, f WHERE contains(t, label) AND NOT regexp_matches(t, pattern) GROUP BY 1
""")
def parser_gaps(spark, sf_dir):
    """Documents that name a field but give no value for it."""
    fields = {"license": ("licen", "(?:version|by(?:-nc)?) [0-9]"), "phone": ("+1", "[+]1 [(][0-9]{3}[)]"), "mail": ("mail", "[a-z0-9.]+@[a-z0-9.-]+")}
    return V.label_gaps(table(spark, sf_dir, "documents"), "doc_id", "text", fields).groupBy("field").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@R.query()
def words_in_documents(spark, sf_dir):
    """Which windows are shown depends on those shown before; a test compares it with a plain search."""
    return S.find_words(table(spark, sf_dir, "documents"), "doc_id", "text", "apache license text", 60, 5)


@R.query("""
SELECT p_partkey, unnest([0, 1, 3])::INT AS line_no, unnest(['Size', 'Type of part', 'Note']) AS label, unnest([p_size::VARCHAR, p_type, 'a: ' || p_name]) AS value FROM part
""")
def line_pairs(spark, sf_dir):
    text = F.concat(F.lit("Size: "), F.col("p_size").cast("string"), F.lit("\n  Type of part :"), F.col("p_type"), F.lit("  \n: none\nNote: a: "), F.col("p_name"), F.lit("\nno colon\nempty:  \n12: number first\n" + "x" * 50 + ": too long"))
    return S.line_pairs(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@R.query("""
WITH v AS (SELECT p_partkey, p_type, p_size, p_name FROM part WHERE p_partkey % 5 > 0)
SELECT p_partkey, 2 AS row_no, 'size' AS label, 'Base' AS "column", p_size::VARCHAR AS value FROM v UNION ALL SELECT p_partkey, 2, 'size', p_type, (p_size + 5)::VARCHAR FROM v UNION ALL SELECT p_partkey, 3, 'name', 'Base', p_name FROM v UNION ALL SELECT p_partkey, 4, NULL, p_type, 'late' FROM v WHERE p_size > 25
""")
def table_columns(spark, sf_dir):
    """Ragged tables: a title above the header, a row with too many cells, a short one, one without a label; some have no header."""
    size = F.col("p_size").cast("string")
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    head = F.when(F.col("p_partkey") % 5 > 0, row("", "Base", F.col("p_type"))).otherwise(row("", "7", F.col("p_type")))
    last = F.when(F.col("p_size") > 25, row(" ", "", "late")).otherwise(row("", "", "", "beyond"))
    rows = F.array(row("Title"), head, row("size", size, (F.col("p_size") + 5).cast("string"), "beyond"), row(F.lit("name"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise("3")), last)
    cells = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(rows).alias("row_no", "cells")).select("p_partkey", "row_no", F.posexplode("cells").alias("col_no", "cell"))
    return S.table_columns(cells, ["p_partkey"])
