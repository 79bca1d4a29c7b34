"""Joins between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import joins as J
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()
LINE = ["l_orderkey", "l_linenumber"]


@R.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN p END AS l_extendedprice FROM r
""")
def unique_key_left_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return J.unique_key_join(lines.select(*LINE).distinct(), lines, LINE, ["l_extendedprice"])


@R.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT sum(n)::BIGINT AS rr, sum(n - 1)::BIGINT AS dr FROM r),
l AS (SELECT l.l_quantity, r.n FROM lineitem l LEFT JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber AND r.n = 1),
g AS (SELECT count(*) AS c, count(n) AS m, sum(CASE WHEN n IS NOT NULL THEN l_quantity ELSE 0 END) AS w, sum(l_quantity) AS a FROM l)
SELECT c AS left_rows, rr AS right_rows, dr AS duplicate_rows, m AS matched, floor(m::DOUBLE / c * 100 * 10 + 0.5) / 10 AS matched_pct, m AS with_values, floor(m::DOUBLE / c * 100 * 10 + 0.5) / 10 AS values_pct,
  floor(w / a * 100 * 10 + 0.5) / 10 AS weighted_pct FROM g, s
""")
def unique_key_join_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return J.unique_key_stats(lines, lines.select(*LINE, "l_extendedprice"), LINE, "l_extendedprice", "l_quantity")


@R.query("""
WITH v AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS votes FROM orders WHERE o_totalprice > 150000 GROUP BY ALL),
ra AS (SELECT *, sum(votes) OVER w::BIGINT AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY votes DESC, o_orderpriority) AS k FROM v WINDOW w AS (PARTITION BY o_custkey, o_orderstatus)),
a AS (SELECT o_custkey, o_orderstatus, o_orderpriority AS av, votes AS avotes, n AS an FROM ra WHERE k = 1),
vb AS (SELECT o_custkey, o_orderpriority, sum(votes)::BIGINT AS votes FROM v GROUP BY ALL),
rb AS (SELECT *, sum(votes) OVER (PARTITION BY o_custkey)::BIGINT AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority) AS k FROM vb),
b AS (SELECT o_custkey, o_orderpriority AS bv, votes AS bvotes, n AS bn FROM rb WHERE k = 1),
s AS (SELECT o_custkey, count(DISTINCT av) AS ms FROM a WHERE an >= 2 GROUP BY 1),
t AS (SELECT c_custkey AS o_custkey, st AS o_orderstatus FROM customer, (SELECT unnest(['F', 'O', 'P']) AS st)),
j AS (SELECT t.*, av, avotes, an, bv, bvotes, bn, ms FROM t LEFT JOIN a USING (o_custkey, o_orderstatus) LEFT JOIN b USING (o_custkey) LEFT JOIN s USING (o_custkey)),
z AS (SELECT *, CASE WHEN an IS NOT NULL THEN CASE WHEN an >= 2 AND avotes::DOUBLE / an >= 0.6 THEN NULL ELSE 'below_threshold' END WHEN bn IS NULL THEN 'no_pool' WHEN bn < 4 THEN 'pooled_n_below'
  WHEN coalesce(ms, 0) <> 1 THEN 'subgroups_disagree' WHEN bvotes::DOUBLE / bn < 0.5 THEN 'below_threshold' END AS reason FROM j)
SELECT o_custkey, o_orderstatus, CASE WHEN an IS NOT NULL THEN 'A' WHEN bn IS NOT NULL THEN 'B' END AS level, CASE WHEN reason IS NULL THEN CASE WHEN an IS NOT NULL THEN av ELSE bv END END AS value, reason FROM z
""")
def pool_unanimity_fallback(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").where("o_totalprice > 150000")
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(*map(F.lit, "FOP"))).alias("o_orderstatus"))
    return J.fallback_majority(targets, votes, ["o_custkey", "o_orderstatus"], ["o_custkey"], "o_orderpriority", 2, 0.6, 4, 0.5, 2)


_CODED = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k')::INT END AS code FROM events"


@R.query(f"""
WITH e AS ({_CODED}), g AS (SELECT user_id, event_type, count(DISTINCT CASE WHEN code <> 0 THEN code END) AS r, max(CASE WHEN code <> 0 THEN code END) AS c, count(CASE WHEN code = 0 THEN 1 END) AS z FROM e GROUP BY ALL)
SELECT event_id, user_id, event_type, code, CASE WHEN code <> 0 THEN code WHEN r = 1 THEN c END AS filled_code,
  CASE WHEN code <> 0 THEN 'keyed' WHEN r = 1 THEN 'filled' WHEN r > 1 THEN 'ambiguous' WHEN z > 0 THEN 'placeholder' ELSE 'unknown' END AS fill_status FROM e JOIN g USING (user_id, event_type)
""")
def key_backfill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("int")).alias("code"))
    return J.backfill(e, "code", ["user_id", "event_type"])


@R.query("""
WITH p AS (SELECT p_partkey, p_size, p_brand, p_type FROM part), t AS (SELECT p_size, p_type, min(p_brand) AS wanted FROM part GROUP BY 1, 2),
j AS (SELECT t.p_size, t.p_type, wanted, p_partkey, p_brand, p_brand = w2 AS hit, max((p_brand = w2)::INT) OVER v AS a, min(p_brand) OVER v = max(p_brand) OVER v AS o
  FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN wanted ELSE 'Brand#0' END AS w2 FROM t) t JOIN p ON p.p_size = t.p_size AND p.p_type = t.p_type WINDOW v AS (PARTITION BY t.p_size, t.p_type))
SELECT p_size, p_type, CASE WHEN p_size % 2 = 0 THEN wanted ELSE 'Brand#0' END AS wanted, p_partkey, p_brand, CASE WHEN a = 1 THEN 'by_name' WHEN o THEN 'single_name' ELSE 'ambiguous' END AS selected_by FROM j WHERE a = 0 OR hit
""")
def select_by_name(spark, sf_dir):
    """Every (size, type) asks for a name: one that it has, or one that nothing has."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    targets = part.groupBy("p_size", "p_type").agg(F.min("p_brand").alias("wanted")).withColumn("wanted", F.when(F.col("p_size") % 2 == 0, F.col("wanted")).otherwise("Brand#0"))
    return J.select_by_name(targets, part, ["p_size", "p_type"], "p_brand", "wanted")


@R.query("""
WITH l AS (SELECT l_returnflag, year(l_shipdate) AS y, l_orderkey % 2 AS odd FROM lineitem), b AS (SELECT l_returnflag, y, count(*) AS n FROM l WHERE odd = 0 GROUP BY ALL), a AS (SELECT l_returnflag, y, count(*) AS n FROM l WHERE odd = 1 GROUP BY ALL)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.y, b.y) AS y, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change
FROM b FULL JOIN a ON a.l_returnflag = b.l_returnflag AND a.y = b.y
""")
def build_delta(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.year("l_shipdate").alias("y"))
    return J.delta(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), ["l_returnflag", "y"])


@R.query("SELECT doc_id, lang, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def unreferenced_anti(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels.select("doc_id"), "doc_id", "left_anti")


_SALES = "SELECT p_brand, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey = p_partkey"


@R.query(f"""
WITH s AS ({_SALES}), t AS (SELECT DISTINCT p_brand, y FROM s),
n AS (SELECT p_brand, 'N' || p_brand AS notice_id, CASE WHEN p_brand NOT LIKE '%3' THEN min(y) END AS b, CASE WHEN p_brand NOT LIKE '%3' THEN max(y) - 2 END AS e FROM s WHERE p_brand NOT LIKE '%5' GROUP BY 1)
SELECT t.p_brand, t.y, CASE WHEN n.p_brand IS NULL THEN 'no_notice' WHEN b IS NULL THEN 'range_unresolved' WHEN y BETWEEN b AND e THEN 'affected' ELSE 'not_affected' END AS status,
  CASE WHEN y BETWEEN b AND e THEN 1 ELSE 0 END::BIGINT AS notices, CASE WHEN y BETWEEN b AND e THEN notice_id ELSE '' END AS notice_ids FROM t LEFT JOIN n USING (p_brand)
""")
def range_join_notices(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    sales = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("p_brand", "y").agg(F.count("*").alias("n"))
    known = ~F.col("p_brand").like("%3")
    notices = sales.where("p_brand NOT LIKE '%5'").groupBy("p_brand").agg(F.when(known, F.min("y")).alias("b"), F.when(known, F.max("y") - 2).alias("e")).withColumn("notice_id", F.concat(F.lit("N"), F.col("p_brand")))
    return J.range_join(sales.select("p_brand", "y"), notices, ["p_brand"], "y", "b", "e")


@R.query("""
WITH r AS (SELECT l_partkey, l_quantity, l_suppkey FROM lineitem), g AS (SELECT l_partkey, count(DISTINCT l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS s, min(l_suppkey) AS one FROM r GROUP BY 1)
SELECT p_partkey AS l_partkey, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'value' ELSE 'range' END AS status, CASE WHEN n = 1 THEN lo END AS value, CASE WHEN n > 1 THEN lo END AS range_low, CASE WHEN n > 1 THEN hi END AS range_high,
  coalesce(n, 0) AS n_values, CASE WHEN s = 1 THEN one END AS single_supplier FROM part LEFT JOIN g ON p_partkey = l_partkey
""")
def price_or_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return J.price_or_range(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), rows, ["l_partkey"], "l_quantity", "l_suppkey")


@R.query("""
WITH p AS (SELECT p_partkey, p_brand AS k, upper(p_name) AS code, upper(substr(p_name, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END, 4 + p_size % 5)) AS val FROM part), c AS (SELECT DISTINCT k, code FROM p), v AS (SELECT DISTINCT k, val FROM p WHERE p_partkey % 3 <> 1),
r AS (SELECT c.k, code, val, CASE WHEN code = val THEN 3 WHEN length(code) < 4 OR length(val) < 4 THEN 0 WHEN starts_with(code, val) OR starts_with(val, code) THEN 2 WHEN contains(code, val) OR contains(val, code) THEN 1 ELSE 0 END AS s FROM c JOIN v ON c.k = v.k),
b AS (SELECT k, code, s, val, row_number() OVER (PARTITION BY k, code ORDER BY s DESC, val) AS i FROM r WHERE s > 0)
SELECT c.k AS p_brand, c.code, CASE s WHEN 3 THEN 'equal' WHEN 2 THEN 'prefix' WHEN 1 THEN 'contains' ELSE 'none' END AS relation, b.val AS related FROM c LEFT JOIN b ON b.k = c.k AND b.code = c.code AND i = 1
""")
def relation_join(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    codes = part.select("p_brand", F.upper("p_name").alias("code")).distinct()
    values = part.where(k % 3 != 1).select("p_brand", F.upper(F.substring(F.col("p_name"), F.when(k % 3 == 0, 1).otherwise(2), 4 + F.col("p_size") % 5)).alias("v"))
    return J.strongest_relation(codes, values, "p_brand", "code", "v")


@R.query("""
WITH n AS (SELECT *, lead(role) OVER w AS r, lead(turn) OVER w AS t, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(text) AS call_chars, CASE WHEN r = 'assistant' THEN t END AS result_turn, CASE WHEN r = 'assistant' THEN length(x) END AS result_chars FROM n WHERE role = 'user'
""")
def call_result_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    pairs = J.pair_next(turns, ["conv_id"], ["turn"], "role", "user", "assistant", ["turn", "chars"])
    return pairs.select("conv_id", "turn", F.col("chars").alias("call_chars"), "result_turn", "result_chars")


@R.query("""
WITH i AS (SELECT DISTINCT l_orderkey AS k, l_partkey * CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END AS p FROM lineitem), k AS (SELECT k AS list, p, row_number() OVER (PARTITION BY k ORDER BY md5(p::VARCHAR), p) AS pos FROM i)
SELECT list, pos::INT AS pos, p AS p_partkey, p_brand, p_name, p_partkey IS NOT NULL AS found FROM k LEFT JOIN part ON p_partkey = p
""")
def ordered_lookup(spark, sf_dir):
    """Lists of part ids, one an order, some of them unknown; each is looked up in its own order."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    ids = lines.select(F.col("l_orderkey").alias("list"), (F.col("l_partkey") * F.when(F.col("l_linenumber") == 7, -1).otherwise(1)).alias("p_partkey")).distinct()
    ids = ids.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(F.md5(F.col("p_partkey").cast("string")), "p_partkey")))
    return J.ordered_lookup(ids, table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey", "pos", keep_unknown=True, lists=("list",))


_CALLS = """e AS (SELECT user_id AS run, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'call' WHEN event_type IN ('purchase', 'signup') THEN 'result' END AS kind,
  CASE WHEN json_extract_string(props, '$.k')::INT % 3 = 0 THEN 'id' || json_extract_string(props, '$.k')::INT % 12 END AS call_id, 'tool' || json_extract_string(props, '$.k')::INT % 4 AS name FROM events)"""


@R.query(f"""
WITH RECURSIVE {_CALLS}, k AS (SELECT *, CASE WHEN call_id IS NOT NULL THEN lag((kind, seq)) OVER w END AS b, CASE WHEN call_id IS NOT NULL THEN lead((kind, seq)) OVER w END AS a FROM e WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY run, call_id ORDER BY seq)),
m AS (SELECT run, name, seq, kind, CASE WHEN kind = 'call' AND a[1] = 'result' THEN a[2] END AS own, kind = 'result' AND coalesce(b[1] = 'call', false) AS taken FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY seq) AS i FROM m WHERE NOT taken),
s(run, name, i, waiting, c, r) AS (SELECT DISTINCT run, name, 0::BIGINT, []::STRUCT(seq BIGINT, own BIGINT)[], NULL::BIGINT, NULL::BIGINT FROM q UNION ALL
  SELECT run, name, i, CASE WHEN kind = 'call' THEN list_append(alive, {{'seq': seq, 'own': own}}) ELSE alive[2:] END, CASE WHEN kind = 'result' THEN alive[1].seq END, CASE WHEN kind = 'result' THEN seq END
  FROM (SELECT q.*, list_filter(s.waiting, lambda x: x.own IS NULL OR x.own > q.seq) AS alive FROM s JOIN q ON q.run = s.run AND q.name = s.name AND q.i = s.i + 1))
SELECT m.run, m.seq AS call_seq, m.name, coalesce(m.own, s.r) AS result_seq FROM m LEFT JOIN s ON s.run = m.run AND s.c = m.seq WHERE m.kind = 'call'
""")
def tool_calls(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("view", "click"), "call").when(F.col("event_type").isin("purchase", "signup"), "result")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("id"), (k % 12).cast("string"))).alias("call_id"), F.concat(F.lit("tool"), (k % 4).cast("string")).alias("name"))
    return J.pair_calls(e, "run", "seq")


@R.query("""
WITH t AS (SELECT p_partkey, p_brand AS make, p_size AS code, p_type AS model, CASE WHEN p_partkey % 13 <> 0 THEN 1995 + p_partkey % 7 END AS y FROM part),
n AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS make, s_nationkey * 2 + 1 AS code, CASE s_suppkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'LARGE' ELSE 'PROMO' END AS model, CASE WHEN s_suppkey % 37 <> 0 THEN 1994 + s_suppkey % 5 END AS b, 1996 + s_suppkey % 6 AS e, 'R' || s_suppkey % 60 AS id, 2000 + s_suppkey % 4 AS ry FROM supplier),
m AS (SELECT p_partkey, y, b, e, id, ry FROM t JOIN n USING (make, model) UNION SELECT p_partkey, y, b, e, id, ry FROM t JOIN n USING (code, model)),
g AS (SELECT p_partkey, bool_or(b IS NULL OR e IS NULL OR y IS NULL) AS o FROM m GROUP BY 1), i AS (SELECT p_partkey, id, max(ry) AS ry FROM m WHERE y BETWEEN b AND e GROUP BY 1, 2),
l AS (SELECT p_partkey, count(*) AS k, string_agg(id, ',' ORDER BY ry DESC, id) AS ids FROM i GROUP BY 1),
s AS (SELECT t.p_partkey, y, CASE WHEN o IS NULL THEN 'no_notice' WHEN o THEN 'range_unresolved' WHEN k IS NULL THEN 'not_affected' ELSE 'affected' END AS status, k, ids FROM t LEFT JOIN g USING (p_partkey) LEFT JOIN l USING (p_partkey))
SELECT p_partkey, y, status, CASE WHEN status = 'affected' THEN k ELSE 0 END AS n_notices, CASE WHEN status = 'affected' THEN ids ELSE '' END AS notice_ids FROM s
""")
def notices_by_any_key(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("make"), F.col("p_size").alias("code"), F.col("p_type").alias("model"), F.when(k % 13 != 0, 1995 + k % 7).alias("y"))
    model = F.when(s % 3 == 0, "SMALL").when(s % 3 == 1, "LARGE").otherwise("PROMO")
    n = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Brand#"), (s % 25 + 1).cast("string")).alias("make"), (F.col("s_nationkey") * 2 + 1).alias("code"), model.alias("model"), F.when(s % 37 != 0, 1994 + s % 5).alias("b"), (1996 + s % 6).alias("e"), F.concat(F.lit("R"), (s % 60).cast("string")).alias("id"), (2000 + s % 4).alias("ry")
    )
    return J.notices_by_any_key(t, n, [["make", "model"], ["code", "model"]], "p_partkey", "y", "b", "e", "id", "ry").drop("make", "code", "model")


@R.query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS part, o_orderkey % 7 + 1 AS line, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'X' END AS flag FROM orders),
r AS (SELECT l_partkey AS part, l_linenumber AS line, l_returnflag AS flag, l_quantity AS v, l_suppkey % 3 AS sup FROM lineitem),
nm AS (SELECT part, line, count(DISTINCT flag) AS names, max(flag) AS one FROM r GROUP BY 1, 2), ow AS (SELECT DISTINCT part, line, flag FROM r),
c AS (SELECT t.*, names, CASE WHEN ow.flag IS NOT NULL THEN t.flag WHEN names = 1 THEN one END AS use FROM t LEFT JOIN nm ON nm.part = t.part AND nm.line = t.line LEFT JOIN ow ON ow.part = t.part AND ow.line = t.line AND ow.flag = t.flag),
a AS (SELECT part, line, flag, count(DISTINCT v) AS k, min(v) AS lo, max(v) AS hi, count(DISTINCT sup) AS s, min(sup) AS s0 FROM r GROUP BY ALL)
SELECT c.o_orderkey, CASE WHEN c.part IS NULL THEN 'no_key' WHEN names IS NULL THEN 'not_found' WHEN use IS NULL THEN 'ambiguous_name' END AS reason, CASE WHEN k = 1 THEN lo END AS value, CASE WHEN k > 1 THEN lo END AS range_low, CASE WHEN k > 1 THEN hi END AS range_high,
  coalesce(k, 0) AS n_values, CASE WHEN s = 1 THEN s0 END AS single_supplier, CASE WHEN s > 1 THEN 'several_suppliers' END AS withheld FROM c LEFT JOIN a ON a.part = c.part AND a.line = c.line AND a.flag = c.use
""")
def value_or_reason(spark, sf_dir):
    o, status = F.col("o_orderkey"), F.col("o_orderstatus")
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(o % 11 != 0, F.col("o_custkey")).alias("part"), (o % 7 + 1).alias("line"), F.when(status == "F", "A").when(status == "O", "N").otherwise("X").alias("flag"))
    lines = table(spark, sf_dir, "lineitem")
    r = lines.select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("v"), (F.col("l_suppkey") % 3).alias("sup"))
    return J.value_or_reason(t, r, ["part", "line"], "name", "flag", "v", "sup").drop("part", "line", "flag")


@R.query("""
WITH x AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT s_suppkey, s_name, n_name, r_name, n AS nations_in_region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN x USING (n_regionkey)
""")
def dimension_join(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sizes = nation.groupBy("n_regionkey").agg(F.count("*").alias("nations_in_region"))
    dims = nation.join(region, nation.n_regionkey == region.r_regionkey).join(sizes, "n_regionkey")
    return table(spark, sf_dir, "supplier").join(dims, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name", "nations_in_region")
