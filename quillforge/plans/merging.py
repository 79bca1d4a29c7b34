"""Matching derived sources of the part table, and merging and judging what they state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import resolution as X
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()

# three views of the part table: one exact, one with shifted prices, one without sizes and with other prices
_SOURCES = """
t AS (SELECT p_partkey AS target_id, p_brand, p_type AS t_type, p_size AS t_size, p_retailprice AS t_price FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT 'a' AS source, p_partkey, p_brand, p_type, p_size, p_retailprice AS price FROM part
  UNION ALL SELECT 'b', p_partkey, p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_type END, p_size, p_retailprice + p_partkey % 3 FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT 'c', p_partkey, p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_size END, p_retailprice - 1 FROM part WHERE p_partkey % 5 <> 1),
v AS (SELECT *, CASE WHEN p_type IS NULL THEN 'unknown' WHEN t_type = p_type THEN 'matched' ELSE 'veto' END AS k_type, CASE WHEN p_size IS NULL THEN 'unknown' WHEN abs(t_size - p_size) <= 1 THEN 'matched' ELSE 'veto' END AS k_size,
  CASE WHEN abs(t_price - price) <= greatest(0.0, abs(t_price) * 0.1) THEN 'matched' ELSE 'veto' END AS k_price FROM t JOIN s USING (p_brand)),
l AS (SELECT *, max((k_size = 'matched')::INT) OVER (PARTITION BY target_id, source) AS st FROM v WHERE k_type <> 'veto' AND k_size <> 'veto' AND k_price <> 'veto'),
m AS (SELECT target_id, source, p_partkey, p_type, p_size, price, concat_ws(',', CASE WHEN k_price = 'matched' THEN 'price' END, CASE WHEN k_size = 'matched' THEN 'size' END, CASE WHEN k_type = 'matched' THEN 'type' END) AS keys_matched,
  concat_ws(',', CASE WHEN k_price = 'unknown' THEN 'price' END, CASE WHEN k_size = 'unknown' THEN 'size' END, CASE WHEN k_type = 'unknown' THEN 'type' END) AS keys_unknown FROM l WHERE st = 0 OR k_size = 'matched'),
u AS (SELECT t.target_id, src.source, count(m.p_partkey) AS survivors, count(DISTINCT m.p_type) AS designations FROM t CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS source) src LEFT JOIN m ON m.target_id = t.target_id AND m.source = src.source GROUP BY ALL),
us AS (SELECT *, CASE WHEN survivors = 0 THEN 'none' WHEN designations = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM u),
lv AS (SELECT target_id, count(CASE WHEN status = 'unique' THEN 1 END) AS unique_sources, count(CASE WHEN survivors > 0 THEN 1 END) AS ws,
  arg_min(source, CASE status WHEN 'unique' THEN ascii(source) WHEN 'ambiguous' THEN ascii(source) + 10 END) AS ls FROM us GROUP BY 1),
ml AS (SELECT target_id, CASE WHEN unique_sources >= 2 THEN 'exact' WHEN ws > 0 THEN 'partial' END AS level, CASE WHEN ws > 0 THEN ls END AS lead_source, unique_sources FROM lv)
"""


def _matching(spark, sf_dir):
    """Targets, rows of the sources, verdicts and bands. Type and size are bands too: what they veto is not paired."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    targets = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("target_id"), "p_brand", F.col("p_type").alias("t_type"), F.col("p_size").alias("t_size"), F.col("p_retailprice").alias("t_price"))
    k = F.col("p_partkey")
    a = part.select(F.lit("a").alias("source"), "p_partkey", "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("price"))
    b = part.where(k % 3 != 0).select(F.lit("b").alias("source"), "p_partkey", "p_brand", F.when(k % 4 != 0, F.col("p_type")).alias("p_type"), "p_size", (F.col("p_retailprice") + k % 3).alias("price"))
    c = part.where(k % 5 != 1).select(F.lit("c").alias("source"), "p_partkey", "p_brand", "p_type", F.when(k % 2 == 0, F.col("p_size")).alias("p_size"), (F.col("p_retailprice") - 1).alias("price"))
    verdicts = {"type": X.exact("t_type", "p_type"), "size": X.within("t_size", "p_size", 1), "price": X.within("t_price", "price", share=0.1)}
    source = a.unionByName(b).unionByName(c)
    price = X.near(source, "price", F.col("t_price") * 0.9, F.col("t_price") * 1.1, 0.2, share=True)
    size = X.near(source, "p_size", F.col("t_size") - 1, F.col("t_size") + 1, 1)
    return targets, source, verdicts, [price, size, (F.when(F.col("t_type").isNotNull(), F.array("t_type")), F.col("p_type"))]


def _judged(spark, sf_dir):
    """Targets, their representatives with members, and their survivors: equal targets are matched once, with equal source
    rows counted as `n`."""
    targets, source, verdicts, bands = _matching(spark, sf_dir)
    reps, members = X.alike(targets, ["p_brand", "t_type", "t_size", "t_price"])
    counted = source.groupBy(*[c for c in source.columns if c != "p_partkey"]).agg(F.count("*").alias("n"))
    return targets, reps, members, lambda some: X.match(some, counted, ["p_brand"], verdicts, "size", bands)


def _statuses(spark, sf_dir):
    _, reps, members, survivors_of = _judged(spark, sf_dir)
    return members, X.match_status(reps, survivors_of(reps), "p_type")


@R.query(f"WITH {_SOURCES} SELECT * FROM m")
def target_match(spark, sf_dir):
    targets, source, verdicts, bands = _matching(spark, sf_dir)
    return X.match(targets, source, ["p_brand"], verdicts, "size", bands, "p_partkey").select("target_id", "source", "p_partkey", "p_type", "p_size", "price", "keys_matched", "keys_unknown")


@R.query(f"WITH {_SOURCES} SELECT * FROM us")
def match_status(spark, sf_dir):
    return X.for_all(*_statuses(spark, sf_dir))


@R.query(f"WITH {_SOURCES} SELECT * FROM ml")
def match_level(spark, sf_dir):
    members, statuses = _statuses(spark, sf_dir)
    return X.for_all(members, X.match_level(statuses, ["a", "b", "c"]))


def _offer_sql(field: str, spread: float, pct: float, step: float) -> str:
    return f"""SELECT target_id, source, '{field}' AS field, count({field}) AS n, count(DISTINCT {field}) AS d, min({field})::DOUBLE AS lo, max({field})::DOUBLE AS hi, quantile_disc({field}, 0.5)::DOUBLE AS med,
      {spread}::DOUBLE AS spread, {pct}::DOUBLE AS pct, {step}::DOUBLE AS step FROM m GROUP BY 1, 2"""


_OFFERS = f"""
os AS ({_offer_sql("price", 4, 1, 1)} UNION ALL {_offer_sql("p_size", 1, 10, 1)}),
of AS (SELECT target_id, source, field, n, CASE WHEN n = 0 THEN 'no_value' WHEN d = 1 THEN 'value' WHEN hi - lo <= spread AND hi - lo <= abs(med) * pct / 100 THEN 'within_precision' ELSE 'survivors_disagree' END AS status,
  CASE WHEN d = 1 THEN lo WHEN n > 0 AND hi - lo <= spread AND hi - lo <= abs(med) * pct / 100 THEN sign(med) * floor(abs(med) / step + 0.500000001) * step END AS value FROM os)
"""
RULES = {"price": (4.0, 1.0, 1.0), "p_size": (1.0, 10.0, 1.0)}


@R.query(f"WITH {_SOURCES}, {_OFFERS} SELECT * FROM of")
def field_offers(spark, sf_dir):
    _, reps, members, survivors_of = _judged(spark, sf_dir)
    return X.for_all(members, X.field_offers(reps, survivors_of, RULES))


@R.query(f"""
WITH {_SOURCES}, {_OFFERS}, ad(source, field, precedence, least_level) AS (VALUES ('a', 'price', 2, 'partial'), ('b', 'price', 1, 'exact'), ('c', 'p_size', 1, 'partial'), ('a', 'p_size', 2, 'partial')),
gv AS (SELECT p_partkey AS target_id, 'price' AS field, p_retailprice AS official_value FROM part WHERE p_partkey % 250 = 0),
o AS (SELECT of.*, level, precedence, least_level, official_value, CASE WHEN of.value IS NULL THEN 'offer_' || of.status WHEN precedence IS NULL THEN 'not_admitted'
    WHEN (CASE level WHEN 'exact' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) < (CASE least_level WHEN 'exact' THEN 2 ELSE 1 END) THEN 'below_level'
    WHEN official_value IS NOT NULL AND abs(official_value - of.value) <= 1 THEN 'official_wins' WHEN official_value IS NOT NULL THEN 'contradicts_official' ELSE 'admitted' END AS reason
  FROM of LEFT JOIN ml USING (target_id) LEFT JOIN ad USING (source, field) LEFT JOIN gv USING (target_id, field)),
f AS (SELECT target_id, field, arg_min(value, precedence) FILTER (reason = 'admitted') AS fv, arg_min(source, precedence) FILTER (reason = 'admitted') AS fs FROM o GROUP BY ALL),
p AS (SELECT target_id, field, any_value(fv) AS fv, any_value(fs) AS fs, coalesce(bool_or(value IS NOT NULL AND abs(value - fv) > 1), false) AS conflict, max(official_value) AS ov,
  coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (value IS NOT NULL AND abs(value - fv) <= 1 AND source <> fs), '') AS peers,
  coalesce(string_agg(DISTINCT source || ':' || reason, ',' ORDER BY source || ':' || reason) FILTER (reason <> 'admitted'), '') AS withheld FROM o JOIN f USING (target_id, field) GROUP BY ALL)
SELECT target_id, field, CASE WHEN ov IS NOT NULL THEN 'official' WHEN fs IS NULL THEN 'withheld' WHEN conflict THEN 'source_conflict' ELSE 'served' END AS status,
  CASE WHEN ov IS NOT NULL THEN ov WHEN fs IS NOT NULL AND NOT conflict THEN fv END AS value, CASE WHEN ov IS NOT NULL THEN 'official' WHEN fs IS NOT NULL AND NOT conflict THEN fs END AS source,
  CASE WHEN fs IS NOT NULL AND NOT conflict AND ov IS NULL THEN peers ELSE '' END AS corroborated_by, withheld FROM p
""")
def facts_merge(spark, sf_dir):
    _, reps, members, survivors_of = _judged(spark, sf_dir)
    levels = X.for_all(members, X.match_level(X.match_status(reps, survivors_of(reps), "p_type"), ["a", "b", "c"]))
    admission = spark.createDataFrame([("a", "price", 2, "partial"), ("b", "price", 1, "exact"), ("c", "p_size", 1, "partial"), ("a", "p_size", 2, "partial")], "source string, field string, precedence int, least_level string")
    official = table(spark, sf_dir, "part").where("p_partkey % 250 = 0").select(F.col("p_partkey").alias("target_id"), F.lit("price").alias("field"), F.col("p_retailprice").alias("official_value"))
    return X.merge_facts(X.for_all(members, X.field_offers(reps, survivors_of, RULES)), levels, admission, official, 1.0)


_EVIDENCE = """e AS (SELECT l_partkey, floor(l_extendedprice / l_quantity / 50)::BIGINT * 50 AS v, s_nationkey AS market, l_suppkey, l_returnflag, l_suppkey % 5 = 0 AS official, l_orderkey % 4 <> 0 AS scope_ok, l_partkey % 7 <> 0 AS policy
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("market"))
    e = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return e.select(
        "l_partkey", (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 50) * 50).alias("v"), "market", "l_suppkey", "l_returnflag", (F.col("l_suppkey") % 5 == 0).alias("official"), (F.col("l_orderkey") % 4 != 0).alias("scope_ok"), (F.col("l_partkey") % 7 != 0).alias("policy")
    )


@R.query(f"""
WITH {_EVIDENCE}, pv AS (SELECT l_partkey, v, count(*) AS c, count(DISTINCT market) AS dm, count(DISTINCT l_returnflag) AS ds FROM e GROUP BY ALL),
b AS (SELECT l_partkey, sum(c)::BIGINT AS n, count(*) AS d, max(dm) AS mm, max(ds) AS ms FROM pv GROUP BY 1),
g AS (SELECT l_partkey, count(DISTINCT market) AS nm, count(DISTINCT l_returnflag) AS ns, count(DISTINCT l_suppkey) AS nsrc, max(v - 50.0) <= min(v + 50.0) AS o FROM e GROUP BY 1)
SELECT l_partkey, n, d AS distinct_values, CASE WHEN d = 1 THEN 'agreed' WHEN o THEN 'rounding_equivalent' WHEN mm = 1 AND nm = d THEN 'market_difference' WHEN nsrc = 1 THEN 'internal_source_inconsistency' WHEN ms = 1 AND ns = d THEN 'variant_scope_difference' ELSE 'true_conflict' END AS conflict_class FROM b JOIN g USING (l_partkey)
""")
def conflict_classes(spark, sf_dir):
    return X.conflict_classes(_evidence(spark, sf_dir).withColumn("tolerance", F.lit(50.0)), ["l_partkey"], "v", "tolerance", "market", "l_suppkey", "l_returnflag")


@R.query(f"""
WITH {_EVIDENCE}, g AS (SELECT l_partkey, bool_or(policy) AS pol, count(DISTINCT CASE WHEN market <> 3 AND scope_ok THEN v END) AS d, min(CASE WHEN market <> 3 AND scope_ok THEN v END) AS val, count(CASE WHEN market <> 3 THEN 1 END) AS f,
  count(CASE WHEN market <> 3 AND scope_ok AND official THEN 1 END) AS off, min(CASE WHEN market = 3 THEN v END) AS lo, max(CASE WHEN market = 3 THEN v END) AS hi FROM e GROUP BY 1),
r AS (SELECT *, CASE WHEN NOT pol THEN 'field_policy_not_portable' WHEN d = 0 THEN 'scope_below_portability' WHEN d = 1 AND lo IS NOT NULL AND (lo <> val OR hi <> val) THEN 'target_contradicts' WHEN d > 1 THEN 'foreign_markets_disagree' WHEN off = 0 THEN 'no_official_source' END AS reason FROM g WHERE f > 0)
SELECT l_partkey, reason IS NULL AS portable, CASE WHEN reason IS NULL THEN val END AS value, reason FROM r
""")
def portability(spark, sf_dir):
    return X.portability(_evidence(spark, sf_dir), ["l_partkey"], "v", "market", 3, "official", "scope_ok", "policy")


@R.query(f"""
WITH {_EVIDENCE}, g AS (SELECT l_partkey, count(v) AS n, count(CASE WHEN v IS NOT NULL AND NOT (l_returnflag = 'N') THEN 1 END) AS solid, count(DISTINCT CASE WHEN scope_ok AND market < 6 THEN v END) AS d, count(CASE WHEN market < 6 THEN 1 END) AS here, count(CASE WHEN scope_ok AND market < 6 THEN 1 END) AS served FROM e GROUP BY 1)
SELECT l_partkey, n, CASE WHEN n = 0 THEN 'missing' WHEN solid = 0 THEN 'weak_provenance' WHEN d > 1 THEN 'conflicting' WHEN served = 0 AND here > 0 THEN 'variant_not_exact' WHEN served = 0 THEN 'foreign_market_only' ELSE 'ok' END AS state FROM g
""")
def field_states(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("here", F.col("market") < 6).withColumn("weak", F.col("l_returnflag") == "N")
    return X.field_states(e, ["l_partkey"], "v", "scope_ok", "here", "weak")


_INTERVALS = """i AS (SELECT l_partkey AS item, floor(l_extendedprice / l_quantity / 400)::BIGINT * 400 AS lo, floor(l_extendedprice / l_quantity / 400)::BIGINT * 400 + CASE WHEN l_linenumber = 1 THEN 500 ELSE 0 END AS hi, 100 AS tol,
  s_nationkey % 3 AS market, l_orderkey % 5 AS document, l_suppkey AS domain, l_returnflag AS scope, l_tax < 0.04 AS exact FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@R.query(f"""
WITH {_INTERVALS}, v AS (SELECT item, lo, hi, count(*) AS c, count(DISTINCT market) AS dm, count(DISTINCT scope) AS ds FROM i GROUP BY ALL), b AS (SELECT item, sum(c)::BIGINT AS n, count(*) AS d, max(dm) AS mm, max(ds) AS ms FROM v GROUP BY 1),
a AS (SELECT item, count(DISTINCT market) AS nm, count(DISTINCT scope) AS ns, max(lo - tol) <= min(hi + tol) AS meets, count(CASE WHEN lo <> hi THEN 1 END) AS ranges, min(CASE WHEN lo = hi THEN lo END) AS s0, max(CASE WHEN lo = hi THEN lo END) AS s1,
  max(CASE WHEN lo <> hi THEN lo END) AS r0, min(CASE WHEN lo <> hi THEN hi END) AS r1, bool_and(exact) FILTER (lo = hi) AS ex FROM i GROUP BY 1),
s AS (SELECT item FROM (SELECT item, document, count(DISTINCT (lo, hi)) AS k FROM i GROUP BY 1, 2 UNION ALL SELECT item, domain + 1000000, count(DISTINCT (lo, hi)) FROM i GROUP BY 1, 2) WHERE k > 1 GROUP BY 1),
k AS (SELECT item, n, d, ex, CASE WHEN d = 1 THEN 'unit_equivalent' WHEN ranges > 0 AND s0 = s1 AND s0 BETWEEN r0 AND r1 THEN 'scalar_inside_range' WHEN meets THEN 'rounding_equivalent' WHEN nm > 1 AND mm = 1 AND nm = d THEN 'market_difference'
  WHEN s.item IS NOT NULL THEN 'internal_source_inconsistency' WHEN ms = 1 AND ns = d THEN 'variant_scope_difference' ELSE 'true_conflict' END AS c FROM b JOIN a USING (item) LEFT JOIN s USING (item))
SELECT item, n, d AS distinct_values, c AS conflict_class, CASE WHEN c = 'scalar_inside_range' THEN coalesce(ex, false) ELSE c IN ('unit_equivalent', 'rounding_equivalent') END AS normalised FROM k
""")
def interval_conflicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber", "l_returnflag", "l_tax")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    low = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 400) * 400
    i = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).select(
        F.col("l_partkey").alias("item"), low.alias("lo"), (low + F.when(F.col("l_linenumber") == 1, 500).otherwise(0)).alias("hi"), F.lit(100).alias("tol"),
        (F.col("s_nationkey") % 3).alias("market"), (F.col("l_orderkey") % 5).alias("document"), F.col("l_suppkey").alias("domain"), F.col("l_returnflag").alias("scope"), (F.col("l_tax") < 0.04).alias("exact"),
    )
    return X.interval_conflicts(i, ["item"], "lo", "hi", "tol", "market", "document", "domain", "scope", "exact")


@R.query("""
WITH r AS (SELECT l_partkey, CASE WHEN l_linestatus = 'F' THEN floor(l_quantity / 10)::INT END AS v, CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity / 10)::INT - l_linenumber % 2 END AS lo, CASE WHEN l_tax > 0.02 THEN floor(l_quantity / 10)::INT + l_linenumber % 3 END AS hi FROM lineitem),
s AS (SELECT *, v IS NOT NULL AND coalesce(hi, v) - coalesce(lo, v) <= 2 AS kept FROM r),
g AS (SELECT l_partkey, count(v) AS n, count(CASE WHEN v IS NOT NULL AND NOT kept THEN 1 END) AS dropped, min(v) FILTER (kept) AS a, max(v) FILTER (kept) AS b, quantile_disc(v, 0.5) FILTER (kept) AS med FROM s GROUP BY 1),
t AS (SELECT *, CASE WHEN n = 0 THEN 'no_value' WHEN dropped > n * 0.25 THEN 'range' WHEN a = b THEN 'value' WHEN b - a <= 1 THEN 'within_precision' ELSE 'survivors_disagree' END AS status FROM g)
SELECT l_partkey, n AS n_stated, dropped AS n_dropped, status, CASE WHEN status = 'value' THEN a WHEN status = 'within_precision' THEN med END AS value FROM t
""")
def range_agreement(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    q, n = F.floor(F.col("l_quantity") / 10).cast("int"), F.col("l_linenumber")
    rows = lines.select("l_partkey", F.when(F.col("l_linestatus") == "F", q).alias("v"), F.when(F.col("l_returnflag") != "N", q - n % 2).alias("lo"), F.when(F.col("l_tax") > 0.02, q + n % 3).alias("hi"))
    return X.range_agreement(rows, ["l_partkey"], "v", "lo", "hi", 2, 1)


@R.query(f"""
WITH {_SOURCES}, rt AS (SELECT target_id, CASE target_id // 50 % 3 WHEN 0 THEN 'european' WHEN 1 THEN 'american' END AS route FROM t), q AS (SELECT target_id, bool_or(status = 'unique' AND source = 'a') AS a, bool_or(status = 'unique' AND source = 'b') AS b, bool_or(status = 'unique' AND source = 'c') AS c, bool_or(survivors > 0) AS s, bool_or(survivors > 0 AND source IN ('a', 'b')) AS eu, bool_or(survivors > 0 AND source = 'c') AS am FROM us GROUP BY 1)
SELECT target_id, route, CASE WHEN CASE route WHEN 'european' THEN a AND b OR a AND c WHEN 'american' THEN c ELSE (a AND b OR a AND c) AND c END THEN 'exact' WHEN CASE route WHEN 'european' THEN eu WHEN 'american' THEN am ELSE s END THEN 'partial' END AS level FROM rt LEFT JOIN q USING (target_id)
""")
def level_by_route(spark, sf_dir):
    targets, reps, members, survivors_of = _judged(spark, sf_dir)
    kind = F.floor(F.col("target_id") / 50) % 3
    routes = targets.select("target_id", F.when(kind == 0, "european").when(kind == 1, "american").alias("route"))
    return X.level_by_route(X.for_all(members, X.match_status(reps, survivors_of(reps), "p_type")), routes, {"european": [["a", "b"], ["a", "c"]], "american": [["c"]]}, {"european": ["a", "b"], "american": ["c"]})


@R.query("""
WITH l AS (SELECT l_partkey AS item, 's' || l_suppkey % 4 AS source, l_linestatus AS field, floor(l_quantity / 12)::INT AS v, l_discount > 0.085 AS bad, year(l_shipdate) AS y, l_tax FROM lineitem),
g AS (SELECT item, source, field, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS d, count(DISTINCT CASE WHEN NOT bad THEN v END) AS k, min(CASE WHEN NOT bad THEN v END) AS lo, max(y) AS y, max(l_tax) AS tax FROM l GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN k > 1 THEN 'survivors_disagree' ELSE 'value' END AS st, CASE WHEN k = 1 THEN lo END AS value, item % 3 AS lv FROM g),
r AS (SELECT *, CASE WHEN n = d THEN 'inconsistent' WHEN d > n * 0.25 THEN 'range' WHEN st = 'survivors_disagree' THEN 'disagree' WHEN value IS NULL THEN 'no_value' WHEN source = 's3' AND field = 'F' THEN 'reference_only' WHEN y < 2001 - 4 THEN 'too_old' WHEN tax < 0.01 THEN 'other_definition' WHEN lv < 1 THEN 'below_level' WHEN item % 11 = 0 THEN 'missing_key' END AS reason FROM o),
v AS (SELECT *, CASE WHEN reason IS NULL THEN value END AS ov FROM r), s AS (SELECT v.*, coalesce(reason, CASE WHEN field = 'O' AND NOT EXISTS (SELECT 1 FROM v x WHERE x.item = v.item AND x.field = v.field AND x.source <> v.source AND abs(x.ov - v.ov) <= 1) THEN 'uncorroborated' ELSE 'offered' END) AS status FROM v)
SELECT item, field, source, CASE WHEN status = 'offered' THEN value END AS value, status FROM s
""")
def offer_ladder(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    bad = F.col("l_discount") > 0.085
    v = F.when(~bad, F.floor(F.col("l_quantity") / 12).cast("int"))
    g = lines.groupBy(F.col("l_partkey").alias("item"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), F.col("l_linestatus").alias("field"))
    g = g.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_dropped"), F.countDistinct(v).alias("k"), F.min(v).alias("lo"), F.max(F.year("l_shipdate")).alias("year"), F.max("l_tax").alias("tax"))
    o = g.select("item", "source", "field", "n", "n_dropped", F.when(F.col("k") > 1, "survivors_disagree").otherwise("value").alias("status"), F.when(F.col("k") == 1, F.col("lo")).alias("value"), "year", ((F.col("source") == "s3") & (F.col("field") == "F")).alias("reference"), (F.col("tax") >= 0.01).alias("definition_ok"), (F.col("item") % 3).alias("level"), (F.col("item") % 11 != 0).alias("key_stated"))
    return X.offer_ladder(o, ["item"], "field", "source", F.lit(2001), 4, 1, ["O"], 1)


@R.query("""
WITH f AS (SELECT p_partkey, 'government' AS tier, p_size AS v FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'dataset', p_size + p_partkey % 2 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'open', CASE WHEN p_partkey % 5 > 0 THEN p_size + p_partkey % 3 END FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'rumour', 0 FROM part),
o AS (SELECT *, CASE tier WHEN 'government' THEN 1 WHEN 'dataset' THEN 2 WHEN 'open' THEN 3 END AS p FROM f WHERE tier <> 'rumour' AND v IS NOT NULL), w AS (SELECT *, first_value(v) OVER (PARTITION BY p_partkey ORDER BY p) AS best FROM o)
SELECT p_partkey, max(best) AS v, arg_min(tier, p) AS tier, coalesce(string_agg(tier || ':' || v, ',' ORDER BY p) FILTER (v <> best), '') AS overruled FROM w GROUP BY 1
""")
def final_records(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    tier = lambda name, where, v: part.where(where).select("p_partkey", F.lit(name).alias("tier"), v.cast("int").alias("v"))
    facts = tier("government", k % 4 == 0, F.col("p_size")).union(tier("dataset", k % 3 == 0, F.col("p_size") + k % 2)).union(tier("open", k % 2 == 0, F.when(k % 5 > 0, F.col("p_size") + k % 3))).union(tier("rumour", F.lit(True), F.lit(0)))
    return X.by_precedence(facts, ["p_partkey"], "tier", ["government", "dataset", "open"], "v")
