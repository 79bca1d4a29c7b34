"""What keeps queries within their limits on larger tables: how often tables are read, what is broadcast, what joins make."""

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_by_level_reads_its_rows_a_few_times_and_broadcasts_no_exploded_rows(spark):
    from quillforge.operators import rules as L

    df = spark.createDataFrame([(i, "a", i % 5, i) for i in range(50)], "id int, b string, s int, p int")
    levels = {"low": (["b"], {}), "size": (["b"], {"s": 2}), "price": (["b"], {"s": 2, "p": 14}), "near": (["b"], {"s": 1, "p": 7}), "self": (["id"], {})}
    plan = _plan(L.counts_by_level(df, df, "id", levels))
    assert plan.count("Scan ExistingRDD") <= 1 + 2 * len(levels)
    assert plan.count("BroadcastHashJoin") <= 1


def test_page_pairs_deals_pages_out_once_and_joins_nothing(spark):
    from quillforge.operators import structure as T

    pages = spark.createDataFrame([(1, "<ul><li>a: 1</li><li>b: 2</li><li>c: 3</li></ul>")], "page int, html string")
    plan = _plan(T.page_pairs(T.page_elements(pages, "page", "html"), "page"))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_names_beside_letters_whose_upper_case_is_two(spark):
    from quillforge.operators.identity import names_any

    rows = ["ßmit", "mitß", "ﬁ mit", "mıt", "xmit", "mit1", "Mit", "MI\nT", "x+Y", "xx+y", "ſ+y mitſ", "cc by\n", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [rows[r[0]] for r in df.where(names_any(F.col("t"), ["mit", "CC BY", "x+y"])).orderBy("i").collect()]
    assert got == ["ßmit", "mitß", "ﬁ mit", "mıt", "Mit", "x+Y", "cc by\n"]


def test_lists_are_looked_up_one_after_the_other(spark):
    from quillforge.operators.joins import ordered_lookup

    ids = spark.createDataFrame([(n, p, 10 * n + p) for n in (2, 1, 3) for p in (2, 1)], "list int, pos int, id int")
    out = ordered_lookup(ids, ids.select("id"), "id", "pos", lists=("list",))
    assert [(r["list"], r["pos"]) for r in out.collect()] == [(n, p) for n in (1, 2, 3) for p in (1, 2)]
    assert "rangepartitioning(list" in _plan(out)


def test_variant_map_puts_the_entries_beside_a_region_last(spark, sf_dir):
    from quillforge.plans import catalogue

    plan = _plan(catalogue.QUERIES["variant_regions"](spark, sf_dir))
    last = next(line for line in plan.splitlines() if "Join" in line)
    assert last.lstrip(" :+-*()0123456789").startswith("SortMergeJoin") and "family" in last


def test_variant_map_makes_the_lists_of_equal_cases_once_and_never_exchanges_them(spark, sf_dir):
    from quillforge.plans import catalogue

    lines = _plan(catalogue.QUERIES["variant_regions"](spark, sf_dir)).splitlines()
    written = next(i for i, line in enumerate(lines) if "Generate inline(_regions" in line)
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    assert not any("array_join" in line or "lambda" in line for line in lines[:written])
    assert any("array_join" in line for line in lines[written:dealt]) and not any("Exchange" in line for line in lines[written:dealt])


def test_every_region_of_a_case_gets_its_lists(spark):
    from quillforge.operators import selection as Q

    n = 2 * Q._AT_ONCE + 5
    told = lambda d, i, family, power: (d, i, family, [], power, *[[]] * 6)
    rows = [told(d, 0, "f", []) for d in range(n)] + [told(0, 0, "f", [])] * n + [told(d, 1, "f", [100.0]) for d in range(0, n, 2)] + [told(1, 2, None, [100.0]), told(1, 3, "g", [100.0]), told(None, 4, "f", [])]
    regions = spark.createDataFrame(rows, "document int, region int, family string, drivetrain array<string>, power array<double>, displacement array<double>, trim array<string>, body array<string>, propulsion array<string>, designation array<string>, gearbox array<string>")
    entries = spark.createDataFrame([("f", 7, True, 100.0), ("f", 5, True, 200.0), ("f", 6, True, None)], "family string, key int, complete boolean, power double").selectExpr("*", "string(null) drivetrain", "double(null) displacement", "array('x') trims", "string(null) body", "string(null) propulsion")
    got = [(r["document"], r["region"], r["candidates_before"], r["candidates_after"], r["status"], r["assignment"]) for r in Q.variant_map(regions, entries, "document", "region", "family").collect()]
    heard = lambda d: ([7], "assigned", 7) if d % 2 == 0 or d == 1 else ([5, 6, 7], "unresolved", None)
    want = [(d, 0, [5, 6, 7], *heard(d)) for d in [*range(n), *[0] * n]]
    want += [(d, 1, [6, 7], [6, 7], "unresolved", None) for d in range(0, n, 2)] + [(1, 2, [], [], "unresolved", None), (1, 3, [], [], "no_catalog", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_matching_exchanges_no_pairs(spark, sf_dir):
    from quillforge.plans import catalogue

    plan = _plan(catalogue.QUERIES["target_match"](spark, sf_dir))
    assert "Window" not in plan and all("_band2" in line or "p_brand" not in line or "t_type" not in line or "isnull" in line for line in plan.splitlines() if "Join" in line)


def test_equal_targets_meet_equal_notices_once(spark):
    from quillforge.operators.joins import notices_by_any_key

    targets = spark.range(200).selectExpr("id AS t", "'m' AS make", "1 AS code", "2000 AS y")
    notices = spark.range(200).selectExpr("'m' AS make", "1 AS code", "1999 AS b", "2001 AS e", "'R1' AS n", "5 AS ry")
    out = notices_by_any_key(targets, notices, [["make"], ["code"]], "t", "y", "b", "e", "n", "ry")
    assert {(r["status"], r["n_notices"], r["notice_ids"]) for r in out.collect()} == {("affected", 1, "R1")} and out.count() == 200
    assert all("t#" not in line for line in _plan(out).splitlines() if "Join" in line and "make" in line and "isnull" not in line)


def test_data_sheets_are_dealt_out_before_they_are_made_and_read(spark, sf_dir):
    from quillforge.plans import catalogue

    lines = [line.strip() for line in _plan(catalogue.QUERIES["dictionary_statements"](spark, sf_dir)).splitlines()]
    read = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("Exchange hashpartitioning(p_partkey" in line and "REPARTITION_BY_NUM" in line for line in lines[read:])
    assert not any("Generate" in line for line in lines[next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line) :])


def test_equal_segments_of_a_task_are_read_once(spark):
    from quillforge.operators import extraction as X

    long = "power " + "x" * X.KNOWN_LENGTH + " power 90 kw"
    df = spark.createDataFrame([(d, s, None, None, t) for d in range(3) for s, t in enumerate(["power 80 kw", "power 80 kw", long])], "d int, segment int, label string, value string, text string").coalesce(1)
    out = X.extract(df, "d", [X.Field("power", "numeric", ("power",), {"kw": 1.0})])
    assert sorted((r["d"], r["segment"], r["value"]) for r in out.collect()) == [(d, s, v) for d in range(3) for s, v in enumerate(["80", "80", "90"])]


def test_conflicts_deal_their_rows_out_once_by_key(spark, sf_dir):
    from quillforge.plans import catalogue

    for name, key in (("conflict_classes", "l_partkey"), ("interval_conflicts", "item")):
        plan = _plan(catalogue.QUERIES[name](spark, sf_dir))
        assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_COL") == 1
        assert plan.count("Join") == 1  # of the rows and their suppliers


def test_conflict_classes_against_a_plain_loop(spark):
    import random

    from quillforge.operators import resolution as X

    r = random.Random(5)
    some = lambda *v: r.choice(v)
    rows = [(k, some(1.0, 9.0, 20.0, None) if k % 3 else some(1.0, 9.0), some(0.5, 4.0, None), some("a", "b", None) if k % 2 else None, some("s", "t", None), some("x", "y", "z", "")) for k in range(300) for _ in range(r.randint(1, 3))]
    rows += [(None, 1.0, 1.0, "a", "s", "x")]
    want = {}
    for k in range(300):
        mine = [x for x in rows if x[0] == k and x[1] is not None]
        if not mine:
            continue
        values = {x[1] for x in mine}
        labels = lambda i, v=None: {x[i] for x in mine if x[i] is not None and v in (None, x[1])}  # noqa: B023, E731
        parted = lambda i: max(len(labels(i, v)) for v in values) == 1 and len(labels(i)) == len(values)  # noqa: B023, E731
        ends = [(x[1] - x[2], x[1] + x[2]) for x in mine if x[2] is not None]
        near = bool(ends) and max(a for a, _ in ends) <= min(b for _, b in ends)
        kind = "agreed" if len(values) == 1 else "rounding_equivalent" if near else "market_difference" if parted(3) else "internal_source_inconsistency" if len(labels(4)) == 1 else "variant_scope_difference" if parted(5) else "true_conflict"
        want[k] = (len(mine), len(values), kind)
    df = spark.createDataFrame(rows, "k int, v double, t double, market string, source string, scope string")
    out = X.conflict_classes(df, ["k"], "v", "t", "market", "source", "scope").collect()
    assert {x["k"]: (x["n"], x["distinct_values"], x["conflict_class"]) for x in out} == want and len(out) == len(want)
    assert len({kind for _, _, kind in want.values()}) == 6


def test_interval_conflicts_against_a_plain_loop(spark):
    import random

    from quillforge.operators import resolution as X

    r = random.Random(6)
    some = lambda *v: r.choice(v)
    rows = [(k, lo, lo + some(0, 0, 15), some(1, 6, None), some(1, 2, None), some(*range(k % 9 + 1), None), some(*range(9), None), some("x", "y", "z", "", None), some(True, False, None)) for k in range(400) for lo in [some(10, 20, 40) for _ in range(r.randint(1, 3))]]
    rows += [(1, None, 5, 1, 1, 1, 1, "x", True), (None, 1, 1, 1, 1, 1, 1, "x", True)]
    want = {}
    for k in range(400):
        mine = [x for x in rows if x[0] == k and x[1] is not None]
        values = {x[1:3] for x in mine}
        labels = lambda i, v=None: {"" if x[i] is None else str(x[i]) for x in mine if v in (None, x[1:3])}  # noqa: B023, E731
        parted = lambda i: max(len(labels(i, v)) for v in values) == 1 and len(labels(i)) == len(values)  # noqa: B023, E731
        ends = [(x[1] - x[3], x[2] + x[3]) for x in mine if x[3] is not None]
        near = bool(ends) and max(a for a, _ in ends) <= min(b for _, b in ends)
        scalars, ranges = {a for a, b in values if a == b}, [v for v in values if v[0] != v[1]]
        inside = len(scalars) == 1 and bool(ranges) and all(a <= min(scalars) <= b for a, b in ranges)
        shared = any(len({x[1:3] for x in mine if x[i] == own}) > 1 for i in (5, 6) for own in {x[i] for x in mine} - {None})
        kind = "unit_equivalent" if len(values) == 1 else "scalar_inside_range" if inside else "rounding_equivalent" if near else "market_difference" if parted(4) else "internal_source_inconsistency" if shared else "variant_scope_difference" if parted(7) else "true_conflict"
        bound = [x[8] for x in mine if x[1] == x[2] and x[8] is not None]
        want[k] = (len(mine), len(values), kind, bool(bound) and all(bound) if kind == "scalar_inside_range" else kind in ("unit_equivalent", "rounding_equivalent"))
    df = spark.createDataFrame(rows, "k int, lo int, hi int, t int, m int, doc int, dom int, scope string, exact boolean")
    out = X.interval_conflicts(df, ["k"], "lo", "hi", "t", "m", "doc", "dom", "scope", "exact").collect()
    assert {x["k"]: (x["n"], x["distinct_values"], x["conflict_class"], x["normalised"]) for x in out} == want and len(out) == len(want)
    assert len({x[2] for x in want.values()}) == 7


def test_type_codes_are_dealt_out_before_their_forms_are_made(spark, sf_dir):
    from quillforge.plans import catalogue

    lines = _plan(catalogue.QUERIES["type_codes"](spark, sf_dir)).splitlines()
    made = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert len(made) == 2 and all("Exchange hashpartitioning" in "".join(lines[i : i + 5]) and "REPARTITION_BY_NUM" in "".join(lines[i : i + 5]) for i in made)
    assert not any("Exchange" in line and "row_id" in line and "REPARTITION_BY_NUM" not in line for line in lines)  # forms are not exchanged with their rows


def test_rows_with_one_id_count_once_and_only_by_their_makers_rules(spark):
    from quillforge.operators.identity import by_type_code

    targets = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v1"), (3, None, "v1"), (4, "a", "w9"), (5, "c", "v1"), (6, "a", ".")], "t int, make string, code string")
    rows = spark.createDataFrame([(7, "a", "V1", "V1", None), (7, "a", "v 1", None, None), (8, "a", "x", "v1 (EU)", None), (9, "b", "x", "v1", None), (9, None, "v1", "v1", None)], "r int, make string, variant string, version string, approval string")
    rules = spark.createDataFrame([("a", "exact_va", 2), ("a", "toyota_style", 1), ("b", "exact_va", 1), ("c", "exact_va", 1)], "make string, rule string, place int")
    got = {x["t"]: (x["status"], x["rule"], x["rows"]) for x in by_type_code(targets, rows, rules, "t", "r", "make").collect()}
    assert got == {1: ("match", "toyota_style", 2), 2: ("no_match", None, 0), 3: ("no_rows", None, 0), 4: ("no_match", None, 0), 5: ("no_rows", None, 0), 6: ("no_code", None, 0)}
