"""Pairing, conflicts, matching in bands and searches against plain versions on small, awkward rows."""

import random

from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import joins as J
from quillforge.operators import resolution as X
from quillforge.operators import statements as S


def machine(events):
    """Calls and results one after another, as a log is read."""
    pairs, by_id, waiting = [], {}, []
    for seq, kind, call_id, name in events:
        if kind == "call":
            pair = [seq, name, None]
            pairs.append(pair)
            waiting.append(pair)
            if call_id:
                by_id[call_id] = pair
        elif kind == "result":
            pair = by_id.pop(call_id, None) if call_id else None
            if pair is None:
                pair = next((p for p in waiting if p[1] == name), None)
            if pair is not None:
                pair[2] = seq
                waiting = [p for p in waiting if p is not pair]
    return [tuple(p) for p in pairs]


def test_calls_and_results(spark):
    rng = random.Random(5)
    rows, want = [], []
    for run in range(60):
        events = [(i, rng.choice(["call", "result", "result", "other"]), rng.choice([None, "", "x", "y"]), rng.choice("pq")) for i in range(rng.randint(0, 14))]
        rows += [(run, *e) for e in events]
        want += [(run, *r) for r in machine(events)]
    df = spark.createDataFrame(rows, "run int, seq int, kind string, call_id string, name string").repartition(5)
    assert sorted(map(tuple, J.pair_calls(df, "run", "seq").collect()), key=str) == sorted(want, key=str)
    assert any(r[3] is not None for r in want)


def test_interval_conflicts(spark):
    e = [
        ("unit", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("unit", 5.0, 5.0, 0.1, "m2", "d2", "b", "y", False),
        ("inside", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("inside", 3.0, 8.0, 0.1, "m2", "d2", "b", "y", False),
        ("loose", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", False), ("loose", 3.0, 8.0, 0.1, "m2", "d2", "b", "y", True),
        ("round", 5.0, 5.0, 0.5, "m1", "d1", "a", "x", True), ("round", 5.8, 5.8, 0.5, "m1", "d2", "b", "x", True),
        ("market", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("market", 9.0, 9.0, 0.1, "m2", "d1", "a", "x", True),
        ("document", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("document", 9.0, 9.0, 0.1, "m1", "d1", "b", "x", True),
        ("domain", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("domain", 9.0, 9.0, 0.1, "m1", "d2", "a", "x", True),
        ("scope", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("scope", 9.0, 9.0, 0.1, "m1", "d2", "b", None, True),
        ("true", 5.0, 5.0, 0.1, "m1", "d1", "a", "x", True), ("true", 9.0, 9.0, 0.1, "m1", "d2", None, "x", True), ("true", None, 9.0, 0.1, "m1", "d1", None, "x", True),
    ]
    df = spark.createDataFrame(e, "k string, lo double, hi double, tol double, market string, document string, domain string, scope string, exact boolean")
    got = {r["k"]: (r["conflict_class"], r["normalised"]) for r in X.interval_conflicts(df, ["k"], "lo", "hi", "tol", "market", "document", "domain", "scope", "exact").collect()}
    assert got == {
        "unit": ("unit_equivalent", True), "inside": ("scalar_inside_range", True), "loose": ("scalar_inside_range", False), "round": ("rounding_equivalent", True), "market": ("market_difference", False),
        "document": ("internal_source_inconsistency", False), "domain": ("internal_source_inconsistency", False), "scope": ("variant_scope_difference", False), "true": ("true_conflict", False),
    }


def test_range_agreement(spark):
    rows = [("one", 5, None, None)] * 2 + [("wide", 5, 1, 9), ("wide", 5, None, None)] + [("kept", 5, 5, 6)] * 4 + [("kept", 5, 1, 9)] + [("near", 5, None, None), ("near", 6, None, None), ("far", 1, None, None), ("far", 9, None, None), ("none", None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, v int, lo int, hi int")
    got = {r["k"]: tuple(r)[1:] for r in X.range_agreement(df, ["k"], "v", "lo", "hi", 2, 1).collect()}
    assert got == {"one": (2, 0, "value", 5), "wide": (2, 1, "range", None), "kept": (5, 1, "value", 5), "near": (2, 0, "within_precision", 5), "far": (2, 0, "survivors_disagree", None), "none": (0, 0, "no_value", None)}


def test_bands_lose_no_pair(spark):
    rng = random.Random(2)
    targets = spark.createDataFrame([(i, rng.choice("ab"), rng.uniform(10, 500), rng.randint(1, 30)) for i in range(40)], "target_id int, b string, t_price double, t_size int")
    source = spark.createDataFrame([("s", i, rng.choice("ab"), rng.choice([None, rng.uniform(10, 500)]), rng.choice([None, rng.randint(1, 30)])) for i in range(300)], "source string, id int, b string, price double, size int")
    verdicts = {"price": X.within("t_price", "price", share=0.1), "size": X.within("t_size", "size", 2)}
    price = X.near(source, "price", F.col("t_price") * 0.9, F.col("t_price") * 1.1, 0.2, share=True)
    size = X.near(source, "size", F.col("t_size") - 2, F.col("t_size") + 2, 3)
    plain, banded = (sorted(map(tuple, X.match(targets, source, ["b"], verdicts, "size", bands).select("target_id", "id", "keys_matched", "keys_unknown").collect())) for bands in ((), (price, size)))
    assert banded == plain and len(plain) > 50


def test_words_in_documents(spark):
    texts = {1: "red car and red bus, RED CAR", 2: "a bus that is red. " + "x" * 80 + " car far off " + "y" * 80 + " red car-less", 3: None, 4: "nothing here", 5: "carred redcar"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {}
    for r in S.find_words(df, "id", "t", " Red car ", 10, 3).collect():
        got.setdefault(r["id"], []).append((r["offset"], r["score"]))
        assert texts[r["id"]].lower()[r["offset"] :].startswith(("red", "car")) and r["snippet"] in texts[r["id"]]
    assert got == {1: [(0, 1.0), (21, 1.0)], 2: [(texts[2].index("red car"), 1.0)], 5: [(0, 1.0)]}
    got = [(r["offset"], r["score"]) for r in S.find_words(df.where("id = 2"), "id", "t", "car bus", 15, 2).collect()]
    assert got == [(2, 0.5), (texts[2].index("car far"), 0.5)]


def test_fragments_of_a_quote(spark):
    one = lambda s, q: spark.range(1).select(T.quote_in_source(F.lit(s), F.lit(q))).first()[0]
    assert one("Version 2.0 of it", "Version ... 2.0") and one("a 10 b 01 c", "10 … 01") and not one("a 01 b 10", "10 … 01")
    assert not one("Version 2.0 of it", "Versi ... on 2.0") and not one("superpower 190", "power 190") and not one("power 1190", "power 190")
    assert one("power " + "x " * 170 + "90 kw", "power … 90 kW") and not one("power " + "x " * 3_000 + "90 kw", "power … 90 kW")
    assert one("power 1 " + "x " * 300 + "Power-90", "power … 90"), "a later place of the first fragment"
    assert one("a b a b c", "a b … a b … c") and not one("a b a c", "a b … a b … c") and one("a b a b a c", "a b a … a c")
    assert one("4,150 kg", "4,150") and not one("14,150 kg", "4,150") and one("a1b", "a … 1 … b") and not one("any", " … ") and not one("any", "...")
    assert one(None, "x") is False and one("x", None) is False


def test_one_way_splits(spark):
    known = spark.createDataFrame([("m", n) for n in ("a", "b", "a b", "c", "d e f g h", "i j k l m n")] + [("o", "x")], "make string, n string")
    texts = {("m", "a c"): "a|c", ("m", "a b"): None, ("m", "c c"): "c", ("m", "a b c"): None, ("m", "c d e f g h a"): "c|d e f g h|a", ("m", "i j k l m n c"): None, ("m", "a"): None, ("m", "a z"): None, ("o", "a c"): None, ("o", "x x x"): "x", ("m", " c  a "): "c|a", ("m", ""): None, ("m", None): None}
    df = spark.createDataFrame(list(texts), "make string, t string")
    got = {(r["make"], r["t"]): r["parts"] for r in J.split_one_way(df, "t", known, "n", ["make"]).collect()}
    assert got == texts


def test_json_in_a_models_text(spark):
    cases = {'Use {x}: ```json {"a":1}```': '{"a":1}', "[1,2]": "[1,2]", '```\n{"b":1,"a":2}\n```': '{"a":2,"b":1}', '```{bad``` x ```{"c":3}```': '{"c":3}', 'so {"d": {"e": 4}} it is': '{"d":{"e":4}}', "": None, "none": None, "{": None, " 5 ": "5"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["j"] for r in df.select("t", S.lenient_json(F.col("t")).alias("j")).collect()} == cases


def test_levels_by_route(spark):
    status = spark.createDataFrame([(1, "c", 2, "ambiguous"), (1, "a", 0, "none"), (2, "a", 1, "unique"), (2, "b", 1, "unique"), (3, "c", 1, "unique"), (4, "b", 3, "ambiguous")], "target_id int, source string, survivors int, status string")
    routes = spark.createDataFrame([(1, "european"), (2, "european"), (3, None), (4, "american"), (5, "european")], "target_id int, route string")
    got = {r["target_id"]: r["level"] for r in X.level_by_route(status, routes, {"european": [["a", "b"]], "american": [["c"]]}, {"european": ["a", "b"], "american": ["c"]}).collect()}
    assert got == {1: None, 2: "exact", 3: "partial", 4: None, 5: None}


def test_relations_make_only_answers(spark):
    """Against all pairs; equal strings of any length, the others from four characters on."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    codes, values = ([(rng.choice("xy"), word()) for _ in range(90)] + [("x", None), ("z", "aaaa")] for _ in range(2))
    left, right = spark.createDataFrame(codes, "b string, c string"), spark.createDataFrame(values, "b string, v string")

    def best(b, c):
        found = []
        for vb, v in values:
            if vb == b and c is not None and v is not None:
                long = min(len(c), len(v)) >= 4
                s = 3 if c == v else 2 if long and (c.startswith(v) or v.startswith(c)) else 1 if long and (c in v or v in c) else 0
                found.append((-s, v)) if s else None
        return (("equal", "prefix", "contains")[3 + min(found)[0]], min(found)[1]) if found else ("none", None)

    df = J.strongest_relation(left, right, "b", "c", "v")
    assert sorted(((r["b"], r["c"], r["relation"], r["related"]) for r in df.collect()), key=str) == sorted(((b, c, *best(b, c)) for b, c in codes), key=str)


def test_counts_by_level_against_all_pairs(spark):
    from quillforge.operators import rules as L

    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.choice([None, *range(9)]), rng.choice([None, *range(0, 60, 7)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, b string, t string, s int, p int")
    levels = {"low": (["b"], {}), "size": (["b"], {"s": 2}), "type": (["b", "t"], {"s": 2}), "price": (["b", "t"], {"s": 2, "p": 14}), "self": (["id"], {})}
    near = lambda x, y, most: x is not None and y is not None and abs(x - y) <= most
    want = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1]:
                level = "low"
                if near(a[3], b[3], 2):
                    level = "size" if a[2] != b[2] else "price" if near(a[4], b[4], 14) else "type"
                if a[0] == b[0] and level == "price":
                    level = "self"
                want[a[0], level] = want.get((a[0], level), 0) + 1
    whole = [r[0] for r in rows if None not in r]
    got = {(r["id"], r["level"]): r["candidates"] for r in L.counts_by_level(df, df, "id", levels).collect()}
    assert {k: v for k, v in got.items() if k[0] in whole} == {k: v for k, v in want.items() if k[0] in whole}


def test_bindings_by_level(spark):
    from quillforge.operators import rules as L

    m, u, v = "matched", "unknown", "veto"
    rows = [(v, m, m, m, m), (m, v, m, m, m), (m, m, u, m, m), (m, m, m, v, m), (m, m, m, m, u), (m, m, m, m, m)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert [r[0] for r in df.select(L.binding_level(*map(F.col, "abcde"))).collect()] == ["unknown", "model_family", "generation", "body_powertrain", "exact_technical_variant", "exact_market_trim"]
