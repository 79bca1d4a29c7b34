"""Rules of the operators on small rows with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillforge.functions import numbers as N
from quillforge.functions import text as T
from quillforge.operators import aggregates as A
from quillforge.operators import joins as J
from quillforge.operators import ordered as O
from quillforge.operators import resolution as X
from quillforge.plans.catalog import RefusedFilter, filters


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str) if cols else [tuple(r) for r in df.collect()]


def test_weighted_profile(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", 4.0, None), ("b", 6.0, -3.0), (None, None, 2.0), (None, None, None)], "k string, v double, w double")
    got = rows(A.weighted_profile(df, ["k"], ["v"], "w"), "k", "rows", "weight", "v_median", "v_min", "v_max")
    # tie at half the weight takes the lower value; a group without stated weights has no weight; null keys are one group
    assert got == sorted([("a", 3, 7.0, 9.0, 1.0, 9.0), ("b", 2, 2.0, 4.0, 4.0, 6.0), (None, 2, 3.0, None, None, None)], key=str)


def test_ranks_differ(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)], "k string, v int")
    assert rows(A.nearest_rank(df, ["k"], "v", {"p50": 0.5})) == [("a", 4, 2)]
    assert rows(A.rounded_index(df, ["k"], "v", {"p50": 0.5})) == [("a", 4, 3)]  # round(1.5) is 2, the third


def test_majority_ties_and_thresholds(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", None)], "k string, v string")
    assert rows(A.majority(df, ["k"], "v")) == [("a", "x", 2, 4, 0.5, "x:2|y:2")]
    assert rows(A.majority_decision(df, ["k"], "v", 4, 0.5)) == [("a", 4, "x", None)]
    assert rows(A.majority_decision(df, ["k"], "v", 4, 0.51)) == [("a", 4, None, "x|y")]
    assert rows(A.majority_decision(df, ["k"], "v", 5, 0.5)) == []


def test_agreement(spark):
    df = spark.createDataFrame([("one", 5.0), ("one", None), ("near", 10.0), ("near", 10.1), ("far", 1.0), ("far", 9.0), ("none", None)], "k string, v double")
    got = dict((r[0], r[1:]) for r in rows(A.agreement(df, ["k"], "v", 0.2, 5, 0.5), "k", "status", "value"))
    assert got == {"one": ("value", 5.0), "near": ("within_precision", 10.0), "far": ("survivors_disagree", None), "none": ("no_value", None)}


def test_column_profile_of_blanks_and_mixed(spark):
    df = spark.createDataFrame([("1", " ", "x", 0), ("2.5", None, "3", 0)], "a string, b string, c string, w int")
    got = {r["column_name"]: (r["state"], r["value_type"], r["null_pct"]) for r in A.column_profile(df, ["a", "b", "c"], "w").collect()}
    assert got == {"a": ("mapped", "REAL", 0.0), "b": ("empty", None, 100.0), "c": ("mapped", "MIXED", 0.0)}


def test_cohort_reasons(spark):
    members = [("k", 2000, 2003, True)] * 3 + [("k", 2000, None, False)] + [("k", 2001, 1999, True)] * 4 + [("s", 2000, None, False)]
    df = spark.createDataFrame(members, "k string, cohort int, end int, gone boolean")
    start = spark.createDataFrame([(2000,)], "coverage_start int")
    got = {(r["k"], r["cohort"]): r for r in A.cohort_survival(df, ["k"], "cohort", "end", "gone", F.lit(2004), range(3, 5), 4, start).collect()}
    assert got["k", 2000]["status"] == "served" and got["k", 2000]["shares"] == "3:0.7500"  # age 4 is not reached in 2004
    assert got["k", 2000]["p50"] == 3
    assert got["k", 2001]["bad_dates"] == 4 and got["k", 2001]["p50"] is None
    assert got["s", 2000]["status"] == "cohort_too_small"


def test_unique_key_join_drops_duplicate_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    assert rows(J.unique_key_join(left, right, ["k"], ["v"]), "k", "v") == sorted([("a", 1), ("b", None), (None, 4), ("c", None)], key=str)


def test_backfill(spark):
    df = spark.createDataFrame([(1, "z", 0), (2, "z", None), (3, "x", 0), (4, "x", 7), (5, "x", None), (6, "y", 7), (7, "y", 8), (8, "y", None), (9, "e", None)], "id int, g string, code int")
    got = {r["id"]: (r["filled_code"], r["fill_status"]) for r in J.backfill(df, "code", ["g"]).collect()}
    assert got == {1: (None, "placeholder"), 2: (None, "placeholder"), 3: (7, "filled"), 4: (7, "keyed"), 5: (7, "filled"), 6: (7, "keyed"), 7: (8, "keyed"), 8: (None, "ambiguous"), 9: (None, "unknown")}


def test_fallback_never_widens_an_existing_key(spark):
    votes = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "2", "b"), ("t", "2", "b")], "k string, s string, v string")
    targets = spark.createDataFrame([("t", "1"), ("t", "9"), ("u", "1")], "k string, s string")
    got = {(r["k"], r["s"]): (r["level"], r["value"], r["reason"]) for r in J.fallback_majority(targets, votes, ["k", "s"], ["k"], "v", 2, 0.8, 4, 0.7, 2).collect()}
    assert got == {("t", "1"): ("A", None, "below_threshold"), ("t", "9"): ("B", "b", None), ("u", "1"): (None, None, "no_pool")}


def test_pair_calls_by_id_then_oldest_open(spark):
    e = [("r", 1, "call", "i1", "f"), ("r", 2, "call", None, "g"), ("r", 3, "call", None, "g"), ("r", 4, "result", None, "g"), ("r", 5, "result", "i1", "f"), ("r", 6, "result", "zz", "h")]
    df = spark.createDataFrame(e, "run string, seq int, kind string, call_id string, name string")
    assert rows(J.pair_calls(df, "run", "seq"), "call_seq", "result_seq") == [(1, 5), (2, 4), (3, None)]


def test_split_one_way(spark):
    df = spark.createDataFrame([("A B",), ("A B C",), ("X",), ("A A",)], "t string")
    known = spark.createDataFrame([(n,) for n in ("A", "B", "B C", "C")], "n string")
    got = dict(rows(J.split_one_way(df, "t", known, "n"), "t", "parts"))
    assert got == {"A B": "A|B", "A B C": None, "X": None, "A A": "A"}  # A|B|C and A|B C: two ways


def test_split_one_way_of_long_texts(spark):
    long = " ".join(["A", "B C D"] * 20)
    df = spark.createDataFrame([("X Y Z P Q R",), (long,), ("A A A A A A A",), ("E F E F E F",), ("X Y Z P Q",), (None,)], "t string")
    known = spark.createDataFrame([(n,) for n in ("X Y Z", "P Q R", "A", "B C D", "A A", "E", "F", "E F")], "n string")
    got = dict(rows(J.split_one_way(df, "t", known, "n"), "t", "parts"))
    assert got == {"X Y Z P Q R": "X Y Z|P Q R", long: "A|B C D", "A A A A A A A": None, "E F E F E F": None, "X Y Z P Q": None, None: None}


def test_newest_period_keeps_copies(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "2"), ("a", "1"), ("b", "1")], "k string, m string")
    assert rows(O.newest_wins(df, ["k"], "m"), "k", "m") == [("a", "2"), ("a", "2"), ("b", "1")]


def test_streak_and_budget(spark):
    df = spark.createDataFrame([("a", i, p, 10) for i, p in enumerate([0, 0, 1, 0, 0, 0])], "k string, s int, p int, n int")
    assert rows(O.longest_streak(df, ["k"], ["s"], F.col("p") == 1)) == [("a", 6, 3, 3)]
    assert len(rows(O.within_budget(df, ["k"], [F.col("s")], "n", 35))) == 3
    assert len(rows(O.evicted(df, ["k"], [F.desc("s")], "n", 35))) == 3


def test_conflict_classes(spark):
    e = [("agree", 1.0, 0.1, "m1", "s1", "x"), ("agree", 1.0, 0.1, "m2", "s2", "x"), ("round", 1.0, 0.5, "m1", "s1", "x"), ("round", 1.9, 0.5, "m1", "s2", "x"), ("market", 1.0, 0.1, "m1", "s1", "x"), ("market", 5.0, 0.1, "m2", "s2", "x")]
    e += [("inner", 1.0, 0.1, "m1", "s1", "x"), ("inner", 5.0, 0.1, "m1", "s1", "x"), ("scope", 1.0, 0.1, "m1", "s1", "x"), ("scope", 5.0, 0.1, "m1", "s2", "y"), ("true", 1.0, 0.1, "m1", "s1", "x"), ("true", 5.0, 0.1, "m1", "s2", "x")]
    # an order test: a set that fits market and internal takes the earlier class
    e += [("both", 1.0, 0.1, "m1", "s1", "x"), ("both", 5.0, 0.1, "m2", "s1", "y")]
    df = spark.createDataFrame(e, "k string, v double, t double, market string, source string, scope string")
    got = dict(rows(X.conflict_classes(df, ["k"], "v", "t", "market", "source", "scope"), "k", "conflict_class"))
    assert got == {"agree": "agreed", "round": "rounding_equivalent", "market": "market_difference", "inner": "internal_source_inconsistency", "scope": "variant_scope_difference", "true": "true_conflict", "both": "market_difference"}


def test_filters_refuse():
    for bad in ({"kind": "x"}, {"size": 3}):
        with pytest.raises(RefusedFilter):
            filters(**bad)


NUMBERS = {"1,234": 1234.0, "1,234.5": 1234.5, "1,8": 1.8, "12,34": 12.34, "1.80": 1.8, "08": 8.0, "-5": -5.0, "": None, "text": None, "1,2345": None}
TYRES = {"205/55R16": "205/55 R16", "205/55 R 16": "205/55 R16", "225/45ZR17": "225/45 R17", "205/55-16": "205/55 R16", "205/55R25": None, "90/55R16": None, "205/55R16 91V": "205/55 R16", "205/55R16 nonsense": None, "": None, "185/65R15XL": "185/65 R15"}
YEARS = {"2019-05": (2019, 5), "2019-5-3": (2019, 5), "3-5-2019": (2019, 5), "201905": (2019, 5), "20190503": (2019, 5), "2019-13": (None, None), "x": (None, None)}


def test_scalar_functions(spark):
    for table, f in ((NUMBERS, N.locale_number), (TYRES, T.tyre_size)):
        df = spark.createDataFrame([(k,) for k in table], "t string")
        assert dict(rows(df.select("t", f(F.col("t")).alias("v")))) == table
    df = spark.createDataFrame([(k,) for k in YEARS], "t string").select("t", N.year_month(F.col("t")).alias("v"))
    assert {r["t"]: tuple(r["v"]) for r in df.collect()} == YEARS
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(N.round_to_step(F.lit(-2.5), 5.0)) == -5.0 and value(N.round_to_step(F.lit(7.4), 5.0)) == 5.0
    assert value(T.identity_text(F.lit(" ﬁat   500 "))) == "FIAT 500" and value(T.identity_text(F.lit("  "))) is None
    assert value(T.make_key(F.lit("Škoda Auto a.s. 2"))) == "SKODAAUTOAS"
    assert value(T.quote_in_source(F.lit("The “big” red car, is  here"), F.lit('the "big" … is here'))) is True
    assert value(T.quote_in_source(F.lit("is here the big"), F.lit("the big … is here"))) is False
    assert value(T.host(F.lit("https://www.A.example.com:80/x"))) == "a.example.com"
    assert value(T.redacted(F.lit("mail a@b.co now"))) == "mail [email] now"
    assert value(N.full_year(F.lit("2"))) == 2002


def test_stage_times_end_with_the_log(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", "x", t(0), 1), ("a", "y", t(3), 2), ("a", "z", t(9), 3)], "k string, stage string, ts timestamp, seq int")
    assert [r["seconds"] for r in O.stage_times(df, ["k"], "stage", "ts", ["ts", "seq"]).orderBy("seq").collect()] == [3.0, 6.0, 0.0]
