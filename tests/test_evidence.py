"""Extraction, reuse and ranking on rows with known results, and the queries that have no SQL against plain loops."""

import datetime as dt
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillforge.operators import evidence as V
from quillforge.plans import catalogue


def test_unit_anchored(spark):
    df = spark.createDataFrame([(1, "Max power: 90 kW at 5000 rpm\nWeight 1250 kg and length 4.2 m"), (2, "power of the people"), (3, None)], "id int, text string")
    got = V.unit_anchored(df, "id", "text", {"power": "power", "weight": "weight"}, "kW|kg|mm")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "power", 90.0, "kw"), (1, "weight", 1250.0, "kg")]


def test_harvest_marks_implausible_values(spark):
    df = spark.createDataFrame([(1, "version 3\nversion 99 and version 2.5"), (2, "")], "id int, text string")
    got = V.harvest(df, "id", "text", {"v": (r"version ([0-9.]+)", 1.0, 4.0)})
    assert sorted((r["line_no"], r["value"], r["plausible"]) for r in got.collect()) == [(0, 3.0, True), (1, 2.5, True), (1, 99.0, False)]


def test_reasons_ignore_unknowns(spark):
    df = spark.createDataFrame([(1, None), (5, 5), (9, 1)], "a int, b int")
    rules = {"big": F.col("a") > 4, "equal": F.col("a") == F.col("b")}
    assert [tuple(r) for r in df.select(V.reasons(rules).alias("x"), V.first_reason(rules).alias("y")).collect()] == [("", None), ("big,equal", "big"), ("big", "big")]


def test_reuse_by_age(spark):
    facts = spark.createDataFrame([("a", dt.date(2024, 1, 9), 1), ("a", dt.date(2024, 1, 8), 2), ("b", dt.date(2023, 1, 1), 3), ("c", None, 4)], "k string, at date, v int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = V.reusable(facts, wanted, ["k"], "at", F.lit("2024-01-10").cast("date"), 30)
    assert sorted((r["k"], r["fact_v"]) for r in got.collect()) == [("a", 1), ("b", None), ("c", None)]


def test_logical_order(spark):
    line = "דגם 2024 (Turbo) 1.6"
    seen = "1.6 (Turbo) 2024 םגד"
    df = spark.createDataFrame([(seen,), (None,)], "t string")
    assert [r[0] for r in df.select(V.logical_order("t")).collect()] == [line, None]


def test_closest_names(spark, sf_dir):
    names = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        names[r["p_brand"]].add(r["p_name"])
    want = set()
    for k, block in names.items():
        for a in block:
            best = sorted((-round(SequenceMatcher(None, a, b).ratio(), 2), b) for b in block)[:3]
            want |= {(k, a, b, -s) for s, b in best}
    got = catalogue.QUERIES["closest_names"](spark, sf_dir).collect()
    assert {(r["p_brand"], r["p_name"], r["other"], r["ratio"]) for r in got} == want


def test_excerpts_fit_the_budget(spark):
    texts = ["a" * 50, "b" * 400, "a" * 50, None, "  ", "c" * 300, "d" * 10]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "x" * 90)], "e int, i int, t string")
    got = V.excerpts(df, ["e"], [F.col("i")], "t", 10, 640, 350).collect()
    assert sorted((r["e"], r["place"], r["excerpt"]) for r in got) == [(1, 1, "a" * 50), (1, 2, "b" * 350), (1, 3, "c" * 240), (2, 1, "x" * 90)]
    got = V.excerpts(df, ["e"], [F.col("i")], "t", 2, 420, 350).collect()  # room of 20 characters is too little
    assert sorted((r["e"], r["place"]) for r in got) == [(1, 1), (1, 2), (2, 1)]
