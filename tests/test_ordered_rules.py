"""Order-dependent rules against plain loops on small, awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillforge.operators import ordered as O
from quillforge.operators import rules as L


def test_novel_lengths_equal_a_plain_sum(spark):
    rng = random.Random(3)
    rows = [(k % 3, k, (a := rng.randint(-40, 120)), a + rng.randint(-2, 60)) for k in range(120)]
    df = spark.createDataFrame(rows, "e int, seq int, a int, b int")
    want = []
    for e, s, a, b in rows:
        taken = sum(max(0, min(b, d) - max(a, c)) for f, q, c, d in rows if f == e and q < s)
        want.append((e, s, a, b, max(0, b - a - taken)))
    for width in (7, 50, 1000):
        assert sorted(map(tuple, O.novel_lengths(df, ["e"], "seq", "a", "b", width).collect())) == sorted(want)


def test_stage_states_equal_a_plain_machine(spark):
    rng = random.Random(9)
    stages = ["a", "b", "c", "d"]
    rows = [(e, i, rng.choice([*stages, "x"]), 10.0 * i) for e in range(40) for i in range(rng.randint(0, 6))]
    df = spark.createDataFrame(rows, "e int, i int, stage string, s double").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for e in {r[0] for r in rows}:
        state, began, ended = dict.fromkeys(stages, "waiting"), {}, {}
        mine = [r for r in rows if r[0] == e]
        for _, _, stage, s in mine:
            if stage not in stages:
                continue
            if state[stage] == "waiting":
                state[stage], began[stage] = "running", s
            for earlier in stages[: stages.index(stage)]:
                if state[earlier] == "running":
                    state[earlier], ended[earlier] = "done", s
                elif state[earlier] == "waiting":
                    state[earlier] = "skipped"
        last = max(r[3] for r in mine)
        want += [(e, k, v, ended.get(k, last) - began[k] if k in began else None) for k, v in state.items()]
    assert sorted(map(tuple, O.stage_states(df, ["e"], "stage", stages, "ts", ["i"]).collect()), key=str) == sorted(want, key=str)


def test_pinned_rows_stay(spark):
    df = spark.createDataFrame([(1, i, 10, i == 1) for i in range(6)], "k int, i int, n int, pin boolean")
    gone = lambda cap, keep: sorted(r["i"] for r in O.evicted(df, ["k"], [F.desc("i")], "n", cap, keep, F.col("pin")).collect())
    assert gone(30, 0) == [0, 2, 3] and gone(10, 3) == [0, 2] and gone(60, 0) == [] and gone(0, 6) == []


def test_signals_and_weights_go_together(spark):
    df = spark.createDataFrame([(True, 3, None)], "a boolean, b int, c double")
    signals = {c: F.col(c) for c in "abc"}
    assert df.select(L.weighted_signals({"b": 0.25, "a": -1.0, "c": 9.0}, signals)).first()[0] == -0.25
    with pytest.raises(ValueError):
        L.weighted_signals({"a": 1.0}, signals)
