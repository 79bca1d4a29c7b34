"""The automaton against a scan by each alias; matchers by type."""

import random

from quillforge.operators import extraction as X

FIELDS = (
    X.Field("power", "numeric", ("power", "engine power"), {"kw": 1.0, "hp": 0.75}, low=10, high=900),
    X.Field("length", "numeric", ("length",), {"mm": 1.0, "cm": 10.0}),
    X.Field("seats", "numeric", ("seats",), low=1, high=9),
    X.Field("roof", "boolean", ("glass roof",)),
    X.Field("gearbox", "enum", ("gearbox",), values={"manual": "manual", "automatic": "auto", "dct": "auto"}),
    X.Field("tyres", "tyre", ("tyres",)),
    X.Field("price", "price", ("price",), low=10),
)


def lines(text):
    return [(FIELDS[f[0]].name, *f[1:4], round(f[4], 2)) for f in X._Dictionary(FIELDS).in_line(text)]


def pair(label, value):
    return [(FIELDS[f[0]].name, *f[1:3], round(f[4], 2)) for f in X._Dictionary(FIELDS).in_pair(label, value)]


def test_one_pass_finds_what_a_scan_by_each_alias_finds():
    rng = random.Random(6)
    words = ["a", "b", "ab", "a b", "b a b", "c"]
    for _ in range(200):
        fields = tuple(X.Field(f"f{i}", "numeric", tuple(rng.sample(words, rng.randint(1, 3)))) for i in range(3))
        text = " ".join(rng.choice(["a", "b", "c", "ab", "abc", "(a", "b-"]) for _ in range(14))
        spans = set()
        for i, f in enumerate(fields):
            for alias in f.aliases:
                at = text.find(alias)
                while at >= 0:
                    end = at + len(alias)
                    if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                        spans.add((at, end, i))
                    at = text.find(alias, at + 1)
        got = X._Dictionary(fields).hits(text)
        assert set(got) <= spans and len(got) == len(set(got))
        for a, b, i in spans:  # what is left out lies inside a longer one or overlaps one that began before
            assert (a, b, i) in got or any(c < a < d or c == a and d > b for c, d, _ in got)


def test_numbers():
    assert [X.number(t) for t in ("1,234", "1.234.567", "12,5", "0.75", "1 234,50", "7.", "1,23,4")] == [1234, 1234567, 12.5, 0.75, 1234.5, 7, 123.4]


def test_matchers():
    assert lines("power: 100 hp, length 4.5 cm") == [("power", "75", "hp", "label", 0.8), ("length", "45", "cm", "label", 0.8)]
    assert lines("power 100") == [("power", "100", None, "label", 0.55)] and lines("power 100 mm") == [] and lines("power 5 kw") == []
    assert lines("seats 5") == [("seats", "5", None, "label", 0.85)] and lines("seats 12") == [] and lines("overseats 5") == []
    assert lines("at 90 kw of power") == [("power", "90", "kw", "unit", 0.6)] and lines("length or power: see 90 kw there") == [("power", "90", "kw", "label", 0.85)]
    assert lines("power " + "x" * 61 + " 90 kw") == []
    assert lines("glass roof: yes") == [("roof", "true", None, "label", 0.8)] and lines("glass roof optional") == [("roof", "true", None, "label", 0.65)] and lines("glass roof") == [] and lines("without glass roof") == [("roof", "false", None, "label", 0.75)]
    assert lines("gearbox dct or automatic") == [("gearbox", "auto", None, "label", 0.8)] and lines("gearbox manual, automatic") == [("gearbox", "manual", None, "label", 0.6)]
    assert lines("tyres 205/55 r16") == [("tyres", "205/55 R16", None, "label", 0.8)] and lines("tyres 999/55 r16") == []
    assert lines("price 1.299,50 €") == [("price", "1299.5", "EUR", "label", 0.8)] and lines("price $ 5") == []
    assert pair("power (hp)", "100") == [("power", "75", "hp", 0.9)] and pair("power", "100") == [("power", "100", None, 0.8)] and pair("power", "90 kw") == [("power", "90", "kw", 0.95)] and pair("glass roof", "–") == []


def test_awkward_segments(spark):
    rows = [(1, 1, None, None, None), (2, 1, None, None, ""), (3, 1, "Power", None, None), (None, 1, "Power", "90 kW", "power 80 kw"), (4, 1, None, None, "POWER\t90  kW\n\nSeats 5\r\nseats 5"), (5, 1, None, None, "power 90 kw " * 20_000)]
    df = spark.createDataFrame(rows, "doc int, segment int, label string, value string, text string").repartition(3)
    found = X.extract(df, "doc", list(FIELDS))
    got = sorted((r["doc"] or 0, r["field"], r["value"], r["statements"], r["quote"]) for r in X.best_statement(found, "doc").collect())
    assert got == [(0, "power", "90", 1, "90 kW"), (4, "power", "90", 1, "POWER 90 kW"), (4, "seats", "5", 2, "Seats 5"), (5, "power", "90", 20_000, got[3][4])]
    assert X.extract(df.limit(0), "doc", list(FIELDS)).count() == 0
