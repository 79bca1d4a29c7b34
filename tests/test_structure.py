"""Pairs of pages and blocks of lines: the cases that decide."""

from pyspark.sql import functions as F

from quillforge.operators import structure as T


def pairs(spark, html, **options):
    df = spark.createDataFrame([(1, html)], "page int, html string")
    return [(r["kind"], r["label"], r["value"], r["heading"]) for r in T.page_pairs(T.page_elements(df, "page", "html"), "page", **options).orderBy("place").collect()]


def test_chrome_is_left_out(spark):
    three = "<p>a: 1</p><p>b: 2</p><p>c: 3</p>"
    for wrap in ("<nav>{}</nav>", "<div class='subnav x'>{}</div>", "<div id='mainMenu'>{}</div>", "<div role='banner'>{}</div>", "<div hidden>{}</div>", "<div aria-hidden='true'>{}</div>", "<div style='color:red;DISPLAY : none'>{}</div>", "<section class='gdpr-box'>{}</section>", "<template>{}</template>"):
        assert pairs(spark, f"<body>{wrap.format(three)}</body>") == [], wrap
    for wrap in ("<div class='unavailable'>{}</div>", "<body class='has-menu'>{}</body>", "<div role='list'>{}</div>", "<br></i>{}"):
        assert len(pairs(spark, f"<html>{wrap.format(three)}</html>")) == 3, wrap


def test_kinds_of_pairs(spark):
    row = "<div class='r'><b>{}</b><i>{}</i></div>"
    assert pairs(spark, "<h3>H</h3><div>" + "".join(row.format(f"L{i}:", f"v{i}") for i in range(3)) + "</div>") == [("two_column", f"L{i}", f"v{i}", "H") for i in range(3)]
    assert pairs(spark, "<div>" + row.format("L", "v") * 3 + "</div>") == [("two_column", "L", "v", None)], "each pair once"
    assert pairs(spark, "<div>" + "".join(row.format(f"L{i}", f"v{i}") for i in range(2)) + "</div>") == [], "two are no repetition"
    assert pairs(spark, "<div>" + "".join(row.format(f"L{i}", f"v{i}") for i in range(2)) + "</div>", known=F.col("label") == "L1") == [("two_column", "L1", "v1", None)]
    assert pairs(spark, "<div>" + "".join(f"<div><b>L{i}</b>own<i>v{i}</i></div>" for i in range(3)) + "</div>") == [], "own text"
    assert pairs(spark, "<table><tr><td><div><b>a</b><i>1</i></div></td></tr></table>" * 3) == []
    assert pairs(spark, "<dl><dt>a</dt><dd>1</dd><dd>2</dd><dt>b</dt><dt>c:</dt><dd>c</dd><dd>4</dd></dl>") == [("definition_list", "a", "1", None), ("definition_list", "a", "2", None), ("definition_list", "c", "4", None)]
    assert pairs(spark, "<ul><li>0-100 km</li><li>e-CVT x</li><li>a - b</li><li>c — d</li><li>e | f: g</li></ul>") == [("split", "a", "b", None), ("split", "c", "d", None), ("split", "e", "f: g", None)]
    long = "x" * 81
    assert pairs(spark, f"<ul><li>{long}: v</li><li>l: {'y' * 121}</li><li>l: {'y' * 120}</li></ul>", known=F.lit(True)) == [("split", "l", "y" * 120, None)]


def test_awkward_pages(spark):
    rows = [(1, None), (2, ""), (3, "no tags"), (4, "<p"), (5, "</div><div><p>a: b"), (6, "<div>" * 3_000 + "deep: text" + "</div>" * 3_000), (None, "<p>q: r</p>" * 3), (7, "<p>" + "word " * 200_000 + "</p>")]
    elements = T.page_elements(spark.createDataFrame(rows, "page int, html string"), "page", "html")
    assert elements.where("page IN (1, 2, 3)").count() == 0 and elements.where("page = 7").first()["text"].startswith("word word") and T.page_pairs(elements, "page").where("page = 5").count() == 0
    assert T.page_elements(spark.createDataFrame([], "page int, html string"), "page", "html").count() == 0


def test_line_blocks(spark):
    prose = "p" * 40
    cases = {
        f"Power\n(kW)\nPower\n{prose}\n90\nnext": [(0, "Power", "(kW)", "90")],
        f"Power\n{prose}\n{prose}\n90": [(0, "Power", None, "90")],
        f"Power\n90\n{prose}\n1": [],
        f"Power\n{prose}": [],
        f"Power\n{prose}\n(kW)": [],
        f"Power\n{prose}\nPOWER": [],
        f"Power\n{prose}\n{'v' * 39}": [(0, "Power", None, "v" * 39)],
        f"Same\nSame\n{prose}\n5": [(0, "Same", None, "5")],
        f"12\n{prose}\n5": [],
        f"L\n{prose}\n5": [],
        None: [],
        "": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {}
    for r in T.line_blocks(df, "k", "t").orderBy("k", "line").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    assert {k: got.get(k, []) for k in range(len(cases))} == dict(enumerate(cases.values()))
