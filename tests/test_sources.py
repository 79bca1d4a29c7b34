import pytest
from pyspark.sql import functions as F

from quillforge.sources import html as H
from quillforge.sources import readers as R
from quillforge.sources import snapshots as S


def test_events_leave_torn_lines_out(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"kind":"a","seq":1}\n{"kind":"b","seq":2}\n{"kind":"c","se')
    assert R.read_events(spark, str(tmp_path)).count() == 2


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Make;Größe\nX;1\nY;2\n".encode())
    assert R.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["Make", "Größe"]
    (tmp_path / "b.csv").write_bytes("Make\tGröße\nX\tä\n".encode("cp1252"))
    assert R.read_delimited(spark, str(tmp_path / "b.csv")).first()["Größe"] == "ä"
    (tmp_path / "c.csv").write_text("<html>busy</html>")
    with pytest.raises(ValueError, match="error page"):
        R.read_delimited(spark, str(tmp_path / "c.csv"))


def test_resolve_columns(spark):
    df = spark.createDataFrame([("x", "1,234", " ")], "` Mk ` string, Power string, Cn string")
    got, how = R.resolve_columns(df, {"make": ["mk"], "power": [], "name": ["cn"], "co2": []}, frozenset({"co2"}))
    assert how == {"make": " Mk ", "power": "Power", "name": "Cn", "co2": "absent"}
    assert R.canonical(got, {"power": 2.0}).first().asDict() == {"make": "x", "power": 2468.0, "name": None, "co2": None}
    with pytest.raises(R.MissingColumn):
        R.resolve_columns(df, {"year": []})
    with pytest.raises(R.MissingColumn):
        R.resolve_columns(df, {"make": ["mk", "cn"]})


def test_html_tables(spark):
    page = '<table><tr><th>Power:</th><td>90 kW</td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>lone</td></tr></table><dl><dt>Doors</dt><dd>5</dd></dl><a href="../x#y">l</a>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    cells = H.table_cells(df, "id", "html")
    assert cells.count() == 8
    assert sorted(tuple(r) for r in H.label_values(cells, "id").collect()) == [(1, "Doors", "5"), (1, "Power", "90 kW")]


def test_absolute_links(spark):
    base = "https://a.example.com/d/p?q#f"
    want = {"x": "https://a.example.com/d/x", "/y#z": "https://a.example.com/y", "//b.example.com/": "https://b.example.com/", "mailto:a@b": None, "http://c.example.com": "http://c.example.com"}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", H.absolute(F.col("l"), F.lit(base)).alias("u"))
    assert {r["l"]: r["u"] for r in df.collect()} == want


def test_sitemap(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url></urlset>'
    df = spark.createDataFrame([(1, xml)], "id int, xml string")
    assert [r["url"] for r in R.sitemap_urls(df, "xml").collect()] == ["https://a/1", "https://a/2"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, 2020), (2, 2020), (3, 2021)], "id int, year int")
    listed = spark.createDataFrame(S.write_shards(df, path, "year", ["id"]).collect())
    rows, report = S.verified_scan(spark, path, listed)
    assert rows.count() == 3 and {r["problem"] for r in report.collect()} == {"ok"}
    wrong = listed.withColumn("sha256", F.when(F.col("file").contains("2021"), "0").otherwise(F.col("sha256")))
    rows, report = S.verified_scan(spark, path, wrong)
    assert rows.count() == 2 and sorted(r["problem"] for r in report.collect()) == ["mismatch", "ok"]
    extra = listed.union(spark.createDataFrame([("year=1999/x.parquet", 1, "0")], listed.schema))
    assert sorted(r["problem"] for r in S.verify(spark, path, extra).collect()) == ["missing", "ok", "ok"]
    S.write_shards(spark.createDataFrame([(9, 2021)], "id int, year int"), path, "year", ["id"])
    assert sorted((r["id"], r["year"]) for r in S.scan(spark, path, year=[2020, 2021]).collect()) == [(1, 2020), (2, 2020), (9, 2021)]
    with pytest.raises(ValueError):
        S.row_count_check(100, 69)


def test_month_history(spark, tmp_path):
    path = str(tmp_path / "h")
    S.write_month(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path, "2024-01")
    S.write_month(spark.createDataFrame([("a", 2), ("a", 3)], "k string, v int"), path, "2024-02")
    assert sorted((r["k"], r["v"]) for r in S.read_history(spark, path, ["k"]).collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_every_file_has_its_own_dialect(spark, tmp_path):
    """Separators, code pages and columns by file; a byte that is not UTF-8 far behind the beginning; marks and short rows."""
    (tmp_path / "a.csv").write_bytes("Make;Größe\nVW;1\nAudi;2\nshort\nlong;1;2\n\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("Make,Farbe\nSkoda,grün\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"Make\tFarbe\n" + b"".join(b"m%d\tx\n" % i for i in range(20_000)) + "Seat\tgrün €\n".encode("cp1252"))
    (tmp_path / "d.csv").write_bytes(b'Farbe,Make\n"a, ""b""","q"\n')
    got = R.read_delimited(spark, str(tmp_path))
    rows = {(r["Make"], r["Größe"], r["Farbe"]) for r in got.collect() if not r["Make"].startswith("m")}
    assert rows == {("VW", "1", None), ("Audi", "2", None), ("Skoda", None, "grün"), ("Seat", None, "grün €"), ("q", None, 'a, "b"')} and got.count() == 20_005
    (tmp_path / "e.csv").write_bytes(b"\xef\xbb\xbf <!DOCTYPE html>\n<p>")
    with pytest.raises(ValueError, match="e.csv"):
        R.read_delimited(spark, str(tmp_path))


def test_leaves_of_any_depth(spark):
    from quillforge.operators import rules as L

    deep = "{" + '"a":{' * 9 + '"x":[[[1,{"y":"] }"}]],[],{}]' + "}" * 10
    rows = [(1, deep), (2, "[]"), (3, "7"), (4, "no json"), (5, None), (6, '{"n":null,"a.b":[true],"t":"{\\"q\\":[1]}"}')]
    got = {(r["id"], r["path"]): r["value"] for r in L.leaves(spark.createDataFrame(rows, "id int, j string"), ["id"], "j").collect()}
    a = "$" + ".a" * 9 + ".x[0][0]"
    assert got == {(1, a + "[0]"): "1", (1, a + "[1].y"): "] }", (3, "$"): "7", (6, "$.n"): None, (6, '$."a.b"[0]'): "true", (6, "$.t"): '{"q":[1]}'}
