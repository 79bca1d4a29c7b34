"""Queries over the structure of pages and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import structure as T
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


@R.query("""
WITH p AS (SELECT p_partkey AS page, p_name, p_type, p_size, p_brand, p_partkey % 4 AS k FROM part), x(place, kind, label, field, heading, repeated) AS (VALUES
  (1, 'definition_list', 'Brand', 'brand', 'Overview', true), (2, 'definition_list', 'Type', 'type', 'Overview', true), (3, 'two_column', 'Size', 'size', 'Dimensions & more', true), (4, 'two_column', 'Half', 'half', 'Dimensions & more', true), (5, 'two_column', 'Name', 'name', 'Dimensions & more', true),
  (6, 'split', 'Series', 'brand', 'Dimensions & more', true), (7, 'split', 'Kind', 'type', 'Dimensions & more', true), (8, 'split', 'Count', 'size', 'Dimensions & more', true), (9, 'split', 'Price', 'size', 'Dimensions & more', false))
SELECT page, place, kind, label, CASE field WHEN 'brand' THEN p_brand WHEN 'type' THEN p_type WHEN 'size' THEN p_size::VARCHAR WHEN 'half' THEN p_size || ' / 2' WHEN 'name' THEN p_name END AS value, heading, repeated FROM p, x WHERE k <> 3 OR place <= 2
""")
def page_pairs(spark, sf_dir):
    """Product pages: lists, two-column blocks, lines with a label; with navigation, hidden parts and tables around them."""
    s = lambda c: F.col(c).cast("string")
    two = lambda label, value: F.concat(F.lit(f'<div class="row b a"><span>{label}:</span><span> '), value, F.lit(" </span></div>"))
    head = F.concat(F.lit('<html><body><nav><ul><li>Shop: all</li><li>Help: us</li><li>Top: up</li></ul></nav><div class="mainNav"><p>A: b</p><p>C: d</p><p>E: f</p></div><h1>'), F.col("p_name"), F.lit("</h1><h2>Overview</h2><dl><dt>Brand:</dt><dd>"), F.col("p_brand"), F.lit("</dd><dt>Type</dt><dd>"), F.col("p_type"), F.lit("</dd><dd></dd></dl>"))
    rows = F.concat(F.lit("<h2>Dimensions &amp; more</h2><section>"), two("Size", s("p_size")), two("Half", F.concat(s("p_size"), F.lit(" / 2"))), two("Name", F.col("p_name")), F.lit("</section>"))
    lines = F.concat(F.lit("<ul><li><b>Series</b>: "), F.col("p_brand"), F.lit("</li><li><b>Kind</b> – "), F.col("p_type"), F.lit("</li><li><b>Count</b> | "), s("p_size"), F.lit("</li></ul>"))
    tail = F.concat(F.lit('<div style="display: none"><p>X: 1</p><p>Y: 2</p><p>Z: 3</p></div><div><p>Price: '), s("p_size"), F.lit("</p><p>Note: one</p><p>more</p></div><table><tr><td>In: table</td></tr><tr><td>Of: cells</td></tr><tr><td>No: pairs</td></tr></table><footer>Tel: 1</footer></body></html>"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand").repartition("p_partkey")  # dealt out while rows are short: a page is made, and parsed, after it
    pages = part.select(F.col("p_partkey").alias("page"), F.when(F.col("p_partkey") % 4 == 3, head).otherwise(F.concat(head, rows, lines, tail)).alias("html"))
    return T.page_pairs(T.page_elements(pages, "page", "html"), "page", 3, F.col("label") == "Price")


@R.query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END::INT AS line, CASE p_partkey % 3 WHEN 0 THEN 'Length' WHEN 1 THEN 'Weight' ELSE p_type END AS label, CASE WHEN p_partkey % 3 = 0 THEN '(mm)' END AS unit, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' kg' ELSE p_name END AS value FROM part WHERE p_partkey % 7 > 0
""")
def line_blocks(spark, sf_dir):
    """Labels with a unit, a repetition and a description between them and their value; some of them broken off."""
    k, size, prose = F.col("p_partkey"), F.col("p_size").cast("string"), F.lit("This is a description of what the label above it means.")
    lines = lambda *parts: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = F.when(k % 7 == 0, lines("Label", "no description", size, "Last", prose)).when(k % 3 == 0, lines("  Head ", "Length", "(mm)", "Length", prose, size, "after")).when(k % 3 == 1, lines("12", "", "a", "Weight", prose, prose, F.concat(size, F.lit(" kg")))).otherwise(lines("x", F.col("p_type"), prose, F.col("p_name"), ""))
    return T.line_blocks(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
