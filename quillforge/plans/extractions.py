"""Queries over values that documents state about the fields of a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import extraction as X
from quillforge.plans.registry import Registry
from quillforge.session import shuffle_partitions, table

R = Registry()

FIELDS = [
    X.Field("power", "numeric", ("power", "max power", "engine output"), {"kw": 1.0, "hp": 0.75}, low=10, high=900),
    X.Field("range", "numeric", ("range", "electric range"), {"km": 1.0, "mi": 1.6}, low=5, high=2000),
    X.Field("doors", "numeric", ("doors", "number of doors"), low=2, high=6),
    X.Field("sunroof", "boolean", ("sunroof", "glass roof")),
    X.Field("drive", "enum", ("drive", "traction"), values={"front": "front", "all-wheel": "all", "awd": "all"}),
    X.Field("tyres", "tyre", ("tyres", "tyre size")),
    X.Field("price", "price", ("price", "list price"), low=100),
]


@R.query("""
WITH p AS (SELECT p_partkey AS doc, p_size AS n, p_partkey % 4 AS k, p_partkey % 3 AS j FROM part),
s(seg, field, value, unit, method, confidence, doc) AS (
  SELECT 0, 'power', CASE WHEN k = 0 THEN (n + 10)::VARCHAR ELSE ((n + 20) * 3 // 4)::VARCHAR || CASE (n + 20) % 4 WHEN 0 THEN '' WHEN 1 THEN '.75' WHEN 2 THEN '.5' ELSE '.25' END END, CASE WHEN k = 0 THEN 'kw' ELSE 'hp' END, 'pair', CASE WHEN k = 0 THEN 0.95 ELSE 0.9 END, doc FROM p
  UNION ALL SELECT 1, 'doors', (n % 5 + 2)::VARCHAR, NULL, 'pair', 0.95, doc FROM p
  UNION ALL SELECT 2, 'range', (n + 100)::VARCHAR, 'km', 'label', 0.85, doc FROM p
  UNION ALL SELECT 2, 'sunroof', CASE WHEN k = 1 THEN 'false' ELSE 'true' END, NULL, 'label', CASE WHEN k = 2 THEN 0.65 ELSE 0.8 END, doc FROM p
  UNION ALL SELECT 2, 'drive', CASE WHEN j = 0 THEN 'front' ELSE 'all' END, NULL, 'label', CASE WHEN j = 2 THEN 0.6 ELSE 0.8 END, doc FROM p
  UNION ALL SELECT 3, 'tyres', '2' || k || '5/45 R17', NULL, 'label', 0.8, doc FROM p
  UNION ALL SELECT 3, 'price', (n * 1000 + 900)::VARCHAR, 'EUR', 'label', 0.8, doc FROM p
  UNION ALL SELECT 4, 'power', (n + 11)::VARCHAR, 'kw', 'unit', 0.6, doc FROM p
  UNION ALL SELECT 5, 'range', (n + 100)::VARCHAR, NULL, 'label', 0.55, doc FROM p WHERE j = 0
  UNION ALL SELECT 6, 'sunroof', 'false', NULL, 'label', 0.75, doc FROM p WHERE k = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, field, value ORDER BY confidence DESC, seg) AS i, count(*) OVER (PARTITION BY doc, field, value) AS statements FROM s)
SELECT doc, seg::INT AS segment, field, value, unit, method, confidence::DOUBLE AS confidence, statements FROM r WHERE i = 1
""")
def dictionary_statements(spark, sf_dir):
    """Pairs and lines of a data sheet: units of two kinds, options, values of several kinds in a line, numbers of other things."""
    n, k, j = F.col("p_size"), F.col("p_partkey") % 4, F.col("p_partkey") % 3
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    pair = lambda label, value: (F.lit(label), value, none)
    line = lambda *parts: (none, none, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    drive = F.when(j == 0, "front").when(j == 1, "AWD").otherwise("all-wheel or front")
    sheet = [
        pair("Max. power (engine output)", F.when(k == 0, F.concat(s(n + 10), F.lit(" kW"))).otherwise(F.concat(s(n + 20), F.lit("hp at 5,000 rpm")))), pair("Number of doors:", s(n % 5 + 2)),
        line("Powerful looks. Electric range: up to ", s(n + 100), " km; sunroof - ", F.when(k == 1, "no").when(k == 2, "optional").otherwise("standard"), ", traction: ", drive),
        line("tyre size 2", s(k), "5/45R17, arranged for 9 people\nList price: € ", F.format_number(n * 1000 + 900, 0), " in 2024"), line("With ", s(n + 11), " kW this is its power"),
        line(F.when(j == 0, F.concat(F.lit("range "), s(n + 100))).otherwise("range 9000 km")), line(F.when(k == 3, "built without sunroof").otherwise("a sunroof is nice")), line("overpowered 300 kw doorstep"),
    ]
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), label.alias("label"), value.alias("value"), text.alias("text")) for i, (label, value, text) in enumerate(sheet)])
    # dealt out while rows are short: few splits of a file hold them all, and sheets are made and read behind the scan; a given
    # number, as else they would be put together again by their bytes
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(shuffle_partitions(spark), "p_partkey")
    rows = part.select(F.col("p_partkey").alias("doc"), F.explode(segments).alias("s")).select("doc", "s.*")
    return X.best_statement(X.extract(rows, "doc", FIELDS), "doc").drop("quote")
