"""Catalogue reads: cascaded counts, filtered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.operators.ordered import page
from quillforge.plans.registry import Registry
from quillforge.session import table

R = Registry()


class RefusedFilter(ValueError):
    """A combination of filters that is not served."""


def filters(brand: str | None = None, kind: str | None = None, size: int | None = None, q: str | None = None) -> Column:
    """One conjunction; a size needs a brand, a kind needs a brand. q of digits is an id, other q a part of the name."""
    if brand is None and (kind is not None or size is not None):
        raise RefusedFilter("kind and size need a brand")
    out = F.lit(True)
    for column, value in (("p_brand", brand), ("p_type", kind), ("p_size", size)):
        if value is not None:
            out = out & (F.col(column) == value)
    if q is not None:
        out = out & ((F.col("p_partkey") == int(q)) if q.isdigit() else F.contains(F.lower("p_name"), F.lit(q.lower())))
    return out


def search(parts: DataFrame, limit: int = 50, offset: int = 0, **by) -> DataFrame:
    order = [F.col(c) for c in ("p_brand", "p_type", "p_size", "p_name", "p_partkey")]
    return page(parts.where(filters(**by)), order, limit, offset)


@R.query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS models FROM part GROUP BY 1")
def catalog_makers(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("models"))


@R.query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def catalog_models(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@R.query("SELECT p_brand, year(l_shipdate) AS y, count(*) AS n, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def catalog_years(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    both = lines.join(part, lines.l_partkey == part.p_partkey)
    return both.groupBy("p_brand", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))


@R.query("""
SELECT p.*, total FROM (SELECT * FROM part WHERE p_brand = 'Brand#12' AND contains(lower(p_name), 'a') ORDER BY p_brand, p_type, p_size, p_name, p_partkey LIMIT 20 OFFSET 10) p,
  (SELECT count(*) AS total FROM part WHERE p_brand = 'Brand#12' AND contains(lower(p_name), 'a'))
""")
def catalog_search_page(spark, sf_dir):
    return search(table(spark, sf_dir, "part"), 20, 10, brand="Brand#12", q="a")


@R.query("""
WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type, p_size) AS i FROM c) SELECT p_brand, p_type, p_size, n, i AS place FROM g WHERE i <= 3
""")
def top_per_group(spark, sf_dir):
    from pyspark.sql import Window

    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type", "p_size"))).where("place <= 3")


@R.query("SELECT p_brand, count(*) AS n_codes, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def several_values(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_codes"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.countDistinct("p_size").alias("d")).where("d > 1").drop("d")


@R.query("""
WITH g AS (SELECT p_brand, p_size, p_type, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT p_brand, p_size, min(a)::INT AS first_year, max(b)::INT AS last_year, string_agg(p_type || ':' || a || '-' || b, ',' ORDER BY p_type) AS type_codes FROM g GROUP BY 1, 2
""")
def type_code_years(spark, sf_dir):
    """Each code of a maker with its type codes and the years that each was made in."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_type")
    years = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b"))
    per = part.join(years, "l_partkey").groupBy("p_brand", "p_size", "p_type").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    listed = F.sort_array(F.collect_list(F.struct("p_type", F.concat_ws("", "p_type", F.lit(":"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("t"))))
    return per.groupBy("p_brand", "p_size").agg(F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("type_codes"))
