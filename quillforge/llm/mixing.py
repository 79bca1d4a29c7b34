"""Mixing sources to target weights with Pareto order sampling.

Each source gets a share of all words: its weight's share, stopped at `most` times the words it has, with the excess given
to the others by weight. Inside a source every document has a rate, how often the mix should take it: a level of the source
over the fourth root of the document's size, so that more of a source's words come from its many ordinary documents than
from repeats of a few very long ones. Rates stop at `most`; the level is such that rates times sizes add up to the target.
A document with rate r is taken floor(r) times for certain. For the rest a Pareto order sample of unequal probabilities is
drawn in each source: with inclusion probability p = r - floor(r) and a random number u that a hash of the document fixes,
documents rank by the odds u / (1 - u) over the odds p / (1 - p), and the smallest ranks are taken until the words that are
left to the target are reached.

A source can hold a third of all rows, so ranks are never sorted in one task: words are summed over SLICES slices of the
ranks' order first, those sums tell the slice in which the target is reached, and only inside that slice are documents put
in order. What is known of the sources, one row each, is sent to the tasks if it is small; documents are then not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.common import WORD, sent_if_small, stage_table, table

SLICES = 4096


def uniform(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A number in (0, 1) from the md5 of seed, doc_id and text: 48 bits and a half."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target for a frame of one row a source (source, source_size).

    Sources in code point order, null last, have the weights in turn. Water filling in closed form: sources stop at their
    limit in the order of limit over weight; the level of the others is what is left over the weights that are left."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    level = level.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    level = level.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = level.withColumn("level", F.col("left").cast("double") / F.col("weights_left"))
    # the first source, in order of limits, that the level does not fill: from there on the level holds for all
    level = level.withColumn("place", F.row_number().over(by_limit))  # of sources with one limit the first
    level = level.withColumn("final", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")), F.col("cap").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def thinning(size: Column) -> Column:
    """What a rate is the source's level times of: one over the fourth root of the size."""
    return 1 / F.sqrt(F.sqrt(F.greatest(size, F.lit(1)).cast("double")))


def levels(sizes: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """mix_source, level: with rates of level * thinning(size), at most `most`, the sizes of a source's documents add up to its
    target; null where all rates are `most`. sizes has a row for each source and different size, with all its words."""
    by = sizes.join(totals.select("mix_source", "target"), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("thin", thinning(F.col("size")))
    # rates stop for the smallest documents first; the first size that the level of those from it on does not fill decides
    upwards = Window.partitionBy("mix_source").orderBy("size")
    before = F.coalesce(F.sum("words").over(upwards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("thin")).over(Window.partitionBy("mix_source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    by = by.withColumn("level", (F.col("target") - most * before) / F.nullif(rest, F.lit(0.0)))
    first = by.where(F.col("level") * F.col("thin") <= most).groupBy("mix_source").agg(F.min_by("level", "size").alias("level"))
    return first.withColumnRenamed("mix_source", "level_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "") -> DataFrame:
    """docs' rows with size, source_size, target, copies (how often the mix takes the document) and taken (its words).

    Defined cases: a null text has size 0; a null source is a source of its own, the last; a document of size 0 is taken
    by whole copies only and adds no words (a source without words gives none); equal ranks go in order of doc_id, and rows with one doc_id and text one by one,
    so that of several equal rows only some may be taken. Columns of docs named like the new ones are replaced. An empty
    table gives no rows."""
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new]
    # docs' own columns travel in one struct, so that no name of theirs meets a name used here
    docs = docs.select(F.struct(*kept).alias("row"), "doc_id", "source", F.col("text").cast("string").alias("text")).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    u = uniform(F.col("doc_id"), F.col("text"), seed)
    ranks = stage_table(docs.select("doc_id", "source", "size", u.alias("u")), "mix-ranks")
    sizes = stage_table(ranks.groupBy("source", "size").agg(F.sum("size").alias("words")), "mix-sizes")
    totals = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    totals = stage_table(totals.select(F.col("source").alias("mix_source"), "source_size", "target"), "mix-targets")
    totals = totals.join(levels(sizes, totals, most), F.col("mix_source").eqNullSafe(F.col("level_source")), "left").drop("level_source")

    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("level") * thinning(F.col("size")), F.lit(float(most)))))
    whole = F.floor(rate + 1e-9)  # a rate that is a whole number but for rounding
    p = F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0)
    certain = sizes.join(totals, F.col("source").eqNullSafe(F.col("mix_source"))).groupBy("mix_source").agg(F.sum(F.col("words") * whole).alias("certain"))
    totals = totals.join(certain.withColumnRenamed("mix_source", "certain_source"), F.col("mix_source").eqNullSafe(F.col("certain_source")), "left").drop("certain_source")
    totals = stage_table(totals.withColumn("odd", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0))), "mix-totals")

    # the rank, brought into (0, 1] by a rising function; documents without a chance come last and are not in the sample
    rank = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))
    slice_of = F.floor(F.col("rank") * SLICES)
    ranked = ranks.join(sent_if_small(totals), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("p", p).where("p > 0").withColumn("rank", rank)
    sums = ranked.withColumn("slice", slice_of).groupBy("source", "slice").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edge = sums.join(totals, F.col("source").eqNullSafe(F.col("mix_source"))).where("before < odd AND before + words >= odd")
    edge = edge.groupBy("mix_source").agg(F.min("slice").alias("edge_slice"), F.min_by("before", "slice").alias("edge_before"))
    plan = totals.join(edge.withColumnRenamed("mix_source", "edge_source"), F.col("mix_source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    plan = stage_table(plan, "mix-plan")

    inside = ranks.join(sent_if_small(plan), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("p", p).where("p > 0").withColumn("rank", rank).where(slice_of == F.col("edge_slice"))
    inside = inside.groupBy("mix_source", "rank", "doc_id", "size", "edge_before", "odd").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("mix_source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("room", F.col("odd") - F.col("edge_before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(earlier), F.lit(0)))
    # of n equal rows those that fit; the row that crosses the target is taken if that leaves the sum nearer to it
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.col("room") / F.nullif("size", F.lit(0))))).otherwise(F.col("n"))
    rest = F.col("room") - fit * F.col("size")
    crossing = (fit < F.col("n")) & (rest > 0) & (F.col("size") - rest < rest)
    inside = inside.withColumn("taken_of", F.when(F.col("room") >= 0, fit + F.when(crossing, 1).otherwise(0)).otherwise(0)).where("taken_of > 0")
    at = F.struct("rank", F.col("doc_id").isNull().alias("last"), "doc_id", "size")
    stop = inside.groupBy("mix_source").agg(F.max(F.struct(at.alias("at"), "taken_of", "n")).alias("stop")).withColumnRenamed("mix_source", "stop_source")
    plan = stage_table(plan.join(stop, F.col("mix_source").eqNullSafe(F.col("stop_source")), "left").drop("stop_source"), "mix-stops")

    placed = docs.withColumn("u", u).join(sent_if_small(plan), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("p", p).withColumn("whole", whole.cast("long")).withColumn("rank", F.when(F.col("p") > 0, rank))
    before_stop = F.coalesce(at <= F.col("stop.at"), F.lit(False))
    sampled = (F.col("p") > 0) & F.when(F.col("edge_slice").isNull(), F.col("odd") > 0).otherwise((slice_of < F.col("edge_slice")) | ((slice_of == F.col("edge_slice")) & before_stop))

    def taking(rows: DataFrame, sampled: Column) -> DataFrame:
        rows = rows.withColumn("copies", F.least(F.col("whole") + F.when(sampled, 1).otherwise(0), F.lit(most)).cast("long"))
        return rows.withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *new)

    if plan.where("stop.taken_of < stop.n").isEmpty():
        return taking(placed, sampled)
    # equal rows of which only some are taken: they are counted part by part, so that no task numbers all of them
    some = F.coalesce((F.col("stop.taken_of") < F.col("stop.n")) & (at == F.col("stop.at")), F.lit(False))
    equal = stage_table(placed.where(some).withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id()), "mix-equal")
    parts = equal.groupBy("mix_source", "part").agg(F.count("*").alias("in_all"))
    parts = parts.withColumn("before", F.coalesce(F.sum("in_all").over(Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(F.col("mix_source").alias("part_source"), F.col("part").alias("of_part"), "before")
    numbered = equal.withColumn("nth", F.row_number().over(Window.partitionBy("mix_source", "part").orderBy("in_part")))
    numbered = numbered.join(sent_if_small(stage_table(parts, "mix-parts")), F.col("mix_source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("of_part")))
    return taking(placed.where(~some), sampled).unionByName(taking(numbered, F.col("before") + F.col("nth") <= F.col("stop.taken_of")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every document of docs as often as the mix takes it, with the columns of docs."""
    columns = docs.columns
    docs = docs.select(F.struct(*columns).alias("whole_row"), "doc_id", "source", "text")
    return mix(docs, weights, most).where("copies > 0").select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place FROM c
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (arg_min(level, place) FILTER (cap > level * weight) OVER ()) * weight), cap::DOUBLE) AS target FROM l
), z AS (
  SELECT d.source, d.size, sum(d.size)::BIGINT AS words, any_value(target) AS target, 1 / sqrt(sqrt(greatest(d.size, 1)::DOUBLE)) AS thin FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, d.size
), v AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * thin) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING), 0) AS level FROM z
), f AS (
  SELECT source, arg_min(level, size) AS level FROM v WHERE level * thin <= 3 GROUP BY source
), o AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE least(3.0, coalesce(level / sqrt(sqrt(greatest(size, 1)::DOUBLE)), 3.0)) END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(rate + 1e-9)::BIGINT AS whole, CASE WHEN size > 0 THEN greatest(rate - floor(rate + 1e-9), 0.0) ELSE 0.0 END AS p FROM o
), q AS (
  SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0.0) AS odd, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank FROM p
), r AS (
  SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) END AS upto FROM q
)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken, n::BIGINT AS copies FROM (
  SELECT *, whole + CASE WHEN odd > 0 AND (upto <= odd OR (upto - size < odd AND upto - odd < odd - (upto - size))) THEN 1 ELSE 0 END AS n FROM r
)
"""
