"""Grouped statistics that built-in aggregates do not give: weighted medians that never interpolate, nearest ranks,
majorities with shares, profiles of columns, and cohort survival.

All of them aggregate equal values first, so that only distinct values of a group are put in order.
Every ordering has a tie-break, and unknown (null) never counts as a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.numbers import half_up


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys are equal; the keys of the left side stay."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def weighted_profile(df: DataFrame, keys: list[str], measures: list[str], weight: str) -> DataFrame:
    """One row per key: rows, weight, and for each measure <m>_median, <m>_min, <m>_max.

    A weight that is null or not positive counts 1. The median is the smallest value at which the running weight reaches
    half of the measure's own weight. A measure without values has nulls; the weight is null if no row states one."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0)).cast("double")
    out = None
    for m in measures:
        # equal values (and the rows without one) once: all that is asked for comes from these rows
        values = df.groupBy(*keys, F.col(m).alias("v")).agg(F.sum(w).alias("w"), F.count("*").alias("c"), F.count(weight).alias("stated"))
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        known = F.when(F.col("v").isNotNull(), F.col("w"))
        ranked = values.withColumn("run", F.sum(known).over(upto)).withColumn("half", F.sum(known).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 2)
        stats = [F.min(F.when(F.col("run") >= F.col("half"), F.col("v"))).alias(f"{m}_median"), F.min("v").alias(f"{m}_min"), F.max("v").alias(f"{m}_max")]
        if out is None:
            out = ranked.groupBy(*keys).agg(F.sum("c").alias("rows"), F.when(F.sum("stated") > 0, F.sum("w")).alias("weight"), *stats)
        else:
            out = join_null_safe(out, ranked.groupBy(*keys).agg(*stats), keys)
    return out


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """n and, for each name, the value at rank max(1, ceil(q n)) among the non-null values in ascending order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("run", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.col("n") * q)), F.col("v"))).alias(name) for name, q in quantiles.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def rounded_index(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """n and, for each name, the value at index round(q (n - 1)), halves to even: another rule than nearest_rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("run", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("run") > F.bround((F.col("n") - 1) * F.lit(q), 0), F.col("v"))).alias(name) for name, q in quantiles.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def vote_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, votes, n (votes of the key) and rank by votes descending, then value."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.asc(value))
    return votes.withColumn("rank", F.row_number().over(rank)).withColumn("n", F.sum("votes").over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def majority(df: DataFrame, keys: list[str], value: str, top: int = 3) -> DataFrame:
    """keys, majority, majority_n, n, share (four digits) and top_values ("value:votes", best first)."""
    ranked = vote_counts(df, keys, value).where(F.col("rank") <= top)
    entries = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", F.col(value).cast("string"), F.col("votes").cast("string")).alias("entry"))))
    return ranked.groupBy(*keys).agg(
        F.min_by(value, "rank").alias("majority"),
        F.max("votes").alias("majority_n"),
        F.max("n").alias("n"),
        half_up(F.max("votes") / F.max("n"), 4).alias("share"),
        F.array_join(F.transform(entries, lambda e: e["entry"]), "|").alias("top_values"),
    )


def majority_decision(df: DataFrame, keys: list[str], value: str, least_n: int = 20, least_share: float = 0.8) -> DataFrame:
    """keys, n, standard (if n and the exact share are high enough) or alternatives (the two most frequent values)."""
    ranked = vote_counts(df, keys, value)
    summary = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("votes").alias("votes"),
        F.max(F.when(F.col("rank") == 1, F.col(value))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col(value))).alias("second"),
    )
    reached = (F.col("n") >= least_n) & (F.col("votes") / F.col("n") >= least_share)
    return summary.where(F.col("n") >= least_n).select(*keys, "n", F.when(reached, F.col("first")).alias("standard"), F.when(~reached, F.concat_ws("|", "first", "second")).alias("alternatives"))


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, votes, share: the most frequent value, the smallest of equals."""
    return vote_counts(df, keys, value).where("rank = 1").select(*keys, F.col(value).alias("dominant"), "votes", half_up(F.col("votes") / F.col("n"), 4).alias("share"))


def column_profile(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """One row per column: state, type, null_pct, distinct_values, weighted_pct (coverage by weight). An
    empty table has no rows.

    Blank strings are null. Weights count if any is positive (others then 0), else every row counts 1. The type is that of
    all values: INTEGER within REAL, TEXT only if no value is a number, MIXED otherwise."""
    weighed = F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(F.lit(0.0))
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), clean(c).alias("v")) for c in columns])
    # each different value of a column once, then one row a column: values are counted, not compared with each other
    values = df.select(weighed.alias("w"), F.explode(cells).alias("c")).groupBy("c.column_name", "c.v").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    number, whole = F.expr("try_cast(v as double)"), F.col("v").rlike(r"^[+-]?[0-9]+$")
    count_of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    e = values.groupBy("column_name").agg(
        F.sum("n").alias("_n"),
        F.sum("w").alias("_w"),
        count_of(F.col("v").isNotNull()).alias("values"),
        F.count("v").alias("distinct"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0)).alias("weight"),
        count_of(whole).alias("whole"),
        count_of(number.isNotNull() & ~whole).alias("real"),
    )
    e = e.withColumn("weight", F.when(F.col("_w") > 0, F.col("weight")).otherwise(F.col("values").cast("double"))).withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("_n").cast("double")))
    text = F.col("values") - F.col("whole") - F.col("real")
    kind = F.when(F.col("values") == 0, None).when(text == F.col("values"), "TEXT").when(text > 0, "MIXED").when(F.col("real") > 0, "REAL").otherwise("INTEGER")
    return e.select(
        "column_name",
        F.when(F.col("values") == 0, "empty").otherwise("mapped").alias("state"),
        kind.alias("value_type"),
        half_up((F.col("_n") - F.col("values")) / F.nullif("_n", F.lit(0)) * 100, 1).alias("null_pct"),
        F.col("distinct").alias("distinct_values"),
        half_up(F.col("weight") / F.nullif("_w", F.lit(0.0)) * 100, 1).alias("weighted_pct"),
    )


def coverage_start(df: DataFrame, year: str, least_share: float = 0.01) -> DataFrame:
    """One row: the earliest year that holds at least least_share of all rows."""
    counts = df.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("y")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return shares.agg(F.min(F.when(F.col("share") >= least_share, F.col("y"))).alias("coverage_start"))


def cohort_survival(active: DataFrame, keys: list[str], cohort: str, end: str, cancelled: str, ref_year: Column, ages: range, least_size: int, start: DataFrame, dated_share: float = 0.95) -> DataFrame:
    """One row per cohort: size, cancelled, dated, status (the first reason to withhold, else served), p25, p50, p75 of the
    age at the end, and shares ("age:share" for each age reached, four digits).

    active has one row a member: keys, cohort year, end year (null: none), cancelled flag. An end before the start is a bad
    date and gives no age. start has one row, coverage_start. An age a is reached if ref_year - cohort >= a + 1."""
    age = F.col(end) - F.col(cohort)
    group = [*keys, cohort]
    members = active.withColumn("age", F.when(F.col(cancelled) & (age >= 0), age))
    sizes = members.groupBy(*group).agg(
        F.count("*").alias("size"),
        F.sum(F.col(cancelled).cast("long")).alias("cancelled"),
        F.count(F.when(F.col(cancelled) & F.col(end).isNotNull(), 1)).alias("dated"),
        F.count(F.when(F.col(cancelled) & (age < 0), 1)).alias("bad_dates"),
        *[F.count(F.when(F.col("age") <= a, 1)).alias(f"a{a}") for a in ages],
    )
    ranks = nearest_rank(members, group, "age", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    out = join_null_safe(sizes, ranks, group).crossJoin(F.broadcast(start)).withColumn("ref_year", ref_year)
    status = (
        F.when(F.col("size") < least_size, "cohort_too_small")
        .when(F.col(cohort) < F.col("coverage_start"), "before_coverage")
        .when((F.col("cancelled") > 0) & (F.col("dated") / F.col("cancelled") < dated_share), "undated")
        .otherwise("served")
    )
    reached = F.array(*[F.when(F.col("ref_year") - F.col(cohort) >= a + 1, F.concat(F.lit(f"{a}:"), half_up(F.col(f"a{a}") / F.col("size"), 4).cast("decimal(9,4)").cast("string"))) for a in ages])
    served = F.col("status") == "served"
    out = out.withColumn("status", status)
    return out.select(*group, "size", "cancelled", "dated", "bad_dates", "status", *[F.when(served, F.col(p)).alias(p) for p in ("p25", "p50", "p75")], F.when(served, F.array_join(F.array_compact(reached), "|")).alias("shares"))


def agreement(df: DataFrame, keys: list[str], value: str, spread: Column | float, spread_pct: Column | float, step: Column | float, weight: Column | None = None) -> DataFrame:
    """One row per key: n, n_null, status and value. One distinct value is the value; several within the spread, and within
    spread_pct percent of the lower median, give the lower median rounded to the step; others disagree; none is no_value.

    The limits may depend on the keys. All comes from one aggregation of equal values; a row counts `weight` times."""
    spread, spread_pct, step = (x if isinstance(x, Column) else F.lit(x) for x in (spread, spread_pct, step))
    values = df.groupBy(*keys, F.col(value).alias("v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("c"))
    whole = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_last())
    known = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)
    ranked = values.withColumn("run", F.sum(known).over(whole.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(known).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = F.min(F.when(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.col("all") * 0.5)), F.col("v")))
    both = ranked.groupBy(*keys).agg(F.sum(known).alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("n_null"), F.count("v").alias("distinct_values"), F.min("v").alias("lo"), F.max("v").alias("hi"), middle.alias("median"))
    width = F.col("hi") - F.col("lo")
    near = (width <= spread) & (width <= F.abs(F.col("median")) * spread_pct / 100)
    status = F.when(F.col("n") == 0, "no_value").when(F.col("distinct_values") == 1, "value").when(near, "within_precision").otherwise("survivors_disagree")
    rounded = F.signum("median") * F.floor(F.abs(F.col("median")) / step + F.lit(0.5 + 1e-9)) * step
    return both.select(*keys, "n", "n_null", "distinct_values", status.alias("status"), F.when(F.col("distinct_values") == 1, F.col("lo")).when((F.col("n") > 0) & near, rounded).alias("value"))
