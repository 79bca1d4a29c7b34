"""Measures of runs and resources: distributions of number texts, quality gates, metrics of runs and batches, curves, facets.

A ratio without a denominator is null, never zero; a sum of nothing is null where it stands for a cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.numbers import half_up, locale_number
from quillforge.operators.aggregates import join_null_safe, rounded_index


def text_distribution(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_texts, n (those that are numbers, in any of the locale's spellings), p5, p50, p95 by rounded index."""
    numbers = df.select(*keys, text, locale_number(F.col(text)).alias("_v"))
    ranks = rounded_index(numbers, keys, "_v", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    counts = numbers.groupBy(*keys).agg(F.count(text).alias("n_texts"))
    return join_null_safe(counts, ranks, keys).withColumn("n", F.coalesce("n", F.lit(0)))


def quality_gate(df: DataFrame, resource: str, parsed: Column, keyed: Column, shape: Column, least_parsed: float, most_unkeyed: dict[str, float], otherwise: float, shapes: int) -> DataFrame:
    """One row per resource: n, parsed_pct, unkeyed_pct, verdict and the most frequent shapes of what does not parse.

    The verdict is the first that applies: empty, unparsed (the exact share parsed is under least_parsed), unkeyed (the exact
    share without a key is over the resource's limit), ok."""
    flags = df.select(F.col(resource), F.coalesce(parsed, F.lit(False)).alias("_p"), F.coalesce(keyed, F.lit(False)).alias("_k"), shape.alias("_shape"))
    per = flags.groupBy(resource).agg(F.count("*").alias("n"), F.count_if("_p").alias("_np"), F.count_if(~F.col("_k")).alias("_nu"))
    odd = flags.where("NOT _p").groupBy(resource, "_shape").agg(F.count("*").alias("_c"))
    odd = odd.withColumn("_i", F.row_number().over(Window.partitionBy(resource).orderBy(F.desc("_c"), "_shape"))).where(F.col("_i") <= shapes)
    listed = odd.groupBy(resource).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_shape", "_c"))), lambda x: F.concat_ws(":", F.coalesce(x["_shape"], F.lit("null")), x["_c"].cast("string"))), "|").alias("shapes"))
    limit = reduce(lambda out, item: F.when(F.col(resource) == item[0], item[1]).otherwise(out), most_unkeyed.items(), F.lit(otherwise))
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("_np") / F.col("n") < least_parsed, "unparsed").when(F.col("_nu") / F.col("n") > limit, "unkeyed").otherwise("ok")
    share = lambda c: half_up(F.col(c) / F.col("n") * 100, 2)
    return join_null_safe(per, listed, [resource]).select(resource, "n", share("_np").alias("parsed_pct"), share("_nu").alias("unkeyed_pct"), verdict.alias("verdict"), F.coalesce("shapes", F.lit("")).alias("shapes"))


def once_per_tuple(df: DataFrame, columns: list[str], name: str, expression: Column) -> DataFrame:
    """df with `name`: an expensive expression over `columns`, evaluated once for each different tuple (nulls are equal)."""
    values = df.select(*columns).distinct().withColumn(name, expression)
    return join_null_safe(df, values, columns)


def run_metrics(events: DataFrame, run: str, seq: str, kind: str, text: str, cost: str, asks: list[str], answers: list[str]) -> DataFrame:
    """One row per run: counts, sizes, ratios, first answer, repeats (answered from a cache) and null-aware costs.

    A repeat is an ask whose text an earlier ask of any run has. The cost of a run is null if no event states one."""
    ask, answer = F.col(kind).isin(asks), F.col(kind).isin(answers)
    e = events.withColumn("_chars", F.length(text))
    first = F.row_number().over(Window.partitionBy(text).orderBy(run, seq))
    repeats = events.where(ask).withColumn("_first", first).groupBy(run).agg(F.count_if(F.col("_first") > 1).alias("repeats"))
    per = e.groupBy(run).agg(
        F.count("*").alias("events"),
        F.count_if(ask).alias("asks"),
        F.count_if(answer).alias("answers"),
        F.countDistinct(kind).alias("kinds"),
        F.sum("_chars").alias("chars"),
        F.sum(F.when(answer, F.col("_chars"))).alias("answer_chars"),
        F.max("_chars").alias("longest"),
        F.min(F.when(answer, F.col(seq))).alias("first_answer"),
        F.count(cost).alias("priced"),
        F.sum(cost).alias("cost"),
    )
    out = per.join(repeats, run, "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    ratio = lambda a, b: half_up(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return out.select("*", ratio("answers", "asks").alias("answer_rate"), ratio("repeats", "asks").alias("repeat_rate"), ratio("answer_chars", "answers").alias("mean_answer"), ratio("cost", "answers").alias("cost_per_answer"))


def batch_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per metric: n (runs that state it), total, mean, median, lowest, highest; nulls are left out, not zero."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])
    each = metrics.select(F.explode(cells).alias("c")).select("c.*")
    total = F.sum(F.col("v").cast("decimal(38,6)")).cast("double")
    return each.groupBy("metric").agg(F.count("v").alias("n"), total.alias("total"), half_up(total / F.nullif(F.count("v"), F.lit(0)), 4).alias("mean"), F.median("v").alias("median"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def stats_by_config(runs: DataFrame, config: str, run: str, value: str, complete: Column, listed: int) -> DataFrame:
    """One row per configuration, and one for all together (overall): runs, total, mean, median of complete runs, and how many
    are incomplete with the first `listed` of them. Incomplete runs count in nothing else."""
    r = runs.withColumn("_ok", F.coalesce(complete, F.lit(False))).withColumn("_config", F.col(config).cast("string"))
    value_of = F.when(F.col("_ok"), F.col(value))
    # the first incomplete runs of a configuration; the first of all are among them
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(run))
    each = r.where("NOT _ok").select("_config", run).withColumn("_i", place("_config")).where(F.col("_i") <= listed).drop("_i")
    overall = each.withColumn("_config", F.lit("overall")).withColumn("_i", place("_config")).where(F.col("_i") <= listed).drop("_i")
    names = each.unionByName(overall).groupBy("_config").agg(F.array_join(F.sort_array(F.collect_list(run)).cast("array<string>"), ",").alias("_names"))
    both = r.withColumn("_config", F.explode(F.array("_config", F.lit("overall"))))
    stats = both.groupBy("_config").agg(
        F.count_if("_ok").alias("runs"), F.sum(value_of).alias("total"), half_up(F.avg(value_of), 4).alias("mean"), F.median(value_of).alias("median"), F.count_if(~F.col("_ok")).alias("incomplete")
    )
    return stats.join(names, stats["_config"].eqNullSafe(names["_config"]), "left").select(stats["_config"].alias("config"), "runs", "total", "mean", "median", "incomplete", F.coalesce("_names", F.lit("")).alias("incomplete_runs"))


def agreement(rows: DataFrame, by: list[str], offer: str, truth: str, least: int, per_miss: int) -> DataFrame:
    """by, runs, agree, disagree, no_offer, proposed: how often offers equal what is known, over rows whose truth is known. proposed
    (for admission): at least `least` agree, and `per_miss` for each that disagrees."""
    known = rows.where(F.col(truth).isNotNull()).groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.col(offer) == F.col(truth)).alias("agree"), F.count_if(F.col(offer) != F.col(truth)).alias("disagree"), F.count_if(F.col(offer).isNull()).alias("no_offer"))
    return known.withColumn("proposed", (F.col("agree") >= least) & (F.col("disagree") * per_miss <= F.col("agree")))


def turn_curve(events: DataFrame, run: str, turn: str, item: Column, of: int) -> DataFrame:
    """turn, runs, mean and median coverage: the share of `of` items that a run has seen up to a turn, over the runs that
    reach the turn. An item counts from the first turn that shows it."""
    e = events.withColumn("_item", item)
    fresh = e.where("_item IS NOT NULL").groupBy(run, "_item").agg(F.min(turn).alias(turn)).groupBy(run, turn).agg(F.count("*").alias("_new"))
    turns = e.select(run, turn).distinct().join(fresh, [run, turn], "left")
    upto = Window.partitionBy(run).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    seen = turns.withColumn("_share", F.coalesce(F.sum("_new").over(upto), F.lit(0)) / of)
    return seen.groupBy(turn).agg(F.count("*").alias("runs"), half_up(F.avg("_share"), 4).alias("mean_coverage"), half_up(F.median("_share"), 4).alias("median_coverage"))


def backend_metrics(queries: DataFrame, backend: str, rank: str, latency: str, cost: str, accepted: Column) -> DataFrame:
    """One row per backend: queries, answered and accepted ratios, median rank of the first hit, p50 and p95 latency by rounded
    index, cost per 1,000 queries, accepted per unit of cost (null without cost)."""
    per = queries.groupBy(backend).agg(
        F.count("*").alias("queries"),
        half_up(F.count(rank) / F.count("*"), 4).alias("answered"),
        half_up(F.count_if(accepted) / F.count("*"), 4).alias("accepted"),
        F.median(rank).alias("median_rank"),
        half_up(F.sum(cost) / F.count(cost) * 1000, 2).alias("cost_per_1000"),
        half_up(F.count_if(accepted) / F.nullif(F.sum(cost), F.lit(0)), 4).alias("accepted_per_cost"),
    )
    ranks = rounded_index(queries, [backend], latency, {"p50_latency": 0.5, "p95_latency": 0.95}).drop("n")
    return join_null_safe(per, ranks, [backend])


def facets(df: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """keys and, for each name, "value:count" pairs, the most frequent first, then by value; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("v")) for n, c in names.items()])
    counts = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("v IS NOT NULL").groupBy(*keys, "facet", "v").agg(F.count("*").alias("n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "v"))), lambda x: F.concat_ws(":", x["v"], (-x["o"]).cast("string")))
    return counts.groupBy(*keys, "facet").agg(F.sum("n").alias("n"), F.array_join(pairs, "|").alias("counts"))


def capped(df: DataFrame, keys: list[str], item: str, order: list[Column], most: int) -> DataFrame:
    """keys, total and the first `most` items in order, comma-joined: a capped list never hides how many there are."""
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first = F.sort_array(F.collect_list(F.when(F.col("_i") <= most, F.struct("_i", F.col(item).cast("string").alias("v")))))
    return placed.groupBy(*keys).agg(F.count("*").alias("total"), F.array_join(F.transform(first, lambda x: x["v"]), ",").alias("listed"))


def first_of_fact(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The first row, by seq, of each fact: its key and the identity of its value; with `copies`. 205, 205.0, " 205 " and
    "1,066" and 1066 are one value each; all else is compared as text, trimmed, in lower case."""
    number = F.regexp_replace(F.trim(F.col(value)), ",", "").try_cast("double")
    plain = F.trim(F.col(value)).rlike(r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$")
    identity = F.when(plain, F.concat(F.lit("num:"), (number + F.lit(0.0)).cast("string"))).otherwise(F.concat(F.lit("txt:"), F.lower(F.trim(F.col(value)))))
    keyed = df.withColumn("_identity", identity)
    per = Window.partitionBy(*key, "_identity")
    return keyed.withColumn("_i", F.row_number().over(per.orderBy(seq))).withColumn("copies", F.count("*").over(per)).where("_i = 1").drop("_i", "_identity")


def against_earlier(df: DataFrame, entity: list[str], seq: list[str], value: str, by: list[str]) -> DataFrame:
    """by and how often a row's value agrees with, differs from, or has no earlier value of its entity (the newest that is
    stated), and how many rows state nothing themselves."""
    w = Window.partitionBy(*entity).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    e = df.withColumn("_before", F.last(value, ignorenulls=True).over(w))
    stated, known = F.col(value).isNotNull(), F.col("_before").isNotNull()
    return e.groupBy(*by).agg(F.count_if(stated & known & (F.col(value) == F.col("_before"))).alias("agree"), F.count_if(stated & known & (F.col(value) != F.col("_before"))).alias("disagree"), F.count_if(stated & ~known).alias("no_earlier"), F.count_if(~stated).alias("not_stated"))


def united(df: DataFrame, keys: list[str], lists: list[Column]) -> DataFrame:
    """keys and `items`: the lists one after another, each item where it stands first; null lists and items are nothing."""
    empty = F.array().cast("array<string>")
    return df.select(*keys, F.array_distinct(F.array_compact(F.concat(*[F.coalesce(c.cast("array<string>"), empty) for c in lists]))).alias("items"))


def grouped_sums(rows: DataFrame, keys: list[str], measures: list[str], year: Column, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Two results over the same rows of a delimited source: the sums of the measures (texts that are no whole numbers count
    nothing) by key for the wanted year; and one row with how many rows were of it, of other years, and of none."""
    sums = rows.where(year == wanted).groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(F.col(m).try_cast("bigint")).alias(m) for m in measures])
    seen = rows.agg(F.count_if(year == wanted).alias("of_year"), F.count_if(year != wanted).alias("other_years"), F.count_if(year.isNull()).alias("no_year"))
    return sums, seen


def selection_steps(df: DataFrame, keys: list[str], steps: dict[str, Column]) -> DataFrame:
    """keys, step, before, after, dropped and unknown for steps taken in order: a row goes on unless the step's condition is
    false; where it is unknown the row stays and is counted."""
    alive, cells = F.lit(True), []
    for i, (name, ok) in enumerate(steps.items()):
        cells.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("step"), alive.alias("before"), (alive & F.coalesce(ok, F.lit(True))).alias("after"), (alive & ok.isNull()).alias("unknown")))
        alive = alive & F.coalesce(ok, F.lit(True))
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("s")).select(*keys, "s.*")
    per = rows.groupBy(*keys, "place", "step").agg(F.count_if("before").alias("before"), F.count_if("after").alias("after"), F.count_if("unknown").alias("unknown"))
    return per.select(*keys, "step", "before", "after", (F.col("before") - F.col("after")).alias("dropped"), "unknown")
