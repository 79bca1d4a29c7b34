"""Rule ladders over rows and groups: consistency, bindings, routing, triage, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def three_way(known: Column, ok: Column) -> Column:
    """consistent / suspicious / not_checkable."""
    return F.when(~F.coalesce(known, F.lit(False)) | ok.isNull(), "not_checkable").when(ok, "consistent").otherwise("suspicious")


def in_band(df: DataFrame, bands: DataFrame, key: str, ratio: Column) -> DataFrame:
    """df with band_ok: the ratio within its key's band; null without a band. bands is a small rule table (key, lo, hi)."""
    return df.withColumn("ratio", ratio).join(F.broadcast(bands), key, "left").withColumn("band_ok", F.col("ratio").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


# Fixed values that results must carry: levels of binding, from weakest to strongest.
LEVELS = ("unknown", "model_family", "generation", "body_powertrain", "exact_technical_variant", "exact_market_trim")


def binding_level(family: Column, year: Column, powertrain: Column, technical: Column, trim: Column) -> Column:
    """The highest level whose dimension and all below it are matched (verdicts: matched, veto, unknown); any veto of the
    family gives unknown."""
    m = lambda c: c == "matched"
    return (
        F.when(~m(family), LEVELS[0])
        .when(~m(year), LEVELS[1])
        .when(~m(powertrain), LEVELS[2])
        .when(~m(technical), LEVELS[3])
        .when(~m(trim), LEVELS[4])
        .otherwise(LEVELS[5])
    )


def weighted_signals(weights: dict[str, float], signals: dict[str, Column]) -> Column:
    """The sum of signals, each times its weight in the configuration; yes/no signals count 1 or 0, unknown ones 0. Three
    digits, half up. A signal without a weight is an error, as is a weight without a signal."""
    if weights.keys() != signals.keys():
        raise ValueError(f"weights and signals differ in {sorted(weights.keys() ^ signals.keys())}")
    terms = [F.coalesce(signals[name].cast("double"), F.lit(0.0)) * weight for name, weight in weights.items()]
    return F.floor(sum(terms[1:], terms[0]) * 1000 + 0.5) / 1000


def single_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys all of whose rows state one and the same value (no nulls), with it and the number of rows."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("_s"), F.countDistinct(value).alias("_d"), F.max(value).alias(value))
    return per.where("_d = 1 AND _s = n").drop("_s", "_d")


def assemble(df: DataFrame, keys: list[str], value: str, rank: list[Column], source: str) -> DataFrame:
    """One row per key: the best-ranked value, its source, other values (best first) and all sources of the chosen one."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    r = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w))
    r = r.withColumn("_first", F.first(value).over(w))
    other = F.sort_array(F.collect_list(F.when(F.col(value) != F.col("_first"), F.struct("_i", F.col(value).cast("string").alias("v")))))
    return r.groupBy(*keys).agg(
        F.max("_first").alias("value"),
        F.min_by(source, "_i").alias("source"),
        F.array_join(F.array_distinct(F.transform(other, lambda x: x["v"])), "|").alias("alternatives"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col(value) == F.col("_first"), F.col(source).cast("string")))), "|").alias("attributions"),
    )


def key_sets(df: DataFrame, keys: list[str], names: str) -> DataFrame:
    """keys, common and seen: the intersection and union of the comma-joined name lists of a key's rows, without lists of lists:
    a name is common if it is in as many rows as there are."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"))
    each = df.select(*keys, F.explode(F.array_distinct(F.split(names, ","))).alias("name")).where("name <> ''")
    counts = each.groupBy(*keys, "name").agg(F.count("*").alias("c")).join(rows, keys)
    sets = counts.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("c") == F.col("n"), F.col("name")))), ",").alias("common"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("seen"))
    return rows.join(sets, keys, "left").select(*keys, F.col("n").alias("rows"), F.coalesce("common", F.lit("")).alias("common"), F.coalesce("seen", F.lit("")).alias("seen"))


def depth(json: Column) -> Column:
    """How deep containers of a JSON text stand in each other; what is in strings does not count."""
    marks = F.regexp_replace(F.regexp_replace(json, r'"(?:\\\\.|[^"\\\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, step, lambda s: s["most"])


def leaves(df: DataFrame, key: list[str], json: str) -> DataFrame:
    """key, path, value of every leaf of a JSON text, of any depth; containers have no row of their own, nulls a null value.

    Paths are $.name, or $."name" where the name has more than letters, digits and _, and [i] in arrays. Each level of the
    deepest row is one explode in one chain of operators; rows that are leaves already pass through."""
    levels = df.agg(F.max(depth(F.col(json)))).first()[0] or 0
    out = df.select(*key, F.lit("$").alias("path"), F.expr(f"try_parse_json(`{json}`)").alias("_v")).where("_v IS NOT NULL")
    inner = F.expr("schema_of_variant(_v)").rlike("^(OBJECT|ARRAY)")
    for _ in range(levels):
        each = df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value")
        name = F.when(F.col("_key").rlike("^[A-Za-z0-9_]+$"), F.col("_key")).otherwise(F.concat(F.lit('"'), "_key", F.lit('"')))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        moved = out.lateralJoin(each).withColumn("_has", F.col("_value").isNotNull())
        out = moved.select(*key, F.when(F.col("_has"), F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.when(F.col("_has"), F.col("_value")).otherwise(F.col("_v")).alias("_v"))
    return out.where(~inner).select(*key, "path", F.expr("cast(_v as string)").alias("value"))


def after_cursor(rows: DataFrame, cursors: DataFrame, key: list[str], position: str, cursor: str) -> DataFrame:
    """rows whose position is past their key's cursor; a key without a cursor has read nothing yet."""
    both = rows.join(cursors, key, "left")
    return both.where(F.col(cursor).isNull() | (F.col(position) > F.col(cursor))).select(*rows.columns)


def within_counts(targets: DataFrame, rows: DataFrame, keys: list[str], reach: dict[str, int], name: str) -> DataFrame:
    """keys, the numbers in `reach` and a count under `name`, once for each that targets state: the rows of the same keys whose
    whole numbers in `reach` are each at most so far away. What no row is near has no row here.

    Without a number it is a count by key. The last number is counted by running sums over its values in order; one before it
    is spread over the values it may take, so keep its reach small. Rows with a null there are near nothing."""
    if not reach:
        return rows.groupBy(*keys).agg(F.count("*").alias(name))
    *spread, (value, far) = reach.items()
    columns = list(dict.fromkeys([*keys, *reach]))
    asked = targets.select(*columns).distinct()
    for c, most in spread:
        asked = asked.withColumn(f"_{c}", F.explode(F.sequence(F.col(c) - most, F.col(c) + most)))
    keyed = [*keys, *[f"_{c}" for c, _ in spread]]
    points = rows.groupBy(*keys, *reach).agg(F.count("*").alias("_n")).withColumnsRenamed({c: f"_{c}" for c, _ in spread})
    # the sum of all points below the lower end is taken from the sum of all up to the upper end
    ends = F.explode(F.array(F.struct((F.col(value) - far).alias("_at"), F.lit(0).alias("_kind")), F.struct((F.col(value) + far).alias("_at"), F.lit(2).alias("_kind"))))
    queries = asked.where(F.col(value).isNotNull()).select("*", ends.alias("_e")).select(*asked.columns, "_e.*")
    marks = queries.unionByName(points.withColumnRenamed(value, "_at").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    running = F.sum("_n").over(Window.partitionBy(*keyed).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    upto = marks.withColumn("_sum", F.coalesce(running, F.lit(0))).where("_kind <> 1")
    return upto.groupBy(*columns).agg(F.sum(F.when(F.col("_kind") == 2, F.col("_sum")).otherwise(-F.col("_sum"))).alias(name))


def counts_by_level(targets: DataFrame, rows: DataFrame, target: str, levels: dict[str, tuple[list[str], dict[str, int]]]) -> DataFrame:
    """target, level, candidates: how many rows bind to a target at each level and at none above it.

    levels, the lowest first, has for each what a row must share with the target: keys, and how far numbers may be away. Each
    asks for all that the one before it asks for and more. Counts are made from the given targets, not from what earlier
    levels added to them, and joined by sorting: what explode makes is more than Spark expects, too much to send to the driver."""
    out = targets
    for i, (keys, reach) in enumerate(levels.values()):
        counted = within_counts(targets, rows, keys, reach, f"_c{i}")
        out = out.join(counted.hint("merge") if reach or target in keys else counted, list(dict.fromkeys([*keys, *reach])), "left").na.fill(0, [f"_c{i}"])
    alone = [F.col(f"_c{i}") - (F.col(f"_c{i + 1}") if i + 1 < len(levels) else F.lit(0)) for i in range(len(levels))]
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), n.alias("candidates")) for level, n in zip(levels, alone, strict=True)]))
    return out.select(target, each.alias("l")).select(target, "l.*").where("candidates > 0")
