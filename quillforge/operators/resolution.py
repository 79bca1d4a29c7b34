"""Entity resolution and merge: verdicts per key with vetoes, survivors, levels, offers, precedence, conflict classes,
portability, field states.

A null states nothing: it is neither a match nor a veto. What is withheld carries the first reason that applies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.operators.aggregates import agreement, join_null_safe, nearest_rank
from quillforge.operators.evidence import first_reason


def exact(a: str, b: str) -> Column:
    return F.when(F.col(a).isNull() | F.col(b).isNull(), "unknown").when(F.col(a) == F.col(b), "matched").otherwise("veto")


def within(a: str, b: str, absolute: float = 0.0, share: float = 0.0) -> Column:
    """Equal within the larger of an absolute tolerance and a share of the first."""
    limit = F.greatest(F.lit(absolute), F.abs(F.col(a)) * share)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), "unknown").when(F.abs(F.col(a) - F.col(b)) <= limit, "matched").otherwise("veto")


def near(df: DataFrame, value: str, low: Column, high: Column, width: float, share: bool = False) -> tuple[Column, Column]:
    """For match's `bands`: the bands that values between low and high lie in, and the band of a value; of equal width, or
    with share of equal ratio (positive values only)."""
    cell = (lambda x: F.floor(F.log(x) / width)) if share else (lambda x: F.floor(x / width))
    return F.sequence(cell(low), cell(high)), cell(F.col(value))


def match(targets: DataFrame, source: DataFrame, block: list[str], verdicts: dict[str, Column], prefer: str, bands: list[tuple[Column, Column]] = (), row: str | None = None) -> DataFrame:
    """Candidate pairs of equal block that no key vetoes, with the keys matched and unknown.

    Among a target's survivors, those that match the key `prefer` supersede those that do not state it. The block is an
    equi-join; vetoes are its residual, so vetoed pairs are never kept. Each of `bands` (see near) makes a key part of the
    equi-join: a target goes into the few bands its partners can lie in, and into that of the rows that do not state the
    value; one that does not state it itself meets its whole block. Pairs are not exchanged: which sources have a preferred
    survivor is told to the targets, from source rows that differ in more than their id `row`."""
    meets = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_of_{c}") for c in block))
    cells = [F.when(reach.isNotNull(), F.concat(reach, F.array(F.lit(None)))) for reach, _ in bands]
    stated = reduce(lambda a, b: a & b, (reach.isNotNull() for reach, _ in bands), F.lit(True))

    def pairs(t: DataFrame, rows: DataFrame) -> DataFrame:
        r = rows.withColumnsRenamed({c: f"_of_{c}" for c in block})
        spread, on = t.where(stated), meets
        for k, (_, own) in enumerate(bands):
            spread, r, on = spread.withColumn(f"_band{k}", F.explode(cells[k])), r.withColumn(f"_own{k}", own), on & F.col(f"_band{k}").eqNullSafe(F.col(f"_own{k}"))
        helpers = [f"_{name}{k}" for k in range(len(bands)) for name in ("band", "own")]
        both = spread.join(r, on).drop(*helpers)
        if bands:
            both = both.unionByName(t.where(~stated).join(r, meets).drop(*helpers))
        named = both.drop(*[f"_of_{c}" for c in block]).withColumns({f"_{k}": v for k, v in verdicts.items()})
        return named.where(reduce(lambda x, y: x & y, (F.col(f"_{k}") != "veto" for k in verdicts)))

    preferred = F.col(f"_{prefer}") == "matched"
    different = source if row is None else source.drop(row).distinct()
    has = pairs(targets, different).where(preferred).groupBy("target_id").agg(F.collect_set("source").alias("_has"))  # the sources are few
    alive = pairs(targets.join(has, "target_id", "left"), source).where(preferred | ~F.coalesce(F.array_contains("_has", F.col("source")), F.lit(False)))
    keys = lambda state: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{k}") == state, F.lit(k)) for k in sorted(verdicts)])), ",")
    return alive.withColumn("keys_matched", keys("matched")).withColumn("keys_unknown", keys("unknown")).drop("_has", *[f"_{k}" for k in verdicts])


def alike(targets: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One of the targets for each different content of `columns`, and (target_id, _rep): which one stands for which."""
    reps = targets.groupBy(*columns).agg(F.min("target_id").alias("target_id"))
    return reps, join_null_safe(targets.select("target_id", *columns), reps.withColumnRenamed("target_id", "_rep"), columns).select("target_id", "_rep")


def for_all(members: DataFrame, of_reps: DataFrame) -> DataFrame:
    """What is known of the targets that stand for others, for all of them (see alike)."""
    return members.join(of_reps.withColumnRenamed("target_id", "_rep"), "_rep").drop("_rep")


def match_status(targets: DataFrame, survivors: DataFrame, designation: str) -> DataFrame:
    """target_id, source, survivors, designations and status (none, unique, ambiguous) for every target and source. A
    survivor stands for `n` rows where there is such a column."""
    sources = survivors.select("source").distinct()
    per = survivors.groupBy("target_id", "source").agg((F.sum("n") if "n" in survivors.columns else F.count("*")).alias("survivors"), F.countDistinct(designation).alias("designations"))
    grid = targets.select("target_id").crossJoin(F.broadcast(sources))  # the sources are few and fixed
    out = grid.join(per, ["target_id", "source"], "left").na.fill(0, ["survivors", "designations"])
    status = F.when(F.col("survivors") == 0, "none").when(F.col("designations") == 1, "unique").otherwise("ambiguous")
    return out.withColumn("status", status)


def match_level(statuses: DataFrame, lead: list[str]) -> DataFrame:
    """target_id, level, lead_source: exact if two sources are unique, partial if any has survivors, else null; the lead is
    the first source in order that is unique, or else that has survivors."""
    rank = F.array_position(F.array(*map(F.lit, lead)), F.col("source"))
    best = F.when(F.col("status") == "unique", rank).when(F.col("status") == "ambiguous", rank + len(lead))
    per = statuses.groupBy("target_id").agg(F.count_if(F.col("status") == "unique").alias("unique_sources"), F.count_if(F.col("survivors") > 0).alias("with_survivors"), F.min_by("source", best).alias("lead_source"))
    level = F.when(F.col("unique_sources") >= 2, "exact").when(F.col("with_survivors") > 0, "partial")
    return per.select("target_id", level.alias("level"), F.when(F.col("with_survivors") > 0, F.col("lead_source")).alias("lead_source"), "unique_sources")


def level_by_route(statuses: DataFrame, routes: DataFrame, exact: dict[str, list[list[str]]], sources: dict[str, list[str]]) -> DataFrame:
    """target_id, route, level for targets with a route. exact says for each route which sources make a match exact: any of the
    lists, all of whose sources must be unique. Else it is partial if any of the route's own sources has survivors, and null
    if none has. An unknown route (one that exact does not have, or null) asks for all routes' conditions and looks at all
    sources."""
    own = lambda condition: F.collect_set(F.when(condition, F.col("source")))  # noqa: E731  the sources are few
    per = statuses.groupBy("target_id").agg(own(F.col("status") == "unique").alias("_unique"), own(F.col("survivors") > 0).alias("_alive"))
    holds = {route: reduce(lambda a, b: a | b, (F.size(F.array_except(F.array(*map(F.lit, all_of)), F.col("_unique"))) == 0 for all_of in ways)) for route, ways in exact.items()}
    alive = {route: F.arrays_overlap(F.array(*map(F.lit, names)), F.col("_alive")) for route, names in sources.items()}
    by_route = lambda of, otherwise: reduce(lambda out, route: F.when(F.col("route") == route, of[route]).otherwise(out), of, otherwise)
    both = routes.join(per, "target_id", "left")
    met = by_route(holds, reduce(lambda a, b: a & b, holds.values()))
    some = by_route(alive, F.size("_alive") > 0)
    level = F.when(F.col("_unique").isNotNull() & met, "exact").when(some, "partial")
    return both.select("target_id", "route", level.alias("level"))


def offer_ladder(offers: DataFrame, key: list[str], field: str, source: str, now_year: Column, max_age: int, least_level: int, alone: list[str], step: float) -> DataFrame:
    """key, field, source, value and status of offers with n, n_dropped, status, value, year, reference, definition_ok, level,
    key_stated; the first that applies: inconsistent (rows were dropped, none is left), range (over a quarter was), disagree,
    reference_only, too_old, other_definition, below_level, missing_key, uncorroborated (a field of `alone` whose value no
    other source offers within a step), offered. A status that is not offered has no value."""
    left = F.col("n") - F.col("n_dropped")
    checks = {
        "inconsistent": (F.col("n") > 0) & (left == 0),
        "range": F.col("n_dropped") > F.col("n") * 0.25,
        "disagree": F.col("status") == "survivors_disagree",
        "no_value": F.col("value").isNull(),
        "reference_only": F.col("reference"),
        "too_old": F.col("year") < now_year - max_age,
        "other_definition": ~F.col("definition_ok"),
        "below_level": F.col("level") < least_level,
        "missing_key": ~F.col("key_stated"),
    }
    judged = offers.withColumn("_reason", first_reason(checks))
    offered = F.when(F.col("_reason").isNull(), F.col("value"))
    # a value's neighbours in order tell whether another source is within a step; of one source there is one offer
    near = Window.partitionBy(*key, field).orderBy(offered.asc_nulls_last(), source)
    gap = lambda other: F.abs(other - offered) <= step
    backed = F.coalesce(gap(F.lag(offered).over(near)), F.lit(False)) | F.coalesce(gap(F.lead(offered).over(near)), F.lit(False))
    judged = judged.withColumn("_backed", backed)
    status = F.coalesce("_reason", F.when(F.col(field).isin(alone) & ~F.col("_backed"), "uncorroborated").otherwise("offered"))
    return judged.select(*key, field, source, F.when(status == "offered", F.col("value")).alias("value"), status.alias("status"))


def by_precedence(facts: DataFrame, key: list[str], tier: str, order: list[str], value: str) -> DataFrame:
    """One row per key: the value of the first tier, in order, that states one, the tier, and the tiers that it overrules with
    another value ("tier:value", in order). Tiers not in order count for nothing; one row a key and tier."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(tier))
    stated = facts.where((place > 0) & F.col(value).isNotNull()).select(*key, place.alias("_p"), F.col(tier).alias("_t"), F.col(value).alias("_v"))
    per = stated.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", "_t", "_v"))).alias("_all"))  # at most one a tier
    first = F.get("_all", F.lit(0))
    others = F.transform(F.filter("_all", lambda x: x["_v"] != first["_v"]), lambda x: F.concat_ws(":", x["_t"], x["_v"].cast("string")))
    return per.select(*key, first["_v"].alias(value), first["_t"].alias(tier), F.array_join(others, ",").alias("overruled"))


def field_offers(targets: DataFrame, survivors_of: Callable[[DataFrame], DataFrame], rules: dict[str, tuple[float, float, float]]) -> DataFrame:
    """target_id, source, field, n, status, value: the agreement of the targets' survivors (each stands for `n` rows) on each
    field, by (spread, percent, step). Number, smallest and largest value decide but where they lie within the spread: there
    alone, as a median is needed, survivors are looked up again and their values put in order."""
    limit = lambda i: reduce(lambda out, f: F.when(F.col("field") == f, F.lit(float(rules[f][i]))).otherwise(out), rules, F.lit(None).cast("double"))
    stats = [x for f in rules for x in (F.sum(F.when(F.col(f).isNotNull(), F.col("n"))).alias(f"_n_{f}"), F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"))]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"_n_{f}", F.lit(0)).alias("n"), F.col(f"_lo_{f}").cast("double").alias("lo"), F.col(f"_hi_{f}").cast("double").alias("hi")) for f in rules])
    each = survivors_of(targets).groupBy("target_id", "source").agg(*stats).select("target_id", "source", F.explode(cells).alias("c")).select("target_id", "source", "c.*")
    close = F.coalesce((F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") <= limit(0)), F.lit(False))
    status = F.when(F.col("n") == 0, "no_value").when(F.col("lo") == F.col("hi"), "value").otherwise("survivors_disagree")
    clear = each.where(~close).select("target_id", "source", "field", "n", status.alias("status"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))
    asked = each.where(close).select("target_id", "source", "field")
    again = survivors_of(targets.join(asked.select("target_id").distinct(), "target_id", "left_semi"))
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in rules])
    stated = again.select("target_id", "source", "n", F.explode(values).alias("c")).select("target_id", "source", "n", "c.*")
    keys = ["target_id", "source", "field"]
    agreed = agreement(stated, keys, "v", limit(0), limit(1), limit(2), F.col("n")).join(asked, keys, "left_semi")
    return clear.unionByName(agreed.select(*keys, "n", "status", "value"))


def merge_facts(offers: DataFrame, levels: DataFrame, admission: DataFrame, official: DataFrame, step: float) -> DataFrame:
    """One row per target and field: value, source, status and corroborated_by.

    admission (source, field, precedence, least_level) says which offers count. Order of reasons: the offer's own status,
    not_admitted, below_level, then against the official value official_wins or contradicts_official. Among admitted offers
    the smallest precedence is chosen; another offered value farther away than one step makes a source_conflict (no value),
    equal ones corroborate."""
    rank = lambda level: F.when(level == "exact", 2).when(level == "partial", 1).otherwise(0)
    o = offers.join(levels.select("target_id", "level"), "target_id", "left").join(F.broadcast(admission), ["source", "field"], "left").join(official, ["target_id", "field"], "left")
    offered = F.col("value").isNotNull()
    reason = (
        F.when(~offered, F.concat(F.lit("offer_"), F.col("status")))
        .when(F.col("precedence").isNull(), "not_admitted")
        .when(rank(F.col("level")) < rank(F.col("least_level")), "below_level")
        .when(F.col("official_value").isNotNull() & (F.abs(F.col("official_value") - F.col("value")) <= step), "official_wins")
        .when(F.col("official_value").isNotNull(), "contradicts_official")
        .otherwise("admitted")
    )
    o = o.withColumn("reason", reason).withColumn("offered", offered)
    w = Window.partitionBy("target_id", "field")
    first = F.min(F.when(F.col("reason") == "admitted", F.struct("precedence", "value", "source"))).over(w)
    o = o.withColumn("_first", first).withColumn("_far", F.col("offered") & (F.abs(F.col("value") - F.col("_first.value")) > step))
    per = o.groupBy("target_id", "field").agg(
        F.max("_first").alias("f"),
        F.max(F.coalesce("_far", F.lit(False))).alias("conflict"),
        F.max("official_value").alias("official_value"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("offered") & ~F.coalesce("_far", F.lit(False)) & (F.col("source") != F.col("_first.source")), F.col("source")))), ",").alias("peers"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("reason") != "admitted", F.concat_ws(":", "source", "reason")))), ",").alias("withheld"),
    )
    chosen = F.col("f").isNotNull() & ~F.col("conflict")
    status = F.when(F.col("official_value").isNotNull(), "official").when(F.col("f").isNull(), "withheld").when(F.col("conflict"), "source_conflict").otherwise("served")
    return per.select(
        "target_id",
        "field",
        status.alias("status"),
        F.when(F.col("official_value").isNotNull(), F.col("official_value")).when(chosen, F.col("f.value")).alias("value"),
        F.when(F.col("official_value").isNotNull(), F.lit("official")).when(chosen, F.col("f.source")).alias("source"),
        F.when(chosen & F.col("official_value").isNull(), F.col("peers")).otherwise("").alias("corroborated_by"),
        "withheld",
    )


def _all_stated(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _different(label: str, key: list[str]) -> Column:
    """Of rows of one value each: is its label, null if it has none or several, that of no other value of the key?"""
    return F.col(label).isNotNull() & (F.count("*").over(Window.partitionBy(*key, label)) == 1)


def conflict_classes(evidence: DataFrame, key: list[str], value: str, tolerance: str, market: str, source: str, scope: str) -> DataFrame:
    """One row per key: n, distinct_values and the first class that fits: agreed, rounding_equivalent (all stated intervals
    share a point), market_difference, internal_source_inconsistency, variant_scope_difference, true_conflict.

    A partition class needs each value to carry exactly one label, and no label to carry two values. Equal rows are counted
    first, then dealt out by key once; what follows, values and their labels, stays where it is."""
    columns = {"_value": value, "_tolerance": tolerance, "_market": market, "_scope": scope}
    stated = evidence.where(_all_stated([*key, value])).groupBy(*key, *[F.col(c).alias(n) for n, c in columns.items()])
    rows = stated.agg(F.count("*").alias("_n"), F.min(source).alias("_s0"), F.max(source).alias("_s1")).repartition(*key)
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    values = rows.groupBy(*key, "_value").agg(
        F.sum("_n").alias("_n"), F.min("_s0").alias("_s0"), F.max("_s1").alias("_s1"), only("_market"), only("_scope"), F.max(F.col("_value") - F.col("_tolerance")).alias("_left"), F.min(F.col("_value") + F.col("_tolerance")).alias("_right")
    )
    values = values.withColumn("_market", _different("_market", key)).withColumn("_scope", _different("_scope", key))
    both = values.groupBy(*key).agg(
        F.sum("_n").alias("n"), F.count("*").alias("distinct_values"), (F.max("_left") <= F.min("_right")).alias("_overlap"), (F.min("_s0") == F.max("_s1")).alias("_one_source"), F.min("_market").alias("_market"), F.min("_scope").alias("_scope")
    )
    kind = (
        F.when(F.col("distinct_values") == 1, "agreed")
        .when(F.col("_overlap"), "rounding_equivalent")
        .when(F.col("_market"), "market_difference")
        .when(F.col("_one_source"), "internal_source_inconsistency")
        .when(F.col("_scope"), "variant_scope_difference")
        .otherwise("true_conflict")
    )
    return both.select(*key, "n", "distinct_values", kind.alias("conflict_class"))


def interval_conflicts(evidence: DataFrame, key: list[str], low: str, high: str, tolerance: str, market: str, document: str, domain: str, scope: str, exact: str) -> DataFrame:
    """One row per key: n, different values, class and normalised (the values do not really disagree), for stated intervals.

    Classes in order: unit_equivalent (one value in the common unit), scalar_inside_range (all scalars are one, inside every
    stated range; normalised if every scalar is bound exactly), rounding_equivalent (all intervals, widened by their
    tolerance, share a point), market_difference, internal_source_inconsistency (one document or domain states several
    values), variant_scope_difference, true_conflict. A partition class needs one label for each value and different ones.
    Equal rows are counted first, then dealt out by key once."""
    columns = {"_lo": low, "_hi": high, "_tolerance": tolerance, "_market": market, "_scope": scope, "_document": document, "_domain": domain}
    stated = evidence.where(_all_stated([*key, low, high])).groupBy(*key, *[F.col(c).alias(n) for n, c in columns.items()])
    rows = stated.agg(F.count("*").alias("_n"), F.min(exact).alias("_exact")).repartition(*key)
    for c in ("_document", "_domain"):
        own = Window.partitionBy(*key, c)
        several = (F.min("_lo").over(own) != F.max("_lo").over(own)) | (F.min("_hi").over(own) != F.max("_hi").over(own))
        rows = rows.withColumn(c, F.col(c).isNotNull() & several)
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    only = lambda c: F.when(F.min(label(c)) == F.max(label(c)), F.min(label(c))).alias(c)
    values = rows.groupBy(*key, "_lo", "_hi").agg(
        F.sum("_n").alias("_n"), F.min("_exact").alias("_exact"), only("_market"), only("_scope"), F.max(F.col("_document") | F.col("_domain")).alias("_shared"), F.max(F.col("_lo") - F.col("_tolerance")).alias("_left"), F.min(F.col("_hi") + F.col("_tolerance")).alias("_right")
    )
    values = values.withColumn("_market", _different("_market", key)).withColumn("_scope", _different("_scope", key))
    scalar = F.col("_lo") == F.col("_hi")
    both = values.groupBy(*key).agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("distinct_values"),
        F.min("_market").alias("_market"),
        F.min("_scope").alias("_scope"),
        F.max("_shared").alias("_shared"),
        F.max("_left").alias("_left"),
        F.min("_right").alias("_right"),
        F.min(F.when(scalar, F.col("_lo"))).alias("_s0"),
        F.max(F.when(scalar, F.col("_lo"))).alias("_s1"),
        F.max(F.when(~scalar, F.col("_lo"))).alias("_r0"),
        F.min(F.when(~scalar, F.col("_hi"))).alias("_r1"),
        F.min(F.when(scalar, F.col("_exact"))).alias("_exact"),
    )
    inside = (F.col("_s0") == F.col("_s1")) & F.col("_s0").between(F.col("_r0"), F.col("_r1"))
    kind = (
        F.when(F.col("distinct_values") == 1, "unit_equivalent")
        .when(inside, "scalar_inside_range")
        .when(F.col("_left") <= F.col("_right"), "rounding_equivalent")
        .when(F.col("_market"), "market_difference")
        .when(F.col("_shared"), "internal_source_inconsistency")
        .when(F.col("_scope"), "variant_scope_difference")
        .otherwise("true_conflict")
    )
    normal = F.when(kind == "scalar_inside_range", F.coalesce("_exact", F.lit(False))).otherwise(kind.isin("unit_equivalent", "rounding_equivalent"))
    return both.select(*key, "n", "distinct_values", kind.alias("conflict_class"), normal.alias("normalised"))


def range_agreement(rows: DataFrame, keys: list[str], value: str, low: str, high: str, widest: float, spread: float, most_dropped: float = 0.25) -> DataFrame:
    """One row per key: n_stated, n_dropped, status and value, for rows that may state their own range around a value.

    A row whose range is wider than `widest` loses this value (a bound it does not state is its value). Where more than
    most_dropped of the stated values go, the field is a range and has no value. Else what is left agrees (value), lies
    within the spread (within_precision: the lower median), or survivors_disagree; no stated value is no_value."""
    lo, hi = F.coalesce(low, value), F.coalesce(high, value)
    kept = F.when(hi - lo <= widest + 1e-9, F.col(value))
    stated = rows.where(F.col(value).isNotNull()).withColumn("_kept", kept)
    medians = nearest_rank(stated, keys, "_kept", {"_median": 0.5}).select(*keys, "_median")
    per = rows.groupBy(*keys).agg(F.count(value).alias("n_stated"), F.count(F.when(F.col(value).isNotNull(), kept)).alias("_n"), F.min(F.when(F.col(value).isNotNull(), kept)).alias("_lo"), F.max(F.when(F.col(value).isNotNull(), kept)).alias("_hi"))
    both = join_null_safe(per, medians, keys).withColumn("n_dropped", F.col("n_stated") - F.col("_n"))
    status = (
        F.when(F.col("n_stated") == 0, "no_value")
        .when(F.col("n_dropped") > F.col("n_stated") * most_dropped, "range")
        .when(F.col("_lo") == F.col("_hi"), "value")
        .when(F.col("_hi") - F.col("_lo") <= spread, "within_precision")
        .otherwise("survivors_disagree")
    )
    return both.select(*keys, "n_stated", "n_dropped", status.alias("status"), F.when(status == "value", F.col("_lo")).when(status == "within_precision", F.col("_median")).alias("value"))


def portability(evidence: DataFrame, key: list[str], value: str, market: str, target: str, official: str, scope_ok: str, policy: str) -> DataFrame:
    """One row per key with foreign evidence: portable, value and the first reason against it, in this order: policy, scope,
    target_contradicts (checked when the foreign values agree), foreign_markets_disagree, no_official_source."""
    foreign = F.col(market) != target
    per = evidence.groupBy(*key).agg(
        F.max(policy).alias("_policy"),
        F.countDistinct(F.when(foreign & F.col(scope_ok), F.col(value))).alias("_values"),
        F.min(F.when(foreign & F.col(scope_ok), F.col(value))).alias("_value"),
        F.count_if(foreign).alias("_foreign"),
        F.count_if(foreign & F.col(scope_ok) & F.col(official)).alias("_official"),
        F.min(F.when(~foreign, F.col(value))).alias("_lo"),
        F.max(F.when(~foreign, F.col(value))).alias("_hi"),
    )
    per = per.where("_foreign > 0")
    contradicted = F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("_value")) | (F.col("_hi") != F.col("_value")))
    reason = (
        F.when(~F.col("_policy"), "field_policy_not_portable")
        .when(F.col("_values") == 0, "scope_below_portability")
        .when((F.col("_values") == 1) & contradicted, "target_contradicts")
        .when(F.col("_values") > 1, "foreign_markets_disagree")
        .when(F.col("_official") == 0, "no_official_source")
    )
    return per.select(*key, reason.isNull().alias("portable"), F.when(reason.isNull(), F.col("_value")).alias("value"), reason.alias("reason"))


def field_states(evidence: DataFrame, key: list[str], value: str, in_scope: str, in_market: str, weak: str) -> DataFrame:
    """One row per key: missing, weak_provenance, conflicting, variant_not_exact, foreign_market_only or ok, the first that fits."""
    served = F.col(in_scope) & F.col(in_market) & F.col(value).isNotNull()
    per = evidence.groupBy(*key).agg(
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNotNull() & ~F.col(weak)).alias("solid"),
        F.countDistinct(F.when(served, F.col(value))).alias("values"),
        F.count_if(F.col(in_market) & F.col(value).isNotNull()).alias("here"),
        F.count_if(served).alias("served"),
    )
    state = (
        F.when(F.col("n") == 0, "missing")
        .when(F.col("solid") == 0, "weak_provenance")
        .when(F.col("values") > 1, "conflicting")
        .when((F.col("served") == 0) & (F.col("here") > 0), "variant_not_exact")
        .when(F.col("served") == 0, "foreign_market_only")
        .otherwise("ok")
    )
    return per.select(*key, "n", state.alias("state"))
