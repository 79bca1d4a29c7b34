"""Extraction from text, admission with reasons, binding levels, reuse, triage and ranking of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quillforge.functions.text import quote_in_source


def harvest(docs: DataFrame, key: str, text: str, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """key, line_no, field, raw, value, plausible: numbers that each rule's pattern finds in a line, with its plausible range.

    Lines are the segments; a rule's first group is the number. All rules run in one pass over a line."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract_all("line", F.lit(p), F.lit(1)).alias("raws"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for f, (p, lo, hi) in rules.items()])
    hits = lines.select(key, "line_no", F.explode(F.filter(found, lambda x: F.size(x["raws"]) > 0)).alias("h")).select(key, "line_no", "h.field", F.explode("h.raws").alias("raw"), "h.lo", "h.hi")
    value = F.expr("try_cast(raw as double)")
    return hits.select(key, "line_no", "field", "raw", value.alias("value"), value.between(F.col("lo"), F.col("hi")).alias("plausible"))


def label_gaps(docs: DataFrame, key: str, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """key, field: documents that hold a field's label (fields: label, pattern of a value; both in lower case) but no value."""
    low = F.lower(F.col(text))
    checks = F.array(*[F.struct(F.lit(f).alias("field"), (F.contains(low, F.lit(label)) & ~low.rlike(pattern)).alias("gap")) for f, (label, pattern) in fields.items()])
    return docs.select(key, F.explode(F.filter(checks, lambda c: F.coalesce(c["gap"], F.lit(False)))).alias("c")).select(key, "c.field")


def unit_anchored(docs: DataFrame, key: str, text: str, aliases: dict[str, str], units: str, reach: int = 60) -> DataFrame:
    """key, field, value, unit: a number with a unit at most `reach` characters after an alias of the field."""
    parts = []
    for field, alias in aliases.items():
        pattern = rf"(?i)(?:{alias})[^0-9\n]{{0,{reach}}}?([0-9]+(?:\.[0-9]+)?) ?(?:{units})\b"
        whole = rf"(?i)(?:{alias})[^0-9\n]{{0,{reach}}}?[0-9]+(?:\.[0-9]+)? ?({units})\b"
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"), F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("u"))
        parts.append(docs.select(key, F.lit(field).alias("field"), F.explode(pairs).alias("p")).select(key, "field", F.col("p.v").cast("double").alias("value"), F.lower("p.u").alias("unit")))
    return reduce(DataFrame.unionByName, parts)


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, comma-joined in order; unknown (null) is not a reason."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])), ",")


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null if none."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])


def admit(evidence: DataFrame, sources: DataFrame, source: str, text: str, fields: DataFrame, key: list[str], seq: str) -> DataFrame:
    """evidence (key, seq, source, field, value, unit, quote) with its reason: the first that applies, or admitted.

    unknown_field (not in fields: field, field_unit, lo, hi; a small table), no_source, no_quote, quote_not_in_source (its
    fragments don't stand in the source one after another), value_not_in_quote (no number of the quote is the value),
    unit_differs, implausible, duplicate (an earlier row, by seq, that fails nothing else states the same fact of the key)."""
    e = evidence.join(F.broadcast(fields), "field", "left").join(sources.select(source, F.col(text).alias("_text")), source, "left")
    numbers = F.transform(F.regexp_extract_all("quote", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    checks = {
        "unknown_field": F.col("lo").isNull() & F.col("hi").isNull(),
        "no_source": F.col("_text").isNull(),
        "no_quote": F.col("quote").isNull() | (F.trim("quote") == ""),
        "quote_not_in_source": ~quote_in_source(F.col("_text"), F.col("quote")),
        "value_not_in_quote": F.col("value").isNull() | ~F.exists(numbers, lambda n: F.abs(n - F.col("value")) < 1e-9),
        "unit_differs": ~F.col("unit").eqNullSafe(F.col("field_unit")),
        "implausible": ~F.col("value").between(F.col("lo"), F.col("hi")),
    }
    judged = e.withColumn("_reason", first_reason(checks)).drop("_text")
    first = F.min(F.when(F.col("_reason").isNull(), F.col(seq))).over(Window.partitionBy(*key, "field", "value"))
    judged = judged.withColumn("reason", F.coalesce("_reason", F.when(F.col(seq) > first, "duplicate").otherwise("admitted")))
    return judged.select(*evidence.columns, "reason")


def first_match(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with the first rule, in order, that holds for a row."""
    return df.withColumn("rule", first_reason(dict(rules)))


def rule_coverage(df: DataFrame, group: str, key: str, rules: list[tuple[str, Column]], listed: int) -> DataFrame:
    """group, rule, n, examples: how many rows each rule is the first to hold for (null: none), with the `listed` smallest keys.

    Only the smallest keys of a rule travel: the limit is applied in every task before rows meet."""
    found = first_match(df, rules).select(group, "rule", key)
    counts = found.groupBy(group, "rule").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "rule").orderBy(key))
    first = found.withColumn("_i", place).where(F.col("_i") <= listed).groupBy(group, "rule").agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias("examples"))
    return counts.join(first, counts[group].eqNullSafe(first[group]) & counts["rule"].eqNullSafe(first["rule"])).select(counts[group], counts["rule"], "n", "examples")


def preceding(df: DataFrame, entity: list[str], order: list[str], label: Column, name: str) -> DataFrame:
    """df with the last non-null label at or before each row."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(label, ignorenulls=True).over(w))


def reusable(facts: DataFrame, wanted: DataFrame, scope: list[str], at: str, now: Column, max_days: int) -> DataFrame:
    """wanted with the newest fact of its scope (as fact_*), if it is at most max_days old; a fact without a date is too old."""
    columns = [c for c in facts.columns if c not in scope]
    newest = facts.where(F.col(at).isNotNull() & (F.date_diff(now, F.to_date(at)) <= max_days)).groupBy(*scope).agg(F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c != at])).alias("_f"))
    return wanted.join(newest, scope, "left").select(*wanted.columns, *[F.col(f"_f.{c}").alias(f"fact_{c}") for c in columns])


def yields(df: DataFrame, by: list[str], turns: str, solved: str, least: int) -> DataFrame:
    """by, samples, turns, solved, ratio of clusters with at least `least` samples; 0.0 where there are no turns."""
    per = df.groupBy(*by).agg(F.count("*").alias("samples"), F.sum(turns).alias("turns"), F.sum(solved).alias("solved")).where(F.col("samples") >= least)
    return per.withColumn("ratio", F.coalesce(F.floor(F.col("solved") / F.nullif("turns", F.lit(0)) * 1000 + 0.5) / 1000, F.lit(0.0)))


def interrupted(events: DataFrame, entity: list[str], ts: str, quiet_seconds: int) -> DataFrame:
    """Per entity: sessions (split where the gap to the event before is longer than quiet_seconds) and the longest gap."""
    w = Window.partitionBy(*entity).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    g = events.withColumn("_gap", gap)
    return g.groupBy(*entity).agg((F.count_if(F.col("_gap") > quiet_seconds * 1_000_000) + 1).alias("sessions"), F.floor(F.max("_gap") / 1_000_000).alias("longest_gap"))


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left, right, strict=True)])


def closest(codes: DataFrame, values: DataFrame, block: str, code: str, value: str, n: int) -> DataFrame:
    """The n values of its block most like each code by the ratio of matching blocks, two digits, ties by value.

    For diagnosis only; blocks keep it an equi-join over distinct strings."""
    pairs = codes.select(block, code).distinct().join(values.select(block, value).distinct(), block)
    scored = pairs.withColumn("ratio", F.bround(_ratio(code, value), 2))
    w = Window.partitionBy(block, code).orderBy(F.desc("ratio"), value)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def excerpts(df: DataFrame, entity: list[str], order: list[Column], text: str, max_items: int, max_chars: int, max_each: int, least_room: int = 200) -> DataFrame:
    """entity, place, excerpt: the prefix of each entity's different texts, in order, that fits a budget.

    A text counts with its first max_each characters, and once. Of the max_chars characters each gets what those before it
    leave; the one that crosses the budget is cut to what is left, if that is at least least_room. Blank texts are none."""
    once = df.where(F.length(F.trim(F.col(text))) > 0).withColumn("excerpt", F.substring(F.col(text), 1, max_each))
    by_text = Window.partitionBy(*entity, "excerpt").orderBy(*order)
    once = once.withColumn("_copy", F.row_number().over(by_text)).where("_copy = 1")
    in_order = Window.partitionBy(*entity).orderBy(*order)
    before = F.coalesce(F.sum(F.length("excerpt")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = once.withColumn("place", F.row_number().over(in_order)).withColumn("_left", F.lit(max_chars) - before)
    fits = (F.length("excerpt") <= F.col("_left")) | (F.col("_left") >= least_room)
    return placed.where((F.col("place") <= max_items) & fits).select(*entity, "place", F.substring("excerpt", F.lit(1), F.col("_left").cast("int")).alias("excerpt"))


def merged_snippets(hits: DataFrame, document: list[str], at: str, length: str, text: str, context: int, most_chars: int) -> DataFrame:
    """document, place, start, snippet, hits: the surroundings of hits (from 0), `context` characters to both sides, merged where
    they touch; in order of place, as long as they fit most_chars together."""
    spans = hits.withColumn("_a", F.greatest(F.col(at) - context, F.lit(0))).withColumn("_b", F.least(F.col(at) + F.col(length) + context, F.length(text)))
    in_order = Window.partitionBy(*document).orderBy("_a", "_b", at)
    reached = F.max("_b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(F.col("_a") > reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("_group", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*document, F.col("_group").alias("place")).agg(F.min("_a").alias("start"), F.max("_b").alias("_end"), F.count("*").alias("hits"), F.first(text).alias("_text"))
    upto = Window.partitionBy(*document).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fitted = merged.withColumn("_sum", F.sum(F.col("_end") - F.col("start")).over(upto)).where(F.col("_sum") <= most_chars)
    return fitted.select(*document, "place", "start", F.substring("_text", F.col("start") + 1, F.col("_end") - F.col("start")).alias("snippet"), "hits")


def corroborated(bindings: DataFrame, offers: DataFrame, key: list[str], level: str, vetoed: str, value: str, least: int, highest: int, step: float) -> DataFrame:
    """bindings with new_level and backed_by: a binding of level `least` or more, without a veto, whose value some independent
    offer of its key states, within a step, is of the highest level; the sources that say so are told even if it was before."""
    o = offers.where(F.col("offer").isNotNull()).select(*key, "source", "offer")
    able = bindings.where((F.col(level) >= least) & ~F.coalesce(F.col(vetoed), F.lit(False)) & F.col(value).isNotNull())
    near = F.abs(F.col("offer") - F.col(value)) <= step
    per = able.join(o, key).where(near).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("_names"))
    both = bindings.join(per, key, "left")
    raised = F.when(F.col("_names").isNotNull(), F.greatest(F.col(level), F.lit(highest))).otherwise(F.col(level))
    return both.select(*bindings.columns, raised.alias("new_level"), F.coalesce("_names", F.lit("")).alias("backed_by"))


def withheld(offers: DataFrame, key: list[str], field: str, value: str, never: list[str], requires: DataFrame, cycle: str) -> DataFrame:
    """offers with reason: never_offered (a field of the never-list), not_offered (no value), requires:<field> (the first field,
    by name, that requires (field, cycle or null for all, needs) asks for in the offer's cycle and that the key has no value
    for), else admitted."""
    stated = offers.where(F.col(value).isNotNull()).select(*key, F.col(field).alias("needs")).distinct().withColumn("_has", F.lit(True))
    asked = offers.select(*key, F.col(field), F.col(cycle)).distinct().join(F.broadcast(requires.withColumnRenamed("cycle", "_cycle")), field)
    asked = asked.where(F.col("_cycle").isNull() | (F.col("_cycle") == F.col(cycle)))
    unmet = asked.join(stated, [*key, "needs"], "left").where("_has IS NULL").groupBy(*key, field).agg(F.min("needs").alias("_needs"))
    both = offers.join(unmet, [*key, field], "left")
    reason = F.when(F.col(field).isin(never), "never_offered").when(F.col(value).isNull(), "not_offered").when(F.col("_needs").isNotNull(), F.concat(F.lit("requires:"), "_needs")).otherwise("admitted")
    return both.select(*offers.columns, reason.alias("reason"))


def feedback(candidates: DataFrame, decisions: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, kind, value, reason: labelled examples from what was proposed and decided, one row each. accepted (decided for that
    value), rejected (decided against, with the reason), superseded (another value of its key was accepted), open (no
    decision on its key), missed (accepted, but never a candidate)."""
    d = decisions.select(*key, F.col(value).alias("_v"), "accepted", "reason")
    won = d.where("accepted").select(*key, F.lit(True).alias("_won")).distinct()
    own = candidates.select(*key, value).distinct().join(d.withColumnRenamed("_v", value), [*key, value], "left").join(won, key, "left")
    kind = F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected").when(F.col("_won"), "superseded").otherwise("open")
    judged = own.select(*key, kind.alias("kind"), value, F.when(kind == "rejected", F.col("reason")).alias("reason"))
    missed = d.where("accepted").withColumnRenamed("_v", value).join(candidates.select(*key, value).distinct(), [*key, value], "left_anti")
    return judged.unionByName(missed.select(*key, F.lit("missed").alias("kind"), value, F.lit(None).cast("string").alias("reason")))


def dead_routes(attempts: DataFrame, scope: list[str], at: str, found: Column, now: Column, max_days: int) -> DataFrame:
    """scope, attempts, newest: routes that need not be tried again: none of their attempts found anything, and the newest is at
    most max_days old."""
    per = attempts.groupBy(*scope).agg(F.count("*").alias("attempts"), F.max(at).alias("newest"), F.max(F.coalesce(found, F.lit(False))).alias("_any"))
    return per.where(~F.col("_any") & (F.date_diff(now, F.to_date("newest")) <= max_days)).drop("_any")


def expected_states(expected: DataFrame, evidence: DataFrame, key: list[str], value: str, in_scope: Column, in_market: Column, weak: Column, not_applicable: str) -> DataFrame:
    """The state of every expected key (with a flag that it does not apply), whether it has evidence or not; the first of:
    not_applicable, missing (no evidence), unresolved (evidence without a value), weak_provenance, conflicting,
    variant_not_exact, foreign_market_only, ok."""
    has = F.col(value).isNotNull()
    served = in_scope & in_market & has
    per = evidence.groupBy(*key).agg(F.count("*").alias("_all"), F.count(value).alias("n"), F.count_if(has & ~weak).alias("_solid"), F.countDistinct(F.when(served, F.col(value))).alias("_values"), F.count_if(in_market & has).alias("_here"), F.count_if(served).alias("_served"))
    both = expected.join(per, key, "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    rules = {
        "not_applicable": F.col(not_applicable),
        "missing": none("_all"),
        "unresolved": none("n"),
        "weak_provenance": none("_solid"),
        "conflicting": F.col("_values") > 1,
        "variant_not_exact": none("_served") & (F.col("_here") > 0),
        "foreign_market_only": none("_served"),
        "ok": F.lit(True),
    }
    return both.select(*key, F.coalesce("n", F.lit(0)).alias("n"), first_reason(rules).alias("state"))


@F.pandas_udf(StringType())
def logical_order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lines of right-to-left text that were stored in the order seen, turned back: the line is reversed, runs of digits
    and Latin letters inside it are not."""
    import re

    # fixed values: brackets and their mirror images
    mirror = str.maketrans("()[]{}<>", ")(][}{><")
    run = re.compile(r"[0-9A-Za-z][0-9A-Za-z.,:/%+-]*[0-9A-Za-z]|[0-9A-Za-z]")

    def turned(line: str) -> str:
        back = line[::-1].translate(mirror)
        return run.sub(lambda m: m[0][::-1], back)

    for batch in batches:
        yield batch.map(turned, na_action="ignore")
