"""Joins with rules of their own: unique keys only, exact-then-pooled fallback, back-fill, ranges, relations of strings."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.numbers import percent
from quillforge.functions.text import relation
from quillforge.operators.aggregates import join_null_safe, vote_counts


def unique_keys(right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of right whose key (null equals null) occurs once. One aggregation, whatever the number of copies."""
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    return once.where("_n = 1").drop("_n")


def unique_key_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every row of left, with columns of right where its key occurs exactly once there; a duplicate key attaches nothing."""
    return join_null_safe(left, unique_keys(right, keys, columns), keys)


def unique_key_stats(left: DataFrame, right: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """One row: what unique_key_join would match, by rows and by weight; percentages are null on a zero denominator."""
    sizes = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("_v"))
    r = sizes.agg(F.sum("_n").alias("right_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    both = join_null_safe(left, sizes.where("_n = 1"), keys)
    got = both.agg(
        F.count("*").alias("left_rows"), F.count("_n").alias("matched"), F.count("_v").alias("with_values"), F.sum(F.when(F.col("_v").isNotNull(), F.col(weight)).otherwise(0)).alias("_w"), F.sum(weight).alias("_all")
    )
    one = got.crossJoin(F.broadcast(r))  # one row each
    return one.select(
        "left_rows", "right_rows", "duplicate_rows", "matched", percent(F.col("matched"), F.col("left_rows")).alias("matched_pct"), "with_values", percent(F.col("with_values"), F.col("left_rows")).alias("values_pct"), percent(F.col("_w"), F.col("_all")).alias("weighted_pct")
    )


def fallback_majority(targets: DataFrame, votes: DataFrame, exact: list[str], pool: list[str], value: str, least_n: int, least_share: float, pool_n: int, pool_share: float, least_sub: int) -> DataFrame:
    """targets with level (A, B or null), value and reason.

    Level A is the exact key, if it has any votes: it gives its majority when n and share are high enough. Only where
    the exact key has no entry the pool decides (level B): refusals in order are no_pool, pooled_n_below, subgroups_disagree
    (sub-groups of at least least_sub votes must have one majority) and below_threshold. Shares are compared exactly."""
    a = vote_counts(votes, exact, value).where("rank = 1").select(*exact, F.col(value).alias("a_value"), F.col("votes").alias("a_votes"), F.col("n").alias("a_n"))
    b = vote_counts(votes, pool, value).where("rank = 1").select(*pool, F.col(value).alias("b_value"), F.col("votes").alias("b_votes"), F.col("n").alias("b_n"))
    subs = a.where(F.col("a_n") >= least_sub).groupBy(*pool).agg(F.countDistinct("a_value").alias("b_majorities"))
    t = join_null_safe(join_null_safe(join_null_safe(targets, a, exact), b, pool), subs, pool)
    is_a = F.col("a_n").isNotNull()
    a_ok = (F.col("a_n") >= least_n) & (F.col("a_votes") / F.col("a_n") >= least_share)
    reason = (
        F.when(is_a & a_ok, None)
        .when(is_a, "below_threshold")
        .when(F.col("b_n").isNull(), "no_pool")
        .when(F.col("b_n") < pool_n, "pooled_n_below")
        .when(F.coalesce("b_majorities", F.lit(0)) != 1, "subgroups_disagree")
        .when(F.col("b_votes") / F.col("b_n") < pool_share, "below_threshold")
    )
    return t.select(*targets.columns, F.when(is_a, "A").when(F.col("b_n").isNotNull(), "B").alias("level"), F.when(reason.isNull(), F.when(is_a, F.col("a_value")).otherwise(F.col("b_value"))).alias("value"), reason.alias("reason"))


def backfill(df: DataFrame, code: str, group: list[str], placeholder: int = 0) -> DataFrame:
    """df with filled_code and status: a row without a code takes the only real code of its group.

    The placeholder is a code of nothing: {0} is placeholder, {0, X} gives X, {X, Y} is ambiguous, {} unknown."""
    real = F.when(F.col(code) != placeholder, F.col(code))
    per = df.groupBy(*group).agg(F.countDistinct(real).alias("_real"), F.max(real).alias("_code"), F.count(F.when(F.col(code) == placeholder, 1)).alias("_zero"))
    both = join_null_safe(df, per, group)
    keyed = F.col(code).isNotNull() & (F.col(code) != placeholder)
    status = F.when(keyed, "keyed").when(F.col("_real") == 1, "filled").when(F.col("_real") > 1, "ambiguous").when(F.col("_zero") > 0, "placeholder").otherwise("unknown")
    return both.select(*df.columns, F.when(keyed, F.col(code)).when(F.col("_real") == 1, F.col("_code")).alias("filled_code"), status.alias("fill_status"))


def select_by_name(targets: DataFrame, rows: DataFrame, key: list[str], name: str, target_name: str) -> DataFrame:
    """Rows of each target's key: those with its name; failing that all, if they share one name; else none (ambiguous)."""
    t = targets.select(*key, F.col(target_name).alias("_wanted"))
    both = t.join(rows, key)
    per = Window.partitionBy(*key, "_wanted")
    both = both.withColumn("_hit", F.col(name).eqNullSafe(F.col("_wanted"))).withColumn("_any", F.max("_hit").over(per)).withColumn("_one", (F.min(name).over(per) == F.max(name).over(per)) & (F.count(name).over(per) == F.count("*").over(per)))
    how = F.when(F.col("_any"), "by_name").when(F.col("_one"), "single_name").otherwise("ambiguous")
    return both.withColumn("selected_by", how).where("NOT _any OR _hit").withColumnRenamed("_wanted", target_name).drop("_hit", "_any", "_one")


def range_join(targets: DataFrame, notices: DataFrame, key: list[str], at: str, begin: str, end: str) -> DataFrame:
    """targets with status and matched notices: those of its key whose range holds `at`; one notice of the key without a range
    withholds them all (range_unresolved). The join is an equi-join on the key with the range as a residual."""
    open_keys = notices.groupBy(*key).agg(F.max(F.col(begin).isNull() | F.col(end).isNull()).alias("_open"))
    flagged = targets.join(open_keys, key, "left")
    n = notices.select(*key, begin, end, "notice_id")
    hit = flagged.join(n, key, "left").withColumn("_in", F.col(at).between(F.col(begin), F.col(end)))
    got = hit.groupBy(*targets.columns).agg(F.max("_open").alias("_open"), F.countDistinct(F.when(F.col("_in"), F.col("notice_id"))).alias("n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("_in"), F.col("notice_id")))), ",").alias("ids"))
    status = F.when(F.col("_open").isNull(), "no_notice").when(F.col("_open"), "range_unresolved").when(F.col("n") == 0, "not_affected").otherwise("affected")
    return got.select(*targets.columns, status.alias("status"), F.when(status == "affected", F.col("n")).otherwise(0).cast("long").alias("notices"), F.when(status == "affected", F.col("ids")).otherwise("").alias("notice_ids"))


def notices_by_any_key(targets: DataFrame, notices: DataFrame, keys: list[list[str]], target: str, at: str, begin: str, end: str, notice: str, newest: str) -> DataFrame:
    """targets with status, n_notices and notice_ids: the notices that share any one of the keys and whose range holds `at`.

    One equi-join a key, united: no disjunction in a join. A matched notice without a range withholds them all
    (range_unresolved); so does a target without `at`. Ids are listed once, the newest notice first, then by id. Targets that
    differ in their name alone meet the notices once, and so do notices that differ in nothing that is read of them."""
    asked = [at, *dict.fromkeys(c for key in keys for c in key)]
    known = targets.select(*asked).distinct()
    columns = [*asked, begin, end, notice, newest]
    parts = [known.join(notices.select(*key, begin, end, notice, newest).distinct(), key).select(*columns) for key in keys]
    matched = reduce(DataFrame.unionByName, parts)
    inside = F.col(at).between(F.col(begin), F.col(end))
    listed = F.sort_array(F.collect_set(F.when(inside, F.struct((-F.coalesce(newest, F.lit(0))).alias("o"), notice))))
    per = matched.groupBy(*asked).agg(F.max(F.col(begin).isNull() | F.col(end).isNull() | F.col(at).isNull()).alias("_open"), F.array_distinct(F.transform(listed, lambda x: x[notice])).alias("_ids"))
    status = F.when(F.col("_open").isNull(), "no_notice").when(F.col("_open"), "range_unresolved").when(F.size("_ids") == 0, "not_affected").otherwise("affected")
    both = join_null_safe(targets, per, asked).withColumn("status", status)
    affected = F.col("status") == "affected"
    return both.withColumn("n_notices", F.when(affected, F.size("_ids")).otherwise(0).cast("long")).withColumn("notice_ids", F.when(affected, F.array_join("_ids", ",")).otherwise("")).drop("_open", "_ids")


def value_or_reason(targets: DataFrame, rows: DataFrame, key: list[str], name: str, target_name: str, value: str, supplier: str) -> DataFrame:
    """targets with reason, value, range_low, range_high, n_values, single_supplier and withheld: a lookup by a key of several parts.

    Reasons in order: no_key (a part is null), not_found, ambiguous_name (the key's rows have several names and none is the
    target's). Rows of the target's name count alone where there are any. One value gives it, several give a range; a
    supplier is told only if there is one, else it is withheld as several_suppliers."""
    t = targets.withColumn("_no_key", reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key)))
    per_name = rows.groupBy(*key, F.col(name).alias("_name")).agg(F.collect_set(value).alias("_values"), F.collect_set(supplier).alias("_suppliers"))
    names = per_name.groupBy(*key).agg(F.count("*").alias("_names"), F.max(F.struct("_name", "_values", "_suppliers")).alias("_any"))
    own = per_name.select(*key, F.col("_name").alias(target_name), F.struct("_values", "_suppliers").alias("_own"))
    both = t.join(names, key, "left").join(own, [*key, target_name], "left")
    picked = F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_names") == 1, F.struct("_any._values", "_any._suppliers"))
    reason = F.when(F.col("_no_key"), "no_key").when(F.col("_names").isNull(), "not_found").when(picked.isNull(), "ambiguous_name")
    both = both.withColumn("reason", reason).withColumn("_p", F.when(reason.isNull(), picked))
    n = F.size("_p._values")
    return both.select(
        *targets.columns,
        "reason",
        F.when(n == 1, F.array_min("_p._values")).alias("value"),
        F.when(n > 1, F.array_min("_p._values")).alias("range_low"),
        F.when(n > 1, F.array_max("_p._values")).alias("range_high"),
        F.when(F.col("_p").isNotNull(), n).otherwise(0).cast("long").alias("n_values"),
        F.when(F.size("_p._suppliers") == 1, F.array_min("_p._suppliers")).alias("single_supplier"),
        F.when(F.size("_p._suppliers") > 1, "several_suppliers").alias("withheld"),
    )


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str, position: str, keep_unknown: bool = False, lists: tuple[str, ...] = ()) -> DataFrame:
    """rows in the order of the id list; unknown ids are dropped, or kept as rows without values and found = false.

    Where ids holds several lists, `lists` names their columns: one list stands after the other. The position alone would
    put the same place of all lists into one task."""
    out = ids.join(rows.withColumn("found", F.lit(True)), key, "left" if keep_unknown else "inner")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).orderBy(*lists, position)


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_before, n_after, change: full outer comparison of the row counts of two builds."""
    b = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    a = after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    both = b.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_before").join(a, reduce(lambda x, y: x & y, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys)), "full")
    n0, n1 = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], n0.alias("n_before"), n1.alias("n_after"), (n1 - n0).alias("change"))


def price_or_range(targets: DataFrame, rows: DataFrame, key: list[str], value: str, supplier: str) -> DataFrame:
    """targets with status and value: one price gives it, several a range and their number; a supplier only if single."""
    per = rows.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.countDistinct(supplier).alias("n_suppliers"), F.min(supplier).alias("_s"))
    both = targets.join(per, key, "left")
    status = F.when(F.col("n_values").isNull(), "not_found").when(F.col("n_values") == 1, "value").otherwise("range")
    return both.select(
        *targets.columns,
        status.alias("status"),
        F.when(status == "value", F.col("lo")).alias("value"),
        F.when(status == "range", F.col("lo")).alias("range_low"),
        F.when(status == "range", F.col("hi")).alias("range_high"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.when(F.col("n_suppliers") == 1, F.col("_s")).alias("single_supplier"),
    )


def strongest_relation(left: DataFrame, right: DataFrame, block: str, code: str, value: str, least: int = 4) -> DataFrame:
    """For each row of left the strongest relation (equal, prefix, contains; the last two in either direction and only between
    strings of at least `least` characters) of its code to a value of its block on the right, ties to the smallest value.

    Equi-joins on substrings, for codes and names: a string of L characters has L squared of them at most. Of the values that
    share a substring only the smallest travels, so no pair of strings is made that is not an answer."""
    codes = left.select(F.col(block).alias("_block"), F.col(code).alias("_code")).where(F.col(code).isNotNull()).distinct()
    values = right.select(F.col(block).alias("_block"), F.col(value).alias("_value")).where(F.col(value).isNotNull()).distinct()

    def parts(df: DataFrame, text: str) -> DataFrame:
        """_block, text and each different substring with whether it stands at the beginning."""
        starts = df.where(F.length(text) >= least).select("*", F.explode(F.sequence(F.lit(1), F.length(text) - least + 1)).alias("_at"))
        each = starts.select("*", F.explode(F.sequence(F.lit(least), F.length(text) - F.col("_at") + 1)).alias("_n"))
        return each.select("_block", text, F.substring(F.col(text), F.col("_at"), F.col("_n")).alias("_part"), (F.col("_at") == 1).alias("_first"))

    same = codes.join(values.withColumnRenamed("_value", "_code"), ["_block", "_code"], "left_semi").select("_block", "_code", F.lit(3).alias("_s"), F.col("_code").alias("_related"))
    inside = parts(codes, "_code").join(values.withColumnRenamed("_value", "_part"), ["_block", "_part"], "left_semi").select("_block", "_code", F.when(F.col("_first"), 2).otherwise(1).alias("_s"), F.col("_part").alias("_related"))
    smallest = parts(values, "_value").groupBy("_block", "_part", "_first").agg(F.min("_value").alias("_related")).withColumnRenamed("_part", "_code")
    around = codes.join(smallest, ["_block", "_code"]).select("_block", "_code", F.when(F.col("_first"), 2).otherwise(1).alias("_s"), "_related")
    best = same.unionByName(inside).unionByName(around).groupBy("_block", "_code").agg(F.min(F.struct((-F.col("_s")).alias("_s"), "_related")).alias("_b"))
    names = F.when(F.col("_b._s") == -3, "equal").when(F.col("_b._s") == -2, "prefix").when(F.col("_b._s") == -1, "contains").otherwise("none")
    both = left.join(best.withColumnsRenamed({"_block": block, "_code": code}), [block, code], "left")
    return both.withColumn("relation", names).withColumn("related", F.col("_b._related")).drop("_b")


def alias_window(targets: DataFrame, rows: DataFrame, aliases: DataFrame, target: str, row: str, make: str, year: str, reach: int) -> DataFrame:
    """target, candidates, first_<row>: rows that have any alias of the target's maker (aliases: make, alias) and a year at most
    `reach` away; targets without any are left out. Rows are counted by (alias, year) first, so a target meets a count for
    each alias and year of its window, not the rows."""
    counts = rows.where(F.col(year).isNotNull()).groupBy("alias", year).agg(F.countDistinct(row).alias("_n"), F.min(row).alias("_first"))
    asked = targets.join(aliases.distinct(), make).select(target, "alias", F.explode(F.sequence(F.col(year) - reach, F.col(year) + reach)).alias(year))
    return asked.join(counts, ["alias", year]).groupBy(target).agg(F.sum("_n").alias("candidates"), F.min("_first").alias(f"first_{row}"))


def pair_next(events: DataFrame, by: list[str], order: list[str], kind: str, call: str, result: str, columns: list[str]) -> DataFrame:
    """Each call with the columns (as result_*) of the row that follows it, if that is a result; else nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    nxt = {c: F.lead(c).over(w) for c in [kind, *columns]}
    out = events.withColumn("_kind", nxt[kind]).withColumns({f"result_{c}": nxt[c] for c in columns})
    out = out.where(F.col(kind) == call)
    return out.withColumns({f"result_{c}": F.when(F.col("_kind") == result, F.col(f"result_{c}")) for c in columns}).drop("_kind")


def _queues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, name, seq, is_call, own) in order of (run, name, seq) to (run, call_seq, result_seq). What is held is the open
    calls of one name of one run: a queue from which calls drop out by themselves once their own result has come."""
    key, calls = None, deque()
    for batch in batches:
        found = []
        for run, name, seq, is_call, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (run, name) != key:
                key, calls = (run, name), deque()
            if is_call:
                calls.append((seq, own))
                continue
            while calls and calls[0][1] is not None and calls[0][1] < seq:
                calls.popleft()
            if calls:
                found.append((run, calls.popleft()[0], seq))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(f).type) for c, f in zip(columns, (0, 2, 2), strict=True)], names=["run", "call_seq", "result_seq"])


def pair_calls(events: DataFrame, run: str, seq: str) -> DataFrame:
    """run, call_seq, name, result_seq of every call, from columns kind (call/result), call_id, name.

    A result goes to the newest call of its id that no result of that id took. Every other result goes to the oldest call of
    its name that is still open then: one whose own result comes later is open until then, and takes part; its own result
    replaces the other. A result that finds no open call drops out. Which call is the oldest open one depends on all results
    before, so rows of a (run, name) are read in order, by one task; it holds that name's open calls only."""
    e = events.where(F.col("kind").isin("call", "result"))
    by_id = Window.partitionBy(run, "call_id").orderBy(seq)
    named = F.col("call_id").isNotNull() & (F.col("call_id") != "")
    call = F.col("kind") == "call"
    before = F.lag(F.struct(F.col("kind"), F.col(seq).alias("at"))).over(by_id)
    after = F.lead(F.struct(F.col("kind"), F.col(seq).alias("at"))).over(by_id)
    taken = F.when(named & ~call & (before["kind"] == "call"), before["at"])
    own = F.when(named & call & (after["kind"] == "result"), after["at"])
    e = e.select(F.col(run).alias("_run"), "name", F.col(seq).alias("_seq"), call.alias("_is_call"), own.alias("_own"), taken.alias("_taken"))
    kinds = dict(e.dtypes)
    ordered = e.where("_taken IS NULL").drop("_taken").repartition("_run", "name").sortWithinPartitions("_run", "name", "_seq")
    by_name = ordered.mapInArrow(_queues, f"run {kinds['_run']}, call_seq {kinds['_seq']}, result_seq {kinds['_seq']}")
    own_results = e.where("_own IS NOT NULL").select(F.col("_run").alias("run"), F.col("_seq").alias("call_seq"), F.col("_own").alias("own_seq"))
    calls = events.where("kind = 'call'").select(F.col(run).alias("run"), F.col(seq).alias("call_seq"), "name")
    both = calls.join(own_results, ["run", "call_seq"], "left").join(by_name, ["run", "call_seq"], "left")
    return both.select(F.col("run").alias(run), "call_seq", "name", F.coalesce("own_seq", "result_seq").alias("result_seq"))


def split_one_way(names: DataFrame, text: str, known: DataFrame, name: str, by: list[str] | None = None, most: int = 5) -> DataFrame:
    """names with parts: the text's words as a sequence of known names (of the same `by`), each once, if the text splits in
    exactly one way and that has at least two parts. The whole text counts as a way if it is a known name itself.

    A part has at most `most` words; texts have any number. Parts meet the known names in one equi-join; a fold over the words
    then keeps at most two ways to reach each word, enough to tell one from several. Null texts have no parts."""
    by = by or []
    words = F.split(F.trim(F.col(text)), r"\s+")
    texts = names.select(*by, text).where(F.col(text).isNotNull()).distinct()
    ends = texts.select("*", words.alias("_words")).select("*", F.explode(F.sequence(F.lit(1), F.size("_words"))).alias("_end"))
    parts = ends.select("*", F.explode(F.sequence(F.lit(1), F.least("_end", F.lit(most)))).alias("_size")).withColumn("_part", F.array_join(F.slice("_words", F.col("_end") - F.col("_size") + 1, F.col("_size")), " "))
    found = parts.join(known.select(*by, F.col(name).alias("_part")).distinct(), [*by, "_part"]).groupBy(*by, text, "_end").agg(F.sort_array(F.collect_list(F.struct("_size", "_part"))).alias("_hits"))
    per_text = found.groupBy(*by, text).agg(F.map_from_entries(F.collect_list(F.struct("_end", "_hits"))).alias("_at"))

    def reached(ways: Column, end: Column) -> Column:
        steps = F.transform(F.element_at("_at", end), lambda h: F.transform(F.get(ways, end - h["_size"]), lambda way: F.array_append(way, h["_part"])))
        return F.coalesce(F.slice(F.flatten(steps), 1, 2), F.array().cast("array<array<string>>"))

    start = F.array(F.array(F.array().cast("array<string>")))
    folded = F.aggregate(F.sequence(F.lit(1), F.size(words)), start, lambda ways, end: F.concat(ways, F.array(reached(ways, end))))
    split = per_text.withColumn("_ways", F.element_at(folded, -1))
    only = F.get("_ways", F.lit(0))
    split = split.select(*by, text, F.when((F.size("_ways") == 1) & (F.size(only) >= 2), F.array_join(F.array_distinct(only), "|")).alias("parts"))
    return names.join(split, [*by, text], "left")
