"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A mask selects some of the words under it and ignores the others; a seed is the hash of the selected words. Test items and
documents are joined on equal seeds of equal masks, so a passage with some words replaced still hits wherever the
replaced words fall on ignored positions. Short items have seeds of denser, shorter masks: with them no placement of up to
20 % replaced words leaves an item of any length without a seed, nor one of a run that is long enough. Each hit gives a
diagonal, the offset of the item in the document. On it the words around the hit are compared one by one.

Scale: one pass over the texts, in which seeds meet the items' seeds by a broadcast whose size is checked (a shuffled join
beyond that). Only hits go on, one row for each document, item and diagonal; they meet the texts again in a second pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm.common import sent_if_small, stage_table, table

#: Words compared: runs of letters and digits, in lower case.
TOKEN = r"[\p{L}\p{N}]+"
#: 1: the word counts, 0: it is ignored. Weight 6 each.
MASKS = ("11101101", "110100111", "1011010011")
#: Also used for items of up to SHORT words, for which MASKS alone leave placements out. Weight 5 each.
SHORT_MASKS, SHORT = ("110111", "11111"), 25
#: Used alone for items of five to TINY words, of which one may be replaced; still shorter items have one solid mask.
TINY_MASKS, TINY = ("1111", "11011", "10111", "11101"), 7
#: The part of an item's words that must match where the item lies, or else the run of matching words that is enough.
RATIO, RUN = 0.8, 13


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _seeds(hashes: str, masks: tuple[str, ...], known: tuple[str, ...]) -> list[Column]:
    """For each mask the seeds at positions 0, 1, ... of the array column `hashes`; a mask's number is its place in `known`."""

    def of(mask: str) -> Column:
        k = known.index(mask)
        chosen = [j for j, bit in enumerate(mask) if bit == "1"]
        seeds = F.transform(F.sequence(F.lit(0), F.size(hashes) - len(mask)), lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(hashes), i + j) for j in chosen]))
        return F.when(F.size(hashes) >= len(mask), seeds).otherwise(F.array().cast("array<long>"))

    return [of(mask) for mask in masks]


def _seed_rows(words: DataFrame, masks: tuple[str, ...], known: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, seed, place for every seed of the array column `words`."""
    hashed = words.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    arrays = hashed.select(*keys, *[s.alias(f"s{k}") for k, s in enumerate(_seeds("hashes", masks, known))])
    sizes = [F.size(f"s{k}") for k in range(len(masks))]
    rows = arrays.select(*keys, *[n.alias(f"n{k}") for k, n in enumerate(sizes)], F.posexplode(F.concat(*[f"s{k}" for k in range(len(masks))])).alias("at", "seed"))
    place, before = F.lit(None), F.lit(0)
    for k in range(len(masks)):
        here = F.col("at") - before
        place = here if k == 0 else F.when(F.col("at") >= before, here).otherwise(place)
        before = before + F.col(f"n{k}")
    return rows.select(*keys, "seed", place.alias("place"))


def masks_for(words: int) -> tuple[str, ...]:
    """The masks of an item of that many words. One of up to four words must stand in the text unchanged."""
    if words < 5:
        return ("1" * words,)
    if words <= TINY:
        return TINY_MASKS
    return MASKS + (SHORT_MASKS if words <= SHORT else ())


def leaks(docs: DataFrame, items: DataFrame, ratio: float = RATIO, run: int = RUN) -> DataFrame:
    """One row for each document and test item that the document holds: doc_id, text_key, item_id, matched, overlap, ratio, run, doc_start.

    A pair is a leak if on one of its diagonals at least `ratio` of the item's words match, or if the best stretch (each match
    adds 1, each other word takes 4 off) has at least `run` matching words. Of several diagonals the one with most
    matches counts, then the first. text_key, a hash of the text, tells rows with one doc_id apart.
    Defined cases: null texts have no words; items without words never match; an item of one to four words matches where
    they all stand in a row; repeated rows give one row; rows with a null doc_id are searched like others, as are items with
    a null item_id; items with one item_id are one item each. Other columns are ignored; without items or documents there
    are no rows."""
    bench = items.select(F.col("item_id").cast("long"), _tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    keyed_items = bench.withColumn("item", F.struct("item_id", "words")).withColumn("n", F.size("words"))
    # one group of items for each set of masks; only masks of lengths that occur are looked for in the texts
    lengths = sorted(r["n"] for r in keyed_items.select(F.least("n", F.lit(SHORT + 1)).alias("n")).distinct().collect())
    groups: dict[tuple[str, ...], list[int]] = {}
    for n in lengths:
        groups.setdefault(masks_for(n), []).append(n)
    masks = tuple(sorted({m for group in groups for m in group}, key=lambda m: (len(m), m))) or MASKS
    parts = [_seed_rows(keyed_items.where(F.least("n", F.lit(SHORT + 1)).isin(of)), group, masks, "item") for group, of in groups.items()] or [_seed_rows(keyed_items, masks, masks, "item")]
    seeds = reduce(DataFrame.unionByName, parts)
    seeds = stage_table(seeds.select("item.item_id", F.xxhash64("item.words").alias("item_key"), "seed", F.col("place").alias("item_place")).distinct(), "item-seeds")

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).where("text IS NOT NULL")
    found = _seed_rows(keyed.select("doc_id", "text_key", _tokens(F.col("text")).alias("words")), masks, masks, "doc_id", "text_key").join(sent_if_small(seeds), "seed")
    hits = stage_table(found.select("doc_id", "text_key", "item_id", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct(), "hits")

    bench = bench.withColumn("item_key", F.xxhash64("words")).withColumnRenamed("words", "item_words").withColumnRenamed("item_id", "of_item").withColumnRenamed("item_key", "of_key")
    places = hits.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hits"))
    places = sent_if_small(stage_table(places, "hit-texts")).select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"))
    texts = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")))
    texts = stage_table(texts.select("hit_doc", "hit_key", _tokens(F.col("text")).alias("words")).dropDuplicates(["hit_doc", "hit_key"]), "hit-words")
    both = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key"))).join(bench, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_key") == F.col("of_key")))

    at = F.col("diagonal")
    same = F.transform("item_words", lambda w, j: (at + j >= 0) & (at + j < F.size("words")) & F.coalesce(F.get(F.col("words"), at + j) == w, F.lit(False)))
    zero = F.lit(0)
    start = F.struct(zero.alias("now"), zero.alias("now_hits"), zero.alias("best"), zero.alias("best_hits"))

    def step(s: Column, match: Column) -> Column:
        fresh = s["now"] <= 0
        now = F.when(fresh, 0).otherwise(s["now"]) + F.when(match, 1).otherwise(-4)
        got = F.when(fresh, 0).otherwise(s["now_hits"]) + F.when(match, 1).otherwise(0)
        better = now > s["best"]
        return F.struct(now.alias("now"), got.alias("now_hits"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, got).otherwise(s["best_hits"]).alias("best_hits"))

    judged = both.withColumn("same", same).select(
        "doc_id",
        "text_key",
        "item_id",
        "diagonal",
        F.size(F.filter("same", lambda x: x)).cast("long").alias("matched"),
        F.size("item_words").cast("long").alias("overlap"),
        F.aggregate("same", start, step)["best_hits"].cast("long").alias("run"),
    )
    judged = judged.withColumn("ratio", F.col("matched") / F.col("overlap")).where((F.col("ratio") >= ratio) | (F.col("run") >= run))
    best = judged.groupBy("doc_id", "text_key", "item_id").agg(F.max_by(F.struct("matched", "overlap", "ratio", "run", "diagonal"), F.struct("matched", -F.col("diagonal"))).alias("b"))
    return best.select("doc_id", "text_key", "item_id", "b.matched", "b.overlap", "b.ratio", "b.run", F.greatest(F.col("b.diagonal"), F.lit(0)).cast("long").alias("doc_start"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item (rows with a null text stay)."""
    bad = stage_table(leaks(docs, items).select(F.col("doc_id").alias("leak_doc"), F.col("text_key").alias("leak_key")).distinct(), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    clean = rows.join(sent_if_small(bad), F.col("doc_id").eqNullSafe(F.col("leak_doc")) & (F.col("text_key") == F.col("leak_key")), "left_anti")
    return clean.select("row.*")


def op2_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
