"""Substring deduplication by seed and extend.

Each document is winnowed into anchors: of every `window - SEED + 1` consecutive SEED-word grams the one with the smallest
hash (rightmost of equals). The rule sees nothing but the words, so two documents that share `window` consecutive words
share the anchor inside them at the same offset.

Documents are joined on the anchors that several hold, each with the first holder of an anchor, and in every such pair the
matches are extended both ways from the anchors, word by word (by 64-bit hashes of words, under a seed drawn for each run). Maximal repeats of at least `window` words are kept. One
partner an anchor is enough where a passage stands in the same surroundings. A window around an anchor that the first holder
does not have may still stand in another earlier document; pairing all holders of an anchor would grow with the square of a
passage's copies, so such windows, and only they, are compared by two independent hashes (128 bits, under a seed drawn for
each run): neither of two equal ones matches the first holder, so both are among them.

Scale: an anchor is shuffled for about every 22 words. Anchors in one document only, and copies of a whole text, end there.
Texts are read again only for documents that hold a shared anchor. A first holder that many documents have is repeated, so
that its pairs are dealt out; counting is pre-aggregated in the map tasks, so a passage that a third of all documents hold
costs a row for each task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import text_np as N
from quillforge.llm.common import join_keys, sent_if_small, stage_table, table, tuned

SEED = 8
#: Pairs that one copy of a first holder's text serves.
PAIRS = 2_048
#: In a pair, the most diagonals that are extended one by one; texts that repeat themselves more are compared by windows.
DIAGONALS = 64
_OTHER = np.uint64(0x94D049BB133111EB)
_SLICE = 1 << 20
_STRETCH = 1 << 20
U64 = np.uint64
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _chosen(hashes: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """The different anchors of each document; the words go in stretches that overlap by a window."""
    found: list[list[np.ndarray]] = [[] for _ in at[1:]]
    for first in range(0, len(hashes), _STRETCH):
        part = hashes[first : first + _STRETCH + window - 1]
        inside = np.clip(at - first, 0, len(part))
        grams, _ = N.gram_hashes(part, inside, SEED)
        best = N.sliding_argmin(grams, window - SEED + 1)
        for i in range(int(np.searchsorted(at, first, "right")) - 1, len(at) - 1):
            lo, hi = max(at[i] - first, 0), min(at[i + 1] - first, len(part))
            if lo >= min(_STRETCH, len(part)):
                break
            if hi - lo >= window:
                found[i].append(grams[np.unique(best[lo : hi - window + 1])])
    return [np.unique(np.concatenate([np.zeros(0, U64), *f])).view(np.int64) for f in found]


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, anchors = [], []
            shas = [N.word_sha256(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            for (hashes,), at in N.hashed(batch.column("text"), seed=seed):
                n_words += np.diff(at).tolist()
                anchors += _chosen(hashes, at, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("copy_key"), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "key", "copy_key", "n_words", "kept_sha256", "anchors"],
            )

    return run


def _spans(inside: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _extended(a: np.ndarray, b: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]], window: int) -> np.ndarray:
    """Which words of a lie in a run of at least `window` words that b has too; a and b are 64-bit hashes of words under a drawn
    seed, seeds the places of each shared anchor in both. Matches grow along the diagonals that the seeds lie on."""
    covered = np.zeros(len(a), bool)
    if sum(len(p) * len(q) for p, q in seeds) <= DIAGONALS * DIAGONALS:
        diagonals = np.unique(np.concatenate([(q[None, :] - p[:, None]).reshape(-1) for p, q in seeds])) if seeds else ()
        if len(diagonals) <= DIAGONALS:
            for d in diagonals:
                low, high = max(0, -d), min(len(a), len(b) - d)
                for start, end in _spans(a[low:high] == b[low + d : high + d]):
                    if end - start >= window:
                        covered[low + start : low + end] = True
            return covered
    if len(a) < window or len(b) < window:
        return covered
    whole = [N.gram_hashes(x, np.array([0, len(x)]), window)[0][: len(x) - window + 1] for x in (a, b)]
    order = np.argsort(whole[1], kind="stable")
    near = np.minimum(np.searchsorted(whole[1][order], whole[0]), len(order) - 1)
    mine = np.flatnonzero(whole[1][order[near]] == whole[0])
    depth = np.zeros(len(a) + 1, np.int64)
    for first in range(0, len(mine), 1 << 14):  # windows of equal hash are compared word by word
        i, j = mine[first : first + (1 << 14)], order[near[mine[first : first + (1 << 14)]]]
        reach = np.arange(window)
        i = i[(a[i[:, None] + reach] == b[j[:, None] + reach]).all(axis=1)]
        np.add.at(depth, i, 1)
        np.add.at(depth, i + window, -1)
    return np.cumsum(depth[:-1]) > 0


def _extend(window: int, seed: int, bits: int):
    """For each pair the spans that its matches cover, and the windows around its anchors that they don't: for each different one
    two independent hashes and all its starts."""

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        size = np.cumsum(pc.add(pc.binary_length(batch.column("text")), pc.binary_length(batch.column("held"))).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(size):
            end = int(np.searchsorted(size, (size[first - 1] if first else 0) + _SLICE, "right"))
            yield first, max(end, first + 1)
            first = max(end, first + 1)

    def seeds_of(column: pa.Array) -> tuple:
        blocks = list(N.hashed(column, seed=seed))
        hashes = np.concatenate([h for (h,), _ in blocks])
        lengths = np.concatenate([np.diff(at) for _, at in blocks])
        at = np.concatenate([[0], np.cumsum(lengths)])
        return at, hashes, N.gram_hashes(hashes, at, SEED)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, end in slices(whole):
                batch = whole.slice(first, end - first)
                at, hashes, grams = seeds_of(batch.column("text"))
                other_at, other, other_grams = seeds_of(batch.column("held"))
                wide = N.gram_hashes(hashes, at, window)[0] & np.uint64((1 << bits) - 1)
                check = N.gram_hashes(N.splitmix(hashes ^ _OTHER), at, window)[0]
                best = N.sliding_argmin(grams, window - SEED + 1)
                later = batch.column("later").to_pylist()
                spans, out_hash, out_check, out_pos, n_hashes, n_starts = [], [], [], [], [], []
                for i, hits in enumerate(batch.column("hits")):
                    anchors = np.sort(hits.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    lo, hi = at[i], max(at[i], at[i + 1] - window + 1)
                    chosen = np.isin(grams[best[lo:hi]], anchors)
                    mine = np.unique(best[lo:hi][chosen])
                    theirs = other_at[i] + np.flatnonzero(np.isin(other_grams[other_at[i] : max(other_at[i], other_at[i + 1] - SEED + 1)], anchors))
                    pairs = [(mine[grams[mine] == x] - lo, theirs[other_grams[theirs] == x] - other_at[i]) for x in anchors]
                    covered = _extended(hashes[lo : at[i + 1]], other[other_at[i] : other_at[i + 1]], [p for p in pairs if len(p[0]) and len(p[1])], window)
                    # a row with the holder's own doc_id is not later than it: it only shows which windows the holder lacks
                    spans.append([{"start": s, "end": e} for s, e in _spans(covered)] if later[i] else [])
                    # windows that the first holder does not have
                    inside = np.concatenate([[0], np.cumsum(covered)])
                    take = np.flatnonzero(chosen)
                    take = take[inside[take + window] - inside[take] < window]
                    h, c = wide[lo + take], check[lo + take]
                    order = np.lexsort((take, c, h))
                    take, h, c = take[order], h[order], c[order]
                    fresh = np.ones(len(take), bool)
                    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                    out_hash.append(h[fresh].view(np.int64))
                    out_check.append(c[fresh].view(np.int64))
                    out_pos.append(take.astype(np.int64))
                    n_hashes.append(int(fresh.sum()))
                    n_starts.append(np.diff(np.append(np.flatnonzero(fresh), len(take))))
                joined = lambda values: np.concatenate([np.zeros(0, np.int64), *values])
                ends_of = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                places = pa.ListArray.from_arrays(ends_of(joined(n_starts)), pa.array(joined(out_pos)))
                lists = [pa.ListArray.from_arrays(ends_of(n_hashes), v) for v in (pa.array(joined(out_hash)), pa.array(joined(out_check)), places)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, _SPAN), *lists], names=["doc_id", "key", "spans", "hashes", "checks", "places"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document without the words of its repeats."""
    for batch in batches:
        removed, shas, repeats = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
            words = text.encode().split()
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, spans.values.field("start").to_numpy(zero_copy_only=False), 1)
            np.add.at(depth, spans.values.field("end").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(depth[:-1]) > 0
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            repeats.append([{"start": s, "end": e} for s, e in _spans(gone)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(repeats, _SPAN)], names=["doc_id", "key", "n_removed", "sha", "repeats"])


def remove_repeats(docs: DataFrame, window: int = 50, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (word spans, end exclusive) for every row of docs.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id, judged on the
    input. Defined cases: a null text has no words; a text shorter than the window keeps all; rows with one doc_id never
    count as earlier than each other, so repeated rows give equal rows; a row with a null doc_id is neither earlier nor
    later than any and keeps all. Other columns are ignored. An empty table gives an empty result. `bits` of the first hash
    are used: fewer only make collisions, which the second hash then tells apart (a test does so)."""
    if window <= SEED:
        raise ValueError(f"window must be over {SEED} words")
    tuned(docs.sparkSession)
    seed = int.from_bytes(os.urandom(8), "little")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    base = docs.withColumn("copy_key", F.md5("text")).mapInArrow(_anchors(window, seed), "doc_id long, key long, copy_key string, n_words long, kept_sha256 string, anchors array<long>")
    base = stage_table(base, "anchors")
    first_copy = base.groupBy("copy_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_copies"))
    base = join_keys(base, first_copy, "copy_key", "n_copies", base.count()).drop("n_copies").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)))

    seeds = base.where("doc_id IS NOT NULL AND NOT is_copy").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    place = F.struct("doc_id", "key")
    shared = seeds.groupBy("anchor").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    shared = shared.select("anchor", F.col("first.doc_id").alias("holder"), F.col("first.key").alias("holder_key"))
    # other rows of the holder's doc_id meet it too: later documents may have windows from them that it lacks
    hits = seeds.join(shared, "anchor").where("doc_id > holder OR key <> holder_key").groupBy("doc_id", "key", "holder", "holder_key").agg(F.collect_set("anchor").alias("hits"))
    hits = stage_table(hits, "hits")

    texts = docs.where("doc_id IS NOT NULL")
    repeated_rows = stage_table(base.where("doc_id IS NOT NULL AND NOT is_copy").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated-rows")
    if not repeated_rows.isEmpty():  # equal rows are read once from here on
        several = sent_if_small(repeated_rows)
        texts = texts.join(several, ["doc_id", "key"], "left_anti").unionByName(texts.join(several, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]))

    def texts_of(ids: DataFrame) -> DataFrame:
        """doc_id, key and text, once for each (doc_id, key) in ids."""
        return texts.join(sent_if_small(stage_table(ids.distinct(), "ids")), ["doc_id", "key"], "left_semi")

    holder = ["holder", "holder_key"]
    holders = stage_table(hits.groupBy(*holder).agg(F.count("*").alias("n_pairs")).withColumn("holder_id", F.xxhash64(*holder)), "holders")
    ids = [F.col("holder").alias("doc_id"), F.col("holder_key").alias("key")]
    copies = holders.select(*ids, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_pairs") - 1) / PAIRS))).alias("copy"))
    held = texts_of(holders.select(*ids)).withColumnRenamed("text", "held").join(copies, ["doc_id", "key"]).toDF(*holder, "held", "copy")
    pairs = join_keys(hits.withColumn("holder_id", F.xxhash64(*holder)), holders.groupBy("holder_id").agg(F.max("n_pairs").alias("n_pairs")), "holder_id", "n_pairs", hits.count())
    pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("doc_id", "key"), F.floor((F.col("n_pairs") - 1) / PAIRS) + 1)).drop("n_pairs", "holder_id")
    pairs = texts_of(hits.select("doc_id", "key")).join(pairs, ["doc_id", "key"]).join(held, [*holder, "copy"])
    schema = "doc_id long, key long, spans array<struct<start:long,end:long>>, hashes array<long>, checks array<long>, places array<array<long>>"
    extended = stage_table(pairs.select("doc_id", "key", "text", "held", "hits", (F.col("doc_id") > F.col("holder")).alias("later")).mapInArrow(_extend(window, seed, bits), schema), "extended")

    def matches(*lists: str) -> DataFrame:
        names = {"hashes": "hash", "checks": "check", "places": "places"}
        return extended.select("doc_id", "key", F.explode(F.arrays_zip(*lists)).alias("w")).select("doc_id", "key", *[F.col(f"w.{c}").alias(names[c]) for c in lists])

    per_hash = matches("hashes", "checks").groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("check").alias("check"), F.max("check").alias("other_check"))
    per_hash = stage_table(per_hash.where("first_doc < last_doc"), "repeated")
    # the complement as the key: the few repeated windows are dealt anew, so that a hot key on the other side can be split
    repeated = per_hash.where("check = other_check").select(F.bitwise_not("hash").alias("to_hash"), "first_doc")
    later = matches("hashes", "places").join(repeated, F.bitwise_not("hash") == F.col("to_hash")).where("doc_id > first_doc").select("doc_id", "key", "places")
    clashes = per_hash.where("check <> other_check").select("hash")
    if not clashes.isEmpty():  # different windows of one hash: both hashes together are the key
        both = matches("hashes", "checks", "places").join(sent_if_small(clashes), "hash")
        firsts = both.groupBy("hash", "check").agg(F.min("doc_id").alias("first_doc"))
        later = later.unionByName(both.join(firsts, ["hash", "check"]).where("doc_id > first_doc").select("doc_id", "key", "places"))
    later = later.select("doc_id", "key", F.transform("places", lambda p: F.struct(p.alias("start"), (p + window).alias("end"))).alias("spans"))
    found = extended.where(F.size("spans") > 0).select("doc_id", "key", "spans").unionByName(later)
    covered = stage_table(found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "covered")

    cut = texts_of(covered.select("doc_id", "key")).join(covered, ["doc_id", "key"]).select("doc_id", "key", "text", "spans").mapInArrow(_cut, "doc_id long, key long, n_removed long, sha string, repeats array<struct<start:long,end:long>>").dropDuplicates(["doc_id", "key"])

    whole_copy = F.col("is_copy") & (F.col("n_words") >= window)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return base.join(cut, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole_copy, nothing).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
        F.when(whole_copy, everything).otherwise(F.coalesce("repeats", F.array().cast("array<struct<start:long,end:long>>"))).alias("repeats"),
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("n_repeats", F.size("repeats").cast("long")).drop("repeats")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM s
), f AS (
  SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h
), c AS (
  SELECT DISTINCT doc_id, i FROM g JOIN f USING (h) WHERE doc_id > first_doc
), e AS (
  SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS is_new FROM c
), m AS (
  SELECT doc_id, i, sum(is_new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM m GROUP BY doc_id, run
), d AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a + 1) AS n_removed, count(*) AS n_repeats FROM r GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN a IS NULL THEN ws ELSE
    flatten(list_transform(range(0, len(a) + 1), lambda k: ws[CASE WHEN k = 0 THEN 1 ELSE b[k] + 1 END : CASE WHEN k = len(a) THEN len(ws) ELSE a[k + 1] - 1 END])) END, ' ')) AS kept_sha256,
  coalesce(n_repeats, 0)::BIGINT AS n_repeats
FROM w LEFT JOIN d USING (doc_id)
"""
