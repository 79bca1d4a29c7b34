"""Language-model scores by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of all orders, each by the weight of its context's
frequency bucket: P_k(w|context) = l_k[b] c(context w) / c(context) + (1 - l_k[b]) P_k-1, down to the uniform distribution
over the vocabulary and one unknown word. b is the bucket (power of two) of c(context); an unseen context passes all to the
order below. The weights are learned by expectation-maximisation: the texts of a part of the training documents are deleted
from the counts, and the weights make those texts likeliest under the counts of the rest. Scores then use the counts of all
training documents.

1. Each task hashes its texts in chunks of bounded size, which are written. A chunk keeps its tokens as places in its list of
   words, and asks for the counts of its different n-grams: one sorted run of hashes with the chunk's own counts for each
   order and radix, compressed. However frequent an n-gram is, it is in a run once.
2. The runs of a radix meet, are added up, and each is answered with the counts of its n-grams in the run's own order.
3. Answers and tokens of a chunk meet: chunks of deleted texts give the statistics for the weights, all chunks their scores.

Words are told apart by 64-bit hashes under a seed drawn for each run (two of ten million words share one with probability
3e-6). Nothing is pruned or sampled; the number of radixes follows the amount of text, so that what meets in a task does not.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm import runs as R
from quillforge.llm import text_np as N
from quillforge.llm.common import stage_table, table, tuned

U64 = np.uint64
ORDER = 2
#: One of so many training texts is deleted from the counts that the weights are learned with.
DELETED_EVERY = 20
#: Tokens of a chunk: about 200 MB of temporary arrays.
CHUNK = 1_200_000
#: N-grams of one order that meet in a task, about.
MEETING = 1 << 20
ROUNDS, GAIN = 20, 1e-5
BUCKETS = 65
_END, _BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_TEST, _TRAIN, _DELETED = 0, 1, 2
_TOKENS, _ASKED, _ANSWER, _TOTALS = 0, 1, 2, 3

_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("level", pa.int32()), ("radix", pa.int32()), ("block", pa.binary())])
_DDL = "kind int, chunk long, deleted boolean, level int, radix int, block binary"


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA, strict=True)], schema=_SCHEMA)


def grams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that end at each token; before a text's first token stands the begin mark."""
    levels = [tokens]
    mark = _BEGIN
    for _ in range(order - 1):
        context = np.empty_like(tokens)
        context[1:] = levels[-1][:-1]
        context[starts] = mark
        levels.append(N.splitmix(context * U64(0x9E3779B97F4A7C15) + tokens))
        mark = N.splitmix(np.array([mark], U64))[0]
    return levels


def _packed(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<u8").tobytes(), *parts])


def _unpacked(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.frombuffer(data, "<u8", n, 8).astype(np.int64)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("block", pa.binary())])


def _chunks(seed: int):
    """Texts to chunks of tokens; texts that are deleted from the counts have chunks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: [] for d in (False, True)}  # doc_id, slot, role, hashes
        size = dict.fromkeys(held, 0)

        def chunk(deleted: bool) -> pa.RecordBatch:
            ids, slots, roles, hashes = zip(*held[deleted], strict=True)
            held[deleted], size[deleted] = [], 0
            lengths = np.array([len(h) + 1 for h in hashes])
            words, place, n = np.unique(np.concatenate([x for h in hashes for x in (h, [_END])]).astype(U64), return_inverse=True, return_counts=True)
            # frequent words first: most places are small numbers then
            order = np.lexsort((words, -n))
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            known = np.array([i is not None for i in ids])
            parts = [R.pack(words[order]), *[R.store(v.astype(U64)) for v in (rank[place], lengths, np.array([i or 0 for i in ids], np.int64).view(U64), known, np.array(roles))]]
            return pa.RecordBatch.from_arrays([pa.array([slots[0] * 2 + deleted]), pa.array([deleted]), pa.array([_packed(parts)], pa.binary())], schema=_CHUNK_SCHEMA)

        for batch in batches:
            ids, slots, roles = (batch.column(c).to_pylist() for c in ("doc_id", "slot", "role"))
            first = 0
            for (hashes,), at in N.hashed(batch.column("text"), seed=seed, lower=True):
                for i in range(len(at) - 1):
                    deleted = roles[first] == _DELETED
                    held[deleted].append((ids[first], slots[first], roles[first], hashes[at[i] : at[i + 1]].copy()))
                    size[deleted] += at[i + 1] - at[i] + 1
                    first += 1
                    if size[deleted] >= CHUNK:
                        yield chunk(deleted)
        for deleted in held:
            if held[deleted]:
                yield chunk(deleted)

    return run


class Tokens:
    """The tokens of a chunk: the places of their words among the chunk's words in order of hash."""

    def __init__(self, block: bytes):
        words, place, *others = _unpacked(block)
        (by_rank,) = R.unpack(words)
        order = np.argsort(by_rank)
        self.words = by_rank[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        self.place = at[R.load(place).view(np.int64)]
        lengths, ids, known, roles = map(R.load, others)
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids, self.known, self.roles = ids.view(np.int64), known.astype(bool), roles

    def grams(self, order: int) -> list[np.ndarray]:
        return grams(self.words[self.place], self.starts, order)


def _ask(order: int, radix_bits: int):
    """A run of different n-grams with the chunk's own counts for each chunk, level and radix that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, deleted, block in zip(*[batch.column(c) for c in ("chunk", "deleted", "block")], strict=True):
                tokens = Tokens(block.as_py())
                weight = np.repeat(tokens.roles != _TEST, tokens.lengths)
                for level, g in enumerate(tokens.grams(order), 1):
                    keys, place = np.unique(g, return_inverse=True)
                    n = np.bincount(place, weight, len(keys)).astype(U64)
                    bounds = np.searchsorted(keys >> U64(64 - radix_bits), np.arange((1 << radix_bits) + 1).astype(U64)) if radix_bits else np.array([0, len(keys)])
                    for r in np.flatnonzero(np.diff(bounds)).tolist():
                        i, j = bounds[r], bounds[r + 1]
                        yield _row(_ASKED, number.as_py(), deleted.as_py(), level, r, R.pack(keys[i:j], n[i:j]))

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts without and in the deleted texts for every run of a (level, radix), and the totals of single tokens."""
    for (level, radix), rows in R.in_groups(batches, ["level", "radix"]):
        asked = [(chunk, deleted, *R.unpack(block, 1)) for _, _, chunk, deleted, block in rows]
        keys = np.concatenate([a[2] for a in asked])
        sizes = [len(a[2]) for a in asked]
        order = np.argsort(keys, kind="stable")
        fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(fresh) - 1
        n = np.concatenate([a[3] for a in asked])
        in_deleted = np.repeat([a[1] for a in asked], sizes)
        kept, deleted = (np.bincount(place, n * mine).astype(U64) for mine in (~in_deleted, in_deleted))
        del keys, order, n
        if level == 1:
            totals = np.array([kept.sum(), deleted.sum(), (kept > 0).sum(), (kept + deleted > 0).sum()], U64)
            yield _row(_TOTALS, 0, False, level, radix, totals.tobytes())
        at = 0
        for (chunk, mine, *_), size in zip(asked, sizes, strict=True):
            here = place[at : at + size]
            yield _row(_ANSWER, chunk, mine, level, radix, _packed([R.store(kept[here]), R.store(deleted[here])]))
            at += size


class Chunk(Tokens):
    """The tokens of a chunk with the counts of their n-grams."""

    def __init__(self, rows: Iterator[tuple], order: int):
        answers: list[list[list[np.ndarray]]] = [[] for _ in range(order)]
        for _, kind, level, _, block in rows:
            if kind == _TOKENS:
                super().__init__(block)
            else:
                answers[level - 1].append([R.load(b) for b in _unpacked(block)])
        self.end = int(np.searchsorted(self.words, _END))
        self.answers = [[np.concatenate(c) for c in zip(*a, strict=True)] for a in answers]

    def counts(self, everything: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every token the counts of its n-grams, by order, and of the contexts of orders from 2; of all training texts, or of
        those that are not deleted."""
        totals = [a[0] + a[1] if everything else a[0] for a in self.answers]
        texts = totals[0][self.end]
        found = [totals[0][self.place]]
        contexts = []
        for level, g in enumerate(self.grams(len(totals)), 1):
            if level > 1:
                contexts.append(np.concatenate([[0], found[-1][:-1]]).astype(U64))
                contexts[-1][self.starts] = texts
                found.append(totals[level - 1][np.unique(g, return_inverse=True)[1]])
        return found, contexts


def buckets(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the power of two at or below the count."""
    return np.frexp(counts.astype(float))[1]


def _statistics(order: int):
    """Different (counts, context counts) of the tokens of deleted texts, with how many tokens have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in R.in_groups(batches, ["chunk"]):
            found, contexts = Chunk(rows, order).counts(False)
            columns = [*found, *contexts]
            at = np.lexsort(columns)
            columns = [c[at] for c in columns]
            fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(at)))
            arrays = [c[first].astype(np.int64) for c in columns] + [buckets(c[first]).astype(np.int32) for c in columns[order:]] + [n]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[*[f"c{k + 1}" for k in range(order)], *[f"x{k + 2}" for k in range(order - 1)], *[f"b{k + 2}" for k in range(order - 1)], "n"])

    return run


def learn(statistics: DataFrame, order: int, tokens: int, words: int) -> list[np.ndarray]:
    """Mixture weights by order and bucket: EM over the statistics, a pass over that table a round. A bucket that no deleted
    token is in has the weight of the one below it, one half if there is none."""
    weights = [np.full(BUCKETS, 0.5) for _ in range(order)]
    last = None
    uniform = 1 / (words + 1)
    for _ in range(ROUNDS):
        lower: Column = F.lit(uniform)
        ways = []
        for k in range(order):
            bucket = F.lit(0) if k == 0 else F.col(f"b{k + 1}")
            weight = F.lit(float(weights[0][0])) if k == 0 else F.element_at(F.array(*map(F.lit, weights[k].tolist())), bucket + 1)
            own = F.col("c1") / F.lit(float(max(tokens, 1))) if k == 0 else F.col(f"c{k + 1}") / F.col(f"x{k + 1}")
            seen = F.lit(tokens > 0) if k == 0 else F.col(f"x{k + 1}") > 0
            here = F.when(seen, weight * own).otherwise(0.0)
            total = here + F.when(seen, 1 - weight).otherwise(1.0) * lower
            ways.append((bucket, seen, here / total))
            lower = total
        share: Column = F.col("n").cast("double")
        parts = []
        for k in reversed(range(order)):
            bucket, seen, own = ways[k]
            parts.append(F.struct(F.lit(k).alias("k"), bucket.cast("int").alias("b"), F.when(seen, share * own).otherwise(0.0).alias("own"), F.when(seen, share).otherwise(0.0).alias("all")))
            share = F.when(seen, share * (1 - own)).otherwise(share)
        rows = statistics.select((F.log10(lower) * F.col("n")).alias("likelihood"), F.array(*parts).alias("parts"), "n").select("n", "likelihood", F.posexplode("parts").alias("i", "p"))
        found = rows.groupBy("p.k", "p.b").agg(F.sum("p.own").alias("own"), F.sum("p.all").alias("all"), F.sum("likelihood").alias("likelihood"), F.sum("n").alias("n")).collect()
        top = [r for r in found if r["k"] == order - 1]
        if not top:
            return weights
        likelihood = sum(r["likelihood"] for r in top) / sum(r["n"] for r in top)
        for k in range(order):
            mine = {r["b"]: r["own"] / r["all"] for r in found if r["k"] == k and r["all"] > 0}
            value = 0.5
            for b in range(BUCKETS):
                value = min(1 - 1e-6, mine.get(b, value))
                weights[k][b] = value
        if last is not None and likelihood - last < GAIN:
            return weights
        last = likelihood
    return weights


def _score(order: int, weights: list[np.ndarray], tokens: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in R.in_groups(batches, ["chunk"]):
            chunk = Chunk(rows, order)
            found, contexts = chunk.counts(True)
            one = found[0].astype(float)
            weight = weights[0][0] if tokens else 0.0
            p = weight * one / max(tokens, 1) + (1 - weight) / (words + 1)
            for k in range(1, order):
                seen = contexts[k - 1].astype(float)
                weight = np.where(seen > 0, weights[k][buckets(contexts[k - 1])], 0)
                p = weight * found[k] / np.maximum(seen, 1) + (1 - weight) * p
            sums = [np.add.reduceat(v, chunk.starts) for v in (one > 0, np.log10((one + 1) / (tokens + words + 1)), np.log10(p))]
            arrays = [pa.array(chunk.ids, pa.int64(), mask=~chunk.known), pa.array(chunk.roles == _TEST), pa.array(chunk.lengths), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(chunk.ids), tokens)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, deleted_every: int = DELETED_EVERY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; texts where held_out is true
    are scored, not learned from.

    Defined cases: a null text is an empty one, with its end as the only token; a null held_out is false; repeated rows and
    copies count as often as they stand there, and a null doc_id keeps its row. Without training documents the model is
    uniform over one unknown word. Other columns are ignored. An empty table gives an empty result."""
    spark = docs.sparkSession
    tuned(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.when(F.coalesce(held_out, F.lit(False)), _TEST).when(F.pmod(F.xxhash64(text), F.lit(deleted_every)) == 0, _DELETED).otherwise(_TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), role.alias("role"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    radix_bits = max(0, (size // 6 // MEETING).bit_length())
    seed = int.from_bytes(os.urandom(8), "little")
    chunks = stage_table(rows.withColumn("slot", F.monotonically_increasing_id()).mapInArrow(_chunks(seed), "chunk long, deleted boolean, block binary"), "tokens")
    asked = chunks.mapInArrow(_ask(order, radix_bits), _DDL).select("level", "radix", "chunk", "deleted", "block")
    meeting = asked.repartition("level", "radix").sortWithinPartitions("level", "radix")
    answers = stage_table(meeting.mapInArrow(_answer, _DDL), "ngram-counts")
    totals = answers.where(F.col("kind") == _TOTALS).select("block")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([np.frombuffer(b.as_py(), np.int64) for b in batch.column("block")]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(values[:, i]) for i in range(4)], names=["a", "b", "c", "d"])

    added = totals.mapInArrow(spread, "a long, b long, c long, d long").agg(*[F.sum(c) for c in "abcd"]).first()
    sums = [int(v or 0) for v in added]
    kept, everything, kept_words, words = sums[0], sums[0] + sums[1], sums[2], sums[3]

    def whole(which: Column) -> DataFrame:
        """Tokens and answers of the chunks that are asked for, in order."""
        tokens = chunks.select(F.lit(_TOKENS).alias("kind"), "chunk", "deleted", F.lit(0).alias("level"), F.lit(0).alias("radix"), "block")
        parts = tokens.unionByName(answers.where(F.col("kind") == _ANSWER)).where(which)
        return parts.select("chunk", "kind", "level", "radix", "block").repartition("chunk").sortWithinPartitions("chunk", "kind", "level", "radix")

    columns = [*[f"c{k + 1} long" for k in range(order)], *[f"x{k + 2} long" for k in range(order - 1)], *[f"b{k + 2} int" for k in range(order - 1)], "n long"]
    statistics = stage_table(whole(F.col("deleted")).mapInArrow(_statistics(order), ", ".join(columns)), "statistics")
    weights = learn(statistics, order, kept, kept_words)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole(F.lit(True)).mapInArrow(_score(order, weights, everything, words), schema)


def op11_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
