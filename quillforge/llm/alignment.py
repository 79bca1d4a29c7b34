"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents link each pair.

Byte offsets where tokens of both sides end cut a text into groups; all tokens of a group are linked. Counting is external:

1. Each task encodes its texts and buffers records (pair, document, occurrences). A full buffer is sorted and written as runs
   of zstd blocks, radix-partitioned by the A side. Beside them go the run's own pairs with their numbers of documents.
2. These pair runs are merged k-way by a heap of their blocks, first some tasks' runs, then all of a radix. The order is
   side-major: once the last pair of an A id is counted, the highest count of that id is known.
3. The counts of a radix meet the record runs of that radix once more, and each document's share streams back: links whose
   count is the highest, and the sum of counts. Shares of a document are then added up.

A pair that a third of all documents hold costs one record a run when it is counted; the record runs of a radix are dealt to
as many tasks as their number asks for, with the radix's counts in each. What a task holds is bounded by the buffer, by the
blocks that overlap in a merge, and by the different pairs of a radix, whose number the vocabularies bound.

Texts are cut where a single blank stands between visible characters. Neither tokenizer has a token across such a cut (this is
checked when the files are loaded; texts stay whole otherwise), so a worker encodes and aligns a word once and remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import runs as R
from quillforge.llm.common import stage_table, table, tuned

U64 = np.uint64
A_SIDE, B_SIDE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts that the ids of side A are dealt into.
RADIX = 16
#: Records that a task buffers before it writes runs: about 60 MB with the copies that sorting needs.
BUFFER = 1 << 20
#: Runs of as many tasks are merged first.
FAN_IN = 64
#: Blocks of record runs that one task takes with the counts of their radix.
SHARE = 512
#: Words that a worker remembers: about 60 MB.
REMEMBERED = 250_000
_DOC_BITS = 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORKER: dict[tuple, Aligner] = {}


def _visible_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the others in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """The bytes of every id, one after another, with their places."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_slices(self.start[ids], self.length[ids])]


def _slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all slices, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Words:
    """What is known of each word: counts, its groups as text, its linked pairs with occurrences."""

    def __init__(self, n_a, n_b, n_groups, n_links, good, n_pairs, pairs, times, text):
        self.columns = [np.asarray(c) for c in (n_a, n_b, n_groups, n_links, good, n_pairs, pairs, times)]
        self.text: list[bytes] = text

    n_a, n_b, n_groups, n_links, good, n_pairs, pairs, times = (property(lambda self, i=i: self.columns[i]) for i in range(8))

    def plus(self, other: Words) -> Words:
        return Words(*[np.concatenate(c) for c in zip(self.columns, other.columns, strict=True)], self.text + other.text)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = _visible_bytes()
        entries = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            entries[i] = bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.sides = Side(entries), Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        whole = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None and not any("▁" in p.lstrip("▁") for p in pieces)
        self.cut = _CUT.split if whole else lambda text: [text]
        self.b_bits = max(1, (self.sides[1].size - 1).bit_length())
        self.lanes = -(-self.sides[0].size // RADIX)
        if (RADIX * self.lanes - 1).bit_length() + self.b_bits + _DOC_BITS > 64:
            raise ValueError("the vocabularies are too large for 64-bit records")
        self.known: dict[str, int] = {}
        self.words = self.aligned([])

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Side-major: first the radix of the A id, then the A id, then the B id."""
        return ((((a % RADIX) * self.lanes + a // RADIX).astype(U64) << U64(self.b_bits)) | b.astype(U64)).astype(U64)

    def radix(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(self.b_bits)) // U64(self.lanes)

    def aligned(self, words: list[str]) -> Words:
        """Groups and links of each word with a blank before it, all words at once."""
        side_a, side_b = self.sides
        raw = [(" " + w).encode() for w in words]
        ids, counts = [], []
        for lists in ([e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)] if words else [], self.b.encode(words, num_threads=1) if words else []):
            counts.append(np.fromiter(map(len, lists), np.int64, len(words)))
            ids.append(np.fromiter((i for x in lists for i in x), np.int64, int(counts[-1].sum())))
        size = np.fromiter(map(len, raw), np.int64, len(words))
        good = np.ones(len(words), bool)
        for side, x, n in zip(self.sides, ids, counts, strict=True):
            mine = np.bincount(np.repeat(np.arange(len(words)), n), side.length[x], len(words)).astype(np.int64)
            good &= mine == size
        # bytes are compared where lengths agree
        text = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8)
        word_of_byte = np.repeat(np.flatnonzero(good), size[good])
        for side, x, n in zip(self.sides, ids, counts, strict=True):
            good[word_of_byte[side.bytes_of(x[np.repeat(good, n)]) != text]] = False
        ids = [x[np.repeat(good, n)] for x, n in zip(ids, counts, strict=True)]
        counts = [np.where(good, n, 0) for n in counts]
        owner = np.repeat(np.arange(len(words)), counts[0])
        # all good words are one stream of bytes; groups end where tokens of both sides end
        ends = [np.cumsum(s.length[x]) for s, x in zip(self.sides, ids, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        in_group = [np.searchsorted(shared, e) for e in ends]
        per = [np.bincount(g, minlength=len(shared)) for g in in_group]
        group_owner = owner[np.searchsorted(ends[0], shared)] if len(shared) else owner[:0]
        per_word = lambda at, weight=None: np.bincount(at, weight, len(words)).astype(np.int64)
        n_links = per_word(group_owner, per[0] * per[1])
        # pairs: of ids that occur several times in a group once, with the product of their numbers
        different = []
        for x, g, side in zip(ids, in_group, self.sides, strict=True):
            keys, times = R.summed(g * side.size + x, np.ones(len(x), np.int64))
            different.append((keys // side.size, keys % side.size, times))
        (ga, xa, ta), (gb, xb, tb) = different
        first_b = np.searchsorted(gb, np.arange(len(shared) + 1))
        n_b_of = np.diff(first_b)[ga] if len(ga) else ga
        left = np.repeat(np.arange(len(ga)), n_b_of)
        right = _slices(first_b[ga], n_b_of) if len(ga) else left
        pairs, times, at = self.keys(xa[left], xb[right]), ta[left] * tb[right], group_owner[ga[left]] if len(left) else left
        order = np.lexsort((pairs, at))
        pairs, times, at = pairs[order], times[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (at[1:] != at[:-1])])) if len(pairs) else left
        times = np.add.reduceat(times, first) if len(first) else times
        return Words(counts[0], counts[1], per_word(group_owner), n_links, good, per_word(at[first]), pairs[first], times, self._written(ids, in_group, per, group_owner, len(words)))

    @staticmethod
    def _written(ids, in_group, per, group_owner, n_words: int) -> list[bytes]:
        """The groups of each word as text: decimal ids, "," between ids of a side, "|" between sides, ";" between groups."""
        total = per[0] + per[1]
        start = np.cumsum(total) - total
        rank = [np.arange(len(g)) - (np.cumsum(n) - n)[g] for g, n in zip(in_group, per, strict=True)]
        place = [start[in_group[0]] + rank[0], start[in_group[1]] + per[0][in_group[1]] + rank[1]]
        value, mark = np.zeros(int(total.sum()), np.int64), np.full(int(total.sum()), ord(","), np.uint8)
        for p, x in zip(place, ids, strict=True):
            value[p] = x
        mark[start + per[0] - 1] = ord("|")
        mark[start + total - 1] = ord(";")
        digits = np.ones(len(value), np.int64)
        for k in range(1, 10):
            digits += value >= 10**k
        ends = np.cumsum(digits + 1)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = mark
        for k in range(int(digits.max()) if len(digits) else 0):
            has = digits > k
            out[ends[has] - 2 - k] = ord("0") + value[has] // 10**k % 10
        # a word's groups lie together; the last ";" is left out
        last = np.searchsorted(group_owner, np.arange(n_words), "right") - 1
        first = np.searchsorted(group_owner, np.arange(n_words), "left")
        data, closing = out.tobytes(), ends[start + total - 1] if len(total) else ends
        begin = np.concatenate([[0], closing]) if len(closing) else np.zeros(1, np.int64)
        return [data[begin[f] : closing[z] - 1] if z >= f else b"" for f, z in zip(first, last, strict=True)]

    def look_up(self, words: list[str]) -> tuple[np.ndarray, Words]:
        """The place of each word in a table; new words are remembered while there is room."""
        at = [self.known.get(w) for w in words]
        missing = list(dict.fromkeys([w for w, i in zip(words, at, strict=True) if i is None]))
        if not missing:
            return np.array(at, np.int64), self.words
        table = self.words.plus(self.aligned(missing))
        places = {w: len(self.words.text) + i for i, w in enumerate(missing)}
        at = [places[w] if i is None else i for w, i in zip(words, at, strict=True)]
        if len(table.text) <= REMEMBERED:
            self.words = table
            self.known.update(places)
        return np.array(at, np.int64), table


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of files and worker process."""
    if (a_path, b_path) not in _WORKER:
        _WORKER[a_path, b_path] = Aligner(a_path, b_path)
    return _WORKER[a_path, b_path]


_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("slot", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("first", pa.int64()), ("block", pa.binary())])
_DDL = "kind int, doc_id long, slot long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, first long, block binary"
_DOCUMENT, _RECORDS, _PAIRS = 0, 1, 2


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _encode(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        held: list[list[np.ndarray]] = []
        n_held, base, n_docs = 0, None, 0

        def spilled() -> Iterator[pa.RecordBatch]:
            """Runs of what is held: blocks of records, and of pairs with their numbers of documents, by radix."""
            codes, times = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(codes)
            codes, times = codes[order], times[order]
            keys = codes >> U64(_DOC_BITS)
            docs = codes & U64((1 << _DOC_BITS) - 1)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            pairs, n = keys[first], np.diff(np.append(first, len(keys)))
            for kind, columns in ((_RECORDS, (keys, docs, times)), (_PAIRS, (pairs, n))):
                radix = tool.radix(columns[0])
                bounds = np.searchsorted(radix, np.arange(RADIX + 1))
                for r in range(RADIX):
                    mine = [c[bounds[r] : bounds[r + 1]] for c in columns]
                    for i, j in R.cuts(len(mine[0])):
                        yield _rows(kind=[kind], slot=[base], radix=[r], first=[int(mine[0][i])], block=[R.pack(*[c[i:j] for c in mine])])

        for whole in batches:
            for batch in _by_bytes(whole):
                texts = batch.column("text").to_pylist()
                split = [tool.cut(t) for t in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                at, words = tool.look_up([w for s in split for w in s])
                starts = np.cumsum(sizes) - sizes
                good = np.logical_and.reduceat(words.good[at], starts) & np.array([bool(t) for t in texts])
                sums = [np.where(good, np.add.reduceat(c[at], starts), 0) for c in (words.n_a, words.n_b, words.n_groups, words.n_links)]
                shas = [hashlib.sha256(b";".join([words.text[k] for k in at[s : s + n].tolist()])).hexdigest() if g else "" for s, n, g in zip(starts.tolist(), sizes.tolist(), good.tolist(), strict=True)]
                slots = batch.column("slot").to_numpy()
                yield _rows(kind=np.full(len(texts), _DOCUMENT, np.int32), doc_id=batch.column("doc_id"), slot=slots, n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups_sha256=shas)
                if held and slots[-1] - base >= 1 << _DOC_BITS:
                    yield from spilled()
                    held, n_held = [], 0
                base = int(slots[0]) if not held else base
                # each word of a document once, then each pair of a document once
                doc = np.repeat(np.arange(len(texts)), sizes)
                use = good[doc]
                code, times = R.summed((doc[use] << 40) | at[use], np.ones(int(use.sum()), np.int64))
                word, doc = code & ((1 << 40) - 1), (code >> 40) + int(slots[0]) - base
                n_pairs = words.n_pairs[word]
                take = _slices((np.cumsum(words.n_pairs) - words.n_pairs)[word], n_pairs)
                code = (words.pairs[take] << U64(_DOC_BITS)) | np.repeat(doc, n_pairs).astype(U64)
                code, times = R.summed(code, words.times[take] * np.repeat(times, n_pairs))
                if len(code):
                    held.append([code, times])
                    n_held += len(code)
                if n_held >= BUFFER:
                    yield from spilled()
                    held, n_held = [], 0
        if held:
            yield from spilled()

    return run


def _by_bytes(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text; one text is never cut here."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")], np.int64)
    total = np.cumsum(sizes)
    first = 0
    while first < len(batch):
        end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, "right")))
        yield batch.slice(first, end - first)
        first = end


_MERGED = "radix int, part int, first long, block binary"


def _merged_rows(radix: int, part: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, j in R.cuts(len(keys)):
        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([part], pa.int32()), pa.array([int(keys[i])], pa.int64()), pa.array([R.pack(keys[i:j], n[i:j])], pa.binary())], names=["radix", "part", "first", "block"])


def _merge_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of all runs of a (radix, part)."""
    for (radix, part), rows in R.in_groups(batches, ["radix", "part"]):
        for keys, n in R.merged(R.unpack(row[-1], 1) for row in rows):
            yield from _merged_rows(radix, part, keys, n)


def _merge_all(b_bits: int):
    """Counts of all pairs of a radix, twice the count and one more where it is its A id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), rows in R.in_groups(batches, ["radix"]):
            kept: list[list[np.ndarray]] = []

            def closed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
                a = keys >> U64(b_bits)  # noqa: B023
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                best = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a)))) == n
                yield from _merged_rows(radix, 0, keys, n * U64(2) + best)  # noqa: B023

            for block in R.merged(R.unpack(row[-1], 1) for row in rows):
                kept.append(block)
                keys, n = (np.concatenate(c) for c in zip(*kept, strict=True))
                a = keys >> U64(b_bits)
                open_ = int(np.searchsorted(a, a[-1]))  # pairs of the last A id may still come
                if open_:
                    yield from closed(keys[:open_], n[:open_])
                kept = [[keys[open_:], n[open_:]]]
            if kept:
                yield from closed(*kept[0])

    return run


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(radix, share) after (radix, share): first the counts of the radix, then record blocks, whose documents get their part."""
    for _, rows in R.in_groups(batches, ["radix", "share"]):
        counts: list[list[np.ndarray]] = []
        table = None
        for _, _, kind, _, slot, block in rows:
            if kind == _PAIRS:
                counts.append(R.unpack(block, 1))
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*counts, strict=True)]
            keys, docs, times = R.unpack(block, 2)
            found = table[1][np.searchsorted(table[0], keys)]
            doc, best, total = R.summed(docs, times * (found & U64(1)), times * (found >> U64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64) + slot), pa.array(best.astype(np.int64)), pa.array(total.astype(np.int64))], names=["slot", "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Per row of docs doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and all linked pairs: a, b,
    n_docs, is_best (no pair of its A id is in more documents).

    Defined cases: a text that is null or empty, or that the tokens of a side do not give back byte for byte (one with
    U+2581), has no tokens: zeros and an empty groups_sha256. Repeated rows and copies are documents of their own; a null
    doc_id keeps its row. An empty table gives empty results. Other columns are ignored."""
    spark = docs.sparkSession
    tuned(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("slot", F.monotonically_increasing_id())
    encoded = stage_table(rows.mapInArrow(_encode(a_path, b_path), _DDL), "aligned")
    tool = aligner(a_path, b_path)
    pairs = encoded.where(F.col("kind") == _PAIRS).select("radix", F.floor(F.shiftright("slot", 33) / FAN_IN).cast("int").alias("part"), "first", "block")
    some = pairs.repartition("radix", "part").sortWithinPartitions("radix", "part", "first").mapInArrow(_merge_some, _MERGED)
    counts = some.repartition("radix").select("radix", "first", "block").sortWithinPartitions("radix", "first").mapInArrow(_merge_all(tool.b_bits), _MERGED)
    counts = stage_table(counts, "pair-counts")

    records = encoded.where(F.col("kind") == _RECORDS)
    per_radix = records.groupBy("radix").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("n_shares"))  # RADIX rows
    share = F.pmod(F.xxhash64("slot", "first"), F.col("n_shares")).cast("int")
    records = records.join(F.broadcast(per_radix), "radix").select("radix", share.alias("share"), F.lit(_RECORDS).alias("kind"), "first", "slot", "block")
    sent = counts.join(F.broadcast(per_radix), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("n_shares") - 1)).alias("share"), F.lit(_PAIRS).alias("kind"), "first", F.lit(0).cast("long").alias("slot"), "block")
    dealt = sent.unionByName(records).repartition("radix", "share").sortWithinPartitions("radix", "share", F.col("kind").desc(), "first")
    parts = dealt.mapInArrow(_shares, "slot long, n_best long, count_sum long").groupBy("slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = encoded.where(F.col("kind") == _DOCUMENT).select("doc_id", "slot", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    result = documents.join(parts, "slot", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return result, _pair_table(counts, tool)


def _pair_table(counts: DataFrame, tool: Aligner) -> DataFrame:
    b_bits, lanes = tool.b_bits, tool.lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                keys, n = R.unpack(block.as_py(), 1)
                dealt = (keys >> U64(b_bits)).astype(np.int64)
                a = dealt % lanes * RADIX + dealt // lanes
                b = (keys & U64((1 << b_bits) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((n >> U64(1)).astype(np.int64)), pa.array((n & U64(1)).astype(bool))], names=["a", "b", "n_docs", "is_best"])

    return counts.select("block").mapInArrow(run, "a long, b long, n_docs long, is_best boolean")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(A_SIDE), public_tokenizers.path(B_SIDE))[0]
