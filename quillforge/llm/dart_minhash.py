"""Near-duplicate detection with DartMinHash signatures.

A document is a weighted set: its five-word shingles, weighted by how often each occurs. Every unit of weight of a shingle
is a region at which darts are thrown: hashes of (shingle, unit, dart number) give each dart its arrival time (a Poisson
process) and the coordinate it hits. A document keeps the earliest dart of each coordinate. It reads the darts only up to
a time at which about COORDINATES * ln(COORDINATES) of them have landed, whatever its length, and goes on where a
coordinate is still empty. Two documents agree on a coordinate with a probability equal to their weighted Jaccard similarity.

BANDS bands of ROWS coordinates are joined. At similarity 0.8 a pair shares no band with probability 3e-6.

No group is expanded into pairs. Equal texts collapse to one node. In the first round each node is paired only with the
hub of each of its buckets, the node that shares most buckets with others; exact similarities are computed for pairs whose
signatures agree enough, and links form classes. Then only buckets that still hold several classes are looked at again,
and nodes of different classes in them are compared, so that no link between different texts is lost to the shortcut. In
large buckets this is done in blocks, inside the tasks; nodes of the bucket's largest class only meet the others there. Only
pairs that can be links leave the tasks: their signatures
agree enough, and a bound allows it (shingles that no other node there has cannot be shared, so two texts of a and b
shingles of which u and v are such overlap in at most min(a - u, b - v)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import text_np as N
from quillforge.llm.common import join_keys, sent_if_small, shuffle_partitions, stage_table, table, tuned

U64 = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
COORDINATES, BANDS, ROWS = 256, 42, 6
#: A pair of similarity 0.8 has an estimate below this with probability 1e-6, less than that of sharing no band.
LEAST_ESTIMATE = 0.68
#: Buckets of more nodes than this get the bound on overlaps before their nodes are paired.
LARGE_BUCKET = 32
#: Nodes of a large bucket that are compared in one piece with as many others.
BLOCK = 1024
#: Units whose darts are thrown at once: bounds the temporary arrays.
UNITS = 1 << 15
_STEP, _UNIT = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every unit of shingle weight, document by document, and the number of units of each document.

    A text of one to four words has one shingle, all its words; a text without words has none."""
    starts, ends, at = N.words(data, offs)
    (hashes,) = N.word_hashes(data, starts, ends)
    grams, whole = N.gram_hashes(hashes, at, SHINGLE)
    lengths = np.diff(at)
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        short, _ = N.gram_hashes(hashes[at[i] : at[i + 1]], np.array([0, lengths[i]]), int(lengths[i]))
        grams[at[i]], whole[at[i]] = N.splitmix(short[:1] ^ U64(lengths[i]))[0], True
    where = np.flatnonzero(whole)
    doc = np.repeat(np.arange(len(lengths)), lengths)[where]
    grams = grams[where]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    index = np.arange(len(grams))
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    nth = (index - np.maximum.accumulate(np.where(fresh, index, 0))).astype(U64)
    return N.splitmix(grams ^ (nth * _UNIT)), np.bincount(doc, minlength=len(lengths))


def _throw(unit: np.ndarray, until: np.ndarray, cell: np.ndarray, best: np.ndarray) -> None:
    """Enter all darts of the units up to their documents' times into best[cell + coordinate]."""
    left, since, done, width = np.arange(len(unit)), np.zeros(len(unit)), 0, 1
    while len(left):
        dart = N.splitmix(unit[left][:, None] + np.arange(done + 1, done + width + 1, dtype=U64) * _STEP)
        time = since[:, None] - np.cumsum(np.log1p((dart >> U64(11)) * -(2.0**-53)), axis=1)
        row, col = np.nonzero(time <= until[left][:, None])
        np.minimum.at(best, cell[left[row]] + (dart[row, col] & U64(COORDINATES - 1)).astype(np.int64), time[row, col])
        more = time[:, -1] <= until[left]
        left, since, done, width = left[more], time[more, -1], done + width, min(2 * width, 16)


def signatures(unit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document COORDINATES 16-bit codes of its earliest darts (documents without units: zeros)."""
    n = len(counts)
    best = np.full(n * COORDINATES, np.inf)
    reach = COORDINATES * (math.log(COORDINATES) + 4) / np.maximum(counts, 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    todo = np.flatnonzero(counts > 0)
    while len(todo):
        pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in todo])
        owner = np.repeat(todo, counts[todo])
        for k in range(0, len(pick), UNITS):
            _throw(unit[pick[k : k + UNITS]], reach[owner[k : k + UNITS]], owner[k : k + UNITS] * COORDINATES, best)
        todo = todo[np.isinf(best.reshape(n, COORDINATES)[todo]).any(axis=1)]
        reach[todo] *= 2
    return (N.splitmix(best.view(U64)) & U64(0xFFFF)).astype("<u2").reshape(n, COORDINATES) * (counts > 0)[:, None].astype("<u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_units, rows = [], []
        for _, _, data, offs in N.blocks(batch.column("text")):
            unit, counts = units(data, offs)
            n_units += counts.tolist()
            rows += [x.tobytes() for x in signatures(unit, counts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy_key"), pa.array(n_units, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "copy_key", "n_units", "signature"])


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, COORDINATES)[:, : BANDS * ROWS].astype(U64).reshape(-1, BANDS, ROWS)
        key = np.arange(BANDS, dtype=U64)[None, :] + np.zeros((len(rows), 1), U64)
        for j in range(ROWS):
            key = N.splitmix(key ^ (rows[:, :, j] + U64(j << 32)))
        flat = pa.array(key.reshape(-1).view(np.int64))
        offsets = pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, flat)], names=["node", "keys"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, COORDINATES) for c in ("signature_a", "signature_b"))
        keep = pa.array((a == b).mean(axis=1) >= LEAST_ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def _unit_sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, data, offs in N.blocks(column):
        unit, counts = units(data, offs)
        out += np.split(unit, np.cumsum(counts)[:-1])
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, likeness = [], []
            for x, y in zip(_unit_sets(batch.column("text_a")), _unit_sets(batch.column("text_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                likeness.append(both / max(1, len(x) + len(y) - both))
                kept.append(likeness[-1] >= threshold)
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b")), pa.array(likeness, pa.float64()).filter(keep)], names=["a", "b", "similarity"])

    return run


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.view(np.int64) for x in _unit_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "units"])


def _compare(threshold: float):
    """One pair of blocks of a large bucket: the pairs of nodes of different classes whose signatures agree enough and whose
    extents allow a link, each in the first band that it shares only."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(frame["signature"]), "<u2").reshape(-1, COORDINATES)
        node, label, size, most = (frame[c].to_numpy() for c in ("node", "label", "n_units", "shareable"))
        alike = lambda x, y: (x[: BANDS * ROWS] == y[:, : BANDS * ROWS]).reshape(len(y), BANDS, ROWS).all(axis=2)
        first, second = frame["i"].iloc[0], frame["j"].iloc[0]
        left = np.flatnonzero(frame["mine"] == first)
        right = left if first == second else np.flatnonzero(frame["mine"] == second)
        out = []
        for x in left:
            y = right[(label[right] != label[x]) & ((node[right] > node[x]) | (first != second))]
            overlap = np.minimum(most[x], most[y])
            y = y[overlap * (1 + threshold) >= threshold * (size[x] + size[y]) - 1e-6]
            y = y[(rows[x] == rows[y]).mean(axis=1) >= LEAST_ESTIMATE]
            if len(y):
                out.append((np.full(len(y), node[x]), node[y], alike(rows[x], rows[y]).argmax(axis=1)))
        if not out:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b, band = (np.concatenate(c) for c in zip(*out, strict=True))
        keep = band == frame["band_no"].iloc[0]
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b). Labels spread to neighbours and then
    jump along themselves; every round is a written table, and only a count of changes comes to the driver."""
    both = stage_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stage_table(spread.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, bool]:
    """Three things: doc_id, copy_key and n_units of every row of docs with both a doc_id and a text; for each copy_key its
    n_copies and its class: class_id and keeper_key (the row that stays, by doc_id and copy_key) and class_size; and whether
    every doc_id occurs once."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.md5("text").alias("copy_key"), "text")
    sketches = stage_table(known.mapInArrow(_sketch, "doc_id long, copy_key string, n_units long, signature binary"), "sketches")
    # a node is a text: its rows may have any doc_ids, and a doc_id may have several texts
    copies = sketches.groupBy("copy_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_copies"))
    copies = stage_table(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    tokens = sketches.join(copies.select("copy_key", "first_doc", "node"), "copy_key").where("doc_id = first_doc AND n_units > 0").select("node", "n_units", "signature")
    tokens = stage_table(tokens.dropDuplicates(["node"]), "nodes")

    bands = stage_table(tokens.select("node", "signature").mapInArrow(_band_keys, "node long, keys array<long>").select("node", F.posexplode("keys").alias("band_no", "band")), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    filled = stage_table(bands.join(buckets, "band"), "buckets")
    shared = filled.groupBy("node").agg(F.sum("in_bucket").alias("shared"))
    hubs = filled.join(shared, "node").groupBy("band").agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("hub"))

    # where no doc_id is repeated, it alone finds a row; else texts are hashed again to tell its rows apart
    unique = sketches.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def texts_of(ids: DataFrame) -> DataFrame:
        """node and text of the nodes in ids (node)."""
        key = [] if unique else [F.col("copy_key").alias("at_key")]
        wanted = copies.join(sent_if_small(ids), "node", "left_semi").select("node", F.col("first_doc").alias("at_doc"), *key)
        wanted = sent_if_small(stage_table(wanted, "wanted"))
        same = known["doc_id"] == F.col("at_doc")
        found = known.join(wanted, same if unique else same & (F.col("copy_key") == F.col("at_key"))).select("node", "text")
        return found if unique else found.dropDuplicates(["node"])

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        a = tokens.select(F.col("node").alias("a"), F.col("signature").alias("signature_a"))
        b = tokens.select(F.col("node").alias("b"), F.col("signature").alias("signature_b"))
        return stage_table(pairs.join(a, "a").join(b, "b").mapInArrow(_agree, "a long, b long"), f"{name}-likely")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = stage_table(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct(), f"{name}-ids")
        needed = texts_of(ids)
        a = needed.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = needed.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return stage_table(pairs.join(a, "a").join(b, "b").mapInArrow(_verify(threshold), "a long, b long, similarity double"), f"{name}-links")

    star = filled.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = stage_table(star, "star")
    links = verified(likely(star, "star"), "star")
    labels = components(links)

    labelled = filled.join(labels, "node", "left").select("band", "band_no", "node", "in_bucket", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    rest = stage_table(labelled.join(split, "band"), "rest")

    large = rest.where(F.col("in_bucket") > LARGE_BUCKET)
    ids = stage_table(large.select("node").distinct(), "large-ids")
    # dealt out evenly first: texts of one large group may lie close together in the input
    rows = texts_of(ids).repartition(shuffle_partitions(docs.sparkSession)).mapInArrow(_unit_rows, "node long, units array<long>").select("node", F.explode(F.array_distinct("units")).alias("unit")).distinct()
    alone = rows.groupBy("unit").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    extents = ids.join(tokens.select("node", "n_units"), "node").join(alone, "node", "left").select("node", "n_units", (F.col("n_units") - F.coalesce("own", F.lit(0))).alias("shareable"))
    # a node with fewer shareable shingles than the threshold's part of its own has no partner
    able = stage_table(extents.where(F.col("shareable") >= threshold * F.col("n_units") - 1e-6), "extents")
    large = stage_table(large.join(able, "node"), "large")
    many = stage_table(_dealt(large).join(tokens.select("node", "signature"), "node").groupBy("band", "i", "j").applyInPandas(_compare(threshold), "a long, b long").join(star, ["a", "b"], "left_anti"), "large-likely")

    small = rest.where(F.col("in_bucket") <= LARGE_BUCKET)
    x, y = (small.select(F.col("band").alias(f"band_{s}"), F.col("node").alias(s), F.col("label").alias(f"label_{s}")) for s in "ab")
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("a") < F.col("b"))
    few = x.join(y, (F.col("band_a") == F.col("band_b")) & apart).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    across = verified(likely(few, "across").union(many).distinct(), "across")
    labels = components(links.union(across))

    placed = stage_table(copies.join(labels, "node", "left").select("copy_key", "first_doc", "n_copies", F.coalesce("label", "node").alias("label")), "placed")
    sizes = placed.groupBy("label").agg(F.min(F.struct("first_doc", "copy_key")).alias("keeper"), F.sum("n_copies").alias("class_size"), F.count("*").alias("n_texts"))
    classes = sizes.select("label", F.col("keeper.first_doc").alias("class_id"), F.col("keeper.copy_key").alias("keeper_key"), "class_size", "n_texts")
    texts = join_keys(placed, classes, "label", "n_texts", placed.count()).select("copy_key", "n_copies", "class_id", "keeper_key", "class_size")
    return sketches.select("doc_id", "copy_key", "n_units"), stage_table(texts, "classes"), unique


def _dealt(large: DataFrame) -> DataFrame:
    """The nodes of large buckets in pairs of blocks (i, j) that are to be compared.

    Nodes of a bucket's largest class are linked already and are only compared with the others, the strays. Strays are dealt
    into blocks that all meet each other and the blocks of the class: with s strays among n nodes this makes about
    s * n / BLOCK rows, and n where there are few strays."""
    per_class = large.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = per_class.groupBy("band").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n_all"), F.max("n").alias("n_main"))
    n_blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    main = main.select("band", "main", n_blocks("n_main").alias("of_main"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("of_strays")).where("of_strays > 0")
    main = sent_if_small(stage_table(main, "main-classes"))
    stray = F.col("label") != F.col("main")
    dealt = large.join(main, "band").withColumn("mine", F.when(stray, F.pmod(F.xxhash64("node"), "of_strays")).otherwise(F.col("of_strays") + F.pmod(F.xxhash64("node"), "of_main")).cast("int"))
    others = F.sequence(F.lit(0), F.when(stray, F.col("of_strays") + F.col("of_main")).otherwise(F.col("of_strays")) - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band_no", "node", "label", "n_units", "shareable")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size (rows), n_shingles for each row of docs.

    Classes are the connected components of links between texts whose weighted five-word shingle similarity is at least
    threshold. Defined cases: equal texts (empty ones too) are one class; a null text, and a text on a row with a null
    doc_id, is a class of its own (class_id is its doc_id); texts under five words count as one shingle; rows that share
    a doc_id are judged by their texts, each. Other columns are ignored; an empty table gives no rows."""
    tuned(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, texts, _ = _classes(docs, threshold)
    alone = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_shingles"))
    found = join_keys(rows, texts, "copy_key", "n_copies", rows.count())
    return found.select("doc_id", "class_id", "class_size", F.col("n_units").alias("n_shingles")).union(alone)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one with the smallest doc_id of each class; rows with a null doc_id or text all stay.

    Every other row's text is near one that stays: rows with one doc_id and different texts go or stay by their texts."""
    tuned(docs.sparkSession)
    _, texts, unique = _classes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), threshold)
    key = [] if unique else [F.col("keeper_key").alias("kept_key")]
    kept = stage_table(texts.select(F.col("class_id").alias("kept_id"), *key).distinct(), "kept")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string")).alias("copy_key"))
    same = F.col("doc_id") == F.col("kept_id")
    stay = known.join(sent_if_small(kept), same if unique else same & (F.col("copy_key") == F.col("kept_key")))
    stay = stay if unique else stay.dropDuplicates(["doc_id", "copy_key"])
    return stay.select("row.*").union(docs.where("doc_id IS NULL OR text IS NULL"))


def op6_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
