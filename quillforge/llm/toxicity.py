"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (letters and digits, lower case), the five-byte stems of the words, pairs of neighbours and
pairs with one word skipped, each hashed to one of DIMENSIONS coordinates and counted once. Follow-the-regularised-leader
keeps a learning rate for each coordinate and sets most weights to zero (L1), so what is broadcast is small: its size is
bounded by DIMENSIONS and known before it is sent.

The model is fitted on at most `fit_rows` rows of labelled documents, taken by a hash of doc_id. Everything else covers all rows:
scoring is one pass over the texts without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm import text_np as N
from quillforge.llm.common import stage_table, table, tuned

U64 = np.uint64
DIMENSIONS = 1 << 20
#: The most labelled documents that the model is fitted on.
FIT_ROWS = 12_000
STEM_BYTES = 5
_STRETCH = 1 << 19


def features(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each block of rows, the distinct coordinates of each text, ascending."""
    for (word, stem), at in N.hashed(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), N.PUNCT, stem=STEM_BYTES):
        found = [np.zeros(0, U64)]
        # a very long text goes in stretches; what is kept of each is at most its distinct coordinates
        for first in range(0, len(word), _STRETCH):
            place = np.arange(first, min(len(word), first + _STRETCH))
            doc = np.searchsorted(at, place, "right") - 1
            last = at[doc + 1]
            kinds = [(doc, word[place]), (doc, stem[place])]
            for gap, salt in ((1, U64(0x51ED27)), (2, U64(0x8A3C9B))):
                ok = place + gap < last
                kinds.append((doc[ok], N.splitmix(word[place[ok]] * U64(0x9E3779B97F4A7C15) + word[place[ok] + gap] + salt)))
            docs = np.concatenate([d for d, _ in kinds]).astype(U64)
            cells = np.concatenate([h for _, h in kinds]) & U64(DIMENSIONS - 1)
            found.append(np.unique((docs << U64(32)) | cells))
        both = found[1] if len(found) == 2 else np.unique(np.concatenate(found))
        yield np.split((both & U64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(both >> U64(32), np.arange(1, len(at) - 1).astype(U64)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for block in features(batch.column("text")) for r in block]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rank", "tie", "label", "n")), pa.array(rows, pa.list_(pa.int32()))], names=["rank", "tie", "label", "n", "cells"])


def ftrl(rows: list[tuple[np.ndarray, float]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and values of the weights that are not zero, and the bias (which is not penalised)."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    penalty = np.full(DIMENSIONS + 1, l1)
    penalty[DIMENSIONS] = 0

    def weights(at):
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, (np.sign(z[at]) * penalty[at] - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for cells, label in rows:
            at = np.append(cells, DIMENSIONS)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / alpha
            z[at] += slope - rate * w
            n[at] += slope * slope
    final = weights(np.arange(DIMENSIONS + 1))
    at = np.flatnonzero(final[:-1])
    return at, final[at], float(final[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most fit_rows rows of the labelled documents, those with the smallest hash of doc_id.

    A doc_id with several labels counts as toxic if any of them says so; null labels and null doc_ids are left out. The rows of
    a doc_id come in order of a hash of their texts, and equal rows one after another; fit_rows bounds rows, so a doc_id with
    more rows than that is taken in part. Equal rows travel once, with their number. Without any labelled document the model
    is empty and every score is 0.5."""
    tuned(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("rank", F.xxhash64("doc_id", "text").alias("tie"), "label", "text")
    first = texts.groupBy("rank", "tie").agg(F.count("*").alias("n")).orderBy("rank", "tie").limit(fit_rows)
    before = F.sum("n").over(Window.orderBy("rank", "tie")) - F.col("n")  # over at most fit_rows rows
    taken = stage_table(first.withColumn("n", F.least("n", F.lit(fit_rows) - before)).where("n > 0"), "fit-rows")
    cells = texts.join(F.broadcast(taken), ["rank", "tie"]).select("rank", "tie", "label", "n", "text").dropDuplicates(["rank", "tie"]).mapInArrow(_extract, "rank long, tie long, label double, n long, cells array<int>")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "tie"], kind="stable")
        at, w, bias = ftrl([row for *row, n in zip(frame["cells"], frame["label"], frame["n"], strict=True) for _ in range(n)], alpha, beta, l1, l2, epochs)
        return pd.DataFrame({"at": [*at.tolist(), DIMENSIONS], "w": [*w.tolist(), bias]})

    found = cells.groupBy().applyInPandas(learn, "at long, w double").toPandas()  # at most DIMENSIONS + 1 rows
    main = found[found["at"] < DIMENSIONS]
    return main["at"].to_numpy(), main["w"].to_numpy(), float(found["w"][found["at"] == DIMENSIONS].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with a column `score` between 0 and 1 in the end; a null or empty text gets the score of the bias alone.

    The model's own column is put last under that name even if docs has one, which is then replaced."""
    tuned(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        dense = np.zeros(DIMENSIONS)
        dense[at] = w
        for batch in batches:
            sums = [dense[r].sum() + bias for block in features(batch.column("text")) for r in block]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=[*batch.schema.names, "score"])

    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
