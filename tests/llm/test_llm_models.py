"""Interpolation, whitening and token alignment against plain versions."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillforge.llm import alignment, interpolation, runs, text_np, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_PATH, B_PATH = public_tokenizers.path(alignment.A_SIDE), public_tokenizers.path(alignment.B_SIDE)
CLASHING = "doc_id long, text string, slot long, role int, kind int, radix int, chunk long, n_a long, row string"


def corpus(spark, sf_dir, more):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + more
    return rows, spark.createDataFrame([(d, t, 1, 2, 3, 4, 5, 6, "x") for d, t in rows], CLASHING).repartition(5)


def key(row):
    return (row[0] is None, row[0] or 0, *row[2:4])


# runs


def test_blocks_round_trip_and_merge():
    rng = np.random.default_rng(5)
    want = collections.Counter()
    blocks = []
    for _ in range(23):
        keys = np.unique(rng.integers(0, 4_000, 700).astype(np.uint64) ** np.uint64(4))
        n = rng.integers(1, 9, len(keys)).astype(np.uint64)
        for k, v in zip(keys.tolist(), n.tolist()):
            want[k] += v
        for i, j in runs.cuts(len(keys), 100):
            back = runs.unpack(runs.pack(keys[i:j], n[i:j]), 1)
            assert (back[0] == keys[i:j]).all() and (back[1] == n[i:j]).all()
            blocks.append(back)
    blocks.sort(key=lambda b: int(b[0][0]))
    for least in (1, 500, 1 << 20):
        out = list(runs.merged(blocks, least))
        keys = np.concatenate([o[0] for o in out])
        assert (np.diff(keys.astype(object)) > 0).all()
        assert dict(zip(keys.tolist(), np.concatenate([o[1] for o in out]).tolist())) == want
    assert list(runs.merged([])) == []
    assert (runs.load(runs.store(np.array([5, 0, 1 << 63], np.uint64))) == np.array([5, 0, 1 << 63], np.uint64)).all()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two", "a bb ccc " * 400, None, "x" * 3_000 + " y", "", "end"])

    def hashes():
        return [h[a:b].tolist() for (h,), at in text_np.hashed(texts, seed=3) for a, b in zip(at, at[1:])]

    want = hashes()
    monkeypatch.setattr(text_np, "BLOCK_BYTES", 64)
    assert hashes() == want and [len(w) for w in want] == [2, 1200, 0, 2, 0, 1]


# deleted interpolation


def plain_scores(rows, roles, order):
    texts = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]

    def grams(ws):
        padded = ["<begin>"] * (order - 1) + ws
        return [[tuple(padded[i + order - k : i + order]) for k in range(1, order + 1)] for i in range(len(ws))]

    def counted(wanted):
        counts, contexts = [collections.Counter() for _ in range(order)], [collections.Counter() for _ in range(order)]
        for ws, role in zip(texts, roles):
            for gs in grams(ws) if role in wanted else ():
                for k, g in enumerate(gs):
                    counts[k][g] += 1
                    contexts[k][g[:-1]] += 1
        return counts, contexts

    def probability(gs, counts, contexts, weights):
        p, shares = 1 / (len(counts[0]) + 1), []
        for k, g in enumerate(gs):
            n = contexts[k][g[:-1]] if k else max(1, sum(counts[0].values()))
            bucket = n.bit_length() if k else 0
            own = weights[k][bucket] * counts[k][g] / n if n else 0
            p = own + (1 - weights[k][bucket] if n else 1) * p
            shares.append((bucket, own / p) if n else None)
        return p, shares

    weights, last = [[0.5] * 65 for _ in range(order)], None
    counts, contexts = counted({1})
    for _ in range(interpolation.ROUNDS):
        own, everything, likelihood, n = collections.Counter(), collections.Counter(), 0, 0
        for ws, role in zip(texts, roles):
            for gs in grams(ws) if role == 2 else ():
                p, shares = probability(gs, counts, contexts, weights)
                likelihood, n, left = likelihood + math.log10(p), n + 1, 1.0
                for k in reversed(range(order)):
                    if shares[k]:
                        own[k, shares[k][0]] += left * shares[k][1]
                        everything[k, shares[k][0]] += left
                        left *= 1 - shares[k][1]
        if not n:
            break
        for k in range(order):
            value = 0.5
            for b in range(65):
                value = weights[k][b] = min(1 - 1e-6, own[k, b] / everything[k, b] if everything[k, b] else value)
        if last is not None and likelihood / n - last < interpolation.GAIN:
            break
        last = likelihood / n
    counts, contexts = counted({1, 2})
    total, words = sum(counts[0].values()), len(counts[0])
    return [
        (d, role == 0, len(ws), sum(counts[0][(w,)] > 0 for w in ws), total, sum(math.log10((counts[0][(w,)] + 1) / (total + words + 1)) for w in ws), sum(math.log10(probability(g, counts, contexts, weights)[0]) for g in grams(ws)))
        for (d, _), ws, role in zip(rows, texts, roles)
    ]


def held_apart(doc_id):
    return F.crc32(doc_id.cast("string")) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_equals_plain_counts_and_em(spark, sf_dir, order, monkeypatch):
    monkeypatch.setattr(interpolation, "CHUNK", 20_000)
    monkeypatch.setattr(interpolation, "MEETING", 1 << 12)  # several radixes
    rows, df = corpus(spark, sf_dir, [(900_001, None), (900_002, ""), (900_003, " "), (None, "hello hello"), (900_004, "The THE the \x0b a"), (900_004, "The THE the \x0b a")])
    role = F.when(F.coalesce(held_apart(F.col("doc_id")), F.lit(False)), 0).when(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(20)) == 0, 2).otherwise(1)
    roles = {(r["doc_id"], r["text"]): r["r"] for r in df.select("doc_id", "text", role.alias("r")).collect()}
    assert set(roles.values()) == {0, 1, 2}
    want = sorted(plain_scores(rows, [roles[r] for r in rows], order), key=key)
    got = sorted(map(tuple, interpolation.score_texts(df, held_apart(F.col("doc_id")), order).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_interpolation_without_training_texts_or_rows(spark):
    one = interpolation.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).collect()
    assert [tuple(r) for r in one] == [(1, True, 3, 0, 0, 0.0, 0.0)]
    assert interpolation.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def test_interpolation_beats_the_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = interpolation.score_texts(docs, held_apart(F.col("doc_id"))).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# whitening


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    a = fit - sums / n
    values, components = np.linalg.eigh(a.T @ a / n)
    values, components = values[::-1], components[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ (components[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


def test_whitening_equals_eigenvectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [r for r in table.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, white, explained = plain_whitening([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(table.withColumn("x", F.lit(1)).withColumn("i", F.lit(2))).collect()}
    assert len(got) == 4 * len(rows)
    for i, r in enumerate(rows):
        for c in range(4):
            mine = got[r["vec_id"], c + 1]
            assert (mine["n"], mine["deviation"]) == (n, deviation[i])
            assert abs(abs(mine["whitened"]) - abs(white[i, c])) < 1e-9 and abs(mine["explained"] / explained[c] - 1) < 1e-9
            assert mine["identity_error"] < 1e-10
    signs = np.array([[np.sign(got[r["vec_id"], c + 1]["whitened"] * white[i, c]) for c in range(4)] for i, r in enumerate(rows)])
    assert (signs == signs[0]).all()


def test_whitening_of_badly_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6))
    v[:, 3], v[:, 4], v[:, 5] = v[:, 0], 7, v[:, 1] * 2e-2 + 3e3 * v[:, 2]
    got = whitening.whitened(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), components=6).toPandas()
    n, _, white, explained = plain_whitening(v)
    mine = got.sort_values(["vec_id", "component"])
    assert mine["identity_error"].max() < 1e-4
    np.testing.assert_allclose(mine["explained"].to_numpy()[:4], explained, rtol=1e-6)
    np.testing.assert_allclose(np.abs(mine["whitened"].to_numpy().reshape(-1, 6)[:, :3]), np.abs(white[:, :3]), atol=1e-5)
    assert mine[mine["component"] >= 5]["whitened"].isna().all() and (mine[mine["component"] >= 5]["explained"] == 0).all()


def test_whitening_awkward_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [3.0]), (None, [0.5, -1.0]), (6, []), (7, [float("inf"), 0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 4, 5: 2, None: 2, 6: 2} and {r["n"] for r in got} == {4}
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 9 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in one)
    for nothing in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(nothing, "vec_id long, embedding array<float>")).collect() == []
    huge = whitening.whitened(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge)


# alignment


def plain_alignment(rows):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    byte_of = alignment._visible_bytes()
    documents = []
    for doc_id, text in rows:
        nothing = (doc_id, 0, 0, 0, collections.Counter(), "")
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(b.id_to_piece, ids[1]))]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            documents.append(nothing)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links, groups, i, j = collections.Counter(), [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            left, right = i, j
            while i < len(ends[0]) and ends[0][i] <= end:
                i += 1
            while j < len(ends[1]) and ends[1][j] <= end:
                j += 1
            groups.append(",".join(map(str, ids[0][left:i])) + "|" + ",".join(map(str, ids[1][right:j])))
            links.update((x, y) for x in ids[0][left:i] for y in ids[1][right:j])
        documents.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = collections.Counter(p for d in documents for p in d[4])
    highest = collections.Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [(*d[:4], sum(d[4].values()), sum(n for p, n in d[4].items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in d[4].items()), d[5]) for d in documents], counts


def test_alignment_equals_a_plain_version(spark, sf_dir, monkeypatch):
    more = [(1, None), (2, ""), (3, " "), (4, "a ▁b c"), (5, "  two  blanks \n\t end "), (None, "hello hello"), (6, "x" * 3_000), (6, "x" * 3_000), (7, "日本語 テスト ÿé"), (8, "<|endoftext|> <s> </s> <0x41>"), (9, "𝕏𝕐 ﬁ é\x00"), (10, "don't  won't　wide")]
    rows, df = corpus(spark, sf_dir, [(None if d is None else 900_000 + d, t) for d, t in more])
    want, counts = plain_alignment(rows)
    result, pairs = alignment.align(df, A_PATH, B_PATH)
    assert sorted(map(tuple, result.collect()), key=key) == sorted(want, key=key)
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == counts


def test_alignment_with_many_small_runs(spark, monkeypatch):
    """Workers take their limits from the module, so the small ones are set in the tasks' closures by hand."""
    import pyarrow as pa

    tool = alignment.Aligner(A_PATH, B_PATH)
    monkeypatch.setattr(alignment, "BUFFER", 50)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setitem(alignment._WORKER, (A_PATH, B_PATH), tool)
    texts = ["one two three four", "two two six", "seven, one", "", "a b c d e f g"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["doc_id", "text", "slot"])
    out = pa.Table.from_batches(alignment._encode(A_PATH, B_PATH)(iter([batch.slice(0, 70), batch.slice(70)]))).to_pylist()
    counts = collections.Counter()
    for r in out:
        if r["kind"] == alignment._PAIRS:
            k, n = runs.unpack(r["block"], 1)
            counts.update(dict(zip(k.tolist(), n.tolist())))
    want = plain_alignment(list(enumerate(texts)))[1]
    got = {}
    for k, n in counts.items():
        dealt, b = k >> tool.b_bits, k & ((1 << tool.b_bits) - 1)
        got[dealt % tool.lanes * alignment.RADIX + dealt // tool.lanes, b] = n
    assert got == want and len(tool.known) <= 3 and sum(r["kind"] == alignment._RECORDS for r in out) > 2 * alignment.RADIX - 20


def test_alignment_of_nothing(spark):
    result, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH)
    assert result.collect() == [] and pairs.collect() == []
    result, pairs = alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A_PATH, B_PATH)
    assert sorted(r["groups_sha256"] for r in result.collect()) == ["", ""] and pairs.collect() == []


def test_words_are_encoded_as_in_their_texts():
    tool = alignment.Aligner(A_PATH, B_PATH)
    for text in ("plain words here", " lead", "trail ", "tab\t end", "new\nline \n x", "  nbsp  em", "a\x1c b", "x  y", "é ü", "12 34,5 ..."):
        parts = tool.cut(text)
        assert [i for p in parts for i in tool.a.encode(" " + p, add_special_tokens=False).ids] == tool.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in tool.b.encode(p)] == tool.b.encode(text)
