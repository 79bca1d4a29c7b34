"""The pipeline's stages, each on what the stage before it kept, and the queries with SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_llm_operators import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from quillforge.llm import toxicity
from quillforge.llm.common import stage_table
from quillforge.llm.queries import ORACLE_SQL, QUERIES


def staged(spark, docs, sf_dir):
    """The input of every stage and what the last one gives."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage_table(stage(spark, out[-1], sf_dir), name))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    return staged(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_stages_keep_whole_rows(stages):
    columns = stages[0].columns
    for before, after in zip(stages[:4], stages[1:5]):
        assert after.columns == columns and set(rows_of(after)) <= set(rows_of(before))
    counts = [df.count() for df in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]


def test_toxicity_stage(spark, sf_dir, stages):
    """Scored again, document by document, from the model's weights."""
    docs = stages[0]
    at, weights, bias = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    known = dict(zip(at.tolist(), weights.tolist()))
    want = []
    for r in docs.collect():
        ((cells,),) = toxicity.features(pa.array([r["text"]], pa.string()))
        if bias + sum(known.get(c, 0.0) for c in cells.tolist()) < 0:
            want.append(tuple(r))
    assert rows_of(stages[1]) == sorted(want, key=str)


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(d for d, c in brute_classes(rows) if d == c)


def test_decontamination_stage(spark, sf_dir, stages):
    token = re.compile(r"[^\W_]+")
    bench = [token.findall(r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(words):
        for item in bench:
            for at in range(-len(item), len(words)):
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(item)]
                if any(same):
                    best = now = hits = found = 0
                    for m in same:
                        now, hits = (0, 0) if now <= 0 else (now, hits)
                        now, hits = now + (1 if m else -4), hits + m
                        if now > best:
                            best, found = now, hits
                    if sum(same) >= 0.8 * len(item) or found >= 13:
                        return True
        return False

    shared = {w for item in bench for w in item}
    kept = []
    for r in stages[2].collect():
        words = token.findall((r["text"] or "").lower())
        if sum(w in shared for w in words) < 10 or not leaks(words):
            kept.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(kept)


def test_mixing_stage(stages, tmp_path):
    stages[3].write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = collections.Counter({d: n for d, n in con.execute(f"select doc_id, copies from ({ORACLE_SQL['op4_mixing']})").fetchall()})
    assert collections.Counter(r["doc_id"] for r in stages[4].collect()) == +want


def test_token_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(stages[4].collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(stages[5]) == sorted(want, key=str)


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with names used inside, and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size long, node long, u double"
    texts = [None, "", " \n", "one", "w " * 20_000, "w " * 20_000, "x" * 50_000, "some plain words of text number " + " ".join(map(str, range(40)))]
    rows = [(None if i == 3 else i, t, None, None if i % 3 else f"s{i % 2}", None, 1.0, "r", i, 1, 0.5) for i, t in enumerate(texts)]
    awkward = spark.createDataFrame([*rows, rows[-1], rows[1], (None,) * 10], schema)
    labels = spark.createDataFrame([(1, 0, None), (None, 0, 1), (7, 1, 0), (7, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, ""), (2, "words of text number nothing"), (2, "words of text number nothing")], "item_id long, text string")
    for k, (d, l, b) in enumerate([(awkward, labels, bench), (awkward, labels.limit(0), bench.limit(0)), (awkward.limit(0), labels, bench)]):
        folder = f"{tmp_path}/{k}"
        for name, df in (("documents", d), ("labels", l), ("benchmark", b)):
            df.write.parquet(f"{folder}/{name}.parquet")
        out = staged(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        for before, after in zip(out[:4], out[1:5]):
            assert after.columns == awkward.columns and set(rows_of(after)) <= set(rows_of(before))
        assert out[5].count() == out[4].count() and (k == 2) == (out[1].count() == 0)
        assert k != 1 or rows_of(out[1]) == rows_of(awkward)  # no labels: nothing is known against a document
        assert corpus_pipeline.run(spark, folder).count() == out[5].count()


def test_run_gives_the_same(spark, sf_dir):
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
