"""Token counts through a cache of content digests.

A text's digest is the SHA-256 of its content; a tokenizer's version is the SHA-256 of its file. Counts are stored under
both. A run joins its digests to the stored counts, encodes one text for each digest that is missing, appends those counts
to the cache, and reads every count from the cache. The byte-level tokenizers normalise nothing, so content is normalised
only in that a null text counts as an empty one: anything more would merge texts whose counts differ.

Texts are never shuffled while the digests that decide are few enough to be sent around; their number is checked.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.common import BROADCAST_ROWS, join_keys, shared_folder, stage_table, table, tuned
from quillforge.llm.tokens import encoder

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
TOKENIZER = "byte_bpe_50k.json"


def version_of(tokenizer: str) -> str:
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            n = [len(ids) // encode.kind.itemsize for ids in encode.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def cached(spark, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of this version, one row each; a cache that does not exist yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs at once may append the same digest


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; new counts are appended to the cache.

    No begin, end or other special token is added, and nothing is cut or padded. Defined cases: a null text is an empty
    one (0 tokens); repeated rows and copies are encoded once; a null doc_id keeps its row. Other columns are ignored."""
    spark = docs.sparkSession
    tuned(spark)
    version = version_of(tokenizer)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = stage_table(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = cached(spark, cache, version).select("digest")
    distinct = keyed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("owner"), F.count("*").alias("n"))
    missing = stage_table(distinct.join(known, "digest", "left_anti").select("digest", F.col("owner.doc_id").alias("owner"), "n"), "missing")
    n_missing, n_known = missing.count(), known.count()
    if n_missing:
        several = missing.where("n > 1").select("digest", "owner")
        if n_known == 0:
            wanted = texts
        elif n_missing <= BROADCAST_ROWS or n_missing < n_known:
            ids = missing.select("digest")
            wanted = texts.join(F.broadcast(ids) if n_missing <= BROADCAST_ROWS else ids, "digest", "left_semi")
        else:
            wanted = texts.join(F.broadcast(known) if n_known <= BROADCAST_ROWS else known, "digest", "left_anti")
        several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
        wanted = wanted.join(several, "digest", "left").where("owner IS NULL OR doc_id <=> owner").select("digest", "text")
        fresh = wanted.mapInArrow(_count(tokenizer), "digest binary, n_tokens long").dropDuplicates(["digest"])
        fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = cached(spark, cache, version).join(distinct.select("digest", "n"), "digest")
    return join_keys(keyed, counts, "digest", "n", keyed.count()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """The cache is the one that the session names in quillforge.tokenCache, which outlives runs; where none is named, a new one."""
    cache = spark.conf.get("quillforge.tokenCache", None) or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
