"""Readers for files whose form is not known exactly, and columns whose names vary."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The events of all kinds in one schema; what a kind does not have is null.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


def code_page(name: str) -> tuple[str, str]:
    """The upper half of a one-byte code page: its characters as ISO-8859-1 reads them, and as they are meant."""
    meant = {chr(b): bytes([b]).decode(name, "ignore") for b in range(0x80, 0x100)}
    changed = {k: v for k, v in meant.items() if v and v != k}
    return "".join(changed), "".join(changed.values())


class MissingColumn(ValueError):
    """A required column has no spelling in the header, or several columns fit."""


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a torn line (cut while being written) is left out, and so is one without kind or seq."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("kind IS NOT NULL AND seq IS NOT NULL")


def is_error_body(head: bytes) -> bool:
    """HTML or JSON where a table was expected."""
    start = head.lstrip()[:15].lower()
    return start.startswith((b"<!doctype", b"<html", b"{", b"["))


#: More kinds of header, separator and encoding than this among the files of one read are an error.
MOST_DIALECTS = 200


def read_delimited(spark: SparkSession, path: str, fallback: str = "cp1252") -> DataFrame:
    """Delimited files with a header, all columns as strings; rows shorter or longer than their file's header are dropped.

    Every file has its own dialect, found in the tasks from all of its lines: it is UTF-8 if each of them is, else in the
    fallback, a one-byte code page; the separator is the one of comma, semicolon and tab that its header has most of. Only
    the different dialects reach the driver. Files with different columns are united, a missing column being null. A file
    whose first line begins like HTML or JSON is an error page and refused. Quoted fields do not span lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")
    first = F.struct("_block", "_line")
    files = lines.groupBy("file").agg(F.min_by("value", first).alias("header"), F.min(first).alias("_first"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    count = lambda c: F.length("header") - F.length(F.replace("header", F.lit(c), F.lit("")))
    best = F.greatest(*[F.struct(count(c).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(",;\t")])
    files = files.withColumn("separator", best["c"]).withColumn("raw", F.decode(F.col("header").cast("binary"), "ISO-8859-1"))
    kinds = files.groupBy("raw", "utf8", "separator").agg(F.min("file").alias("example")).limit(MOST_DIALECTS + 1).collect()
    if not kinds:
        raise FileNotFoundError(path)
    if len(kinds) > MOST_DIALECTS:
        raise ValueError(f"{path} has files of more than {MOST_DIALECTS} kinds")
    if errors := sorted(k["example"] for k in kinds if is_error_body(k["raw"].encode("latin-1").removeprefix(b"\xef\xbb\xbf"))):
        raise ValueError(f"{errors[0]} holds an error page")
    read, meant = code_page(fallback)
    body = lines.join(files.select("file", "raw", "utf8", "separator", "_first"), "file").where((first != F.col("_first")) & (F.trim("value") != ""))
    parts = []
    for kind in kinds:
        text = kind["raw"].encode("latin-1").decode("utf-8") if kind["utf8"] else kind["raw"].translate(str.maketrans(read, meant))
        names = [n.strip() for n in next(csv.reader([text.lstrip("\ufeff")], delimiter=kind["separator"]), [])]
        line = F.col("value") if kind["utf8"] else F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), read, meant)
        fields = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))], T.StructField("_bad", T.StringType())])
        row = F.from_csv(line, fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": kind["separator"], "escape": "\"", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
        mine = body.where((F.col("raw") == kind["raw"]) & (F.col("utf8") == kind["utf8"])).select(row.alias("r")).where("r._bad IS NULL")
        parts.append(mine.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], optional: frozenset[str] = frozenset()) -> tuple[DataFrame, dict[str, str]]:
    """df's columns under their canonical names, and an outcome for each: the live name, or "absent".

    Spellings are compared trimmed and without case. A required name without a column, or any name with two, is an error."""
    live: dict[str, list[str]] = {}
    for c in df.columns:
        live.setdefault(c.strip().lower(), []).append(c)
    chosen, outcome = [], {}
    for name, spellings in wanted.items():
        hits = [c for s in dict.fromkeys(x.strip().lower() for x in [name, *spellings]) for c in live.get(s, [])]
        if len(hits) > 1:
            raise MissingColumn(f"{name}: several columns fit: {hits}")
        if not hits and name not in optional:
            raise MissingColumn(f"{name}: no column fits")
        outcome[name] = hits[0] if hits else "absent"
        chosen.append(F.col(f"`{hits[0]}`").alias(name) if hits else F.lit(None).cast("string").alias(name))
    return df.select(*chosen), outcome


def canonical(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Blank strings as nulls; the columns of scales as scaled doubles."""

    def clean(name: str) -> Column:
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        return (F.expr(f"try_cast(replace(nullif(trim(cast(`{name}` as string)), ''), ',', '') as double)") * scales[name] if name in scales else text).alias(name)

    return df.select(*[clean(c) for c in df.columns])


def sitemap_urls(docs: DataFrame, xml: str) -> DataFrame:
    """docs with url, one row for each location of an XML sitemap or sitemap index, and is_index."""
    body = F.regexp_replace(F.col(xml), r'xmlns="[^"]*"', "")
    return docs.withColumn("_body", body).select(*[c for c in docs.columns if c != xml], F.contains("_body", F.lit("<sitemapindex")).alias("is_index"), F.explode(F.expr("xpath(_body, '//loc/text()')")).alias("url"))


def sitemap_pages(docs: DataFrame, name: str, xml: str, roots: list[str], most_levels: int = 3) -> DataFrame:
    """root and url: the pages that the sitemaps of docs (name, xml) list, reached from the roots through sitemap indexes up to
    most_levels deep. Each level is one join; a sitemap that is not there lists nothing."""
    listed = sitemap_urls(docs.select(name, xml), xml)
    level = docs.where(F.col(name).isin(roots)).select(F.col(name).alias("root"), F.col(name).alias("_at"))
    pages = None
    for _ in range(most_levels):
        found = level.join(listed, F.col("_at") == F.col(name)).select("root", "url", "is_index")
        here = found.where("NOT is_index").select("root", "url")
        pages = here if pages is None else pages.union(here)
        level = found.where("is_index").select("root", F.col("url").alias("_at")).distinct()
    return pages.distinct()


def challenge_page(text: Column, least: int = 400) -> Column:
    """Is this short page a bot challenge rather than content?"""
    return (F.length(text) < least) & text.rlike(r"(?i)captcha|verify you are human|access denied|enable javascript|attention required")
