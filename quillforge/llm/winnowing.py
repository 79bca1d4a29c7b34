"""Document fingerprints by winnowing, in DataFrame operations only.

A text's tokens are its runs of up to TOKEN_CHARS characters that are not white space; runs over that are cut into such
pieces. A run of over LONG_RUN characters (scripts without spaces, encoded data, long lines of code) has a token at each of
its characters instead, the TOKEN_CHARS characters from there on, so that its grams roll and a passage gives the same ones
at every offset. Every GRAM consecutive tokens have a rolling hash, the cyclic polynomial of their 64-bit hashes (each step
rotates by one bit and takes in the next token). Of every WINDOW consecutive hashes the smallest is chosen, the rightmost of
equals, and kept with its position. Two texts with GRAM + WINDOW - 1 tokens in a row in common share a fingerprint there,
and its two positions give the offset. In long runs this takes GRAM + WINDOW + TOKEN_CHARS - 2 characters. Where a passage
begins or ends inside a run, at most LONG_RUN characters of it there may be cut differently.

Windows compare ORDER_BITS bits of the hashes, packed with the position (descending) into one integer, so that the smallest
integer of a window is the rightmost smallest hash. What is kept is the whole hash. DataFrame functions have no state that
runs along an array, so a gram's hash is computed from its GRAM token hashes, not from the gram before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.common import in_ranges, sent_if_small, shuffle_partitions, stage_table, table

GRAM, WINDOW = 5, 16
TOKEN_CHARS, LONG_RUN = 12, 48
PLACE_BITS = 30
ORDER_BITS = 63 - PLACE_BITS
LAST_PLACE = (1 << PLACE_BITS) - 1


def rolling(hashes: list[Column]) -> Column:
    """The cyclic polynomial of the hashes: rotate by a bit, take in the next."""
    n = len(hashes)
    turned = [h if i == n - 1 else F.shiftleft(h, n - 1 - i).bitwiseOR(F.shiftrightunsigned(h, 64 - (n - 1 - i))) for i, h in enumerate(hashes)]
    return reduce(lambda a, b: a.bitwiseXOR(b), turned)


def _packed(value: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value, 64 - ORDER_BITS), PLACE_BITS) + (F.lit(LAST_PLACE) - place.cast("long"))


def _tokens(text: Column) -> Column:
    def tiles(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(f"\\S{{1,{TOKEN_CHARS}}}"), F.lit(0))

    def rolling(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(f"(?=(\\S{{{TOKEN_CHARS}}}))\\S"), F.lit(1))

    runs = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > LONG_RUN, rolling(r)).otherwise(tiles(r))))
    # most texts have no long run: they are not cut into runs first
    return F.when(text.rlike(f"(?<!\\S)\\S{{{LONG_RUN + 1}}}"), cut).otherwise(tiles(text))


def with_fingerprint(df: DataFrame, text: Column, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df with the array columns `name` and `<name>_at`: the hashes that winnowing keeps and their places, in order of place.

    A text of fewer than `gram` tokens has one gram, all of them; with fewer than `window` grams there is one window; an
    empty or null text has no fingerprint."""
    tokens = _tokens(F.coalesce(text, F.lit("")))
    df = df.withColumn("_hashes", F.transform(tokens, lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    grams = F.transform(F.sequence(F.lit(0), n - gram), lambda i: rolling([F.get(F.col("_hashes"), i + j) for j in range(gram)]))
    df = df.withColumn("_grams", F.when(n >= gram, grams).when(n > 0, F.array(F.xxhash64("_hashes"))).otherwise(F.array().cast("array<long>"))).drop("_hashes")
    df = df.withColumn("_packed", F.transform("_grams", _packed))
    m = F.size("_packed")
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), m - (window - 1)), lambda i: F.array_min(F.slice(F.col("_packed"), i, F.lit(window)))))
    chosen = F.when(m > window, chosen).when(m > 0, F.array(F.array_min("_packed"))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(f"{name}_at", F.transform(chosen, lambda x: (F.lit(LAST_PLACE) - x.bitwiseAND(F.lit(LAST_PLACE))).cast("int"))).drop("_packed")
    return df.withColumn(name, F.transform(f"{name}_at", lambda i: F.get(F.col("_grams"), i))).drop("_grams")


def written(name: str) -> Column:
    """hash:position pairs, comma-joined, hashes in hexadecimal."""
    return F.array_join(F.zip_with(name, f"{name}_at", lambda h, i: F.concat(F.lower(F.hex(h)), F.lit(":"), i.cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def in_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) dealt into ranges of their order, and the order inside a range; to each range is added, as its last
    row, the row that follows it (`_extra`): the first of the next range, and for the last range the first of all.

    What is learned beforehand are the first doc_id of each range, which takes one pass over doc_ids, and its text."""
    ranged, order = in_ranges(docs, 4 * shuffle_partitions(docs.sparkSession))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    firsts = stage_table(ranged.groupBy("_range").agg(F.min(place)["doc_id"].alias("first_doc")), "range-firsts")
    firsts = firsts.withColumnRenamed("_range", "of_range")
    heads = ranged.join(sent_if_small(firsts), (F.col("_range") == F.col("of_range")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    heads = heads.groupBy("_range").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text", "doc_id")).alias("head"))
    heads = stage_table(heads.select("_range", "head.doc_id", "head.text"), "range-heads")
    by_range = Window.orderBy("_range")  # one row a range
    before = heads.select("_range", F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(Window.partitionBy())).alias("_before"))
    extra = heads.join(sent_if_small(stage_table(before, "ranges")), "_range").select("doc_id", "text", F.col("_before").alias("_range"), F.lit(True).alias("_extra"))
    rows = ranged.select("doc_id", "text", "_range", F.lit(False).alias("_extra")).union(extra)
    return rows, Window.partitionBy("_range").orderBy("_extra", *order)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The result of op8 for every row of docs: fingerprints of each text and of its edited text, and their likenesses.

    Defined cases: null texts are empty; rows with equal doc_id follow each other in order of a hash of the text, rows with a
    null doc_id come last; a single row is followed by itself. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, order = in_order(docs)
    rows = with_fingerprint(rows.repartition("_range"), F.col("text"), "prints")
    rows = rows.withColumn("next", F.lead(F.struct("text", F.array_distinct("prints").alias("prints"))).over(order)).where("NOT _extra")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "prints", "prints_at", F.col("next.prints").alias("next_prints"), edited.alias("edited"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "edited_prints").drop("edited")
    rows = rows.select("*", F.array_distinct("prints").alias("a"), F.array_distinct("edited_prints").alias("b"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written("prints").alias("fingerprint"), written("edited_prints").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "next_prints").alias("near_next")
    )


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
