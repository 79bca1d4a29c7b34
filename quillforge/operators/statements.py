"""What a text states, and where: hits in context, clauses, years, dates, durations, and the JSON that carries statements.

Positions count characters from 0. Built-in functions do all of it, except windows around the words of a query, whose choice
depends on those chosen before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.text import script_share


def hits_in_context(docs: DataFrame, key: str, text: str, pattern: str, before: int, after: int, excluded: list[str], required: list[str], ambiguous: list[str]) -> DataFrame:
    """key, place, value, verdict for each number that `pattern` (one group) finds: excluded if a word against it stands within
    `before` characters before or `after` behind, unclear with an ambiguous word and none that supports it, unsupported
    without such a word at all, else accepted. The first that applies, in the order excluded, unclear, unsupported."""
    values = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    wholes = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = docs.select(key, F.split(F.col(text), pattern, -1).alias("_between"), F.arrays_zip(values.alias("v"), wholes.alias("w")).alias("_hits")).where(F.size("_hits") > 0)
    rows = rows.select(key, "_between", F.posexplode("_hits").alias("place", "h"))
    left, right = F.get("_between", F.col("place")), F.get("_between", F.col("place") + 1)
    near = F.lower(F.concat(F.substring(left, F.greatest(F.length(left) - before + 1, F.lit(1)), F.lit(before)), F.lit(" "), F.col("h.w"), F.lit(" "), F.substring(right, F.lit(1), F.lit(after))))
    has = lambda words: near.rlike("(^|[^a-z0-9])(" + "|".join(words) + ")($|[^a-z0-9])") if words else F.lit(False)
    verdict = F.when(has(excluded), "excluded").when(has(ambiguous) & ~has(required), "unclear").when(~has(required), "unsupported").otherwise("accepted")
    return rows.select(key, "place", F.col("h.v").alias("value"), verdict.alias("verdict"))


def clause_around(text: Column, at: Column, breaks: str) -> Column:
    """struct(start, end, clause): the part of text around place `at`, between the nearest breaks (characters) before it and from
    it on. Outside the text, or without a place, the whole text."""
    whole = F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("clause"))
    head, tail = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    start = F.length(head) - F.length(F.regexp_extract(head, f"([^{breaks}]*)$", 1))
    end = at + F.length(F.regexp_extract(tail, f"^([^{breaks}]*)", 1))
    part = F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("clause"))
    return F.when(at.isNull() | (at < 0) | (at >= F.length(text)), whole).otherwise(part)


def stated_years(text: Column, first: int, last: int) -> Column:
    """The years from first to last that text states, once, ascending. Years in ranges ("1999-2004"), prices and longer numbers
    do not count."""
    bare = F.regexp_replace(text, r"(^|[^0-9])(?:19|20)[0-9]{2} ?[-/–] ?(?:19|20)[0-9]{2}($|[^0-9])", "$1 $2")
    bare = F.regexp_replace(bare, r"[$€£₪] ?[0-9][0-9.,]*|[0-9][0-9.,]* ?[$€£₪%]|[0-9]*[.,][0-9]+", " ")
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(bare, "[^0-9]+", "  "), F.lit(" ")), F.lit(" ((?:19|20)[0-9]{2}) "), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(first, last))))


def document_date(structured: Column, meta: Column, url: Column, text: Column) -> Column:
    """struct(date, source): the first that is a real date: the structured publication date, the meta date, a year/month/day
    directory of the address, and failing these the first line of the text that is a date by itself."""
    iso = lambda c: F.try_to_date(F.regexp_extract(c, "^ *([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    path = F.regexp_extract(url, "^[a-z]+://[^/]+([^?#]*)", 1)
    folder = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(path, "/((?:19|20)[0-9]{2})/([0-9]{2})/([0-9]{2})(?:/|$)", i) for i in (1, 2, 3)]), "yyyy-MM-dd")
    line = F.try_to_date(F.regexp_extract(text, "(?m)^ *([0-9]{4}-[0-9]{2}-[0-9]{2}) *$", 1), "yyyy-MM-dd")
    found = [(iso(structured), "structured"), (iso(meta), "meta"), (folder, "url"), (line, "text")]
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(name).alias("source"))) for d, name in found])


def warranty(text: Column) -> Column:
    """struct(years, km, unlimited) of the first warranty: "5 years / 100,000 km", "36 months, unlimited mileage". Months are
    years if whole; a part that is not stated is null; null without any duration."""
    low = F.lower(text)
    years = F.regexp_extract(low, "([0-9]{1,2}) ?(?:years?|yrs?)", 1).try_cast("int")
    months = F.regexp_extract(low, "([0-9]{1,3}) ?months?", 1).try_cast("int")
    whole = F.coalesce(years, F.when(months % 12 == 0, (months / 12).cast("int")))
    km = F.regexp_replace(F.regexp_extract(low, "([0-9]{1,3}(?:[,.]?[0-9]{3})+) ?km", 1), "[,.]", "").try_cast("int")
    unlimited = low.rlike("unlimited (?:km|mileage|kilomet)")
    return F.when(whole.isNotNull(), F.struct(whole.alias("years"), F.when(~unlimited, km).alias("km"), unlimited.alias("unlimited")))


def chunk(text: Column, offset: int, most: int) -> Column:
    """struct(part, offset, total, next): a piece of a text and where the next one begins (null at the end)."""
    end = F.least(F.length(text), F.lit(offset + most))
    return F.struct(F.substring(text, offset + 1, most).alias("part"), F.lit(offset).alias("offset"), F.length(text).alias("total"), F.when(end < F.length(text), end).alias("next"))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no white space; null if the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def lenient_json(text: Column) -> Column:
    """The JSON in a model's text, canonical: the first that parses of the whole text, each code fence in order, and what stands
    from the first opening brace to the last closing one; null if none does."""
    fences = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tried = F.concat(F.array(text), fences, F.array(braces))
    parsed = F.transform(F.transform(tried, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: F.when(t != "", canonical_json(t)))
    return F.get(F.filter(parsed, lambda t: t.isNotNull()), F.lit(0))


def without_empty(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields, without those that are null or blank."""
    return F.to_json(F.struct(*[F.when(F.length(F.trim(c.cast("string"))) > 0, c).alias(name) for name, c in fields.items()]))


def find_words(docs: DataFrame, key: str, text: str, query: str, context: int, most: int) -> DataFrame:
    """key, offset, score, snippet: where a document has the query, at most `most` places.

    Places of the whole query, one after another, score 1. Only without any: windows of `context` characters around its single
    words (two letters at least), scored by the share of the words inside, the best first and then the earliest; one within
    `context` of a chosen one is left out. The snippet reaches `context` characters to both sides."""
    low = query.lower().strip()
    words = [w for w in low.split() if len(w) > 1]
    kind = docs.schema[key].dataType.simpleString()

    def places(body: str) -> list[tuple[int, int, float]]:
        out, at = [], body.find(low) if low else -1
        while at >= 0 and len(out) < most:
            out.append((at, len(low), 1.0))
            at = body.find(low, at + len(low))
        if out:
            return out
        windows = []
        for w in words:
            at = body.find(w)
            while at >= 0:
                inside = body[max(0, at - context) : at + len(w) + context]
                windows.append((-sum(x in inside for x in words) / len(words), at, len(w)))
                at = body.find(w, at + len(w))
        for share, at, size in sorted(windows):
            if len(out) < most and all(abs(at - other) > context for other, _, _ in out):
                out.append((at, size, -share))
        return sorted(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, at, round(score, 2), t[max(0, at - context) : at + size + context]) for k, t in zip(batch[key], batch[text], strict=True) if t for at, size, score in places(t.lower())]
            yield pd.DataFrame(rows, columns=[key, "offset", "score", "snippet"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, offset long, score double, snippet string")


def value_owners(docs: DataFrame, key: str, text: str, labels: str, values: str) -> DataFrame:
    """key, place, value, owner: each value (a pattern without groups) in order of its place, with the nearest label that stands
    before it in the text; null before the first label. A text is scanned once, for labels and values together."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?:{labels})|(?:{values})"), F.lit(0))).alias("at", "token"))
    is_label = F.col("token").rlike(f"^(?:{labels})$")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.withColumn("owner", F.last(F.when(is_label, F.lower("token")), ignorenulls=True).over(w)).where(~is_label)
    return owned.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("place"), F.col("token").alias("value"), "owner")


def dictionary_values(docs: DataFrame, key: str, text: str, dictionary: dict[str, dict[str, str]]) -> DataFrame:
    """key, field, value, at: for each field the value of its alias that stands first in the text (the longer of two at one
    place), from 1. Aliases are compared in lower case, as they stand."""
    low = F.lower(F.col(text))
    fields = []
    for field, aliases in dictionary.items():
        hits = F.array(*[F.struct(F.locate(a, low).alias("at"), F.lit(-len(a)).alias("size"), F.lit(v).alias("value")) for a, v in aliases.items()])
        fields.append(F.struct(F.lit(field).alias("field"), F.array_min(F.filter(hits, lambda h: h["at"] > 0)).alias("hit")))
    rows = docs.select(key, F.explode(F.filter(F.array(*fields), lambda f: f["hit"].isNotNull())).alias("f"))
    return rows.select(key, "f.field", "f.hit.value", "f.hit.at")


def market(url: Column, text: Column, tlds: dict[str, str], paths: dict[str, str], letters: dict[str, str], least: float) -> Column:
    """struct(market, by): from the top-level domain, else the first path segment, else the script that holds at least `least` of
    the text's letters; the first that tells. letters: a market and its character class."""
    name = F.regexp_extract(F.lower(url), "^[a-z]+://([^/:?#]+)", 1)
    tld, segment = F.regexp_extract(name, "[.]([a-z]+)$", 1), F.regexp_extract(F.lower(url), "^[a-z]+://[^/]+/([a-z-]+)(?:/|$)", 1)
    pick = lambda c, table: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])
    scripts = F.coalesce(*[F.when(script_share(text, chars) >= least, F.lit(m)) for m, chars in letters.items()])
    return F.coalesce(*[F.when(m.isNotNull(), F.struct(m.alias("market"), F.lit(by).alias("by"))) for m, by in ((pick(tld, tlds), "tld"), (pick(segment, paths), "path"), (scripts, "text"))])


def line_pairs(docs: DataFrame, key: str, text: str, longest: int = 40) -> DataFrame:
    """key, line_no, label, value of lines "label: value": the label is what stands before the first colon, at most `longest`
    characters, and begins with a letter; both are trimmed and not blank."""
    form = rf"^\s*([A-Za-z][^:]{{0,{longest - 1}}}?)\s*:\s*(\S.*?)\s*$"
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.col("line").rlike(form))
    return lines.select(key, "line_no", F.regexp_extract("line", form, 1).alias("label"), F.regexp_extract("line", form, 2).alias("value"))


def table_columns(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row_no, label, column, value of ragged tables given as cells (key, row_no, col_no, cell).

    The header is the first row with two or more cells that are not blank and no number. A column is named by its header cell;
    the first column labels the rows below. Cells without a header, blank cells and all rows above it are left out."""
    c = cells.withColumn("_cell", F.nullif(F.trim("cell"), F.lit("")))
    number = F.col("_cell").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    rows = c.groupBy(*key, "row_no").agg(F.count("_cell").alias("_n"), F.count_if(number).alias("_numbers"))
    heads = rows.where("_n >= 2 AND _numbers = 0").groupBy(*key).agg(F.min("row_no").alias("_head"))
    below = c.join(heads, key)
    names = below.where("row_no = _head AND _cell IS NOT NULL").select(*key, "col_no", F.col("_cell").alias("column"))
    labels = below.where("row_no > _head AND col_no = 0").select(*key, "row_no", F.col("_cell").alias("label"))
    values = below.where("row_no > _head AND col_no > 0 AND _cell IS NOT NULL").select(*key, "row_no", "col_no", F.col("_cell").alias("value"))
    return values.join(names, [*key, "col_no"]).join(labels, [*key, "row_no"], "left").select(*key, "row_no", "label", "column", "value")
