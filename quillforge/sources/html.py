"""Reading HTML: built-in expressions for titles, links and visible text, and a DOM pass for tables and label/value pairs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named entities and what they stand for; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title(html: Column) -> Column:
    return F.trim(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def links(html: Column) -> Column:
    """The href values of all anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta element with this name or property, whichever attribute comes first; null without one."""
    first = F.regexp_extract(html, rf'(?is)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1)
    other = F.regexp_extract(html, rf'(?is)<meta\s+content="([^"]*)"\s+(?:name|property)="{name}"', 1)
    return F.nullif(unescaped(F.coalesce(F.nullif(first, F.lit("")), other)), F.lit(""))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page in canonical form, in page order; blocks that are no JSON are left out."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.array_compact(F.transform(blocks, lambda b: F.to_json(F.try_parse_json(b))))


def microdata(html: Column) -> Column:
    """"name=value" of elements with an itemprop: their content attribute, else their text up to the next tag."""
    pattern = r'(?is)<[a-z0-9]+\s[^>]*itemprop="([^"]*)"(?:[^>]*content="([^"]*)")?[^>]*>([^<]*)'
    part = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("c"), part(3).alias("t")), lambda x: F.concat(x["n"], F.lit("="), F.trim(F.when(x["c"] != "", x["c"]).otherwise(x["t"]))))


def absolute(link: Column, page_url: Column) -> Column:
    """A link as an absolute URL without fragment; null for other schemes."""
    origin = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    out = (
        F.when(link.rlike(r"^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page_url, r"^([a-z]+:)", 1), link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )
    return F.regexp_replace(out, "#.*$", "")


def visible_text(html: Column) -> Column:
    """The text without scripts, styles, comments and tags, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(text), r"[ \t\r\n]+", " "))


class _Cells(HTMLParser):
    """Rows of tables and definition lists, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[str]]] = []
        self.tables, self.text, self.row = 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "dl"):
            self.tables += 1
        if tag == "tr" or (tag == "dt" and self.row is None):
            self.row = []
        if tag in ("td", "th", "dt", "dd"):
            self.text = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "dt", "dd") and self.text is not None:
            if self.row is None:
                self.row = []
            self.row.append(" ".join("".join(self.text).split()))
            self.text = None
        if tag in ("tr", "dd") and self.row:
            self.rows.append((self.tables, self.row))
            self.row = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, col_no, cell of every table and definition list: ragged rows keep the cells they have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                if not page:
                    continue
                parser = _Cells()
                parser.feed(page)
                out += [(k, t, r, c, cell) for r, (t, row) in enumerate(parser.rows) for c, cell in enumerate(row)]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "col_no", "cell"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, table_no int, row_no int, col_no int, cell string")


def label_values(cells: DataFrame, key: str) -> DataFrame:
    """key, label, value of the rows with exactly two cells."""
    per = cells.groupBy(key, "table_no", "row_no").agg(F.count("*").alias("n"), F.max(F.when(F.col("col_no") == 0, F.col("cell"))).alias("label"), F.max(F.when(F.col("col_no") == 1, F.col("cell"))).alias("value"))
    return per.where("n = 2 AND label <> '' AND value <> ''").select(key, F.regexp_replace("label", r"\s*:$", "").alias("label"), "value")
