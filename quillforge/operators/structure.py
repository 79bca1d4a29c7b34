"""Label/value pairs that the structure of a page states, and blocks of lines that state one.

A page is parsed once into rows, one an element, in page order; navigation, hidden parts and scripts are left out there. What
is a pair, how often its kind repeats, and which heading stands above it are read from those rows by ordinary operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is no content, by tag, role, and word of a class or id; and which tags no such word removes.
NOISE = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "nav", "footer", "header")
ROLES = ("navigation", "menu", "menubar", "banner", "contentinfo")
CHROME = ("menu", "breadcrumb", "footer", "header", "cookie", "consent")
EXEMPT = ("html", "body", "main", "table", "thead", "tbody", "tfoot", "tr", "th", "td")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("div", "p", "li", "ul", "ol", "table", "section", "article", "dl", "dt", "dd", "tr", "tbody", "thead", "h1", "h2", "h3", "h4", "h5", "h6", "form", "aside", "main", "figure", "header", "footer", "nav")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LABEL, VALUE, HEADING = 80, 120, 120
#: Characters of an element's text that are kept: more than a pair may have, so that longer ones are told apart.
KEPT = LABEL + VALUE + 5
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CONSENT = re.compile(r"cookie|consent|gdpr|onetrust|cookiebot", re.I)


def _left_out(tag: str, attrs: dict[str, str | None]) -> bool:
    if tag in NOISE or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return True
    marker = f"{attrs.get('id') or ''} {attrs.get('class') or ''}"
    if _CONSENT.search(marker) or set((attrs.get("role") or "").lower().split()) & set(ROLES):
        return True
    words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", marker).lower())
    return tag not in EXEMPT and any(w.startswith("nav") or w.endswith("nav") or any(c in w for c in CHROME) for w in words)


class _Tree(HTMLParser):
    """Elements as [parent, tag, classes, child tags, has own text, has a block inside, in a table, pieces of text, their length].

    An end tag closes the nearest open element of its name, and one of none is ignored. Of texts the first pieces are kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.dead = 0  # open elements inside one that is left out
        self.stack: list[tuple[str, int | None]] = []

    def handle_starttag(self, tag, attrs):
        out = self.dead or _left_out(tag, dict(attrs))
        if tag in VOID:
            if not out and self.open:
                self.nodes[self.open[-1]][3].append(tag)
            return
        if out:
            self.dead += 1
            self.stack.append((tag, None))
            return
        parent = self.open[-1] if self.open else None
        if parent is not None:
            self.nodes[parent][3].append(tag)
        if tag in BLOCKS:
            for i in reversed(self.open):
                if self.nodes[i][5]:
                    break
                self.nodes[i][5] = True
        in_table = parent is not None and (self.nodes[parent][6] or self.nodes[parent][1] == "table")
        self.nodes.append([parent, tag, sorted((dict(attrs).get("class") or "").split()), [], False, False, in_table, [], 0])
        self.open.append(len(self.nodes) - 1)
        self.stack.append((tag, self.open[-1]))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, node = self.stack.pop()
            if node is None:
                self.dead -= 1
            else:
                self.open.pop()
            if t == tag:
                return

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.dead or not text or not self.open:
            return
        self.nodes[self.open[-1]][4] = True
        for i in self.open:
            if self.nodes[i][8] <= KEPT:
                self.nodes[i][7].append(text[: KEPT + 1])
                self.nodes[i][8] += len(text) + 1


def page_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, node, parent, tag, signature, n_children, own_text, has_block, in_table, text of every element that is content, numbered
    in page order. The text is all that stands inside, white space collapsed, cut behind KEPT characters; the signature is
    the tag with its classes and the tags of its children. Null pages have no elements; broken ones those that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(10)]
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = _Tree()
                tree.feed(page or "")
                tree.close()
                for i, (parent, tag, classes, children, own, block, in_table, text, _) in enumerate(tree.nodes):
                    row = (k, i, parent, tag, f"{tag}.{'.'.join(classes)}>{','.join(children)}", len(children), own, block, in_table, " ".join(text)[:KEPT])
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "node", "parent", "tag", "signature", "n_children", "own_text", "has_block", "in_table", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, node int, parent int, tag string, signature string, n_children int, own_text boolean, has_block boolean, in_table boolean, text string")


def _as_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "[:：]+$", ""))


def _pair(label: Column, value: Column) -> Column:
    return (label != "") & (value != "") & (F.length(label) <= LABEL) & (F.length(value) <= VALUE) & (label != value)


def page_pairs(elements: DataFrame, key: str, least: int = 3, known: Column | None = None) -> DataFrame:
    """key, place, kind, label, value, heading, repeated: what the elements (of page_elements) of a page state as label and value.

    definition_list: a dd under the dt before it. two_column: an element of exactly two children with short texts and none of
    its own. split: "label: value", also with a dash between blanks or a bar, in one element without blocks, unless it is a
    half of a two-column one. Nothing inside tables, which have cells. The last two count where at least `least` siblings have
    the same signature, or where `known` (a condition on `label`) holds. Each (label, value) of a page once, lists first, then
    in page order; heading is the last one before it."""
    page = Window.partitionBy(key).orderBy("node")
    e = elements.withColumn("heading", F.last(F.when(F.col("tag").isin(*HEADINGS), F.substring("text", 1, HEADING)), ignorenulls=True).over(page))
    # each element stands in the family of its parent, and at the head of its own; all windows are inside a page, so that pages
    # are dealt out once and nothing is joined
    own = F.struct("tag", "heading", "signature", "parent", "n_children", "own_text", "in_table")
    places = F.array(F.struct(F.col("parent").alias("_family"), F.lit(None).cast(e.select(own).schema[0].dataType).alias("_head")), F.struct(F.col("node").alias("_family"), own.alias("_head")))
    e = e.select("*", F.explode(F.when(F.col("n_children") > 0, places).otherwise(F.slice(places, 1, 1))).alias("_place")).select(*e.columns, "_place.*")
    is_head = F.col("_head").isNotNull()
    siblings = Window.partitionBy(key, "_family").orderBy(is_head.desc(), "node")
    family = siblings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # halves of two-column elements, and the terms of lists, in the parent's own order
    term = F.last(F.when(~is_head & (F.col("tag") == "dt"), _as_label(F.col("text"))), ignorenulls=True).over(siblings)
    parent = F.when(F.col("_family").isNotNull(), F.first("_head", ignorenulls=True).over(siblings))
    e = e.withColumn("_term", term).withColumn("_next", F.lead("text").over(siblings)).withColumn("_next_tag", F.lead("tag").over(siblings)).withColumn("_first", F.coalesce(F.lag(is_head).over(siblings), F.lit(False))).withColumn("_parent", parent)
    lists = ("ul", "ol", "table", "dl")
    value_of = lambda c: F.trim(c)
    above = F.col("_parent")
    two = F.coalesce((above["n_children"] == 2) & ~above["own_text"] & ~above["in_table"] & ~above["tag"].isin("tr", "table", "tbody", "thead", "dl", "dt", "dd"), F.lit(False))
    half = two & F.col("_first") & F.col("_next").isNotNull() & ~F.col("tag").isin(*lists) & ~F.col("_next_tag").isin(*lists) & _pair(_as_label(F.col("text")), value_of(F.col("_next")))
    e = e.withColumn("_half", ~is_head & F.coalesce(half, F.lit(False)))
    # of a two-column element, and of what stands in it, its pair is all that counts
    e = e.withColumn("_halves", F.max("_half").over(family))
    mine = Window.partitionBy(key, "node")
    e = e.withColumn("_whole", F.coalesce(F.max(F.when(is_head, F.col("_halves"))).over(mine), F.lit(False))).where(~is_head)
    in_half = F.col("parent").isNotNull() & F.col("_halves")
    defined = (F.col("tag") == "dd") & (above["tag"] == "dl") & F.col("_term").isNotNull()
    form = rf"(?s)^([^:|–—]{{1,{LABEL}}}?)\s*(?::|\s[–—-]\s|\s\|\s)\s*(\S.{{0,{VALUE - 1}}})$"
    blocks = [b for b in BLOCKS if b not in ("div", "p", "li")]
    single = ~F.col("tag").isin(*blocks) & ~F.col("in_table") & ~F.col("has_block") & (F.length("text") < KEPT) & F.col("text").rlike(form) & ~in_half & ~F.col("_whole")

    def stated(kind: str, node: str, of: Column, label: Column, value: Column, heading: Column, signature: Column) -> Column:
        columns = {"node": F.col(node), "parent": of, "kind": F.lit(kind), "label": label, "value": value, "heading": heading, "signature": signature}
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    text = F.col("text")
    pairs = [
        F.when(defined, stated("definition_list", "node", F.col("parent"), F.col("_term"), value_of(text), above["heading"], F.lit("dl"))),
        F.when(F.col("_half"), stated("two_column", "parent", above["parent"], _as_label(text), value_of(F.col("_next")), above["heading"], above["signature"])),
        F.when(single, stated("split", "node", F.col("parent"), _as_label(F.regexp_extract(text, form, 1)), value_of(F.regexp_extract(text, form, 2)), F.col("heading"), F.col("signature"))),
    ]
    found = e.where(defined | F.col("_half") | single).select(key, F.explode(F.array_compact(F.array(*pairs))).alias("p")).select(key, "p.*").where(_pair(F.col("label"), F.col("value")))
    alike = F.count("*").over(Window.partitionBy(key, "parent", "signature"))
    found = found.withColumn("repeated", (F.col("kind") == "definition_list") | (alike >= least))
    found = found.where(F.col("repeated") | known if known is not None else F.col("repeated"))
    order = [(F.col("kind") != "definition_list").cast("int"), F.col("node")]
    same = Window.partitionBy(key, F.lower("label"), F.lower("value")).orderBy(*order)
    once = found.withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("place"), "kind", "label", "value", "heading", "repeated")


UNIT_LINE = r"^\(\s*[^()0-9]{1,25}\s*\)$"


def line_blocks(docs: DataFrame, key: str, text: str, short: int = 40, description: int = 40, ahead: int = 5) -> DataFrame:
    """key, line, label, unit, value: specifications written over several lines: a short label, within `ahead` lines an optional
    unit in brackets, the label again, and at least one description of `description` characters, then a short value.

    A label that stands in one of the two lines before is their repetition, none of its own. Lines are trimmed, and blank ones
    do not count; they are compared in lower case."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = docs.select(key, lines.alias("_lines")).where(F.size("_lines") > 2)

    def at(i: Column) -> Column:
        quote = F.get(F.col("_lines"), i)
        low = F.lower(quote)
        is_unit = lambda x: x.rlike(UNIT_LINE)
        start = F.struct(F.lit(None).cast("string").alias("unit"), F.lit(False).alias("described"), F.lit(False).alias("stopped"), F.lit(0).alias("used"))

        def step(s: Column, x: Column) -> Column:
            unit = is_unit(x) & s["unit"].isNull() & ~s["described"]
            again = (F.lower(x) == low) & ~s["described"]
            prose = F.length(x) >= description
            go = ~s["stopped"] & (unit | again | prose)
            return F.struct(
                F.when(go & unit, x).otherwise(s["unit"]).alias("unit"), (s["described"] | (go & ~unit & ~again)).alias("described"), (s["stopped"] | ~(unit | again | prose)).alias("stopped"), (s["used"] + go.cast("int")).alias("used")
            )

        read = F.aggregate(F.slice(F.col("_lines"), i + 2, ahead), start, step)
        return F.struct(i.alias("line"), quote.alias("label"), read.alias("read"), F.coalesce(F.lower(F.get(F.col("_lines"), i - 1)) == low, F.lit(False)).alias("one"), F.coalesce(F.lower(F.get(F.col("_lines"), i - 2)) == low, F.lit(False)).alias("two"))

    found = rows.select(key, "_lines", F.explode(F.transform(F.sequence(F.lit(0), F.size("_lines") - 1), at)).alias("b")).select(key, "b.*", F.get("_lines", F.col("b.line") + 1 + F.col("b.read.used")).alias("value"))
    is_label = F.length("label").between(2, short) & F.lower("label").rlike(r"\p{L}") & ~F.col("label").rlike(UNIT_LINE) & ~F.col("one") & ~F.col("two")
    is_value = F.col("value").isNotNull() & (F.length("value") <= short) & ~F.col("value").rlike(UNIT_LINE) & (F.lower("value") != F.lower("label"))
    return found.where(is_label & F.col("read.described") & is_value).select(key, "line", "label", F.col("read.unit").alias("unit"), "value")
