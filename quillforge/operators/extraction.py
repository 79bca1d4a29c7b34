"""Values of dictionary fields in segments of documents: one automaton finds the aliases of all fields in one pass over a text,
whatever their number; a typed matcher then reads the value beside an alias, with a confidence by how it was read."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far a value stands from its alias at most.
REACH = 60
#: How many segments a task keeps what they state of, and how long they are at most: equal ones are read once.
KNOWN, KNOWN_LENGTH = 1 << 14, 400
# Words that state whether something is there.
YES, NO = ("yes", "standard", "included", "✓", "●"), ("no", "none", "not available", "without", "✗")
OPTIONAL = ("optional", "option")
_NUMBER = re.compile(r"(?<![\w.,])[0-9]{1,3}(?:[,.  ][0-9]{3})+(?:[.,][0-9]{1,2})?(?![\w])|(?<![\w.,])[0-9]+(?:[.,][0-9]+)?")
_TYRE = re.compile(r"\b([1-3][0-9][05])\s*/\s*([2-9][05])\s*(?:zr|r|-)?\s*([12][0-9])\b")
_PRICE = re.compile(r"(?:([$€£₪])\s*([0-9][0-9.,]*)|([0-9][0-9.,]*)\s*([$€£₪]|eur\b|usd\b|gbp\b))")
_CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "₪": "ILS", "eur": "EUR", "usd": "USD", "gbp": "GBP"}


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)")


_one_word = functools.lru_cache(maxsize=1 << 14)(_words)
_STATED = (_words(*NO), _words(*OPTIONAL), _words(*YES))
_DENIED = re.compile(r"(?<!\w)(?:no|without|not)\s+$")


class Field(NamedTuple):
    """A field: its aliases; numeric, boolean, enum, tyre or price; for numbers the factors of the units that it accepts into
    its own, and the plausible range; for enums each word's value."""

    name: str
    matcher: str
    aliases: tuple[str, ...]
    units: dict[str, float] = {}
    values: dict[str, str] = {}
    low: float = float("-inf")
    high: float = float("inf")


def number(text: str) -> float | None:
    """A number as texts write it: a group of three digits behind a separator is thousands, anything else a decimal part."""
    bare = re.sub(r"[  ]", "", text).rstrip(".,")
    head, *groups = re.split(r"[.,]", bare)
    if not head:
        return None
    if groups and len(groups[-1]) != 3:
        return float("".join([head, *groups[:-1]]) + "." + groups[-1])
    return float("".join([head, *groups]))


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(round(x, 6))


class _Dictionary:
    def __init__(self, fields: tuple[Field, ...]):
        import ahocorasick

        self.fields = fields
        self.aliases = ahocorasick.Automaton()
        listed: dict[str, list[int]] = {}
        for i, f in enumerate(fields):
            for alias in f.aliases:
                listed.setdefault(" ".join(alias.lower().split()), []).append(i)
        for alias, owners in listed.items():
            self.aliases.add_word(alias, (len(alias), owners))
        self.aliases.make_automaton()
        self.longest = max(map(len, listed), default=0)
        units = sorted({u.lower() for f in fields for u in f.units}, key=lambda u: (-len(u), u))
        one = "(" + "|".join(map(re.escape, units)) + r")(?!\w)"
        self.unit, self.named_unit = (re.compile(r"\s*" + one), re.compile(r"(?<!\w)" + one)) if units else (None, None)

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, field) of the aliases that stand as whole words; one inside a longer one is that one's."""
        found = []
        for last, (size, owners) in self.aliases.iter(text) if len(self.aliases) else ():
            a, b = last - size + 1, last + 1
            if (a and (text[a - 1].isalnum() and text[a].isalnum())) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()):
                continue
            found.append((a, b, owners))
        found.sort(key=lambda h: (h[0], -h[1]))
        kept, reach = [], -1
        for a, b, owners in found:  # sorted by start, the longer first: what ends inside what came before lies inside it
            if b > reach:
                kept += [(a, b, i) for i in owners]
                reach = b
        return kept

    def measured(self, f: Field, text: str, m: re.Match) -> tuple[str, str | None, bool] | None:
        """The value in the field's unit, the stated unit, whether it was converted; None if it can't be the field's."""
        value = number(m.group())
        unit = self.unit.match(text, m.end()) if self.unit else None
        name = unit.group(1) if unit else None
        if value is None or name is not None and f.units and name not in f.units:
            return None
        factor = f.units.get(name, 1.0) if name else 1.0
        return (_shown(value * factor), name, factor != 1.0) if f.low <= value * factor <= f.high else None

    def read(self, f: Field, text: str, structured: bool, before: str = "") -> tuple[str, str | None, float] | None:
        """(value, unit, confidence) of the first value of the field in a text that begins behind its alias."""
        base = 0.9 if structured else 0.8
        if f.matcher == "numeric":
            for m in _NUMBER.finditer(text):
                got = self.measured(f, text, m)
                if got:
                    stated = 0.95 if structured else 0.85
                    missing = 0.8 if structured else 0.55
                    return got[0], got[1], (stated if got[1] or not f.units else missing) - 0.05 * got[2]
                return None  # the nearest number is another field's
        elif f.matcher == "boolean":
            first = min(((m.start(), k) for k, words in enumerate(_STATED) if (m := words.search(text))), default=None)
            if first:
                return ("false", None, base) if first[1] == 0 else ("true", None, base - 0.15 * (first[1] == 1))
            if _DENIED.search(before):
                return "false", None, 0.75
        elif f.matcher == "enum":
            found = sorted((m.start(), -len(w), v) for w, v in f.values.items() for m in _one_word(w.lower()).finditer(text))
            if found:
                return found[0][2], None, base - 0.2 * (len({v for _, _, v in found}) > 1)
        elif f.matcher == "tyre" and (m := _TYRE.search(text)):
            return f"{m.group(1)}/{m.group(2)} R{m.group(3)}", None, base
        elif f.matcher == "price" and (m := _PRICE.search(text)):
            value = number(m.group(2) or m.group(3))
            if value is not None and f.low <= value <= f.high:
                return _shown(value), _CURRENCY[m.group(1) or m.group(4)], base
        return None

    def in_line(self, text: str) -> Iterator[tuple]:
        """(field, value, unit, method, confidence, start, end) of a line of text in lower case."""
        hits = self.hits(text)
        read: set[tuple[int, str]] = set()
        for k, (a, b, i) in enumerate(hits):
            end = min([len(text), b + REACH, *(h[0] for h in hits[k + 1 : k + 2] if h[0] >= b)])
            got = self.read(self.fields[i], text[b:end], False, text[max(0, a - 12) : a])
            if got:
                read.add((i, got[0]))
                yield i, *got[:2], "label", got[2], a, end
        if not self.unit or not hits:
            return
        starts = [h[0] for h in hits]
        for m in _NUMBER.finditer(text):
            unit = self.unit.match(text, m.end())
            if not unit:
                continue
            around = hits[bisect.bisect_left(starts, m.start() - REACH - self.longest) : bisect.bisect_right(starts, unit.end() + REACH)]
            near = [h for h in around if (0 <= m.start() - h[1] <= REACH or 0 <= h[0] - unit.end() <= REACH)]
            if len({h[2] for h in near}) == 1 and self.fields[near[0][2]].matcher == "numeric" and self.fields[near[0][2]].units:
                i = near[0][2]
                got = self.measured(self.fields[i], text, m)
                if got and got[1] and (i, got[0]) not in read:
                    read.add((i, got[0]))
                    a = min(min(h[0] for h in near), m.start())
                    yield i, got[0], got[1], "unit", 0.6 - 0.05 * got[2], a, max(max(h[1] for h in near), unit.end())

    def in_pair(self, label: str, value: str) -> Iterator[tuple]:
        for i in dict.fromkeys(h[2] for h in self.hits(label)):
            got = self.read(self.fields[i], value, True)
            if got and got[1] is None and self.fields[i].units and (u := self.named_unit.search(label)):
                got = self.read(self.fields[i], f"{_NUMBER.search(value).group()} {u.group(1)}", True)  # the unit stands with the label
            if got:
                yield i, *got[:2], "pair", got[2], 0, len(value)


def extract(segments: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """key, segment, field, value, unit, method, confidence, quote: what the segments (key, segment, label, value, text) of a
    document state about the fields.

    A segment with a label is a pair: its label names the field, its value is read as the field's type (confidence 0.95 for a
    number with its unit, 0.8 without, 0.9 for other types). Else its text is read line by line: the value that follows an
    alias before the next one, within REACH characters (0.85, 0.55, 0.8); and a number with a unit that one field's alias
    alone stands near, before or behind (0.6). Converted numbers lose 0.05, enums with several values 0.2, options 0.15; a
    feature named behind "no" or "without" is false (0.75). Numbers outside a field's range are no values. Null segments state
    nothing. The aliases of all fields are one automaton, so a text is read once whatever their number."""
    wanted = tuple(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _Dictionary(wanted)

        def read(label: str | None, value: str | None, text: str | None) -> list[tuple]:
            if label is not None:
                found = [(f, value) for f in dictionary.in_pair(" ".join(label.lower().split()), (value or "").lower())]
            else:
                lines = [" ".join(line.split()) for line in (text or "").splitlines()]
                found = [(f, (line if len(line) == len(line.lower()) else line.lower())[f[5] : f[6]]) for line in lines for f in dictionary.in_line(line.lower())]
            return [(wanted[f[0]].name, f[1], f[2], f[3], round(f[4], 2), q) for f, q in found]

        known = functools.lru_cache(maxsize=KNOWN)(read)
        for batch in batches:
            out = []
            for k, segment, *said in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                stated = known if sum(len(x) for x in said if x) <= KNOWN_LENGTH else read
                out += [(k, segment, *f) for f in stated(*said)]
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.string()] * 4, pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "segment", "field", "value", "unit", "method", "confidence", "quote"])

    kinds = dict(segments.dtypes)
    return segments.select(key, "segment", "label", "value", "text").mapInArrow(run, f"`{key}` {kinds[key]}, segment {kinds['segment']}, field string, value string, unit string, method string, confidence double, quote string")


def best_statement(found: DataFrame, key: str) -> DataFrame:
    """One row for each key, field and value: the statement of highest confidence, then the earliest segment, with their number."""
    order = Window.partitionBy(key, "field", "value").orderBy(F.desc("confidence"), "segment", "method", "quote")
    every = Window.partitionBy(key, "field", "value")
    return found.withColumn("statements", F.count("*").over(every)).withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")
