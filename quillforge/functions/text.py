"""Text and identity normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def value_shape(text: Column) -> Column:
    """Digits as 9, ASCII letters as a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")


def spelling(text: Column) -> Column:
    """Upper case, trimmed, white space collapsed."""
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for batch in batches:
        yield batch.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()).upper(), na_action="ignore")


def identity_text(text: Column) -> Column:
    """NFKC, trimmed, white space collapsed, upper case; blank is null. ASCII text needs no Python."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.nullif(F.when(ascii_only, spelling(text)).otherwise(_nfkc(F.when(~ascii_only, text))), F.lit(""))


def ascii_identity(text: Column) -> Column:
    """identity_text for columns that are known to be ASCII."""
    return F.nullif(spelling(text), F.lit(""))


# Legal forms, which end a maker's name, and words that say nothing of it.
LEGAL_FORMS = ("AG", "GMBH", "LTD", "INC", "CO", "CORP", "SPA", "SA", "SE", "KG", "NV", "BV", "PLC", "LLC")
FILLERS = ("THE", "GROUP", "MOTORS", "MOTOR", "AUTOMOBILES", "AUTOMOTIVE")


def make_key(text: Column, legal: tuple[str, ...] = LEGAL_FORMS, fillers: tuple[str, ...] = FILLERS) -> Column:
    """A maker's name without accents, points and apostrophes, up to the first token with a digit or legal form, joined; fillers
    are left out. Use it on distinct spellings and join the result back, as canonical_makers does."""

    @F.pandas_udf(StringType())
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        def key(s: str) -> str:
            bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper()
            out = []
            for token in bare.replace(".", "").replace("'", "").split():
                if any(c.isdigit() for c in token) or token in legal:
                    break
                if token not in fillers:
                    out.append("".join(c for c in token if c.isalnum()))
            return "".join(out)

        for batch in batches:
            yield batch.map(key, na_action="ignore")

    return keys(text)


def model_key(text: Column) -> Column:
    """Upper case; anything but digits, A-Z and Hebrew letters is one blank."""
    return F.trim(F.regexp_replace(F.upper(text), r"[^0-9A-Z֐-׿]+", " "))


def trim_key(text: Column) -> Column:
    """Upper case; hyphens, points and underscores are blanks; white space collapsed."""
    return spelling(F.translate(text, "-_.", "   "))


def tyre_size(text: Column) -> Column:
    """Canonical W/A Rdd, if width is 105-395, aspect 20-95, rim 10-24 and nothing unknown follows; else null."""
    t = F.upper(F.regexp_replace(text, r"\s+", ""))
    form = r"^([0-9]{3})/([0-9]{2})(ZR|R|-)?([0-9]{2})C?([0-9]{2,3}(/[0-9]{2,3})?[A-Z])?(XL|RF|M\+S)?$"
    w, a, r = (F.when(t.rlike(form), F.regexp_extract(t, form, i).cast("int")) for i in (1, 2, 4))
    return F.when(w.between(105, 395) & a.between(20, 95) & r.between(10, 24), F.concat(w.cast("string"), F.lit("/"), a.cast("string"), F.lit(" R"), r.cast("string")))


def code_form(text: Column) -> Column:
    """A type code without its parenthesised suffix, points and blanks, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"\(.*$", ""), r"[.\s]+", ""))


def relation(code: Column, value: Column, least: int = 4) -> Column:
    """equal, prefix or contains, in either direction; the last two only if both have at least `least` characters."""
    long = (F.length(code) >= least) & (F.length(value) >= least)
    prefix = code.startswith(value) | value.startswith(code)
    inside = code.contains(value) | value.contains(code)
    return F.when(code == value, "equal").when(long & prefix, "prefix").when(long & inside, "contains").otherwise("none")


def host(url: Column) -> Column:
    """The host of an absolute URL, lower case, without www and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def route(url: Column) -> Column:
    """Host and path of a URL, lower case, without a final slash: what two spellings of one route share."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def squash(text: Column) -> Column:
    """Quotes and dashes in one form each, lower case, white space collapsed: for comparing quotes with their sources."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "‘’“”‐‑‒–— ", "''\"\"----- "), r"\s+", " ")))


def same_length(text: Column) -> Column:
    """Quotes, dashes, white space and letter case in one form each, character by character: places in the result are places in
    the text."""
    one = F.translate(text, "‘’“”‐‑‒–—\u00a0\t\n\r", "''\"\"-----    ")
    return F.translate(one, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: Column) -> Column:
    """Words and whole numbers ("4,150" and "146.0" are one each) in lower case, separated by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"), F.lit(0)), " ")


def quote_in_source(source: Column, quote: Column, window: int = 400) -> Column:
    """Do the fragments of a quote (split at an ellipsis) stand in the source, as whole words, one after another inside a passage
    of `window` characters of plain words? Every place of the first fragment is tried."""
    fragments = F.filter(F.transform(F.split(quote, r"\[\.\.\.\]|\.\.\.|…"), plain_words), lambda f: f != "")
    text = F.concat(F.lit(" "), plain_words(source), F.lit(" "))
    first = F.get(fragments, F.lit(0))
    # a group inside a look-ahead: passages may overlap
    passages = F.regexp_extract_all(text, F.concat(F.lit("(?=( \\Q"), first, F.lit(f"\\E .{{0,{window}}}))")), F.lit(1))

    def holds_rest(passage: Column) -> Column:
        body = F.substring(passage, 1, window + 2)

        def after(end: Column, f: Column) -> Column:
            at = F.call_function("locate", F.concat(F.lit(" "), f, F.lit(" ")), body, end + 1)
            return F.when((end > 0) & (at > 0), at + F.length(f)).otherwise(0)

        return F.aggregate(F.slice(fragments, F.lit(2), F.size(fragments)), F.length(first) + 1, after) > 0

    return F.coalesce((F.size(fragments) > 0) & F.exists(passages, holds_rest), F.lit(False))


def masked_numbers(text: Column) -> Column:
    """A quote as a pattern: number tokens as #."""
    return F.regexp_replace(text, r"[0-9][0-9.,]*", "#")


# Kinds of secrets and contact data, and patterns that DuckDB's and Java's engines read alike.
REDACTIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "key": r"AKIA[0-9A-Z]{16}",
    "password": r"password=[^ \n]+",
}


def redacted(text: Column) -> Column:
    """The text with each secret replaced by its kind in brackets."""
    return reduce(lambda t, k: F.regexp_replace(t, REDACTIONS[k], f"[{k}]"), REDACTIONS, text)


def script_share(text: Column, letters: str) -> Column:
    """The share of a script's letters (a character class) among all letters; 0 without letters."""
    mine = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    every = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(mine / F.nullif(every, F.lit(0)), F.lit(0.0))
