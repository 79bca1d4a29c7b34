"""Personal data: rules, and a semi-Markov conditional random field that adds what the rules miss.

The field reads runs of tokens that hold a digit, an at sign or a spelled-out one ("[at]"). It scores whole candidate spans of
up to MAX_TOKENS tokens by features of the span (digits, separators, shapes, checks, the words before it) and finds, by
dynamic programming over the ends of spans, the boundaries and types of a run together; a span is added if its probability
over all segmentations of its run is at least CONFIDENCE and it overlaps no span of a rule. All other tokens are outside.
Besides the kinds of the rules it knows secrets (keys, tokens, passwords), for which there is no rule.

There are no labelled documents. The field is trained by maximum likelihood on at most FIT_RUNS runs of the input, the first
by a hash among all different ones. Its labels are what the rules find, and the values that stand after a word for a secret
and an equals sign or colon. Each run with a span also appears in altered copies, in forms that the rules do not know (no
plus sign, other separators, spelled-out at signs and dots, with and without a telling word before it), and numbers that are
no personal data (dates, versions, prices, numbers that fail a card's check, ...) are made as counter-examples. So the field
leans on the shape and the surroundings of a span, not on the one mark that a rule asks for. Everything else covers all
rows, in one pass without a shuffle. Time is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.common import stage_table, table, tuned

#: Kinds of the rules, and all kinds of the field.
KINDS = ("email", "ip", "card", "phone")
FIELD = (*KINDS, "secret")
MAX_TOKENS, CONFIDENCE = 5, 0.5
#: The most runs that the field is trained on, the most tokens of a run used for that, and the characters read before a span.
FIT_RUNS, FIT_TOKENS, BEFORE = 3_000, 24, 24
#: The most altered copies, and counter-examples, made for a run.
COPIES = 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+|[\[({](?:at|dot|AT|DOT)[\])}]")
_BREAK = re.compile(r"[\s=\"'<>|,;]")
_AT_SIGN = re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*", re.IGNORECASE)
_DOT_SIGN = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*", re.IGNORECASE)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_SECRET = re.compile(r"(?:token|secret|passwor[dt]|passwd|pwd|api[_ -]?key|access[_ -]?key|bearer)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_=.-]{12,})", re.IGNORECASE)
Span = tuple[str, int, int]

# Words that tell what the number after them is.
WORDS = {
    "mail": ("mail", "email", "e-mail", "contact", "write"),
    "phone": ("tel", "phone", "telephone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "móvil"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "host": ("ip", "host", "server", "address", "addr", "from"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "bearer", "passwort"),
    "other": ("version", "v", "isbn", "order", "invoice", "ref", "no", "nr", "page", "chapter", "line", "date", "on", "price", "id", "commit", "uuid", "section"),
}
_KIND_OF_WORD = {w: kind for kind, words in WORDS.items() for w in words}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """The spans of the four rules, kind by kind in order of KINDS, then by start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the part before an at sign is the whole run of its characters up to it, from the last match on
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secret_spans(text: str) -> list[Span]:
    """Values after a word for a secret: the field's labels for its fifth kind. They hold both letters and digits."""
    return [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of neighbouring tokens with a mark, as (start, end) pairs. Tokens end at white space, quotes and = < > | , ;
    and the tokens on both sides of a spelled-out sign ("name [at] host") belong to its run."""
    out: list[list[tuple[int, int]]] = []
    end = 0

    def token(at: int, low: int) -> tuple[int, int]:
        first = last = at
        while first > low and not _BREAK.match(text[first - 1]):
            first -= 1
        while last < len(text) and not _BREAK.match(text[last]):
            last += 1
        return first, last

    def add(start: int, stop: int) -> None:
        nonlocal end
        if stop <= start or start < end:
            return
        gap = text[out[-1][-1][1] : start] if out else "-"
        if out and gap.isspace() and len(gap) <= 2:
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        end = stop

    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start, stop = token(m.start(), end)
        spelled = m[0][0] in "[({" and stop - start == len(m[0])
        if spelled and start - 2 >= end and text[start - 1] == " ":
            add(*token(start - 2, end))
        add(start, stop)
        if spelled and text[stop : stop + 1] == " ":
            add(*token(stop + 1, stop + 1))
    return out


FEATURES = (
    *(f"tokens={n}" for n in range(1, MAX_TOKENS + 1)),
    *(f"digits={n}" for n in ("0", "1-3", "4-6", "7-8", "9-12", "13-19", "20+")),
    *(f"letters={n}" for n in ("0", "1-2", "3+")),
    *(f"after {kind}" for kind in WORDS),
    *(f"phone shape after {kind}" for kind in ("phone", "other", "nothing")),
    *(f"groups={n}" for n in ("1", "2", "3", "4", "5+")),
    "one at", "mail shape", "spelled", "four numbers", "four bytes", "plus", "two zeros", "parentheses", "dashes", "dots", "slashes", "colon", "underscore", "equal groups", "date shape", "phone shape", "phone shape, grouped", "last group of four",
    "card shape", "card shape, checked", "card in fours, checked", "letters and digits", "long mix", "hexadecimal, 32 or more", "uuid shape", "after equals or colon", "quoted", "bias",
)
_AT = {name: i for i, name in enumerate(FEATURES)}


def _bucket(n: int, cuts: tuple[int, ...], names: tuple[str, ...]) -> str:
    return names[sum(n >= c for c in cuts)]


def span_features(text: str, tokens: int, before: str = "") -> list[int]:
    """The features, by number, of a candidate span: they look at all of it and at the words before it."""
    plain = _DOT_SIGN.sub(".", _AT_SIGN.sub("@", text))
    digits, letters = _digits(plain), sum(c.isalpha() for c in plain)
    n = len(digits)
    known = {k for w in re.findall(r"[^\W\d]+(?:[-_][^\W\d]+)*", before.lower())[-3:] if (k := _KIND_OF_WORD.get(w))}
    groups = re.findall(r"[0-9]+", plain)
    on = [f"tokens={tokens}", "digits=" + _bucket(n, (1, 4, 7, 9, 13, 20), ("0", "1-3", "4-6", "7-8", "9-12", "13-19", "20+")), "letters=" + _bucket(letters, (1, 3), ("0", "1-2", "3+")), "bias"]
    on += [f"after {k}" for k in known]
    on.append("groups=" + (str(len(groups)) if len(groups) < 5 else "5+")) if groups else None
    parts = plain.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    address = four and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    shape = set(plain)
    dated = re.fullmatch(r"(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?:[T ].*)?|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)?[0-9]{2}", plain) is not None
    phone = not shape - set("0123456789+().- /") and 9 <= n <= 15 and not address and not dated
    card = not shape - set("0123456789-. /_") and 13 <= n <= 19
    mix = letters > 0 and n > 0 and not shape - set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")
    if phone:
        on.append("phone shape after " + ("phone" if "phone" in known else "other" if known else "nothing"))
    checks = {
        "one at": plain.count("@") == 1,
        "mail shape": _MAIL.fullmatch(plain) is not None,
        "spelled": plain != text,
        "four numbers": four,
        "four bytes": address,
        "plus": text.startswith("+"),
        "two zeros": text.startswith("00"),
        "parentheses": "(" in plain and ")" in plain,
        "dashes": "-" in plain,
        "dots": "." in plain,
        "slashes": "/" in plain,
        "colon": ":" in plain,
        "underscore": "_" in plain,
        "equal groups": len(groups) > 1 and len({len(g) for g in groups}) == 1,
        "date shape": dated,
        "phone shape": phone,
        "phone shape, grouped": phone and len(groups) >= 3,
        "last group of four": phone and len(groups[-1]) == 4,
        "card shape": card,
        "card shape, checked": card and luhn(digits),
        "card in fours, checked": card and luhn(digits) and len(groups) == 4 and all(len(g) == 4 for g in groups),
        "letters and digits": letters > 0 and n > 0,
        "long mix": mix and len(plain) >= 16 and "@" not in plain,
        "hexadecimal, 32 or more": mix and len(plain) >= 32 and not shape - set("0123456789abcdefABCDEF"),
        "uuid shape": re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", plain) is not None,
        "after equals or colon": before.rstrip(" \"'")[-1:] in ("=", ":") and bool(before.strip()),
        "quoted": before[-1:] in ('"', "'"),
    }
    return [_AT[name] for name in on] + [_AT[name] for name, yes in checks.items() if yes]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and (text[end - 1] in ".:!?*&%$#" or (text[end - 1] in ")]}" and text[end - 2 : end - 1] in ")]}.!")):
        end -= 1
    while end > start and text[start] in ":*&%$#":
        start += 1
    return start, end


class Lattice:
    """All candidate segments of a run: (first token, tokens, features, start, end)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n = len(tokens)
        self.segments = []
        for i in range(self.n):
            for size in range(1, min(MAX_TOKENS, self.n - i) + 1):
                start, end = _trim(text, tokens[i][0], tokens[i + size - 1][1])
                if end > start:
                    self.segments.append((i, size, span_features(text[start:end], size, text[max(0, start - BEFORE) : start]), start, end))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.array([weights[:, f].sum(axis=1) for _, _, f, _, _ in self.segments]).reshape(len(self.segments), len(FIELD))

    def marginals(self, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each (segment, kind), and the log of the sum over all segmentations; a token outside scores 0."""
        scores = self.scores(weights)
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        begins: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, size, *_) in enumerate(self.segments):
            ends[i + size].append(k)
            begins[i].append(k)
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        forward, backward = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[self.segments[k][0]] + total[k] for k in ends[j])])
        for j in range(self.n - 1, -1, -1):
            backward[j] = np.logaddexp.reduce([backward[j + 1], *(backward[j + self.segments[k][1]] + total[k] for k in begins[j])])
        outer = np.array([forward[i] + backward[i + size] for i, size, *_ in self.segments]).reshape(-1, 1)
        return np.exp(scores + outer - forward[self.n]), float(forward[self.n])

    def best(self, weights: np.ndarray) -> list[tuple[int, int]]:
        """The most likely segmentation: (segment, kind) from left to right."""
        scores = self.scores(weights)
        best, back = np.zeros(self.n + 1), [None] * (self.n + 1)
        best[1:] = -np.inf
        into: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, size, *_) in enumerate(self.segments):
            into[i + size].append(k)
        for j in range(1, self.n + 1):
            best[j], back[j] = best[j - 1], None
            for k in into[j]:
                kind = int(scores[k].argmax())
                if (value := best[self.segments[k][0]] + scores[k, kind]) > best[j]:
                    best[j], back[j] = value, (k, kind)
        out, j = [], self.n
        while j:
            if back[j] is None:
                j -= 1
            else:
                out.append(back[j])
                j = self.segments[back[j][0]][0]
        return out[::-1]


def train(examples: list[tuple[str, list[Span]]], epochs: int = 10, rate: float = 0.5, shrink: float = 1e-3) -> np.ndarray:
    """Weights (kind, feature) that maximise the likelihood of the spans, by AdaGrad."""
    weights = np.zeros((len(FIELD), len(FEATURES)))
    squares = np.full_like(weights, 1e-6)
    prepared = []
    for text, spans in examples:
        for tokens in runs(text):
            lattice = Lattice(text, tokens)
            at = {(s, e): k for k, (*_, s, e) in reversed(list(enumerate(lattice.segments)))}
            gold = np.zeros((len(lattice.segments), len(FIELD)))
            for kind, start, end in spans:
                if (start, end) in at:
                    gold[at[start, end], FIELD.index(kind)] = 1
            counts = np.zeros((len(lattice.segments), len(FEATURES)))
            for k, (_, _, f, _, _) in enumerate(lattice.segments):
                counts[k, f] = 1
            prepared.append((lattice, gold, counts))
    for _ in range(epochs):
        for lattice, gold, counts in prepared:
            slope = (gold - lattice.marginals(weights)[0]).T @ counts - shrink * weights
            squares += slope * slope
            weights += rate * slope / np.sqrt(squares)
    return weights


# What may stand before a span of a kind in an altered copy; empty: nothing.
LEADS = {"phone": ("", "", "tel: ", "phone ", "call me at ", "fax "), "email": ("", "mail ", "contact: "), "card": ("", "card ", "visa "), "ip": ("", "host ", "ip: "), "secret": ('token = "', "password: ", "api_key=", 'secret="', "key: ", "bearer ")}


def altered(kind: str, value: str, rng: random.Random) -> str:
    """The same data in a form that the rules do not know."""
    if kind == "phone":
        form = rng.randrange(4)
        body = value.lstrip("+")
        if form == 0:
            return body
        if form == 1:
            return "00" + body
        parts = re.findall("[0-9]+", body)
        # all groups, or the national number alone
        return rng.choice("-. /").join(parts[1:] if form == 2 and len("".join(parts[1:])) >= 9 else parts)
    if kind == "email":
        at, dot = rng.choice((("[at]", "."), ("(at)", "."), (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] ")))
        name, _, host = value.partition("@")
        head, _, tail = host.rpartition(".")
        return name + at + head + dot + tail
    if kind == "ip":
        return rng.choice(("[.]", "[dot]", "(.)")).join(value.split("."))
    if kind == "card":
        d = _digits(value)
        return rng.choice("./_-").join(d[i : i + 4] for i in range(0, len(d), 4))
    alphabet = rng.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    return "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 24, 32, 40)) - 2)) + "7a"


def decoy(rng: random.Random) -> str:
    """A number that is no personal data, with or without a word before it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = (
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 23):02d}:{digits(2)}:{digits(2)}",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"order {digits(6)}-{digits(4)}",
        lambda: f"{rng.randint(1900, 1999)}-{rng.randint(2000, 2024)}",
        lambda: f"{rng.randint(0, 89)}.{digits(4)} {rng.randint(0, 179)}.{digits(4)}",
        lambda: f"id {digits(rng.randint(7, 12))}",
        lambda: digits(rng.randint(9, 12)),
        lambda: f"{digits(8)}-{digits(4)}-4{digits(3)}-a{digits(3)}-{digits(12)}",
        lambda: f"commit {digits(3)}abc{digits(1)}d",
        lambda: f"{rng.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}",
    )
    while True:
        text = rng.choice(forms)()
        if not rule_spans(text):
            return text


def _pick(most: int):
    """The `most` runs with spans, and as many without, that are first by a hash among the different runs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict, dict] = ({}, {})
        worst = [1 << 64, 1 << 64]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text or not _MARK.search(text):
                    continue
                spans = [*rule_spans(text), *secret_spans(text)]
                for tokens in runs(text):
                    first, end = tokens[0][0], tokens[min(len(tokens), FIT_TOKENS) - 1][1]
                    start = max(0, first - BEFORE)
                    if end - start > 2_000:
                        continue
                    piece = text[start:end]
                    rank = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")
                    inside = ",".join(f"{k}:{a - start}:{b - start}" for k, a, b in spans if first <= a and b <= end)
                    side = int(not inside)
                    if rank < worst[side]:
                        held[side][rank] = (piece, inside)
                        if len(held[side]) > 4 * most:
                            for r in sorted(held[side])[most:]:
                                del held[side][r]
                            worst[side] = max(held[side])
        rows = [(r - (1 << 63), *held[side][r], side == 0) for side in (0, 1) for r in sorted(held[side])[:most]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["rank", "run", "spans", "found"])

    return run


def _learn(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights from the sampled runs; where there are few, each has more copies and counter-examples, up to COPIES."""
    examples = []
    copies = min(COPIES, max(1, FIT_RUNS // max(1, len(frame))))
    for text, spans in zip(*(frame.sort_values(["rank", "run"])[c] for c in ("run", "spans")), strict=True):
        gold = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        examples.append((text, gold))
        rng = random.Random(text)
        for kind, a, b in gold * copies:
            value, lead = altered(kind, text[a:b], rng), rng.choice(LEADS[kind])
            examples.append((lead + value, [(kind, len(lead), len(lead) + len(value))]))
        examples += [(decoy(rng), []) for _ in range(copies)]
    return pd.DataFrame({"w": train(examples).reshape(-1) if examples else []})


def fit(docs: DataFrame, fit_runs: int = FIT_RUNS) -> np.ndarray:
    """Train on at most fit_runs different runs, half of them with spans if there are enough; without any run all weights are
    zero. Which runs are taken depends on the set of runs alone, not on how rows are dealt out."""
    tuned(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_pick(fit_runs // 2), "rank long, run string, spans string, found boolean")
    found = stage_table(found, "runs").dropDuplicates(["rank", "run"])
    half = lambda yes: found.where(F.col("found") == yes).orderBy("rank", "run").limit(fit_runs // 2)
    got = half(True).union(half(False)).groupBy().applyInPandas(_learn, "w double").toPandas()["w"].to_numpy()
    return got.reshape(len(FIELD), len(FEATURES)) if len(got) else np.zeros((len(FIELD), len(FEATURES)))


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else starts
    out = []
    for tokens in runs(text):
        lattice = Lattice(text, tokens)
        chosen = lattice.best(weights)
        if not chosen:
            continue
        sure = lattice.marginals(weights)[0]
        for k, kind in chosen:
            *_, start, end = lattice.segments[k]
            i = int(np.searchsorted(starts, end)) if len(starts) else 0
            clear = not i or reach[i - 1] <= start
            if clear and sure[k, kind] >= CONFIDENCE:
                out.append((FIELD[kind], start, end))
    return out


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (all), n_added and n_spans for every row of docs.

    Defined cases: a null text is empty and has no spans; repeated rows give equal rows; a null doc_id keeps its row.
    Other columns are ignored; an empty table gives an empty result."""
    tuned(docs.sparkSession)

    def line(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (FIELD.index(s[0]), s[1], s[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, lines, added = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = extra = ()
                if text and _MARK.search(text):
                    base = rule_spans(text)
                    extra = added_spans(text, base, weights)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                shas.append(hashlib.sha256(line(base).encode()).hexdigest())
                lines.append(line([*base, *extra]))
                added.append(len(extra))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(shas, pa.string()), pa.array(lines, pa.string()), pa.array(added, pa.int64()), pa.array([sum(c) + a for c, a in zip(counts, added, strict=True)], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op5_semi_markov(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
