"""Vectorised word and n-gram hashing over Arrow string columns (used inside Arrow tasks).

A text is scanned as UTF-8 bytes. Every function works on a whole block of documents at once, so no
Python code runs per word. Hashes are 64-bit and depend only on the bytes of the words and a seed: a word's bytes are coded
and multiplied with pseudo-random factors, one for each place in the word. A text cannot be built to collide under a seed
that is drawn for each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed together: bounds the temporary arrays (about 60 bytes for each text byte).
BLOCK_BYTES = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijective scramble of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


BYTE_CODE = splitmix(np.arange(256, dtype=U64))
_GRAM = 0xA0761D6478BD642F
_UNDO = pow(_GRAM, -1, 1 << 64)
_FACTORS: dict[int, np.ndarray] = {}
_POWERS: dict[int, np.ndarray] = {}


def _factors(seed: int, n: int) -> np.ndarray:
    """At least n odd factors, those of a seed; more of them begin with the same."""
    known = _FACTORS.get(seed)
    if known is None or len(known) < n:
        _FACTORS.clear()
        known = _FACTORS[seed] = splitmix(np.arange(max(n, 4096), dtype=U64) ^ splitmix(np.array([seed], U64))) | U64(1)
    return known


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _POWERS[base] = _powers(base, max(n, 1 << 16))
    return known[:n]


_BLANKS = [bytes([b]) for b in (0x20, *range(0x09, 0x0E))]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For matching on letters and digits alone: every ASCII byte that is neither separates.
PUNCT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document offsets into them) of consecutive rows; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    edge = offs[(offs > 0) & (offs < len(data))]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    closes[:-1] &= ~inside[1:]
    closes[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE, stem: int = 0, seed: int = 0) -> list[np.ndarray]:
    """A hash for each word; with stem, also one of each word's first `stem` bytes."""
    if not len(starts):
        return [np.zeros(0, U64)] * (1 + bool(stem))
    longest = int((ends - starts).max())
    codes = np.where(separators, U64(0), BYTE_CODE)[data[starts[0] :]]
    at = np.arange(starts[0], len(data))
    at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    np.minimum(at, longest, out=at)
    codes *= _factors(seed, longest + 1)[at]
    out = [splitmix(np.add.reduceat(codes, starts - starts[0]))]
    if stem:
        codes[at >= stem] = 0
        out.append(splitmix(np.add.reduceat(codes, starts - starts[0]) ^ U64(0x5DEECE66D)))
    return out


def gram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words at each position, and a mask of the positions whose n words lie in one document.

    They roll: each is a difference of two running sums of a polynomial modulo 2^64, whatever n is. Positions past the last
    full gram of the block are masked out."""
    total = len(hashes)
    valid = np.zeros(total, bool)
    out = np.zeros(total, U64)
    if total < n:
        return out, valid
    sums = np.zeros(total + 1, U64)
    np.cumsum(hashes * _powers_of(_GRAM, total), out=sums[1:])
    m = total - n + 1
    out[:m] = splitmix((sums[n:] - sums[:m]) * _powers_of(_UNDO, m))
    room = np.repeat(first[1:], np.diff(first))  # the end of each word's document
    valid[:m] = np.arange(m) + n <= room[:m]
    return out, valid


def _pieces(column: pa.Array, separators: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of bytes and document offsets; a text of several blocks comes in pieces cut at separators, all but the last of
    which are marked. A word longer than a block stays whole."""
    for _, _, data, offs in blocks(column):
        at = 0
        while len(offs) == 2 and len(data) - at > BLOCK_BYTES:
            found = np.flatnonzero(separators[data[at : at + BLOCK_BYTES]])
            if len(found):
                end = at + int(found[-1]) + 1
            else:
                ahead = np.flatnonzero(separators[data[at + BLOCK_BYTES :]])
                end = at + BLOCK_BYTES + int(ahead[0]) + 1 if len(ahead) else len(data)
            if end >= len(data):
                break
            yield data[at:end], np.array([0, end - at]), True
            at = end
        yield data[at:], np.maximum(offs - at, 0), False


def hashed(column: pa.Array, separators: np.ndarray = SPACE, stem: int = 0, seed: int = 0, lower: bool = False) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each block of rows the hashes of all words (and of their stems), and where each document's words begin, one more at
    the end. Temporary arrays are those of BLOCK_BYTES bytes even for one very long text; only its hashes are kept whole."""
    held: list[list[np.ndarray]] = []
    for data, offs, more in _pieces(column, separators):
        if lower:
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
        starts, ends, at = words(data, offs, separators)
        found = word_hashes(data, starts, ends, separators, stem, seed)
        if more:
            held.append(found)
            continue
        if held:
            found = [np.concatenate(h) for h in zip(*held, found, strict=True)]
            at = np.array([0, len(found[0])])
            held = []
        yield found, at


def word_sha256(raw: bytes) -> str:
    """SHA-256 of the words of a text, joined by one blank each; split in pieces, so that a long text makes no long list."""
    sha, at, some = hashlib.sha256(), 0, False
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            cut = max(raw.rfind(c, at, end) for c in _BLANKS)
            if cut < 0:
                cut = min((i for i in (raw.find(c, end) for c in _BLANKS) if i >= 0), default=len(raw) - 1)
            end = cut + 1
        words_ = raw[at:end].split()
        if words_:
            sha.update(b" " * some + b" ".join(words_))
            some = True
        at = end
    return sha.hexdigest()


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the index of its smallest, the rightmost of equals; by doubling, in log2(w) steps."""
    at, width = np.arange(len(values)), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        width += step
    return at
