"""Token ids of whole texts with a public tokenizer file, for use inside Arrow tasks.

The byte-level tokenizers split a text before a blank or a line feed whenever words stand on both sides of it, and merge
nothing across such a split. So a text's ids are the ids of its blank-separated words one after another, and each worker
encodes a word only the first time it meets it. Texts where that split is not certain go to the tokenizer whole.
"""

from __future__ import annotations

import os
from array import array
from functools import partial
from itertools import compress
from operator import is_

import numpy as np

#: Bytes, by estimate, that a worker may keep words and their ids in.
MEMORY = 96 << 20
_WORKER: dict[str, Encoder] = {}
_NOT_KNOWN = partial(is_, None)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[str, bytes | bool] = {}
        self.used = 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self._separator()
        self.feed = None if feed is None else array(self.code, [feed]).tobytes()
        self.stops = {c: array(self.code, self._whole(c)).tobytes() for c in ".,"}

    def _separator(self) -> int | None:
        """The id of a line feed if this tokenizer splits at blanks and line feeds as described above, else None."""
        feed = self._whole("\n")
        probes = ("a b", "a\nb", "one, two\n(three) 4 five!", "x\ny z\nw", "end. of, all,\nthis.")
        if len(feed) != 1 or self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel" or self._whole("a") + self._whole(" b") != self._whole("a b"):
            return None
        if any(self._whole(p) != [i for k, line in enumerate(p.split("\n")) for i in [*([feed[0]] if k else []), *[i for j, w in enumerate(line.split(" ")) for i in self._whole(" " * bool(j) + w)]]] for p in probes):
            return None
        return feed[0]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes | bool]:
        """The ids of words that are not known yet; a word that begins with a line feed stands for both. False: not certain.

        What the worker can still remember it keeps."""
        # a point or comma after a letter is a piece of its own: such words only need the word before it
        stopped = [w for w in words if w[-1:] in self.stops and w[-2:-1].isalpha()]
        rest = words.difference(stopped) | {c for w in stopped if (c := w[:-1]) not in self.known}
        body = {w: w[1:] if w.startswith("\n") else w for w in rest}
        # a word that is empty, or begins or ends with white space of any kind, is not certain to be split off
        sure = [w for w, b in body.items() if b and not b[0].isspace() and not b[-1].isspace()]
        found: dict[str, bytes | bool] = dict.fromkeys(rest, False)
        ids = self._bytes([body[w] if w.startswith("\n") else " " + w for w in sure])
        found.update((w, self.feed + x if w.startswith("\n") else x) for w, x in zip(sure, ids, strict=True))
        for w in stopped:
            core = found[w[:-1]] if w[:-1] in found else self.known[w[:-1]]
            found[w] = core and core + self.stops[w[-1]]
        if self.used < MEMORY:
            self.used += sum(170 + len(w) + (len(x) if x else 0) for w, x in found.items())  # two objects and a place in a table
            self.known.update(found)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind; a null text has none."""
        texts = [t or "" for t in texts]
        if self.feed is None:
            return self._bytes(texts)
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = self._bytes([words[0] for words in split])
        parts = [list(map(self.known.get, words)) for words in split]
        out: list[bytes | None] = []
        open_: list[int] = []
        unknown: set[str] = set()
        for i, (text, words, mine, first) in enumerate(zip(texts, split, parts, firsts, strict=True)):
            mine[0] = False if words[0][-1:].isspace() else first
            out.append(None)
            if any(s in text for s in self.special):
                continue
            try:
                out[i] = b"".join(mine)
            except TypeError:  # a word is not known, or not certain: only such texts are looked through word by word
                open_.append(i)
                unknown.update(compress(words, map(_NOT_KNOWN, mine)))
        found = self._learn(unknown)
        for i in open_:
            mine = parts[i]
            if None in mine:
                mine = [found[w] if p is None else p for w, p in zip(split[i], mine, strict=True)]
            try:
                out[i] = b"".join(mine)
            except TypeError:
                pass
        whole = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(whole, self._bytes([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]
