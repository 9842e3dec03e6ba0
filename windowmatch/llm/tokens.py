"""Token ids of whole texts by the tokenizers library, with remembered words.

Both vocabularies cut a text into pieces before they merge bytes, and never across the white space
handled here, so a text's ids are those of its pieces, one after the other. Every piece is encoded
by the library; a worker remembers the pieces it has met, up to a bound, while it works for the operator.
A word with marks behind it, or with capitals where case does not count, is looked up without them.
"""

from __future__ import annotations

import os
import re
import sys
import weakref
from array import array

import numpy as np
from pyspark import Broadcast

from windowmatch.llm.shared import Memo

#: Pieces and runs of letters that a worker remembers, of each generation.
KNOWN, RUNS = 300_000, 60_000

# White space that may run together across the places where texts are cut; most texts have none of it.
_SUSPECT = (
    b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", "\x85".encode(), "\xa0".encode(),
    "\u1680".encode(), b"\xe2\x80", "\u205f".encode(), "\u3000".encode(),
)
_ODD = re.compile(r"\s\s")
# Latin letters without the two signs among them, then ASCII marks but the apostrophe.
_SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
# What the name of an added token has; such a text is not lower-cased as a whole.
_ADDED = b"<|"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary, for translate()."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTER = _byte_letters()


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    ``spaced``: a piece includes the space before it, and line feeds are pieces (byte-level vocabulary
    without normaliser); otherwise white space is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, spaced: bool, known: int = KNOWN, runs: int = RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.spaced = spaced
        # the memories refer to it weakly, so that they go at once when it goes
        own = weakref.proxy(self)
        self.runs = Memo(lambda r: own._run(r), runs)
        self.first = Memo(lambda w: own._piece(w, ""), runs if spaced else known)
        self.rest = Memo(lambda w: own._piece(w, " "), known)
        self.line = self._whole("\n") if spaced else b""

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: bytes) -> bytes:
        """A run that is one piece for the vocabulary."""
        # ASCII letters stand for themselves
        text = run.decode() if run.isalpha() else run.decode("latin-1").translate(_LETTER)
        return _packed([token.id for token in self.tokenize(text)])

    def _piece(self, word: bytes, space: str) -> bytes:
        letters, marks = word, b""
        if not word.isalpha():
            simple = _SIMPLE.fullmatch(word)
            if not simple:
                return self._whole(space + word.decode())
            letters, marks = simple.groups()
        if not self.spaced:
            letters = letters.lower() if letters.isalpha() else letters.decode().lower().encode()
        if letters != word:
            known = self.rest if space else self.first
            return known[letters] + (self.runs[marks] if marks else b"")
        return self._run(b" " + letters if space else letters)

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a text in UTF-8."""
        if not text:
            return b""
        if not self.spaced:
            if text.isascii() and _ADDED not in text:
                text = text.lower()
            return b"".join(map(self.first.__getitem__, text.split()))
        if any(s in text for s in _SUSPECT) and _ODD.search(text.decode()):
            return self._whole(text.decode())
        lines = []
        for line in text.split(b"\n"):
            head, *tail = line.split(b" ")
            lines.append((self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, tail)))
        return self.line.join(lines)


def _packed(ids: list[int]) -> bytes:
    if sys.byteorder == "little":
        return array("I", ids).tobytes()
    return np.array(ids, "<u4").tobytes()


class Shared:
    """An encoder that is broadcast by its parameters, and made by the worker that needs it.

    A worker outlives the operator and serves the next one. What it remembers goes with the broadcast: before
    the first task that does not name it, instead of lying beside the memory of that task.
    """

    def __init__(self, path: str, spaced: bool):
        self.parameters, self.made = (path, spaced), None

    def __getstate__(self):
        return {**self.__dict__, "made": None}

    def encode(self, text: bytes | None) -> bytes:
        if self.made is None:
            self.made = Encoder(*self.parameters)
        return self.made.encode(text)


def encoder(spark, path: str, spaced: bool) -> Broadcast:
    """A broadcast with an encoder for each worker process."""
    return spark.sparkContext.broadcast(Shared(path, spaced))
