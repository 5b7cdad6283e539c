"""Token ids of whole texts by a byte-level tokenizer file, word by word: the ids of words used lately are kept.

The file's own pattern never joins what stands before a space with what follows it, if that is not white space itself. A
text is therefore cut at such spaces, each word with its space is encoded once by the tokenizers library, and the text's
ids are the words' ids in a row. Texts with longer runs of white space are cut by a stricter rule, at the same places.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: A space that begins a piece of its own, whatever stands before it.
SPACE = re.compile("(?<=.) (?=[^\\s\u180e])", re.DOTALL)
#: A comma or full stop after a letter and before a space or the end is a piece of its own.
STOP = re.compile("[.,](?<=[A-Za-z].)(?= |\\Z)")  # the mark first: others are passed over quickly
#: Letters that make one piece of the pattern together, with a space before them if there is one.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Such letters, and marks behind them that are a piece of their own: all ASCII ones but the apostrophe, which may begin a piece with letters.
TAILED = re.compile(f"({LETTERS.pattern})([!-&(-/:-@\\[-`{{-~]+)")
LONGEST = 64


class IrregularSpace(ValueError):
    """A cut at every space would part a run of white space."""


def cut(text: str) -> list[str]:
    """Words that a space stood before, but for the first.

    White space that other characters follow begins a piece, whatever stands before it. Line feeds and stops become words
    too: a line feed leads its word, a stop follows a zero character, which the text must not hold. A word that is empty or
    begins with white space, other than one line feed and a visible character, tells of a longer run: then no cut holds.
    """
    return STOP.sub(" \0\\g<0>", text.replace("\n", " \n")).split(" ")


class Kept(dict):
    """Values by word, from `find`, kept for words used lately: what is older moves to `old` when the table is full."""

    def __init__(self, find, limit: int = 500_000):
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.find(word)
        self.keep(word, value)
        return value

    def keep(self, word: str, value) -> None:
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[word] = value


class ByteLevelIds:
    """Ids as little-endian unsigned 32-bit numbers. Special tokens' strings inside a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.characters = {b: c for c, b in _byte_of_character().items()}
        self.marks = {f"\0{m}": self.ids(m) for m in ".,"}
        self.line_feed, self.words = self.ids("\n"), Kept(self.word)
        self.tails = Kept(self.ids, 10_000)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, None, False, False).ids).tobytes()

    def _letters(self, piece: str) -> bytes:
        """Of letters that the pattern leaves whole: the merges alone."""
        return array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.characters))]).tobytes()

    def word(self, word: str) -> bytes:
        """Of a space and the word, of a word that a line feed leads, or of a mark."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.merge(self.characters[32] + word)]).tobytes()
        if LETTERS.fullmatch(word):
            return self._letters(f" {word}")
        if word in self.marks:
            return self.marks[word]
        if LETTERS.fullmatch(word, 1) and word[0] == "\n":
            return self.line_feed + self._letters(word[1:])
        if tailed := TAILED.fullmatch(word):
            return (self.words.get(tailed[1]) or self._letters(f" {tailed[1]}")) + self.tails[tailed[2]]
        rest = word[1:] if word[:1] == "\n" else word
        if not rest[:1].strip("\u180e").strip():  # none, or more white space
            raise IrregularSpace
        return self.ids(word if word[0] == "\n" else f" {word}")

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if "\0" not in text:
            first, *words = cut(text)
            try:
                return self.ids(first) + b"".join(map(self.words.__getitem__, words))
            except IrregularSpace:
                pass
        first, *words = SPACE.split(text)
        return self.ids(first) + b"".join(self.ids(f" {w}") for w in words)

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of each id."""
        at = _byte_of_character()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        return {i: t.encode() if i in special else bytes(at[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}


def _byte_of_character() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def lengths(token_bytes: dict[int, bytes]) -> np.ndarray:
    """Bytes of each id, as an array by id."""
    out = np.zeros(max(token_bytes, default=0) + 1, np.int32)
    for i, b in token_bytes.items():
        out[i] = len(b)
    return out


@functools.cache
def byte_level(path: str) -> ByteLevelIds:
    """One for all tasks of a worker, with at most twice the limit of words."""
    return ByteLevelIds(path)
