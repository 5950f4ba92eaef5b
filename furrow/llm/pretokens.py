"""Cutting a text into pieces that byte-pair merges never cross.

`chunks` cuts at single spaces first: there the pattern always begins a new piece, and a space
split is far cheaper than the pattern. A chunk then repeats often enough for a bounded memory
of its result. Where runs of white space make such a cut doubtful the whole text is one chunk.
"""

from __future__ import annotations

import re

import regex

#: A space with white space before it, and white space or the end behind it.
_DOUBTFUL = re.compile(r"\s (?:\s|\Z)")

#: Bytes of one generation of a memory of results, its objects and their places included.
MEMORY_BYTES = 20 << 20
#: What an entry takes besides its characters and ids.
_ENTRY_BYTES = 180


class Memory:
    """Results by chunk or piece: two generations, of which the older is dropped when the newer is full."""

    def __init__(self, room: int | None = None):
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.room = self.left = MEMORY_BYTES if room is None else room

    def get(self, key: str):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: object) -> None:
        if len(key) < 256:
            self.new[key] = value
            self.left -= _ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.left < 0:
                self.old, self.new, self.left = self.new, {}, self.room


def chunks(text: str) -> list[str]:
    """Parts of the text, joined they are the text; each is cut into pieces on its own."""
    if not text:
        return []
    if _DOUBTFUL.search(text):
        return [text]
    first, *rest = text.split(" ")
    out = [" " + part for part in rest]
    if first:
        out.insert(0, first)
    return out


def single(chunk: str) -> bool:
    """Whether a chunk surely is one match of ` ?\\p{L}+`; letters beyond Latin-1 are left to the pattern, whose Unicode may be newer."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


class Pieces:
    """The pattern's matches in a chunk."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall

    def __call__(self, chunk: str) -> list[str]:
        return self.find(chunk)
