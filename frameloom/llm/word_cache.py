"""Text to token ids through a cache of blank-separated chunks.

With the byte-level pattern, a single blank between two characters that are no white space always starts a
piece, and no piece reaches across it. So a text may be cut at such blanks, each chunk encoded by itself, with
its blank, and the ids strung together; chunks repeat, so most are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: White space other than the blank and the line feed; a text with any is cut by the slower pattern.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CLEAN_BLANK = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """Chunks of a text without the blanks between them."""
    if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return _CLEAN_BLANK.split(text)
    return text.split(" ")


class ChunkCache:
    """encode: one value, such as the ids' bytes, for each chunk. limit: entries after which the cache starts anew."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.inner: dict = {}

    def texts(self, texts: Iterable[str]) -> list[list]:
        """The values of each text's chunks in order; whole texts, however long."""
        split = list(map(cut, texts))
        first = list({s[0] for s in split})
        head = dict(zip(first, self.encode(first), strict=True))
        wanted: set[str] = set()
        found = []
        for s in split:
            values = [head[s[0]], *map(self.inner.get, s[1:])]
            if None in values:
                wanted.update(c for c, v in zip(s, values, strict=True) if v is None)
            found.append(values)
        if len(self.inner) + len(wanted) > self.limit and self.inner:
            self.inner = {}  # what was found stays found, but is asked for again when it comes up next
        todo = list(wanted)
        got = dict(zip(todo, self.encode([" " + c for c in todo]), strict=True))
        for s, values in zip(split, found, strict=True):
            if None in values:
                values[:] = [got[c] if v is None else v for c, v in zip(s, values, strict=True)]
        self.inner.update(got)
        return found
