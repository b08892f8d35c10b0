"""Pre-tokens of many texts at once, and a cache of their token ids.

Texts are joined to one array of code points with a boundary between them. Class changes, spaces and contractions give the
pre-tokens' starts in a few array operations, as the public byte-level and word-level splitting patterns do. A pre-token is
known by a 64-bit hash of its code points; only those not met before are handed on as strings, all of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import regex

from gridloom.llm.common import _INV, _POW, PIECE_BYTES, mix64

WHITE, LETTER, NUMBER, OTHER, EDGE = range(5)
_EDGE = 0x110000
#: A cache forgets all its words after a batch that brings them to so many.
MOST_WORDS = 1_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, and of the boundary."""
    points = np.array([*range(0xD800), *range(0xE000, _EDGE)])
    text = "".join(map(chr, points))
    out = np.full(_EDGE + 1, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = value
    out[_EDGE] = EDGE
    return out


def joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a boundary before, between and behind the texts, and the place of each text's first one."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).copy()
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    points[starts - 1] = _EDGE
    return points, starts[:-1]


def _contractions(points: np.ndarray, c: np.ndarray, start: np.ndarray) -> None:
    """Puts 's 't 're 've 'm 'll 'd that start a pre-token apart, whatever follows."""
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 2 < len(points)]
    one, two = points[at + 1], points[at + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for p, size in ((at[short], 2), (at[long], 3)):
        start[p + 1] = False
        start[p + size] |= c[p + size] == LETTER


def byte_level(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of every pre-token: runs of letters, numbers or others with a space before them, and
    white space up to its last character."""
    c = classes()[points]
    before, after = np.concatenate(([EDGE], c[:-1])), np.concatenate((c[1:], [EDGE]))
    start = (c != EDGE) & (c != before)
    shown = (after != WHITE) & (after != EDGE)
    last = (c == WHITE) & shown  # the last of some white space
    start |= last
    glued = np.flatnonzero(last & (points == 32))
    start[glued + 1] = False
    _contractions(points, c, start)
    stop = np.flatnonzero(start | (c == EDGE))
    of = np.flatnonzero(start[stop])
    return stop[of], stop[of + 1]


def word_level(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of every pre-token: runs of letters, single numbers, runs of others."""
    c = classes()[points]
    out = (c == WHITE) | (c == EDGE)
    start = ~out & ((c != np.concatenate(([EDGE], c[:-1]))) | (c == NUMBER))
    _contractions(points, c, start)
    stop = np.flatnonzero(start | out)
    of = np.flatnonzero(start[stop])
    return stop[of], stop[of + 1]


def pieces(text: str, limit: int) -> list[str] | None:
    """The text cut at spaces between two letters, which no pre-token reaches over; None if there are too few of them."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = at + limit
        while (cut := text.rfind(" ", at + 1, cut)) >= 0 and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            pass
        if cut < 0:
            return None
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class WordCodes:
    """Token ids of texts by their pre-tokens. encode: ids of some pre-tokens one behind the other, and their number for each."""

    def __init__(self, split: Callable, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.split, self.encode = split, encode
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: ascending."""
        flat, size = self.encode(words)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, flat.astype(np.uint32)))
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.known, hashes), (self.at, at), (self.size, size)))

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and their number for each text. At most PIECE_BYTES code points with
        the boundaries."""
        points, starts = joined(texts)
        first, last = self.split(points)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _POW[: len(points)], dtype=np.uint64)))
        h, where, word = np.unique(mix64((total[last] - total[first]) * _INV[first] + (last - first).astype(np.uint64)), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, h)
        new = np.flatnonzero((place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1)] != h) if len(self.known) else np.ones(len(h), bool))
        if len(new):
            owner = np.searchsorted(starts, first[where[new]], "right") - 1
            self._learn(h[new], [texts[k][a:b] for k, a, b in zip(owner.tolist(), (first[where[new]] - starts[owner]).tolist(), (last[where[new]] - starts[owner]).tolist(), strict=True)])
            place = np.searchsorted(self.known, h)
        at, size = (self.at[place][word], self.size[place][word]) if len(h) else (self.at[:0], self.size[:0])
        ends = np.cumsum(size)
        out = self.flat[np.repeat(at - (ends - size), size) + np.arange(int(size.sum()))]
        upto = np.concatenate(([0], ends))[np.searchsorted(first, np.append(starts, len(points)))]
        if len(self.known) >= MOST_WORDS:
            self.forget()
        return out, np.diff(upto)

    def rows(self, texts: Sequence[str], alone: Callable[[str], Sequence[int] | None]) -> Iterator[np.ndarray]:
        """Ids of each text. alone: ids of a text that must not be cut here, else None."""
        held: list[str] = []
        plan: list[tuple[int, np.ndarray | None]] = []  # pieces of a text, or its ids
        size = 0

        def handed() -> Iterator[np.ndarray]:
            flat, counts = self.ids(held) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            ends, k = np.concatenate(([0], np.cumsum(counts))), 0
            for n, own in plan:
                yield flat[ends[k] : ends[k + n]] if own is None else own
                k += n

        for text in texts:
            own = alone(text)
            parts = pieces(text, PIECE_BYTES // 2) if own is None and len(text) > PIECE_BYTES // 2 else [text]
            if own is None and len(parts) == 1:
                if size + len(text) + 2 > PIECE_BYTES // 2:
                    yield from handed()
                    held, plan, size = [], [], 0
                held.append(text)
                plan.append((1, None))
                size += len(text) + 1
                continue
            if own is None:
                own = np.concatenate([self.ids([p])[0] for p in parts])
            plan.append((0, np.asarray(own, np.uint32)))
        yield from handed()
