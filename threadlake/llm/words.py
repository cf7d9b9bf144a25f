"""Vectorised word splitting and hashing for whole batches of texts.

A batch's texts are laid end to end as one array of code points (or bytes); all
boundaries, hashes and counts are computed over that array at once, so the cost
per word doesn't include a step of the Python interpreter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64, so that low and high bits both depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX2
    x ^= x >> np.uint64(32)
    return x


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own regex engine sees it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # Beyond these planes no code point is a letter, number or white space.
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        split = Split(Regex(pattern), "removed", invert=True)
        # Few code points at a time, as every worker has what this takes.
        for low in [*range(0, 0xD800, 0x400), *range(0xE000, 0x32400, 0x400)]:
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, range(low, low + 0x400)))):
                out[low + a : low + b] = kind
    return out


@lru_cache(1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    known = _powers()
    if n <= len(known):
        return known
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64))


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice codes[start:end]; slices are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(codes)
    at = np.arange(n, dtype=np.int64)
    follows = np.empty(len(starts), dtype=np.int64)
    follows[:-1], follows[-1] = starts[1:], n
    first = int(starts[0])
    pos = at[first:] - np.repeat(starts, follows - starts)
    value = mixed(codes[first:].astype(np.uint64) + _MIX)
    value *= powers(int(pos.max()) + 1)[pos]
    value[pos >= np.repeat(ends - starts, follows - starts)] = 0
    return mixed(np.add.reduceat(value, starts - first) + (ends - starts).astype(np.uint64))


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size characters each."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in parts of that many rows, so that few texts are Python objects at once.

    After the last, what the task has freed goes back to the machine: a worker's next task may be another stage's.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    _trim()


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: nothing to do


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts end to end, as a string and as code points, and where each starts (with the total at the end)."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return whole, codes, at


def _contractions(codes: np.ndarray, quotes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the apostrophes open 's 't 'm 'd 're 've 'll, and with how many letters."""
    n = len(codes)
    one = np.where(quotes + 1 < n, codes[np.minimum(quotes + 1, n - 1)], 0)
    two = np.where(quotes + 2 < n, codes[np.minimum(quotes + 2, n - 1)], 0)
    in1 = (quotes + 1 < n) & ~fresh[np.minimum(quotes + 1, n - 1)]
    in2 = in1 & (quotes + 2 < n) & ~fresh[np.minimum(quotes + 2, n - 1)]
    single = in1 & np.isin(one, [ord(c) for c in "stmd"])
    double = in2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    letters = np.where(single, 1, np.where(double, 2, 0))
    return quotes[letters > 0], letters[letters > 0]


def _runs(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = char_classes()[codes]
    fresh = np.zeros(len(codes) + 1, dtype=bool)
    fresh[at[:-1]] = True
    return kinds, fresh[:-1]


def byte_level_slices(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the byte-level pattern (a space joins the run after it); they cover everything."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, fresh = _runs(codes, at)
    before = np.empty_like(kinds)
    before[0], before[1:] = OTHER, kinds[:-1]
    space = kinds == SPACE
    blank = codes == 32
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    leads = np.zeros(n, dtype=bool)
    leads[:-1] = ~space[1:] & ~fresh[1:]
    start = np.where(space, (before != SPACE) | leads, (before != kinds) & ~after_blank)
    start |= fresh
    quotes = np.flatnonzero(start & (codes == 39))
    if len(quotes):
        quotes, letters = _contractions(codes, quotes, fresh)
        start[quotes + 1] = False
        after = quotes + 1 + letters
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def word_end_slices(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, single numbers and runs of the rest, with contractions; white space is left out."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, fresh = _runs(codes, at)
    change = np.ones(n, dtype=bool)
    change[1:] = kinds[1:] != kinds[:-1]
    start = change | fresh | (kinds == NUMBER)
    quotes = np.flatnonzero(start & (codes == 39))
    if len(quotes):
        quotes, letters = _contractions(codes, quotes, fresh)
        start[quotes + 1] = False
        after = quotes + 1 + letters
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kinds[starts] != SPACE
    return starts[keep], ends[keep]


class WordTable:
    """Numbers words by their hash; what is known of a word is worked out once while it stays in the table.

    learn(words) is given new words and appends what it finds to pools of its own,
    in order; clear() empties them. The table is emptied when it holds limit words, so memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str]], None], clear: Callable[[], None], limit: int = 200_000):
        self._learn, self._clear, self._limit = learn, clear, limit
        self._slots: dict[int, int] = {}

    def slots(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pool index of each slice of text, whose code points are codes."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        if len(self._slots) > self._limit:
            self._slots.clear()
            self._clear()
        which, distinct = pd.factorize(slice_hashes(codes, starts, ends))
        known = self._slots
        found = [known.get(h, -1) for h in distinct.tolist()]
        slots = np.array(found, dtype=np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.full(len(distinct), -1, dtype=np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            words = [text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            base = len(known)
            known.update(zip(distinct[new].tolist(), range(base, base + len(new))))
            slots[new] = np.arange(base, base + len(new))
            self._learn(words)
        return slots[which]


def cut_at(text: str, specials: tuple[str, ...]) -> list[tuple[str, str]]:
    """(kind, piece) pairs: the leftmost special strings of a text ("special") and what lies between them ("text")."""
    out, rest = [], text
    while rest:
        hits = [(i, -len(s), s) for s in specials if (i := rest.find(s)) >= 0]
        if not hits:
            out.append(("text", rest))
            break
        i, _, s = min(hits)
        if i:
            out.append(("text", rest[:i]))
        out.append(("special", s))
        rest = rest[i + len(s) :]
    return out


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end with one blank after each text, A-Z lower-cased, and where each text starts."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer((b" ".join(texts) + b" ").lower(), dtype=np.uint8), at
