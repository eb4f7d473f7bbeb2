"""Words of a text as hashes, and which places of a text winnowing selects as fingerprints.

Two sequences are winnowed. Over lines: a gram is the shortest run of lines from a given line with at least
LINE_GRAM words; of the grams in each shortest run with at least LINE_WINDOW words (the windows that begin, or
end, at a given line) the one of least hash is selected. Over words: of the grams of WORD_GRAM words in each
PASSAGE_WORDS words in a row, the one of least hash. What is selected depends on the window's own words alone,
so equal windows select equal grams at equal places: a repeated run that holds a window is never missed, and
nothing shorter than a gram ever matches.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Words of a gram of lines, and of a window that selects one.
LINE_GRAM = 8
LINE_WINDOW = 25
#: Words of a gram, and of a passage, which counts wherever in a line it begins and ends.
WORD_GRAM = 25
PASSAGE_WORDS = 50
#: Odd multipliers of the rolling hashes of bytes and of words; grams of lines have keys apart from those of words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LINES = np.uint64(0x5851F42D4C957F2D)
#: Bytes hashed, and windows compared, at once.
BLOCK, CHUNK = 1 << 19, 1 << 15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses modulo 2^64; tables of up to BLOCK entries are kept."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, BLOCK)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > BLOCK:
            return made
        _tables[base] = made
    return _tables[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end, in bytes; white space is ASCII."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, block by block."""
    out, at = [], 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, side="right")))
        low = int(begin[at])
        part = data[low : int(end[stop - 1])]
        up, down = _powers(BYTE_BASE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        b, e = begin[at:stop] - low, end[at:stop] - low
        out.append(_mix((sums[e] - sums[b]) * down[b]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Words:
    """The words of some texts, one text after the other: hashes, lines, and which text each belongs to."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.begin, self.end = word_spans(data)
        self.hashes = word_hashes(data, self.begin, self.end)
        self.firsts = np.append(np.searchsorted(self.begin, np.cumsum(sizes) - sizes), len(self.begin))  # first word of each text
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.firsts))
        line = np.searchsorted(np.flatnonzero(data == 0x0A), self.begin)
        self.lines = np.flatnonzero(line[1:] != line[:-1]) + 1  # first word of each line with words
        self.lines = np.concatenate([np.zeros(min(1, len(line)), np.int64), self.lines])
        self.sums = np.zeros(len(self.hashes) + 1, np.uint64)
        up, self.down = _powers(WORD_BASE, len(self.hashes) + 1)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=self.sums[1:])

    def keys(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words in each of these ranges: the sum of hash * base^place modulo 2^64, mixed."""
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def select_lines(words: Words, gram: int = LINE_GRAM, window: int = LINE_WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word and number of words of the selected grams of lines. A text with fewer words than a window is one window."""
    starts = words.lines
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    ends = np.append(starts[1:], len(words.owner))
    text = words.owner[starts]
    low, high = words.firsts[text], words.firsts[text + 1]
    # the last line of each line's gram; lines too near the text's end have none, and count as reaching beyond it
    whole = starts + gram <= high
    last = np.where(whole, np.searchsorted(ends, starts + gram), np.searchsorted(starts, high))
    keys = words.keys(starts, ends[np.minimum(last, len(ends) - 1)]) ^ LINES
    size = np.minimum(window, high - low)
    ahead, back = starts + size <= high, ends - size >= low
    line = np.arange(len(starts))
    a = np.concatenate([line[ahead], np.searchsorted(starts, (ends - size)[back], side="right") - 1])
    b = np.concatenate([np.searchsorted(ends, (starts + size)[ahead]), line[back]])
    n = np.searchsorted(last, b, side="right") - a  # the grams inside of each window
    a, n = a[n > 0], n[n > 0]
    if not len(a):
        return keys[:0], starts[:0], starts[:0]
    first = np.cumsum(n) - n
    inside = np.repeat(a - first, n) + np.arange(n.sum())
    least = np.flatnonzero(keys[inside] == np.repeat(np.minimum.reduceat(keys[inside], first), n))
    least = least[np.searchsorted(least, first)]  # the first of equal ones
    chosen = np.unique(inside[least])
    return keys[chosen], starts[chosen], ends[last[chosen]] - starts[chosen]


def select_words(words: Words, gram: int = WORD_GRAM, passage: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word and number of words of the selected grams of words."""
    n = len(words.owner)
    if n < passage:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    keys = words.keys(at, at + gram)
    first = np.flatnonzero(words.owner[: n - passage + 1] == words.owner[passage - 1 :])  # windows inside of one text
    windows = sliding_window_view(keys, passage - gram + 1)
    least = np.concatenate([windows[k : k + CHUNK].argmin(axis=1) for k in range(0, len(windows), CHUNK)])  # argmin copies what it looks at
    at = first + least[first]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return keys[at], at, np.full(len(at), gram)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, first word (in its text) and number of words of all selected grams."""
    words = Words(texts)
    key, at, size = (np.concatenate(x) for x in zip(select_lines(words), select_words(words), strict=True))
    return words.owner[at], key, at - words.firsts[words.owner[at]], size


def contexts(texts: list[bytes], asks: list[list[int]], reach: int) -> list[np.ndarray]:
    """For each text's asks (a place between words, times two; plus one for what follows it) the words' short hashes going outward."""
    words = Words(texts)
    short, found = words.hashes.astype(np.uint32).view(np.int32), []
    for low, high, asked in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist(), asks, strict=True):
        for a in asked:
            at = low + a // 2
            found.append(short[at : min(at + reach, high)] if a % 2 else short[max(at - reach, low) : at][::-1])
    return found
