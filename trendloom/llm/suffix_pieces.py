"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (see `pieces.units`, cut further wherever no piece holds the two
characters that meet) are concatenated and indexed by a suffix array sorted to the longest piece's
length. A binary search of every piece gives the range of its occurrences, hence all edges
(start, end, piece); sorted by end position, they are relaxed from left to right.

The vocabulary is BPE, so the best path isn't the one of the highest score sum. Relaxing uses the
fact that a chain of pieces is the BPE encoding of its text exactly if each two neighbours are the
encoding of theirs: of the edges into a position, the one whose piece may follow the last piece at
its start is taken. There is exactly one, and whether two pieces may be neighbours is found by
merging their text once and remembered.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trendloom.llm.common import only_columns
from trendloom.llm.pieces import MODEL, SPACE, Vocabulary, units, vocabulary
from trendloom.llm.token_counts import slices

BATCH_BYTES = 4 << 20
#: Characters indexed by one suffix array at most (or one unit's).
INDEXED = 400_000
#: Encodings of so many units are remembered between batches of a task.
REMEMBERED = 300_000
#: Longer runs of text without a cut are relaxed one by one, not in step with the others.
IN_STEP = 64
#: Judged pairs that are remembered (9 bytes each).
PAIRS = 1 << 20


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the texts of `depth` characters that begin there (prefix doubling)."""
    rank, order, width = codes + 1, np.argsort(codes, kind="stable"), 1
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:]
        key = rank * max(len(rank) + 2, 1 << 22) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
    return order


class Matcher:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        pieces = sorted(vocab.plain, key=lambda p: -len(p))
        self.ids = np.array([vocab.plain[p] for p in pieces], np.int32)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.longest = int(self.sizes.max())
        self.longer = [int((self.sizes > k).sum()) for k in range(self.longest)]  # pieces with a character k
        self.codes = np.zeros((len(pieces), self.longest), np.int64)
        for row, p in zip(self.codes, pieces, strict=True):
            row[: len(p)] = [ord(c) + 1 for c in p]
        self.text = vocab.pieces
        self.fits: dict[int, bool] = {}  # whether a pair may stand together; those of earlier batches, sorted:
        self.fit_keys, self.fit_values = np.array([-1]), np.array([False])
        self.slots = len(self.text) + (1 << 21)
        self.forget()

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of a piece in `codes` (0: between runs of text)."""
        order = suffix_order(codes, self.longest)
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(codes), np.int64)

        def search(after: bool) -> np.ndarray:
            lo, hi = low.copy(), high.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = order[np.minimum(mid, len(codes) - 1)]
                less, tied = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for k, m in enumerate(self.longer):
                    c, p = padded[at[:m] + k], self.codes[:m, k]
                    less[:m] |= tied[:m] & (c < p)
                    tied[:m] &= c == p
                right = less | (tied & after)
                lo = np.where(open_ & right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        first, last = search(False), search(True)
        found = last - first
        piece = np.repeat(np.arange(len(self.ids), dtype=np.int32), found)
        start = order[np.arange(len(piece)) + np.repeat(first - np.cumsum(found) + found, found)].astype(np.int32)
        return start, start + self.sizes[piece].astype(np.int32), self.ids[piece]

    def follows(self, last: int, nxt: int) -> bool:
        """Whether `nxt` may stand after `last` in an encoding (either may be a single character outside the
        vocabulary, which merges with nothing; last = -1: at the start)."""
        key = (last + 1) * self.slots + nxt
        if (known := self.fits.get(key)) is None:
            a = "" if last < 0 else self.spell(last)
            b = self.spell(nxt)
            known = self.fits[key] = merge(a + b, self.vocab.score) == ([a, b] if a else [b])
        return known

    def spell(self, slot: int) -> str:
        return self.text[slot] if slot < len(self.text) else chr(slot - len(self.text))

    def allowed(self, last: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        pairs, where = np.unique((last + 1) * self.slots + nxt, return_inverse=True)
        at = np.searchsorted(self.fit_keys, pairs)
        at[at == len(self.fit_keys)] = 0
        known, fits = self.fit_keys[at] == pairs, self.fit_values[at]
        fits[~known] = [self.follows(k // self.slots - 1, k % self.slots) for k in pairs[~known].tolist()]
        return fits[where]

    def settle(self) -> None:
        """Pairs that were judged since the last time join the sorted ones; beyond PAIRS only the new ones stay."""
        if len(self.fit_keys) > PAIRS:
            self.fit_keys, self.fit_values = np.array([-1]), np.array([False])
        keys = np.concatenate([self.fit_keys, np.fromiter(self.fits, np.int64, len(self.fits))])
        values = np.concatenate([self.fit_values, np.fromiter(self.fits.values(), bool, len(self.fits))])
        order = np.argsort(keys)
        self.fit_keys, self.fit_values = keys[order], values[order]
        self.fits = {}

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and how many each run has. No run is empty; prefix spaces are part of it."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        joined = np.frombuffer("\0".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        gap = (begin + sizes)[:-1]
        codes = joined.copy()
        codes[gap] = 0
        start, end, piece = self.edges(codes)
        alone = codes > 0
        alone[start[end - start == 1]] = False
        lone = np.flatnonzero(alone)  # characters that are no piece
        start, end = np.concatenate([start, lone]).astype(np.int32), np.concatenate([end, lone + 1]).astype(np.int32)
        piece = np.concatenate([piece, (len(self.text) + codes[lone] - 1).astype(np.int32)])
        run_of = np.repeat(np.arange(len(runs)), sizes + 1)[: len(codes)]
        step = end - begin[run_of[start]]
        stepwise = sizes[run_of[start]] <= IN_STEP
        last, back = np.full(len(codes) + 1, -2, np.int64), np.zeros(len(codes) + 1, np.int64)
        last[begin] = -1

        picked = np.flatnonzero(stepwise)
        picked = picked[np.argsort(step[picked], kind="stable")]
        bounds = np.searchsorted(step[picked], np.arange(1, IN_STEP + 2))
        held = np.full(len(codes) + 1, -2, np.int64)  # what is held at a start differs from what ends in a gap before it
        held[begin] = -1
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                e = picked[a:b]
                e = e[held[start[e]] != -2]
                e = e[self.allowed(held[start[e]], piece[e])]
                held[end[e]], back[end[e]] = piece[e], start[e]
                last[end[e]] = piece[e]
        rest = np.flatnonzero(~stepwise)
        rest = rest[np.argsort(end[rest], kind="stable")]
        for s, t, p in zip(start[rest].tolist(), end[rest].tolist(), piece[rest].tolist(), strict=True):
            if held[s] != -2 and self.follows(int(held[s]), p):
                held[t], back[t], last[t] = p, s, p

        # walk back from every run's end, all runs at a time
        owner, at, floor = np.arange(len(runs)), begin + sizes, begin
        owners, slots = [], []
        while len(owner):
            owners.append(owner)
            slots.append(last[at])
            at = back[at]
            on = at > floor
            owner, at, floor = owner[on], at[on], floor[on]
        owner, slot = np.concatenate(owners[::-1]), np.concatenate(slots[::-1])
        order = np.argsort(owner, kind="stable")
        return self.with_bytes(owner[order], slot[order], len(runs))

    def with_bytes(self, owner: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and how many each owner has; characters that are no piece become byte pieces."""
        lone = np.flatnonzero(slot >= len(self.text))
        if len(lone):
            width = np.ones(len(slot), np.int64)
            raw = [[self.vocab.fallback[b] for b in chr(s - len(self.text)).encode("utf-8", "surrogatepass")] for s in slot[lone].tolist()]
            width[lone] = [len(r) for r in raw]
            owner, wide = np.repeat(owner, width), np.repeat(slot, width)
            wide[wide >= len(self.text)] = [i for r in raw for i in r]
            slot = wide
        return slot.astype(np.int32), np.bincount(owner, minlength=n)

    def remember(self, wanted: list[str]) -> None:
        """Encodes the units in `wanted` that aren't known yet, all in one suffix array."""
        runs: dict[str, int] = {}
        parts: list[int] = []
        sizes: list[int] = []
        for unit in wanted:
            before = len(parts)
            text, a = unit.replace(" ", SPACE), 0
            if len(text) > IN_STEP:
                for b in range(1, len(text)):
                    if text[b - 1 : b + 1] not in self.vocab.bigrams:
                        parts.append(runs.setdefault(text[a:b], len(runs)))
                        a = b
            parts.append(runs.setdefault(text[a:], len(runs)))
            sizes.append(len(parts) - before)
        if runs:
            coded, counts = self.encode(list(runs))
            self.settle()
            part = np.array(parts)
            ids = gather(coded, np.cumsum(counts) - counts, counts, part)
            per_unit = np.add.reduceat(counts[part], np.cumsum(sizes) - sizes)
            self.known.update(zip(wanted, range(len(self.starts), len(self.starts) + len(wanted)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(per_unit) - per_unit])
            self.counts = np.concatenate([self.counts, per_unit])
            self.flat = np.concatenate([self.flat, ids])

    def forget(self) -> None:
        """Units' encodings: `known` has a unit's row in `starts` and `counts`, which point into `flat`."""
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        cut = [units(t, self.vocab) if t else [] for t in texts]
        seen = set(chain.from_iterable(cut))
        if len(self.known) + len(new := seen - self.known.keys()) > REMEMBERED:
            self.forget()
            new = seen
        chunk, held = [], 0
        for unit in sorted(new):
            if chunk and held + len(unit) > INDEXED:
                self.remember(chunk)
                chunk, held = [], 0
            chunk.append(unit)
            held += len(unit)
        self.remember(chunk)
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        counts = np.bincount(np.repeat(np.arange(len(cut)), per_text), self.counts[rows], len(cut)).astype(np.int64)
        return gather(self.flat, self.starts, self.counts, rows), counts


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The parts of `flat` that `rows` name, one after the other."""
    n = counts[rows]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[rows], n)]


def merge(text: str, score: dict[str, float]) -> list[str]:
    """BPE of a short text: merge the neighbours whose joint piece scores highest, the leftmost of equals."""
    parts = list(text)
    while True:
        best = max(((score[m], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in score), default=None)
        if best is None:
            return parts
        k = -best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@functools.cache
def matcher(model: str) -> Matcher:
    return Matcher(vocabulary(model))


class Decoder:
    """Ids to text: pieces' bytes one after the other, spaces back, the prefix space off."""

    def __init__(self, vocab: Vocabulary):
        raw = [bytes([vocab.byte_of[i]]) if i in vocab.byte_of else p.replace(SPACE, " ").encode() if p in vocab.plain else b"" for i, p in enumerate(vocab.pieces)]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        text = gather(self.bytes, self.starts, self.sizes, ids).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encoded(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, *more: list) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), lists, *map(pa.array, more)], ["doc_id", "n_tokens", "ids", "same"][: 3 + len(more)])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`doc_id, n_tokens, ids` of every row of `docs(doc_id, text)`; a null or empty text has no ids.

    Ids are the library's for this model, without begin, end or special tokens. Repeated rows each
    give a row; other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_BYTES):
                ids, counts = m.encode_texts([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield _encoded(batch.column(0).slice(a, b - a), ids, counts)
        m.forget()  # the worker goes on to other tasks

    return only_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """`doc_id, text` from `tokens(doc_id, ids)`; null or empty ids give the empty text.

    Bytes that are no UTF-8 become U+FFFD; decoding what `encode` gave returns the text (with U+2581,
    which the model doesn't tell from a space, as a space).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(model))
        for batch in batches:
            texts = [decoder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only_columns(tokens, {"doc_id": "long", "ids": "array<int>"}).mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`doc_id, n_tokens, ids, same` of every row of `docs(doc_id, text)`: as `encode`, and whether
    decoding the ids gives the text again (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, decoder = matcher(model), Decoder(vocabulary(model))
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, counts = m.encode_texts(texts)
                ends = np.cumsum(counts)
                same = [decoder.decode(ids[e - n : e]) == t.replace(SPACE, " ") for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True)]
                yield _encoded(batch.column(0).slice(a, b - a), ids, counts, same)
        m.forget()  # the worker goes on to other tasks

    return only_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, same boolean")
