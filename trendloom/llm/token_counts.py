"""Token counts: batches of texts are encoded in Arrow functions that return only lengths.

Texts are cut at safe boundaries (before runs of spaces, which no piece of the vocabulary crosses; in long stretches without
spaces between characters that stand next to each other in no piece, so that no merge crosses them),
so a long text isn't encoded whole, and each batch is balanced by bytes: whatever rows Spark's
Arrow batches hold, the function encodes slices of at most `BATCH_BYTES` and counts each distinct
unit of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import only_columns, spread
from trendloom.llm.pieces import MODEL, SPACE, processor, units, vocabulary

BATCH_BYTES = 4 << 20
#: Counts of so many units are remembered between slices of a task.
REMEMBERED = 800_000
LIMIT = 4096
#: Characters after which a stretch without spaces is cut at the next safe boundary.
STRETCH = 2048


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most `most` bytes each (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def stretches(unit: str, bigrams: set[str]) -> list[str]:
    """A long unit's parts; each but the first begins with the last character of the one before, which it has no merge with."""
    text, parts, a = unit.replace(" ", SPACE), [], 0
    b = STRETCH
    while b < len(text):
        if text[b - 1 : b + 1] in bigrams:
            b += 1
            continue
        parts.append(unit[max(a - 1, 0) : b])
        a, b = b, b + STRETCH
    return [*parts, unit[max(a - 1, 0) :]]


class Counter:
    """Counts tokens of texts as the library does, without begin, end or added special tokens."""

    def __init__(self, model: str):
        self.encode, self.vocab, self.known, self.leads = processor(model).encode, vocabulary(model), {}, {}

    def count(self, texts: list[str]) -> list[int]:
        cut = [units(t, self.vocab) if t else [] for t in texts]
        known = self.known
        seen = set(chain.from_iterable(cut))
        if len(known) + len(new := seen - known.keys()) > REMEMBERED:
            known.clear()
            new = seen
        order = [u for u in new if len(u) <= STRETCH]
        known.update((u, self.count_long(u)) for u in new if len(u) > STRETCH)
        known.update(zip(order, map(len, self.encode([u[1:] if len(u) > 1 else u for u in order], num_threads=1)), strict=True))
        for u in order:
            if len(u) == 1:  # a space alone: the prefix, which the library adds only before text
                known[u] = 1
        return [sum(map(known.__getitem__, parts)) for parts in cut]

    def count_long(self, unit: str) -> int:
        """Tokens of a unit part by part; what a part's leading character adds, with the library's own prefix, is taken off again."""
        first, *rest = stretches(unit, self.vocab.bigrams)
        n = len(self.encode(first[1:]))
        for part in rest:
            n += len(self.encode(part)) - self.lead(part[0])
        return n

    def lead(self, character: str) -> int:
        if character not in self.leads:
            self.leads[character] = len(self.encode(character))
        return self.leads[character]


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row of `docs(doc_id, text)`.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts: list[int] = []
            for start, end in slices(sizes, BATCH_BYTES):
                counts += counter.count([t or "" for t in batch.column(1).slice(start, end - start).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = spread(only_columns(docs, {"doc_id": "long", "text": "string"})).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
