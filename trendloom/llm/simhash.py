"""SimHash near-duplicates, matched by Golay-code fuzzy hashing.

A document's 64-bit fingerprint takes the bit-wise majority over the XXH64 hashes of its word
shingles. Two fingerprints link if they differ in at most three bits.

The 64 bits are cut into segments, each set into a 23-bit word. Each word of the perfect binary Golay code
[23,12,7] lies within distance 3 of exactly one codeword, so a word decodes to a 12-bit index. A neighbour
at distance 1 decodes to the same index, or, if the word lies at distance 3, to one of the five
codewords at distance 4. Hence the probe indices of a segment (one or six) hold the index of every word one
bit away. Three bit errors over three segments (22, 21, 21 bits) always leave two with at most one error
each: keys of 24 bits. Over four segments (16 bits each) they always leave one without an error and two
more with at most one each: keys of 40 bits, which `layout` takes for tables whose 24-bit keys would be
crowded; both find every link. Probe keys are joined with the index keys of the others, and the join
verifies the distance. A link is emitted by the first key that guarantees it, so exactly once.

A fingerprint has at most 43,744 others within three bits, so links grow in proportion to the distinct
fingerprints; copies share a fingerprint and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import components, materialize, only_columns

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: The greatest number of distinct fingerprints for which keys of 24 bits are used (84 probe keys a fingerprint, against 340).
NARROW_MAX = 1 << 25
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
POLYNOMIAL = 0b110001110101


@dataclass(frozen=True)
class Layout:
    """Segments as (shift, bits), and keys as (segments that must be equal, pair of segments with up to one error), in order."""

    segments: tuple[tuple[int, int], ...]
    keys: tuple[tuple[tuple[int, ...], tuple[int, int]], ...]


NARROW = Layout(((42, 22), (21, 21), (0, 21)), tuple(((), pair) for pair in combinations(range(3), 2)))
WIDE = Layout(((48, 16), (32, 16), (16, 16), (0, 16)), tuple(((k,), pair) for k in range(4) for pair in combinations([x for x in range(4) if x != k], 2)))


def layout(n: int) -> Layout:
    """The layout for so many distinct fingerprints."""
    return NARROW if n <= NARROW_MAX else WIDE


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 if it has no word (null, empty or only white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64, len(words) - k + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id, mark` (the text's hash), `fp` (signed long with the fingerprint's bits) of every row of `docs(doc_id, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = only_columns(docs, {"doc_id": "long", "text": "string"})
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern that leads to the nearest codeword, its weight, and the five
    patterns of weight 4 that lead to the next ones (used where the weight is 3)."""
    single = []
    for bit in range(23):
        word = 1 << bit
        for shift in range(bit, 10, -1):
            if word >> shift & 1:
                word ^= POLYNOMIAL << (shift - 11)
        single.append(word)
    leader, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    beyond: list[list[int]] = [[] for _ in range(2048)]
    for size in (1, 2, 3, 4):
        for bits in combinations(range(23), size):
            syndrome, pattern = 0, 0
            for b in bits:
                syndrome, pattern = syndrome ^ single[b], pattern | 1 << b
            if size == 4:
                beyond[syndrome].append(pattern)
            else:
                leader[syndrome], weight[syndrome] = pattern, size
    return leader, weight, np.array([x or [0] * 5 for x in beyond], np.int64)


def syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for shift in range(22, 10, -1):
        rest ^= np.where(rest >> shift & 1, POLYNOMIAL << (shift - 11), 0)
    return rest


def segment_indices(words: np.ndarray, tables: tuple) -> np.ndarray:
    """Per 23-bit word its six probe indices, -1 where there is none; the first is the word's own codeword index."""
    leader, weight, beyond = tables
    s = syndromes(words)
    more = np.where((weight[s] == 3)[:, None], (words[:, None] ^ beyond[s]) >> 11, -1)
    return np.concatenate([((words ^ leader[s]) >> 11)[:, None], more], axis=1)


def fingerprint_keys(fps: np.ndarray, form: Layout, tables: tuple, probing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each key of the layout the keys of these fingerprints, and whose they are (places in `fps`)."""
    words = [(fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in form.segments]
    indices = [segment_indices(w, tables)[:, : 6 if probing else 1] for w in words]
    for t, (equal, (i, j)) in enumerate(form.keys):
        base = reduce(lambda key, k: key << 16 | words[k], equal, np.full(len(fps), t, np.int64))[:, None, None]
        ok = (indices[i] >= 0)[:, :, None] & (indices[j] >= 0)[:, None, :]
        key = (base << 12 | indices[i][:, :, None]) << 12 | indices[j][:, None, :]
        yield key[ok], np.repeat(np.arange(len(fps)), ok.sum(axis=(1, 2)))


def _keyed(fps: DataFrame, form: Layout, probing: bool) -> DataFrame:
    """Rows `t, key, fp`: the index keys of each fingerprint, or its probe keys; t is the place in the layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                signed = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False)
                for t, (key, owner) in enumerate(fingerprint_keys(signed.view(np.uint64), form, tables, probing)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int8)), pa.array(key), pa.array(signed[owner])], ["t", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "t byte, key long, fp long")


def links(fps: DataFrame, form: Layout = NARROW) -> DataFrame:
    """Pairs `a, b` (a < b) of the distinct fingerprints `fps(fp)` that differ in at most three bits."""
    probe = _keyed(fps, form, True).select("t", "key", F.col("fp").alias("a"))
    index = _keyed(fps, form, False).select(F.col("key").alias("key2"), F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))

    def errors(k: int) -> Column:
        shift, bits = form.segments[k]
        return F.bit_count(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)))

    def holds(equal: tuple[int, ...], pair: tuple[int, int]) -> Column:
        return reduce(Column.__and__, [errors(k) == 0 for k in equal] + [errors(k) <= 1 for k in pair])

    first = F.coalesce(*[F.when(holds(*key), F.lit(t)) for t, key in enumerate(form.keys)])
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= MAX_BITS) & (first == F.col("t"))
    return probe.join(index, (F.col("key") == F.col("key2")) & near).select("a", "b")


def _with_components(docs: DataFrame) -> DataFrame:
    """`doc_id, mark` (the text's hash), `fp, root` of every row; root is a fingerprint of its component."""
    marks = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(marks.select("fp").distinct(), "classes")
    # written, so that in the join the rows of one large group of copies can be split
    roots = materialize(components(links(classes, layout(classes.count()))), "roots")
    return marks.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "mark", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint (16 hex digits), component_id` of every row of `docs(doc_id, text)`.

    component_id is the smallest doc_id reachable over links, itself included. Texts without a word
    (null, empty) have fingerprint zero and link like any other. Rows that repeat a doc_id each give
    a row; a null doc_id never names a component unless no other row is in it (then null). No rows give no rows.
    Copies share a fingerprint, so links are sought between distinct fingerprints only.
    """
    rooted = materialize(_with_components(docs), "rooted")
    named = materialize(rooted.groupBy(F.col("root").alias("name_root")).agg(F.min("doc_id").alias("component_id")), "named")
    return rooted.join(named, F.col("root") == F.col("name_root")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates: that of smallest doc_id (null last), then of smallest text hash.

    A document is known by its doc_id and its text. Rows that repeat both are copies, and one of them stays (that whose columns
    come first as JSON); unlike texts under one doc_id are unlike documents. Texts are only grouped where rows repeat.
    """
    same = _with_components(docs).groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "n")
    kept = materialize(same.groupBy("root").agg(F.min(first).alias("k")).select("k.*"), "kept")
    # the caller's columns in one struct, whatever their names are
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("mark"))
    key = ["none", "id", "mark"]
    out = rows.join(kept.where("n = 1"), key, "left_semi").select("row")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        out = out.union(rows.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
