"""Repeated runs of lines and passages, found by winnowing over line hashes.

`passages` selects window minima as fingerprints: grams of lines, and grams of words for passages that begin or
end inside a line. Positions are joined on the fingerprint: each occurrence meets the first one (by doc_id,
text hash, place), never all others. Matched grams of a document that overlap or touch are one run. A run is then
extended both ways, word by word, as far as its words equal those around the first occurrence of the gram at that end (up
to REACH words, since a longer repeat holds a further fingerprint). A run of at least PASSAGE_WORDS words goes as it is; of a
shorter one its whole lines go, if they have LINE_GRAM words together.

Texts meet the join twice: for the words around the runs, and to be cut. What they meet are written tables of a few
numbers a run, so Spark broadcasts them while they are small, and shuffles the texts by document where they aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm import passages
from trendloom.llm.common import materialize

#: A run is extended by so many words at each end.
REACH = 25
#: Bytes of text taken at once.
SLICE_BYTES = 1 << 20
#: ASCII white space separates words.
SPACES = b" \t\n\v\f\r"
LEAST_LONG = -(1 << 63)


def _rows(docs: DataFrame) -> DataFrame:
    """`doc_id, mark, text`: a document is known by its id (null: the least long) and its text's hash."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG))
    return docs.select(ids.alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of the column's text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def fingerprints(docs: DataFrame) -> DataFrame:
    """`key, doc_id, mark, at, size`: the selected grams of every row, from word `at` on."""
    names = ["key", "doc_id", "mark", "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                owner, key, at, size = passages.fingerprints([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()])
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner),
                    pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], names)

    return _rows(docs).mapInArrow(run, "key long, doc_id long, mark long, at int, size int")


def _runs(found: DataFrame) -> DataFrame:
    """`doc_id, mark, first, last, head, tail`: stretches of words (last excluded) that matched grams cover without a gap.

    `head` and `tail` are the first occurrences (document, text hash, place) of the words at the stretch's two ends; head has the
    number of words of the gram that found it, too.
    """
    origins = found.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "at")).alias("o"), F.count("*").alias("n")).where("n > 1").drop("n")
    origins = materialize(origins, "origins")  # so that a common key's rows can be split in the join
    later = found.join(origins, "key").where(F.struct("doc_id", "mark", "at") > F.col("o"))
    until = F.col("at") + F.col("size")
    later = later.select(
        "doc_id", "mark", "at", until.alias("until"), F.struct("o.doc_id", "o.mark", F.col("o.at").alias("place"), "size").alias("head"),
        F.struct("o.doc_id", "o.mark", (F.col("o.at") + F.col("size")).alias("place")).alias("tail"))
    places = Window.partitionBy("doc_id", "mark").orderBy("at")
    before = F.max("until").over(places.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("new", F.when(F.col("at") <= before, 0).otherwise(1))
    numbered = begun.withColumn("run", F.sum("new").over(places.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("doc_id", "mark", "run").agg(F.min(F.struct("at", "head")).alias("a"), F.max(F.struct("until", "tail")).alias("b"))
    return whole.select("doc_id", "mark", F.col("a.at").alias("first"), F.col("b.until").alias("last"), "a.head", "b.tail")


def _contexts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """`c_doc, c_mark, c_ask, around`: the words outward of the asked places; both documents of an end are asked."""
    asks = ends.select("doc_id", "mark", "ask").union(ends.select("o_doc", "o_mark", "o_ask"))
    asks = asks.groupBy(F.col("doc_id").alias("c_doc"), F.col("mark").alias("c_mark")).agg(F.sort_array(F.collect_set("ask")).alias("asks"))
    asks = materialize(asks, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                asked = part.column(3).to_pylist()
                found = passages.contexts(part.column(2).cast(pa.binary()).to_pylist(), asked, REACH)
                if not found:
                    continue
                owner = pa.array(np.repeat(np.arange(len(asked)), [len(a) for a in asked]), pa.int32())
                around = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), part.column(3).flatten(), around], ["c_doc", "c_mark", "c_ask", "around"])

    rows = _rows(docs).join(asks, (F.col("doc_id") == F.col("c_doc")) & (F.col("mark") == F.col("c_mark")))
    # rows that repeat an id and a text give the same words
    one = rows.select("c_doc", "c_mark", "text", "asks").mapInArrow(run, "c_doc long, c_mark long, c_ask int, around array<int>")
    return one.groupBy("c_doc", "c_mark", "c_ask").agg(F.max("around").alias("around"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """`doc_id, mark, runs`: per document its repeated runs of words (first, last; last excluded), extended both ways."""
    runs = _runs(materialize(fingerprints(docs), "fingerprints"))
    # of a text that repeats itself at a distance of less than a gram, so many of the run's first words are the first occurrence's
    own = (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.mark") == F.col("mark"))
    runs = materialize(runs.withColumn("lead", F.when(own, F.greatest(F.lit(0), F.col("head.size") + F.col("head.place") - F.col("first"))).otherwise(0)).withColumn("head", F.col("head").dropFields("size")), "runs")
    # an ask is a place between words, times two; plus one for what follows it
    end = F.explode(F.array(
        F.struct((F.col("first") * 2).alias("ask"), F.col("head").alias("o")), F.struct((F.col("last") * 2 + 1).alias("ask"), F.col("tail").alias("o")))).alias("end")
    ends = runs.select("doc_id", "mark", "first", "last", "lead", end).select(
        "doc_id", "mark", "first", "last", "lead", "end.ask", F.col("end.o.doc_id").alias("o_doc"), F.col("end.o.mark").alias("o_mark"),
        (F.col("end.o.place") * 2 + F.col("end.ask") % 2).alias("o_ask"))
    found = materialize(_contexts(docs, ends), "contexts")
    mine = found.select("c_doc", "c_mark", "c_ask", F.col("around").alias("own"))
    ends = ends.join(mine, (F.col("doc_id") == F.col("c_doc")) & (F.col("mark") == F.col("c_mark")) & (F.col("ask") == F.col("c_ask"))).drop("c_doc", "c_mark", "c_ask")
    ends = ends.join(found, (F.col("o_doc") == F.col("c_doc")) & (F.col("o_mark") == F.col("c_mark")) & (F.col("o_ask") == F.col("c_ask")))
    unlike = F.array_position(F.zip_with("own", "around", lambda x, y: x.eqNullSafe(y)), False).cast("int")
    more = F.when(unlike == 0, F.size("own")).otherwise(unlike - 1)
    whole = ends.groupBy("doc_id", "mark", "first", "last", "lead").agg(
        F.max(F.when(F.col("ask") % 2 == 0, more)).alias("ahead"), F.max(F.when(F.col("ask") % 2 == 1, more)).alias("behind"))
    run = F.struct((F.col("first") - F.col("ahead") + F.col("lead")).alias("first"), (F.col("last") + F.col("behind")).alias("last"))
    whole = whole.where(run["first"] < run["last"])
    return whole.groupBy("doc_id", "mark").agg(F.collect_set(run).alias("runs"))


def repeated_words(starts: np.ndarray, ends: np.ndarray, n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of a text's n words go; `starts` and `ends` are the places of its lines with words."""
    gone = np.zeros(n + 1, np.int64)
    for first, last in runs:
        if last - first < passages.PASSAGE_WORDS:  # whole lines only
            a, b = int(np.searchsorted(starts, first)), int(np.searchsorted(ends, last, side="right"))
            if a >= b or ends[b - 1] - starts[a] < passages.LINE_GRAM:
                continue
            first, last = int(starts[a]), int(ends[b - 1])
        gone[first] += 1
        gone[last] -= 1
    return np.cumsum(gone)[:-1] > 0


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the repeated words, and how many lines went."""
    data = np.frombuffer(text, np.uint8)
    begin, end = passages.word_spans(data)
    lines = text.split(b"\n")
    line = np.searchsorted(np.flatnonzero(data == 0x0A), begin)
    counts = np.bincount(line, minlength=len(lines))
    solid = counts > 0
    ends = np.cumsum(counts)
    gone = repeated_words((ends - counts)[solid], ends[solid], len(begin), runs)
    cut = np.bincount(line, gone, len(lines))
    off = solid & (cut == counts)
    for i in np.flatnonzero((cut > 0) & ~off).tolist():
        own = slice(ends[i] - counts[i], ends[i])
        at = int(begin[own.start]) - (len(lines[i]) - len(lines[i].lstrip(SPACES)))
        lines[i] = without_words(lines[i], list(zip((begin[own] - at).tolist(), (end[own] - at).tolist(), strict=True)), gone[own].tolist())
    place = np.arange(len(lines))
    before = np.maximum.accumulate(np.where(solid, place, -1))
    after = np.minimum.accumulate(np.where(solid, place, len(lines))[::-1])[::-1]
    inner = ~solid & (before >= 0) & (after < len(lines))  # blank lines between others go with both neighbours
    off[inner] = off[before[inner]] & off[after[inner]]
    return b"\n".join(line for line, x in zip(lines, off.tolist(), strict=True) if not x), int(off.sum())


def without_words(line: bytes, words: list[tuple[int, int]], cut: list[bool]) -> bytes:
    """The line without some words: a kept word goes with the white space before it, the first one with what leads the line."""
    kept = b"".join(line[words[j - 1][1] if j else 0 : words[j][1]] for j in range(len(words)) if not cut[j])
    return (kept.lstrip(SPACES) if cut[0] else kept) + (b"" if cut[-1] else line[words[-1][1] :])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`row` (all columns of `docs` but text), `new_text`, `n_lines`, `n_removed`, `changed` of every row.

    Repeated runs stay at their first occurrence (smallest doc_id, then text hash, then place) and go everywhere else,
    within a document too: whole lines from LINE_GRAM words a run on (always found from LINE_WINDOW words on; shorter
    ones if a window selects them), and whatever words of a run of PASSAGE_WORDS, which may begin and end inside a
    line; of such a line the other words stay, and it isn't counted in `n_removed`. A run is a stretch of words that repeated grams
    cover without a gap, and what extends it: the words at its ends that equal those around the first occurrence of
    its first, or last, gram; words that equal only a later occurrence's stay. A text that repeats itself every p words keeps the first p of them, or the first gram's
    words if those are more (WORD_GRAM, or those of its lines), since a repeat's words never count as its own first occurrence's. Lines compare by their words; a blank
    line goes if the nearest lines with words on both sides go. Runs of fewer than LINE_GRAM words stay. A null text stays
    null with 0 lines; a text may become empty. Rows that repeat a doc_id and a text are one document and change
    alike; a null doc_id counts as the least long, so such a document comes first. No rows give no rows.
    """
    runs = materialize(repeated_runs(docs), "repeats").select(F.col("doc_id").alias("run_doc"), F.col("mark").alias("run_mark"), "runs")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("id"), F.xxhash64("text").alias("mark"))
    joined = rows.join(runs, (F.col("id") == F.col("run_doc")) & (F.col("mark") == F.col("run_mark")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                texts, lines, removed = part.column(1).cast(pa.binary()).to_pylist(), [], []
                for i, found in enumerate(part.column(2).to_pylist()):
                    lines.append(0 if texts[i] is None else texts[i].count(b"\n") + 1)
                    if found:
                        texts[i], n = without_runs(texts[i], [(r["first"], r["last"]) for r in found])
                    removed.append(n if found else 0)
                new = pa.array(texts, pa.binary()).cast(pa.string())
                changed = pc.fill_null(pc.not_equal(new, part.column(1)), False)
                yield pa.RecordBatch.from_arrays([part.column(0), new, pa.array(lines, pa.int32()), pa.array(removed, pa.int32()), changed], names)

    names = ["row", "new_text", "n_lines", "n_removed", "changed"]
    schema = joined.select("row").schema
    for name, kind in zip(names[1:], (T.StringType(), T.IntegerType(), T.IntegerType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)
    return joined.select("row", "text", "runs").mapInArrow(cut, schema)


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with its own columns; text without later repeats, and n_chars (if there) counted anew."""
    out = dedup_lines(docs)
    kinds = dict(docs.dtypes)

    def column(c: str):
        if c == "text":
            return F.col("new_text").alias(c)
        if c == "n_chars":
            return F.when(F.col("changed"), F.length("new_text").cast(kinds[c])).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])
