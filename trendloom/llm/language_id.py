"""Language identification of mixed-language text.

Per language, counts of character n-grams of words (with word ends) give log probabilities. A word's
script narrows the languages that may label it to those whose training text uses the script. Viterbi
over the words' scores with a penalty for switching gives a language per word; stretches of equal
labels are the spans. A text's language is the one whose spans hold the most letters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.common import spread
from trendloom.llm.token_counts import slices

#: First and last code points of the scripts that are told apart.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
WORDS = re.compile(r"[^\W\d_]+")
#: Combining marks belong to the word of the letter before them: vowel signs, points, decomposed accents. Joiners inside of words, too.
MARKED = regex.compile(r"\p{L}(?:[\p{L}\p{M}]|[\u200c\u200d](?=[\p{L}\p{M}]))*|[^\W\d_\p{M}\p{Cf}]")
#: Texts without any of these have no marks: where scripts with marks, joiners and marks of others stand.
FIRST_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u1dff\u200c\u200d\u20d0-\u20ff\u2cef-\u2dff\u302a-\u302f\u3099\u309a\ua66f-\uabff\ufb1e\ufe00-\ufe2f\U00010000-\U0010ffff]")
NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: At most so many labelled documents are learned from, those of least hash.
TRAIN_DOCS = 8000
SWITCH = 12.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
BATCH_BYTES = 2 << 20
#: Words whose n-grams are held at a time.
AT_ONCE = 20_000
REMEMBERED = 200_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    return MARKED.findall(text) if FIRST_MARK.search(text) else WORDS.findall(text)


def letters_of(words: list[str]) -> np.ndarray:
    """The number of letters of each word, its marks not counted."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not all(map(str.isalpha, words)):
        for k in np.flatnonzero(~np.fromiter(map(str.isalpha, words), bool, len(words))).tolist():
            sizes[k] = max(1, sum(map(str.isalpha, words[k])))
    return sizes


def _script_table() -> np.ndarray:
    table = np.zeros(0x10000, np.int8)  # 0: none of them
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, the word of each, and each word's script."""
    text = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    scripts = _script_table()[np.minimum(codes[np.cumsum(sizes) - sizes + 1], 0xFFFF)]
    buckets, owners = [], []
    mixed = np.zeros(len(codes), np.int64)
    for n in range(1, max(NGRAMS) + 1):
        mixed = mixed[: len(codes) - n + 1] * 1_000_003 + codes[n - 1 :]
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        if n in NGRAMS:
            hashed = (mixed * np.int64(-7046029254386353131) + n) >> 20 & (BUCKETS - 1)
            keep = inside & (codes[: len(hashed)] > 2) if n == 1 else inside
            buckets.append(hashed[keep])
            owners.append(owner[: len(hashed)][keep])
    return np.concatenate(buckets), np.concatenate(owners), scripts


@dataclass
class Model:
    """`langs`, `weights[bucket, lang]` (log probabilities) and `uses[script, lang]`."""

    langs: list[str]
    weights: np.ndarray
    uses: np.ndarray


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from text and non-null lang of `docs` whose crc32(doc_id as text) mod 5 isn't 0.

    Of those, the `train_docs` of least hash are read; their counts are summed on the executors, and the
    driver gets one count per language and bucket seen, at most BUCKETS a language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(5) != 0))
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).distinct()
    rows = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            words = list(map(words_of, batch.column(1).to_pylist()))
            for lang in sorted(set(labels)):
                own = list(chain.from_iterable(w for w, x in zip(words, labels, strict=True) if x == lang))
                n, used = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
                for at in range(0, len(own), AT_ONCE):
                    buckets, _, scripts = word_features(own[at : at + AT_ONCE])
                    n += np.bincount(buckets, minlength=BUCKETS)
                    used += np.bincount(scripts, minlength=len(SCRIPTS) + 1)
                keys = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(used)])
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(np.concatenate([n[n > 0], used[used > 0]]))], ["lang", "k", "n"])

    table = rows.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    lang = np.array([langs.index(x) for x in table.column("lang").to_pylist()], np.int64)
    key, n = table.column("k").to_numpy(), table.column("n").to_numpy()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[key[key >= 0], lang[key >= 0]] = n[key >= 0]
    uses = np.zeros((len(SCRIPTS) + 1, len(langs)))
    uses[-1 - key[key < 0], lang[key < 0]] = n[key < 0]
    weights = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, weights, uses > SCRIPT_SHARE * uses.sum(axis=0))


class Labeller:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def rows(self, words: list[list[str]]) -> np.ndarray:
        """The row in `scores` of every word."""
        seen = set(chain.from_iterable(words))
        if len(self.known) + len(new := seen - self.known.keys()) > REMEMBERED:
            self.known, self.scores, new = {}, self.scores[:0], seen
        order = sorted(new)
        self.known.update(zip(order, range(len(self.scores), len(self.scores) + len(order)), strict=True))
        self.scores = np.concatenate([self.scores, *(self.score(order[at : at + AT_ONCE]) for at in range(0, len(order), AT_ONCE))])
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))

    def score(self, words: list[str]) -> np.ndarray:
        buckets, owner, scripts = word_features(words)
        got = np.stack([np.bincount(owner, self.model.weights[buckets, k], len(words)) for k in range(len(self.model.langs))], axis=1)
        may = self.model.uses[scripts]
        got[~may & may.any(axis=1)[:, None]] -= 1000.0
        got[~np.fromiter((w[0].isalpha() for w in words), bool, len(words))] = 0  # numbers in letter-like signs
        return got.astype(np.float32)

    def label(self, texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
        """Words of each text and the language (its place in `langs`) of each word: Viterbi over all texts in step."""
        words = list(map(words_of, texts))
        rows = self.rows(words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        first, sizes = begin[order], n[order]
        best = np.zeros((len(order), len(self.model.langs)), np.float32)
        moved = np.zeros((len(rows), len(self.model.langs)), bool)
        source = np.zeros(len(rows), np.int16)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0) - 1, side="right").tolist()
        for t, m in enumerate(alive):
            at = first[:m] + t
            if t:
                top = best[:m].argmax(axis=1)
                jump = best[np.arange(m), top] - SWITCH
                better = jump[:, None] > best[:m]
                moved[at], source[at] = better, top
                best[:m] = np.where(better, jump[:, None], best[:m])
            best[:m] += self.scores[rows[at]]
        labels = np.zeros(len(rows), np.int16)
        state = best.argmax(axis=1) if len(self.model.langs) else np.zeros(len(order), np.int64)
        for t, m in zip(range(len(alive) - 1, -1, -1), reversed(alive), strict=True):
            at = first[:m] + t
            labels[at] = state[:m]
            state[:m] = np.where(moved[at, state[:m]], source[at], state[:m])
        return words, np.split(labels, begin[1:]) if len(begin) else []


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, lang_pred, score, spans` of every row of `docs(doc_id, text)`.

    lang_pred is `und` (score 0, no spans) where the text is null or has no letter, or nothing was
    learned; of languages whose spans hold as many letters it is the first by name. score is the share of the letters that
    lang_pred's spans hold. spans lists (lang, n_words, n_letters) in text order. Repeated rows each give a row.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    langs = [*model.langs, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in labelled(batches, shipped.value):
            pred, score, span_lang, span_words, span_letters, ends = [], [], [], [], [], [0]
            for lang, share, x, letters in found:
                pred.append(lang)
                score.append(share)
                if lang != UNKNOWN:
                    edge = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
                    span_lang += [langs[k] for k in x[edge]]
                    span_words += np.diff(np.append(edge, len(x))).tolist()
                    span_letters += np.add.reduceat(letters, edge).tolist()
                ends.append(len(span_lang))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(span_lang, pa.string()), pa.array(span_words, pa.int32()), pa.array(span_letters, pa.int32())], ["lang", "n_words", "n_letters"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang string, n_words int, n_letters int>>")


def labelled(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float, np.ndarray, np.ndarray]]]]:
    """The batches in parts of BATCH_BYTES of their second column's text; of each text its language and score, and of each of
    its words the language's place and the number of letters."""
    labeller, langs, none = Labeller(model), [*model.langs, UNKNOWN], np.zeros(0, np.int64)
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes, BATCH_BYTES):
            part, found = batch.slice(a, b - a), []
            words, labels = labeller.label([t or "" for t in part.column(1).to_pylist()]) if model.langs else ([[]] * (b - a), [none] * (b - a))
            for w, x in zip(words, labels, strict=True):
                if not len(w) or not any(map(str.isalpha, w)) and not any(c.isalpha() for t in w for c in t):
                    found.append((UNKNOWN, 0.0, none, none))
                else:
                    letters = letters_of(w)
                    share = np.bincount(x, letters, len(langs)) / letters.sum()
                    found.append((langs[int(share.argmax())], min(1.0, float(share.max())), x, letters))
            yield part, found


def predict(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, spans` of every row, learned from `docs` itself (see `fit`)."""
    found = identify(docs, fit(docs, train_docs))
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


def held_out(doc_id: int, n: int = 5, k: int = 0) -> bool:
    """The same remainder on the driver, for tests."""
    return zlib.crc32(str(doc_id).encode()) % n == k


def keep_identified(docs: DataFrame, train_docs: int = TRAIN_DOCS, languages: Collection[str] | None = None) -> DataFrame:
    """`docs` with the predicted language in `lang`, without the rows that language identification rejects.

    Those are rows without any letter (`und`) and rows whose language isn't among `languages` (None: all learned ones).
    """
    model = fit(docs, train_docs)
    shipped, asked = docs.sparkSession.sparkContext.broadcast(model), None if languages is None else set(languages)
    # texts pass through Python once, and rejected rows end there
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "lang")]
    rows = docs.select((F.struct(*rest) if rest else F.lit(0)).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in labelled(batches, shipped.value):
            langs = [lang for lang, *_ in found]
            kept = pa.array([lang != UNKNOWN and (asked is None or lang in asked) for lang in langs], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string())], ["row", "text", "lang"]).filter(kept)

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang", T.StringType())]))
    return out.select(*[F.col(c if c in ("text", "lang") else f"row.`{c}`").alias(c) for c in docs.columns])
