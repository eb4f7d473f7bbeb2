"""Keywords, weighted concepts, prompt blocks and model output."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.calls import each_or_none
from trendloom.storage import materialize, spread

# Words that are never keywords.
STOPWORDS = """a an the and or but in on at to for of with by from is are was were be been being have has had do does
did will would could should may might shall can that this all you these those it its we our they their which who what
how when where as if not no also such than then so up out about into through show shows shown use used using based
paper propose proposed presents present results""".split()
# Words that are dropped from uploaded documents besides those.
DOCUMENT_STOPWORDS = [*STOPWORDS, *"fig figure table section et al".split()]
TOKEN = "[a-zA-Z]{3,}"
WORD = re.compile(TOKEN)
NAMES = ["rank", "token", "count", "total"]


#: White space of any script, as `str.strip` takes it; Spark's `trim` alone takes blanks only.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Runs of three or more ASCII letters of the lower-cased text, in order, without stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stopwords))


def _ranked(rows: DataFrame, key: str, text: Column, stopwords: list[str], top_n: int) -> DataFrame:
    """`key, rank, token, count, total` of each row's most frequent tokens, ties by first appearance; total counts all its tokens.

    A document is one row, so its tokens are counted where it is read and nothing but the best ones leaves: built-in functions would
    explode and shuffle every token of the corpus, or sort them by interpreted lambdas at twenty times the time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, found = batch.slice(at, 1024), []
                for i, t in enumerate(part.column(1)):
                    counts = Counter(WORD.findall((t.as_py() or "").lower()))
                    for w in stopwords:
                        counts.pop(w, None)
                    total = counts.total()
                    found += [(i, rank, w, n, total) for rank, (w, n) in enumerate(counts.most_common(top_n), 1)]
                owner, *columns = zip(*found, strict=True) if found else ((), (), (), (), ())
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *NAMES])

    read = rows.select(key, text.alias("_text"))
    kind = T.StructType([read.schema[0], *(T.StructField(n, k()) for n, k in zip(NAMES, (T.IntegerType, T.StringType, T.LongType, T.LongType), strict=True))])
    return spread(read).mapInArrow(run, kind)


def keywords(papers: DataFrame, top_n: int = 10, key: str = "arxiv_id") -> DataFrame:
    """`key, keyword, frequency, rank`: the most frequent tokens of title and abstract; ties keep first appearance. `key` is unique."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return _ranked(papers, key, text, STOPWORDS, top_n).select(key, F.col("token").alias("keyword"), F.col("count").alias("frequency"), "rank")


def weighted_concepts(docs: DataFrame, top_n: int = 50, key: str = "paper_id") -> DataFrame:
    """`key, concept, weight, rank`: weight is the token's share of all kept tokens of the document's text. `key` is unique."""
    found = _ranked(docs, key, F.col("text"), DOCUMENT_STOPWORDS, top_n)
    return found.select(key, F.col("token").alias("concept"), (F.col("count") / F.col("total")).alias("weight"), "rank")


def join_pages(pages: DataFrame, key: str = "paper_id") -> DataFrame:
    """`key, text, status`: page texts in page order, joined by blanks; only white space means failed."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    joined = pages.groupBy(key).agg(ordered.alias("_pages")).select(
        key, F.array_join(F.transform("_pages", lambda p: F.coalesce(p["text"], F.lit(""))), " ").alias("text"))
    return joined.withColumn("status", F.when(strip(F.col("text")) == "", "failed").otherwise("processed"))


def extraction_prompt(papers: DataFrame, most: int = 800) -> DataFrame:
    """`arxiv_id, prompt` for a concept extraction backend; abstracts are cut to `most` characters."""
    return papers.select("arxiv_id", F.format_string("Title: %s\nAbstract: %s", F.col("title"), F.substring("abstract", 1, most)).alias("prompt"))


def context_block(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, block`: numbered lines `[i] title (date) — snippet` of a query's hits, best first."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "paper_id")
    line = F.format_string("[%d] %s (%s) — %s", F.col("_i"), F.col("title"), F.date_format("published_at", "yyyy-MM-dd"), F.col("abstract_snippet"))
    lines = hits.withColumn("_i", F.row_number().over(best)).select(key, "_i", line.alias("_line"))
    return lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_line"))).alias("_l")).select(
        key, F.array_join(F.col("_l._line"), "\n").alias("block"))


# The instructions round the sources of a prompt, by what is asked for.
PROMPTS = {
    "prediction": ("You are a research trend analyst. Use the numbered sources below to support your analysis. Cite sources as [1], [2], etc.", "Prediction to analyse:\n"),
    "summary": ("You are a research assistant. Summarize what the literature says about the query below. Cite sources as [1], [2], etc.", "Query: "),
}


def grounded_prompt(asked: DataFrame, blocks: DataFrame, kind: str, key: str = "query_id") -> DataFrame:
    """`key, prompt` of every row of `asked(key, text)`: instructions, the sources of its block (none if it has no block) and the text."""
    head, before = PROMPTS[kind]
    joined = asked.join(blocks.select(key, "block"), key, "left")
    return joined.select(key, F.concat(F.lit(f"{head}\n\nSources:\n"), F.coalesce("block", F.lit("")), F.lit(f"\n\n{before}"), F.coalesce("text", F.lit(""))).alias("prompt"))


def signal_block(signals: DataFrame, top: int = 20) -> DataFrame:
    """One row `block`: a line per leading signal for a report prompt."""
    line = F.format_string("- %s: centrality=%.3f, velocity=%.1f, trend=%s", "concept_name", "centrality_score", "velocity", "trend")
    best = signals.orderBy(F.desc("composite_score"), "concept_name").limit(top)
    lines = best.select("composite_score", "concept_name", line.alias("_line"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("composite_score")).alias("_c"), "concept_name", "_line")))
    return lines.agg(ordered.alias("_l")).select(F.array_join(F.col("_l._line"), "\n").alias("block"))


def json_text(raw: Column) -> Column:
    """Model output without reasoning tags and, if it begins with one, its code fence."""
    text = strip(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?is)<think>.*?</think>", ""))
    bare = strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?", ""), r"```$", ""))
    return F.when(text.startswith("```"), bare).otherwise(text)


def _list_field(text: Column, field: str) -> Column:
    """Items of a list field as strings; anything but a list is no items, empty items are dropped."""
    raw = F.get_json_object(text, f"$.{field}")
    items = F.from_json(raw, "array<string>")
    return F.coalesce(F.filter(F.when(raw.startswith("["), items), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def parse_extractions(raw: DataFrame) -> DataFrame:
    """`arxiv_id, concepts, methods, datasets` from `raw(arxiv_id, raw)`; unusable output gives empty lists."""
    text = json_text(F.col("raw"))
    valid = F.try_parse_json(text).isNotNull() & text.startswith("{") & text.endswith("}")
    cut = raw.select("arxiv_id", F.when(valid, text).alias("_t"))
    return cut.select("arxiv_id", *[_list_field(F.col("_t"), f).alias(f) for f in ("concepts", "methods", "datasets")])


def extract_with(papers: DataFrame, fn: Callable[[list[str]], list[str | None]], batch: int = 32) -> DataFrame:
    """Runs a caller's batch function (prompts to raw outputs) over all papers and parses what it gives.

    A batch whose call raises, or gives another number of outputs, is halved until single prompts fail: these papers have empty lists, and no
    other loses its own. Raw outputs are written down first, so that the function isn't called again by whatever reads the result several times.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw: list[str | None] = []
            for at in range(0, len(part), batch):
                raw += each_or_none(fn, part["prompt"].iloc[at : at + batch].tolist())
            yield pd.DataFrame({"arxiv_id": part["arxiv_id"], "raw": raw})

    return parse_extractions(materialize(extraction_prompt(papers).mapInPandas(run, "arxiv_id string, raw string"), "extractions"))
