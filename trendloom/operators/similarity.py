"""Exact cosine search over embeddings, and embedding pending papers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.functions.calls import each_or_none
from trendloom.storage import materialize

#: Vectors in one side of a tile.
TILE = 16384
#: Bytes of query vectors (as doubles) that are sent to every task at a time, and how many such blocks are worth a pass over the corpus each.
BLOCK_BYTES = 32 << 20
MOST_BLOCKS = 8
#: Queries, and corpus rows, of one matrix product.
QUERIES, ROWS = 256, 4096
FOUND = "query_id long, paper_id long, score double"


def _tiles(df: DataFrame) -> int:
    return max(1, -(-df.count() // TILE))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, as unit rows, from its flat buffer."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]) if chunks else pa.array([], pa.float32())
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


class Best:
    """The k best papers of each of n queries so far: scores falling, ties by id; free places score minus infinity."""

    def __init__(self, n: int, k: int, min_score: float) -> None:
        self.scores, self.papers = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, min_score)  # what a paper must score to be looked at

    def add(self, first: int, scores: np.ndarray, papers: np.ndarray) -> None:
        """Takes in a block of scores (queries from `first` on, papers)."""
        owner, column = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if not len(owner):
            return
        k = self.scores.shape[1]
        asked = np.unique(owner)
        owners = np.concatenate([np.repeat(asked, k), owner])
        all_scores = np.concatenate([self.scores[first + asked].ravel(), scores[owner, column]])
        all_papers = np.concatenate([self.papers[first + asked].ravel(), papers[column]])
        order = np.lexsort((all_papers, -all_scores, owners))
        place = np.arange(len(order)) - np.searchsorted(owners[order], owners[order])
        kept = order[place < k]
        self.scores[first + asked], self.papers[first + asked] = all_scores[kept].reshape(-1, k), all_papers[kept].reshape(-1, k)
        self.least[first + asked] = np.maximum(self.least[first + asked], self.scores[first + asked, -1])


def _nearest_in_place(corpus: DataFrame, queries: DataFrame, blocks: int, top_k: int, min_score: float) -> DataFrame:
    """Each task scans the vectors where they lie against a block of queries that it has whole, and passes on the best of each query."""
    context = corpus.sparkSession.sparkContext
    found = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow().combine_chunks()
        sent = context.broadcast((own.column("query_id").to_numpy(), _unit(own.column("embedding"))))  # BLOCK_BYTES at most, about

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            best = Best(len(ids), top_k, min_score)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    papers, unit = part.column(0).to_numpy(), _unit(part.column(1))
                    for first in range(0, len(ids), QUERIES):
                        best.add(first, vectors[first : first + QUERIES] @ unit.T, papers)
            owner, place = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(best.papers[owner, place]), pa.array(best.scores[owner, place])], ["query_id", "paper_id", "score"])

        if own.num_rows:
            found.append(corpus.select("paper_id", "embedding").mapInArrow(scan, FOUND))
    out = found[0] if found else corpus.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        out = out.union(more)
    return out


def _nearest_in_tiles(corpus: DataFrame, queries: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """Both sides are dealt into tiles by id; each pair of tiles is one matrix product that keeps its own best."""
    nc, nq = _tiles(corpus), _tiles(queries)
    left = corpus.select("paper_id", "embedding", F.pmod(F.xxhash64("paper_id"), F.lit(nc)).cast("int").alias("pc"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("pq"))
    right = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("pq"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("pc"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "paper_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        unit, papers, ids = _unit(a.column("embedding")), a.column("paper_id").to_numpy(), b.column("query_id").to_numpy()
        state = Best(len(ids), top_k, min_score)
        for first in range(0, len(ids), QUERIES):
            vectors = _unit(b.column("embedding").slice(first, QUERIES))
            for at in range(0, len(papers), ROWS):
                state.add(first, vectors @ unit[at : at + ROWS].T, papers[at : at + ROWS])
        owner, place = np.nonzero(state.scores > -np.inf)
        return pa.table({"query_id": pa.array(ids[owner]), "paper_id": pa.array(state.papers[owner, place]), "score": pa.array(state.scores[owner, place])})

    return left.groupBy("pc", "pq").cogroup(right.groupBy("pc", "pq")).applyInArrow(best, FOUND)


def nearest(emb: DataFrame, query_vecs: DataFrame, top_k: int = 5, min_score: float = 0.7, block_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """`query_id, paper_id, score, rank`: the best rows of `emb(paper_id, embedding)` for each `query_vecs(query_id, embedding)`.

    The scan is exact. The queries' bytes are counted first: up to `block_bytes` they are sent to every task, which scans its part of the corpus
    in place and keeps the best top_k a query; beyond that the queries go in blocks of that size, a scan each; and where more than
    `most_blocks` scans were needed, both sides are dealt into tiles. In no form does what a task holds grow with the tables, and
    only the last moves vectors of the corpus. Vectors of zero length score 0; null ones are left out. All vectors have one length.
    """
    corpus, queries = (df.where(F.col("embedding").isNotNull()) for df in (emb, query_vecs))
    size = queries.agg(F.coalesce(F.sum(8 * F.size("embedding") + 8), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = -(-size // block_bytes)
    found = _nearest_in_place(corpus, queries, blocks, top_k, min_score) if blocks <= most_blocks else _nearest_in_tiles(corpus, queries, top_k, min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search(emb: DataFrame, papers: DataFrame, query_vecs: DataFrame, top_k: int = 5, min_score: float = 0.7) -> DataFrame:
    """The nearest papers with arxiv_id, title, a 300-character snippet, score and date, best first."""
    about = papers.select(F.col("id").alias("paper_id"), "arxiv_id", "title", F.substring("abstract", 1, 300).alias("abstract_snippet"), "published_at")
    return nearest(emb, query_vecs, top_k, min_score).join(about, "paper_id").select(
        "query_id", "paper_id", "arxiv_id", "title", "abstract_snippet", "score", "published_at", "rank")


def ground(directions: DataFrame, vectors: DataFrame, emb: DataFrame, papers: DataFrame, top_k: int = 5, min_score: float = 0.6) -> DataFrame:
    """`query_id, query, block` of every row of `directions(query_id, topic, direction)`: the query "topic: direction" and its context.

    `vectors(query_id, embedding)` are the caller's embeddings of those queries. One without a vector, or without a paper that
    scores `min_score`, has the empty context, so nothing that asks is held up.
    """
    found = text.context_block(search(emb, papers, vectors, top_k, min_score))
    query = F.concat(F.coalesce("topic", F.lit("")), F.lit(": "), F.coalesce("direction", F.lit("")))
    return directions.join(found, "query_id", "left").select("query_id", query.alias("query"), F.coalesce("block", F.lit("")).alias("block"))


def unembedded(papers: DataFrame, emb: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers without an embedding, by id."""
    pending = papers.join(emb.select(F.col("paper_id").alias("id")), "id", "left_anti")
    return pending if limit is None else pending.orderBy("id").limit(limit)


def embed_pending(papers: DataFrame, emb: DataFrame, embed_fn: Callable[[list[str]], list[list[float] | None]], batch: int = 32, limit: int | None = None) -> DataFrame:
    """`paper_id, embedding` of papers without an embedding, by their abstracts; null where the caller's function gave none or failed.

    Abstracts go to `embed_fn` in batches. One that fails is halved until single abstracts fail, so a bad one costs no other its
    vector and never ends the job. A null abstract has no embedding. The result is written down first, so that the caller's
    function isn't called again by whatever reads it several times.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asked, vectors = part["abstract"].notna().to_numpy(), np.full(len(part), None, object)
            rows = np.flatnonzero(asked)
            for at in range(0, len(rows), batch):
                own = rows[at : at + batch]
                for row, vector in zip(own.tolist(), each_or_none(embed_fn, part["abstract"].iloc[own].tolist()), strict=True):
                    vectors[row] = vector
            yield pd.DataFrame({"paper_id": part["id"], "embedding": vectors})

    pending = unembedded(papers, emb, limit).select("id", "abstract")
    return materialize(pending.mapInPandas(run, "paper_id long, embedding array<float>"), "embedded")


def embed_counts(embedded: DataFrame) -> DataFrame:
    """One row `embedded, skipped`."""
    return embedded.agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("skipped"))
