"""Incremental intake and windowed counts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom import schemas
from trendloom.functions import text
from trendloom.operators import counts

#: Papers as a feed gives them.
FEED = """arxiv_id string, title string, abstract string, authors array<string>, categories array<string>,
published_at timestamp, updated_at timestamp, pdf_url string, abs_url string"""
KEY = ["keyword", "category", "window_date"]


#: Which of a key's rows in one batch is the first: the least in these columns, of which a missing one is less than any other.
ROW = ["published_at", "title", "abstract", "updated_at", "pdf_url", "abs_url", "authors", "categories"]
TIMES = ["published_at", "updated_at"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders path/<kind>=<number> that were written to their end, by one listing."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ended = fs.globStatus(files.Path(folder, f"{kind}=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()[len(kind) + 1 :]) for s in ended or [])


def _read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The newest folder of compacted batches and those of the whole batches after it."""
    upto = max(_whole(spark, path, "upto"), default=-1)
    return [f"{path}/batch={n}" for n in _whole(spark, path, "batch") if n > upto] + ([f"{path}/upto={upto}"] if upto >= 0 else [])


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The papers of all whole batches."""
    return _read(spark, _folders(spark, path), FEED)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(F.sum("count").alias("count"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all whole batches."""
    return _summed(_read(spark, _folders(spark, path), schemas.KEYWORD_COUNTS))


def _compact(spark: SparkSession, path: str, schema: str, joined: Callable[[DataFrame], DataFrame]) -> None:
    older = _whole(spark, path, "batch")[:-1]
    done = max(_whole(spark, path, "upto"), default=-1)
    fresh = [n for n in older if n > done]
    if fresh:
        folders = [f"{path}/batch={n}" for n in fresh] + ([f"{path}/upto={done}"] if done >= 0 else [])
        joined(_read(spark, folders, schema)).write.mode("overwrite").parquet(f"{path}/upto={fresh[-1]}")


def compact_counts(spark: SparkSession, path: str) -> None:
    """Sums all batches but the newest, which may run again, into one folder; call it now and then between runs.

    Batches taken in are read no more; what removes old files may remove them.
    """
    _compact(spark, path, schemas.KEYWORD_COUNTS, _summed)


def compact_papers(spark: SparkSession, path: str) -> None:
    """Puts the papers of all batches but the newest into files of even size in one folder; as `compact_counts`."""
    _compact(spark, path, FEED, lambda df: df.hint("rebalance"))


def _rows_and_marks(stream: DataFrame) -> DataFrame:
    """`arxiv_id, digest, row`: every row of the stream, and one mark (neither digest nor row) for each key that was never seen before.

    The state holds keys, with and without digests of their rows. A row whose key is new always passes; one of a known key has no mark beside it.
    """
    exact = F.struct(*[F.unix_micros(c).alias(c) if c in TIMES else F.col(c) for c in ROW])
    digest = F.sha2(F.to_json(exact, {"ignoreNullFields": "false"}), 256)
    row = F.struct(*ROW)
    none = F.struct(F.lit(None).cast("string").alias("digest"), F.when(F.lit(False), row).alias("row"))
    both = stream.select("arxiv_id", F.explode(F.array(none, F.struct(digest.alias("digest"), row.alias("row")))).alias("x"))
    return both.select("arxiv_id", "x.digest", "x.row").dropDuplicates(["arxiv_id", "digest"])


def ingest_papers(stream: DataFrame, papers_path: str, counts_path: str, checkpoint: str) -> StreamingQuery:
    """New papers once each, and the keyword counts of new papers only, from a stream of papers (FEED columns).

    Which papers were seen is the stream's own state, keyed by arxiv_id in RocksDB stores under the checkpoint: a batch reads its own rows and
    the states of its own keys, and no older paper, however long the stream has run. Of several rows of a key in a batch the first
    in ROW counts; rows without an arxiv_id count as one key. A batch writes its rows alone, under batch=<number> of both tables; one that
    runs again finds the states as they were before it and overwrites itself with the same rows. Stops when all there is has been read.
    Built-in functions do it all: a call of Python for each key takes milliseconds. A key has two states (its own and its row's).
    """
    names = stream.sparkSession.createDataFrame([], FEED).columns

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("arxiv_id").agg(F.min("row").alias("row"), F.bool_or(F.col("digest").isNull()).alias("new")).where("new")
        first.select("arxiv_id", "row.*").select(*names).write.mode("overwrite").parquet(f"{papers_path}/batch={batch_id}")
        written = _read(spark, [f"{papers_path}/batch={batch_id}"], FEED)
        added = counts.keyword_counts(text.keywords(written), written)
        added.write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")

    spark = stream.sparkSession
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option, None)
    spark.conf.set(option, ROCKSDB)  # which the query takes with it when it starts
    try:
        return _rows_and_marks(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)


def windowed_counts(stream: DataFrame, size: str = "7 days", delay: str = "7 days") -> DataFrame:
    """`window_start, keyword, category, count` from `stream(ts, keyword, category, count)` in tumbling windows.

    Weeks begin on Monday (the epoch was a Thursday, hence the offset). Rows later than `delay` are dropped.
    """
    window = F.window("ts", size, size, "4 days") if size == "7 days" else F.window("ts", size)
    summed = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "keyword", "category").agg(F.sum("count").alias("count"))
    return summed.select(F.col("w.start").alias("window_start"), "keyword", "category", "count")
