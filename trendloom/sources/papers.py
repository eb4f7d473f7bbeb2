"""Reading papers, citations and tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import schemas


def _tidy(text: Column) -> Column:
    """Line ends and double blanks become one blank, in a single pass, without outer blanks."""
    return F.trim(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def read_atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Papers of Atom feed files; entries without a usable id or date are dropped.

    The id is the last part of the entry's address, up to its version.
    """
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schemas.FEED_ENTRY).load(path)

    def link(name: str, value: str) -> Column:
        return F.filter("link", lambda x: x[name] == value)[0]["_href"]

    last = F.element_at(F.split(F.trim("id"), "/"), -1)
    papers = raw.select(
        F.split(last, "v")[0].alias("arxiv_id"), _tidy(F.col("title")).alias("title"), _tidy(F.col("summary")).alias("abstract"),
        F.coalesce(F.filter(F.col("author.name"), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.filter(F.col("category._term"), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>")).alias("categories"),
        F.try_to_timestamp("published").alias("published_at"), F.try_to_timestamp("updated").alias("updated_at"),
        link("_title", "pdf").alias("pdf_url"), link("_rel", "alternate").alias("abs_url"))
    return papers.where("arxiv_id <> '' AND published_at IS NOT NULL")


def by_month(papers: DataFrame) -> DataFrame:
    """Papers with `month`, the first day of their month of publication (null without a date), by which they are laid out."""
    return papers.withColumn("month", F.trunc("published_at", "month"))


def write_by_month(papers: DataFrame, path: str) -> None:
    """Adds papers to the table at `path`, one folder a month; rows of a month are spread over tasks where they are many."""
    laid = by_month(papers)
    laid.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def in_months(df: DataFrame, since: dt.datetime, until: dt.datetime) -> DataFrame:
    """`df` without the months that lie outside of the range, if it is laid out by month: only folders of the others are listed and read."""
    if "month" not in df.columns:
        return df
    return df.where((F.col("month") >= F.lit(since.date().replace(day=1))) & (F.col("month") <= F.lit(until.date().replace(day=1))))


def filter_published(df: DataFrame, since: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    """Both ends belong to the range. Of papers laid out by month, only months in it are read."""
    kept = in_months(df, since, until or dt.datetime(9999, 1, 1)).where(F.col("published_at") >= F.lit(since))
    return kept if until is None else kept.where(F.col("published_at") <= F.lit(until))


def parse_citation_payloads(df: DataFrame) -> DataFrame:
    """`arxiv_id, semantic_scholar_id, year, authors, citations, references` from `df(arxiv_id, payload)`.

    Only entries with an id stay; missing strings become "".
    """
    p = F.from_json("payload", schemas.CITATION_PAYLOAD)
    flat = df.select("arxiv_id", p.alias("p"))

    def ids(field: str) -> Column:
        return F.coalesce(F.filter(F.col(f"p.{field}.paperId"), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))

    authors = F.filter("p.authors", lambda a: a["authorId"].isNotNull() & (a["authorId"] != ""))
    authors = F.transform(authors, lambda a: F.struct(a["authorId"].alias("author_id"), F.coalesce(a["name"], F.lit("")).alias("author_name")))
    return flat.select(
        "arxiv_id", F.coalesce("p.paperId", F.lit("")).alias("semantic_scholar_id"), F.col("p.year").alias("year"),
        F.coalesce(authors, F.array().cast("array<struct<author_id:string,author_name:string>>")).alias("authors"),
        ids("citations").alias("citations"), ids("`references`").alias("references"))


def citation_rows(parsed: DataFrame) -> DataFrame:
    """`source_arxiv_id, cited_paper_id, citation_type`: citations and references of every paper."""
    def rows(field: str, kind: str) -> DataFrame:
        return parsed.select(F.col("arxiv_id").alias("source_arxiv_id"), F.explode(F.col(f"`{field}`")).alias("cited_paper_id"), F.lit(kind).alias("citation_type"))

    return rows("citations", "citation").unionByName(rows("references", "reference")).distinct()


def author_rows(parsed: DataFrame) -> DataFrame:
    """`paper_id, author_id, author_name`, one per paper and author; of several names the first by code points, empty ones last."""
    spread = parsed.select(F.col("arxiv_id").alias("paper_id"), F.explode("authors").alias("a"))
    return spread.select("paper_id", "a.author_id", "a.author_name").groupBy("paper_id", "author_id").agg(
        F.coalesce(F.min(F.when(F.col("author_name") != "", F.col("author_name"))), F.lit("")).alias("author_name"))


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database's table, read in `parts` ranges of its numeric `key`, whose bounds are asked first; rows without a key come with the first range."""
    options = properties or {}
    low, high = spark.read.jdbc(url, f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}) bounds", properties=options).first()
    if low is None:
        return spark.read.jdbc(url, name, properties=options)
    return spark.read.jdbc(url, name, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=options)


def snapshot(tables: dict[str, DataFrame], path: str, stamp: str) -> None:
    """Writes each table under path/stamp, from where `read_table` reads it."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{stamp}/{name}.parquet")
