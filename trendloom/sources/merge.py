"""Writes into keyed tables, as functions from (target, batch) to the new table.

Nothing is updated in place: the result goes to a staging path or replaces the touched partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.storage import materialize


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of the batch whose key the target lacks, one per key: the first in `order` (by default by all columns)."""
    first = first_seen(batch, keys, order or [c for c in batch.columns if c not in keys] or keys)
    return first.alias("b").join(target.select(*keys).alias("t"), _same(keys), "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the batch's new rows; existing keys stay as they are."""
    return target.unionByName(new_rows(target, batch, keys), allowMissingColumns=True)


def insert_counts(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row `new, skipped` for that insertion."""
    total = batch.agg(F.count("*").alias("n"))
    return new_rows(target, batch, keys).agg(F.count("*").alias("new")).crossJoin(total).select("new", (F.col("n") - F.col("new")).alias("skipped"))


def accumulate(target: DataFrame, batch: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds the batch's `sums` to the rows of the same key, or starts new ones."""
    both = target.select(*keys, *sums).unionByName(batch.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def last_written(batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the one written last, which comes last in `order` (by default by all columns, which is the same on every run)."""
    by = F.struct(*(order or []), *batch.columns)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), by).alias("_row")).select("_row.*")


def replace(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The batch's rows instead of those of the same key; others stay. Of several rows of a key the one written last wins (see `last_written`).

    A column of the batch that the target lacks becomes a column of the result, unless it only gives the `order`.
    """
    kept = target.alias("t").join(batch.select(*keys).alias("b"), _same(keys), "left_anti")
    return kept.unionByName(last_written(batch, keys, order).select(*[c for c in batch.columns if c in target.columns or c not in (order or ())]), allowMissingColumns=True)


def update_columns(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Sets the updates' other columns on the rows of the same key, where the new value isn't null.

    Several updates of a key act one after the other in `order` (by default by all columns), so each column gets its last value
    that isn't null, and no row of the target is repeated. Columns that the target lacks, like those of `order` alone, are left out.
    """
    changed = [c for c in updates.columns if c not in keys and c in target.columns]
    by = F.struct(*(order or []), *updates.columns)
    one = updates.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in changed])
    joined = target.alias("t").join(one.alias("b"), _same(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c) if c in changed else F.col(f"t.{c}") for c in target.columns])


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that `df` touches."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def with_bucket(df: DataFrame, keys: list[str], buckets: int, name: str = "bucket") -> DataFrame:
    """`df` with the hash bucket of its keys; a table laid out by it is partitioned by `name`."""
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def read_partitions(spark: SparkSession, path: str, schema: StructType | str, by: str, values: list | None = None) -> DataFrame:
    """The table at `path`, laid out by `by`; with `values` those partitions alone. A table not written yet has no rows."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    if values is None:
        return df
    named = F.col(by).isin([x for x in values if x is not None])
    return df.where(named | F.col(by).isNull() if None in values else named)


def merge_into(spark: SparkSession, path: str, batch: DataFrame, by: str, merged: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | str | None = None) -> list:
    """Merges `batch` into the table at `path`, which is laid out by its column `by`; gives the partitions that were touched.

    `merged(target, batch)` is one of the functions above with its keys, of which `by` must be a function (a part of the key, or a hash of
    it by `with_bucket`): then a key's rows all lie in one partition. Only partitions that the batch has rows for are read, and
    only they are written again; files of all others stay. What they become is written beside the table first, so a job that
    fails while merging leaves the table as it was, and one that runs again gives the same rows (but for `accumulate`, which
    adds again what was added). The driver gets the names of the touched partitions alone. `schema` is the table's, by default the batch's.
    """
    batch = materialize(batch, "batch")
    touched = sorted((r[0] for r in batch.select(by).distinct().collect()), key=lambda x: (x is None, x))
    if touched:
        new = materialize(merged(read_partitions(spark, path, schema or batch.schema, by, touched), batch), "merged")
        write_partitions(new.hint("rebalance", by), path, by)
    return touched
