"""Best rows and row numbers within groups of any size, without a group's rows meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.storage import materialize

#: Parts that a group is dealt into before its best rows are sought.
SALTS = 64


def _columns(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_rows(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group in the given total order.

    Each group is dealt into SALTS parts by a hash of its rows; the best k of the parts meet. So a group that holds most rows of
    the table costs one task a SALTS-th of it, and the second step k * SALTS rows.
    """
    names = df.columns
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names if c not in keys] or [F.lit(0)]), F.lit(SALTS)))
    for by in ([*keys, "_part"], keys):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*_columns(order)))
        salted = salted.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
    return salted.select(*[F.col(f"`{c}`") for c in names])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with `name` (long, from 0): each row's place in its group, in the total order of `order`.

    Rows are dealt into ranges of (keys, order), so a large group spans many of them; a row's place is its place within its range
    plus the rows of the group in the ranges before. Of these only counts are summed up. Rows are written once, since their
    ranges must not change between the two readings.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("long")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_range"]]
    both = dealt.withColumn("_own", own).alias("a").join(starts.alias("b"), same)
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._own") + F.col("b._before") - 1).alias(name))
