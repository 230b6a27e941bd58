"""Samples, pages and quantiles in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_rank(seed: str, key: str) -> Column:
    """An order that is arbitrary, fixed by the seed, and equal in other engines."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The first `n` rows of each stratum by seeded hash, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(hash_rank(seed, key), key))).where(F.col("rank") <= n)


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """`n` rows taken in turn from each stratum, in seeded hash order."""
    return stratified_sample(df, [stratum], key, n, seed).orderBy("rank", stratum, key).limit(n)


def keyset_page(df: DataFrame, key: str, after: object, n: int) -> DataFrame:
    """The `n` rows after a key, and whether more follow."""
    bounded = df.where(F.col(key) > F.lit(after)).orderBy(key).limit(n + 1)
    return bounded.withColumn("rank", F.row_number().over(Window.orderBy(key))).withColumn("truncated", F.max("rank").over(Window.partitionBy()) > n).where(F.col("rank") <= n).drop("rank")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, median (mean of the middle two), nearest-rank 95th percentile and greatest, exact.

    Values are counted first, so ranks come from cumulative counts of distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)
    ranked = counted.withColumn("upto", F.sum("n").over(whole.orderBy(value))).withColumn("total", F.sum("n").over(whole))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col(value)))

    total = F.col("total")
    return ranked.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.min(value).alias("least"),
        ((at(F.floor((total + 1) / 2)) + at(F.floor((total + 2) / 2))) / 2).alias("median"),
        at(F.ceil(total * 0.95)).alias("p95"),
        F.max(value).alias("greatest"),
    )
