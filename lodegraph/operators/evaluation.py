"""Evaluation aggregates: confusion, intervals, effects and a bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import wilson


def confusion(df: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    """Rows (*by, tp, fp, fn, tn); an abstention (null) counts as not said."""
    said = F.coalesce(said, F.lit(False))
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", truth & said), ("fp", ~truth & said), ("fn", truth & ~said), ("tn", ~truth & ~said))])


def rates(counted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a confusion table; null where undefined."""
    precision, recall = (F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))) for x in ("fp", "fn"))
    return counted.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)))


def agreement(df: DataFrame, by: list[str], agrees: Column) -> DataFrame:
    """Rows (*by, k, n, low, high): agreeing rows with their score interval."""
    counted = df.groupBy(*by).agg(F.count_if(agrees).alias("k"), F.count(F.lit(1)).alias("n")).withColumn("interval", wilson(F.col("k"), F.col("n")))
    return counted.select(*by, "k", "n", F.round("interval.low", 9).alias("low"), F.round("interval.high", 9).alias("high"))


def paired(df: DataFrame, unit: str, arm: str, value: str, first: str, second: str) -> DataFrame:
    """Per unit that has both arms, the difference of its means."""
    mean = {a: F.avg(F.when(F.col(arm) == a, F.col(value))).alias(n) for a, n in ((first, "one"), (second, "two"))}
    return df.groupBy(unit).agg(*mean.values()).where("one IS NOT NULL AND two IS NOT NULL").select(unit, (F.col("one") - F.col("two")).alias("difference"))


def bootstrap_interval(units: DataFrame, unit: str, value: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """One row (n, mean, low, high): a Poisson bootstrap of the mean.

    Every unit draws its weight in each replicate from a seeded hash, so replicates are sums with
    map-side combining; nothing but `replicates` means comes together.
    """
    u = F.pmod(F.xxhash64(F.col(unit), F.col("replicate"), F.lit(seed)), F.lit(1 << 40)) / (1 << 40)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum(F.when(u >= c, 1).otherwise(0) for c in cuts)
    drawn = units.select(unit, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("w", weight)
    means = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return units.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(ends, how="cross")
