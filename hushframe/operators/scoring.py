"""Threshold scoring and the statistics of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import below


def positive(**values) -> None:
    """Guards of parameters: each must be above 0."""
    for name, v in values.items():
        if v <= 0:
            raise ValueError(f"{name} must be positive")


def hits(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rows, hits (value below threshold) and ties of each group."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(below(F.col("value"), F.col("threshold"))).alias("hits"), F.count_if(F.col("value") == F.col("threshold")).alias("ties"))


def scored(vectors: DataFrame, id_col: str, values: str, thresholds: DataFrame, nodes: int) -> DataFrame:
    """Hits of each vector over `nodes` thresholds (node, threshold): the vector's first values against the node of the same place. Only `nodes` rows are broadcast."""
    positive(nodes=nodes)
    each = vectors.select(id_col, F.posexplode(F.slice(values, 1, nodes)).alias("node", "value"))
    return each.join(F.broadcast(thresholds.where(F.col("node") < nodes)), "node").groupBy(id_col).agg(F.count_if(below(F.col("value"), F.col("threshold"))).alias("hits"), F.count(F.lit(1)).alias("comparisons"))


def summary(value: Column, digits: int = 6) -> list[Column]:
    """n, mean, population deviation, least and largest."""
    return [F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_pop(value), digits).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")]


def largest(value: Column) -> Column:
    """The largest value, from 0 on: 0 where all are below it or there is none."""
    return F.greatest(F.coalesce(F.max(value), F.lit(0)), F.lit(0))


def batches(df: DataFrame, number: str, size: int) -> DataFrame:
    """df with batch: rows numbered from 0 in groups of `size`, the last one short."""
    positive(size=size)
    return df.withColumn("batch", F.expr(f"{number} div {size}"))


def batch_summary(per_batch: DataFrame, total: str, rows: str, digits: int = 6) -> DataFrame:
    """From one row a batch: the mean over all rows, and the mean, deviation, least and largest of the batches' own means. With a short last batch the two means differ."""
    own = F.col(total) / F.col(rows)
    return per_batch.agg(F.round(F.sum(total) / F.sum(rows), digits).alias("mean_of_rows"), F.round(F.avg(own), digits).alias("mean_of_batches"), F.round(F.stddev_pop(own), digits).alias("sd"), F.round(F.min(own), digits).alias("least"), F.round(F.max(own), digits).alias("most"), F.count(F.lit(1)).alias("n_batches"))


def line(df: DataFrame, y: str, x: str, by: list[str] = (), digits: int = 6) -> DataFrame:
    """The straight line through (x, y) of each group, and how well it fits."""
    return df.groupBy(*by).agg(F.round(F.regr_intercept(y, x), digits).alias("intercept"), F.round(F.regr_slope(y, x), digits).alias("slope"), F.round(F.regr_r2(y, x), digits).alias("r2"))


def scaling(df: DataFrame, workers: str, value: str, digits: int = 6) -> DataFrame:
    """Speed and efficiency against one worker, for whom the mean of all its rows stands."""
    one = df.where(F.col(workers) == 1).agg(F.avg(value).alias("__one")).where("__one is not null")
    return df.crossJoin(one).select(workers, value, F.round(F.col("__one") / F.col(value), digits).alias("speedup"), F.round(100 * F.col("__one") / F.col(value) / F.col(workers), digits).alias("efficiency"))


def per_step(ms: Column, k: Column) -> Column:
    """Microseconds for each threshold."""
    return ms * 1000 / k


def throughput(rows: Column, seconds: Column) -> Column:
    return F.sum(rows) / F.sum(seconds)


def traffic(k: Column, alerts: Column, each: int = 1920) -> Column:
    """GB a day: bytes of a comparison, comparisons an alert, alerts."""
    return F.lit(float(each)) * k * alerts / 1e9


def yearly_cost(ms: Column, alerts_a_day: int = 10_000, parties: int = 2, price: float = 0.04) -> tuple[Column, Column]:
    """Hours of a virtual CPU in a year, and their price."""
    hours = ms / 3.6e6 * parties * alerts_a_day * 365
    return hours, hours * price


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("__n = 1").drop("__n")


def missing(wanted: DataFrame, cache: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """What has no record without an error in the cache."""
    good = cache.where(F.col(error).isNull()) if error in cache.columns else cache
    return wanted.join(good, keys, "left_anti")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's place in its batch, from 0, by an order that must be total."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def zipped(asked: DataFrame, replies: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """What was asked with the reply of the same batch and place, joined on both, never by the order of rows; what has no reply is left out. Other columns must differ in name."""
    return asked.join(replies, [*keys, pos])
