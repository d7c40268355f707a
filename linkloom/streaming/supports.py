"""Supports of items and pairs kept up to date over a stream of baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.baskets import basket_relation, pair_counts


def counts_of_batch(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(item_i, item_j, n_ij) of one batch of whole baskets."""
    return pair_counts(basket_relation(rows, basket, item))


def keep_pair_counts(stream: DataFrame, basket: str, item: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the pair counts of each micro-batch under path, one folder per batch, replaced if the batch is run again.

    A basket has to arrive within one batch. running_counts() sums the batches.
    """

    def write(rows: DataFrame, batch: int) -> None:
        counts_of_batch(rows, basket, item).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(spark, path: str) -> DataFrame:
    """(item_i, item_j, n_ij) over all batches written so far."""
    return spark.read.parquet(path).groupBy("item_i", "item_j").agg(F.sum("n_ij").alias("n_ij"))


def windowed_counts(stream: DataFrame, time: str, item: str, window: str, delay: str) -> DataFrame:
    """(start, item, n): occurrences per window of event time; rows later than the delay are dropped."""
    late = stream.withWatermark(time, delay).where(F.col(item).isNotNull())
    counted = late.groupBy(F.window(time, window).alias("w"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "item", "n")
