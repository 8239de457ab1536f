"""Churn of a stream of changes: windowed counts with a watermark, and an upserted table of totals. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(changes: DataFrame, time: str, item: str, amount: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, item, changes, amount) of a stream; rows later than the watermark are left out by the engine."""
    grouped = changes.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(item).alias("item"))
    return grouped.agg(F.count("*").alias("changes"), F.sum(amount).alias("amount"))


def upsert_totals(batch: DataFrame, epoch: int, folder: str, item: str, amount: str) -> None:
    """For foreachBatch: the totals after this batch as a new version; a batch that runs again writes the same version."""
    spark = batch.sparkSession
    new = batch.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("changes"), F.sum(amount).alias("amount"))
    if epoch > 0:
        old = spark.read.parquet(f"{folder}/version={epoch - 1}")
        new = new.unionByName(old).groupBy("item").agg(F.sum("changes").alias("changes"), F.sum("amount").alias("amount"))
    new.write.mode("overwrite").parquet(f"{folder}/version={epoch}")
