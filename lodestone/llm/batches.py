"""Documents dealt to batches of bounded bytes, written once as a bucketed table, so that later passes over batches read it without another shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(docs: DataFrame, folder: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """((doc_id, text, batch), number of batches): a row's batch follows from its doc_id; null ids are in batch 0.

    The table is written below the folder, which all machines share, and is left for the caller to remove with it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(spark.sparkContext.defaultParallelism, 1 + size // batch_bytes))
    name = f"dealt_{uuid.uuid4().hex}"
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(n)), F.lit(0)).cast("int").alias("batch")
    rows = docs.select("doc_id", "text", batch).repartition(n, "batch")
    rows.write.format("parquet").option("path", f"{folder}/dealt").option("compression", "zstd").bucketBy(n, "batch").saveAsTable(name)
    return spark.table(name), n
