"""Continuous ingestion: new pages become postings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..sources.pages import SCHEMA


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, stems: bool = True) -> StreamingQuery:
    """Index whole documents that arrive as Parquet files of pages below ``source``.

    Each batch is written under its number and replaces what an earlier try left, so a batch
    that is run again adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        index.postings(batch, stems=stems).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
