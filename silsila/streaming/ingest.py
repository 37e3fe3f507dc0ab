"""Incremental ingest: a stream of texts into per-collection tables, each batch replacing the collections it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse
from ..sources.catalogue import replace_book


def ingest_texts(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse the chains of every new file under `source` and replace its collections under `out`.

    Each batch overwrites its own slug partitions, so a batch that runs again after a failure leaves the same tables.
    """

    def write(batch: DataFrame, _: int) -> None:
        parsed = parse.parse_chains(batch)
        replace_book(parsed.select("slug", "id", F.col("parsed.names").alias("names"), F.col("parsed.reached").alias("reached"), F.col("parsed.gaps").alias("gaps")), out)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
