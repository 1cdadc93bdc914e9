"""Incremental indexing: documents arriving as a stream of files are appended to a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspan.operators.index import postings
from inkspan.sources.tables import DOCUMENT, lenient


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of Parquet documents; each micro-batch writes its postings under its own folder, so that a repeated batch replaces itself."""
    docs = spark.readStream.schema(DOCUMENT).parquet(source)

    def append(batch: DataFrame, epoch: int) -> None:
        postings(lenient(batch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies_so_far(spark: SparkSession, target: str) -> DataFrame:
    """(term, df) over everything indexed; a document delivered twice counts once."""
    return spark.read.parquet(target).select("term", "doc_no").distinct().groupBy("term").agg(F.count("*").alias("df"))
