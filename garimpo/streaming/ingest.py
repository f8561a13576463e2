"""Incremental ingestion: new documents become chunks of the index once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import clean_text
from garimpo.operators.segment import chunk_documents
from garimpo.operators.vectors import Embedder, HashingEmbedder, embed
from garimpo.sources.sinks import write_index


def ingest(stream: DataFrame, index: str, checkpoint: str, load: Callable[[], Embedder] = HashingEmbedder, **segmentation):
    """Start a query that cleans, cuts and embeds the documents of a stream and adds their chunks to an index.

    ``stream`` has ``(doc_id, text, *metadata)``.  Each micro-batch runs the batch operators;
    a batch that is repeated after a failure adds nothing twice, as known chunk ids are left out.
    """

    def add(batch: DataFrame, _: int) -> None:
        clean = clean_text(batch)
        chunks = chunk_documents(clean, **segmentation)
        if "categoria" not in chunks.columns:
            chunks = chunks.withColumn("categoria", F.lit(None).cast("string"))
        write_index(chunks.withColumn("embedding", embed(F.col("text"), "passage", load)), index, reset=False)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and key; rows later than the watermark are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n"
    )
