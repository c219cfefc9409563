"""Structured Streaming ingest: payload files arrive, records are parsed, resolved and upserted batch by batch.

An extra beyond the batch engine.  Every micro-batch is one version of the
store, and upserts by key are idempotent, so a batch replayed after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.dedup import dedup_papers
from ..operators.record_store import RecordStore, hydrate
from ..sources.payloads import PARSERS, fan_out

PAYLOADS = "source string, query string, payload string, pos bigint"


def ingest_batch(batch: DataFrame, store: RecordStore) -> None:
    """Parse, resolve, hydrate from and upsert into the store."""
    if not batch.head(1):
        return
    papers = dedup_papers(fan_out(batch, tuple(PARSERS))).withColumn("relevance", F.lit(0.0))
    stored = store.read()
    store.write(hydrate(papers, stored) if stored is not None else papers)


def start_ingest(spark: SparkSession, inbox: str, store_root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Watch a folder of JSON payload lines."""
    store = RecordStore(spark, store_root)
    stream = spark.readStream.schema(PAYLOADS).json(inbox)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(df, store))
    return writer.trigger(availableNow=True).start() if once else writer.start()
