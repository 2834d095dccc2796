"""Entries that keep arriving, upserted batch by batch into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbspark.operators import entries
from kbspark.plans.knowledge import ENTRIES
from kbspark.shared import stored
from kbspark.sources.store import read_table, upsert_buckets

ARRIVING = "seq long, what string, why string, how string"


def upsert_stream(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """Read new Parquet files (seq, what, why, how) of ``source`` until none is
    left and upsert their entries. A batch that is run again after a failure
    leaves the same table, as an upsert of the same rows changes nothing."""

    def step(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        none = {c: F.lit(None).cast(kind) for c, kind in read_table(session, root, "entries", ENTRIES).dtypes if c in entries.CONTEXT}
        keyed = entries.body_of(entries.keyed(batch.where(F.col("what").isNotNull())).withColumns(none))  # the body that a run would give them
        new = entries.last_of_each_key(keyed).select("category", "slug", "what", "why", "how", *entries.CONTEXT, "body")
        upsert_buckets(stored(new, "batch"), root, "entries", ("category", "slug"), ENTRIES)

    stream = spark.readStream.schema(ARRIVING).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, minutes: int = 10, late_minutes: int = 30) -> DataFrame:
    """Events per type and time window of a stream of ``events`` (ts, event_type)."""
    return events.withWatermark("ts", f"{late_minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))
