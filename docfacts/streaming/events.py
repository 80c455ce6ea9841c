"""Structured Streaming over the event log: windowed counts, and the rules' state kept per key."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and type; the watermark bounds the state."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """A user's events with no longer gap than this between them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def rule_counters(events: DataFrame) -> DataFrame:
    """rule_id, support, negatives as of each batch, from state kept per rule: a document's denial overrides its confirmation, never the reverse."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        confirmed, denied = (set(x) for x in state.get) if state.exists else (set(), set())
        for f in frames:
            error = f["event_type"] == "error"
            denied |= set((f["event_id"] % 50)[error].tolist())
            confirmed |= set((f["event_id"] % 50)[~error].tolist())
        confirmed -= denied
        state.update((sorted(confirmed), sorted(denied)))
        yield pd.DataFrame({"rule_id": [key[0]], "support": [len(confirmed)], "negatives": [len(denied)]})

    return events.groupBy("user_id").applyInPandasWithState(update, "rule_id long, support long, negatives long", "confirmed array<long>, denied array<long>", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all available input; each batch goes to a table of the warehouse, by its number, so that a repeated batch replaces itself."""
    name = f"stream_{uuid4().hex}"
    place = f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/b{0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(place)
    if key:  # the newest state of each key
        columns = [c for c in out.columns if c not in (*key, "batch")]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(*key, "s.*")
    return out.drop("batch")
