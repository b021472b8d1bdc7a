"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemill.operators.matching import source_health
from tidemill.sources import lake as L
from tidemill.sources.folders import shared_folder


def drain_inbox(stream: DataFrame, lake: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Verifies, deduplicates and appends each micro-batch of raw rows; bad ones are set aside.

    A micro-batch is written under its own id in overwrite mode, so a replay after a failure doesn't add it twice; the
    manifest is read from what is stored under other ids.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(lake).where(F.col("batch") != batch_id)
            manifest = L.manifest_of(stored)
        except Exception as error:  # the first batch: nothing is stored yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            manifest = None
        good, bad = L.drain(batch, manifest)
        good.write.mode("overwrite").parquet(f"{lake}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, kind: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by kind and tumbling or sliding event-time window; rows later than ``late`` are left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def distinct_sightings(stream: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key inside the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def upsert_sightings(stream: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps newest values with first and last sighting of each key in a versioned folder: batch n reads the version
    before it and writes its own, so replays give the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("first_seen", F.col("seen")).withColumn("last_seen", F.col("seen")).drop("seen")
        old = spark.read.parquet(f"{target}/version={batch_id - 1}") if batch_id else fresh.limit(0)
        L.upsert_sightings(old.select(*fresh.columns), batch, key).write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_states(stream: DataFrame, retire_at: int = 2) -> DataFrame:
    """The state machine of source health over a stream of (``url, seq, code, fallback``): a url's counter and state
    are kept between batches; retired is final. Emits each url's state after a batch."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        refused, status = state.get if state.exists else (0, "ok")
        rows = pd.concat(list(batches)).sort_values("seq")
        for code, fallback in zip(rows["code"], rows["fallback"], strict=True):
            refused = refused + 1 if code == 403 else 0 if code == 200 else refused
            if status != "retired":
                status = "retired" if refused >= retire_at and fallback else "failing" if refused else "ok"
        state.update((int(refused), status))
        yield pd.DataFrame({"url": [key[0]], "refused": [int(refused)], "state": [status]})

    return stream.groupBy("url").applyInPandasWithState(follow, "url string, refused long, state string", "refused long, state string", "update", "NoTimeout")


def fresh_hints(stream: DataFrame, ts: str, ttl: str = "72 hours") -> DataFrame:
    """Hints by (brand, store) whose time to live hasn't passed: sums over sliding windows of that length."""
    out = stream.withWatermark(ts, ttl).groupBy(F.window(ts, ttl, "24 hours").alias("w"), "brand", "store")
    return out.agg(F.sum("weight").alias("strength")).select(F.col("w.end").alias("until"), "brand", "store", "strength")


def matured_claims(claims: DataFrame, snapshots: DataFrame, days: int = 14, late: str = "2 days") -> DataFrame:
    """Claims (``item, made_at, threshold``) joined to snapshots (``snap_item, seen_at, value``) of the days after they
    fall due: an interval join of two streams; state older than the watermarks is dropped."""
    left, right = claims.withWatermark("made_at", late), snapshots.withWatermark("seen_at", late)
    due = F.expr(f"item = snap_item AND seen_at >= made_at + interval {days} days AND seen_at < made_at + interval {days + 7} days")
    return left.join(right, due).select("item", "made_at", "seen_at", (F.col("value") >= F.col("threshold")).alias("hit"))


def run_to_files(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there; executors write its rows to a new folder under ``spark.checkpoint.dir``, which
    is read back. In complete mode these are the last batch's rows, else all batches'. A batch is written under its own
    id in overwrite mode, so a replay doesn't add it twice."""
    shared = shared_folder(spark, name)
    folders: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{shared}/rows/{batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        if folder not in folders:
            folders.append(folder)

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{shared}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    if not folders:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(folders[-1:] if mode == "complete" else folders))


__all__ = [
    "distinct_sightings",
    "drain_inbox",
    "fresh_hints",
    "health_states",
    "matured_claims",
    "run_to_files",
    "source_health",
    "upsert_sightings",
    "windowed_counts",
]
