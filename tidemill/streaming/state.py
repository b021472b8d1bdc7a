"""Keyed state between micro-batches, with time to live: source health, live hints, and the inbox's manifest.

State is kept by key, or by a hashed part of the keys where there are many, in the RocksDB store, so a micro-batch reads
and writes the keys or parts that it has. Rows of a key arrive in chunks, of which only a few narrow columns are held."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from tidemill.sources.lake import LAKE_KEY

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that these operators need, where the session has none of its own choice."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


def _columns(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    parts = [[part[n].to_numpy() for n in names] for part in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0) for _ in names]


def follow(refused: int, state: str, code: np.ndarray, fallback: np.ndarray, retire_at: int) -> tuple[int, str]:
    """A source's counter and state after codes in order: refusals count up, a success starts anew, and retired, from
    ``retire_at`` refusals with a fallback on, is final."""
    refusals = np.cumsum(code == 403)
    anew = np.maximum.accumulate(np.where(code == 200, refusals, -refused))
    counter = refusals - anew
    if state != "retired":
        state = "retired" if np.any((counter >= retire_at) & fallback) else "failing" if counter[-1] else "ok"
    return int(counter[-1]), state


class SourceHealth(StatefulProcessor):
    def __init__(self, retire_at: int):
        self.retire_at = retire_at

    def init(self, handle) -> None:  # noqa: ANN001
        self.kept = handle.getValueState("health", "refused long, state string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        seq, code, fallback = _columns(rows, ["seq", "code", "fallback"])
        if not len(seq):
            return
        order = np.argsort(seq, kind="stable")
        refused, state = self.kept.get() if self.kept.exists() else (0, "ok")
        refused, state = follow(refused, state, code[order].astype(float), fallback[order].astype(bool), self.retire_at)
        self.kept.update((refused, state))
        yield pd.DataFrame({"url": [key[0]], "seq": [seq[order[-1]]], "refused": [refused], "state": [state]})

    def close(self) -> None:
        pass


def source_states(stream: DataFrame, retire_at: int = 2) -> DataFrame:
    """The state machine of source health over ``url, seq, code, fallback``: each url's counter and state after every
    micro-batch that has it, with its last ``seq``. A url's batches must come in order of ``seq``; inside one any order will do."""
    with_state_store(stream.sparkSession)
    rows = stream.select("url", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("code"), F.lit(0)).alias("code"), F.coalesce("fallback", F.lit(False)).alias("fallback"))
    return rows.groupBy("url").transformWithStateInPandas(SourceHealth(retire_at), "url string, seq long, refused long, state string", "Update", "None")


class LiveHints(StatefulProcessor):
    """A key's hints that are younger than the time to live, in microseconds; a timer takes the last ones away."""

    def __init__(self, ttl: dt.timedelta):
        self.ttl = ttl // dt.timedelta(microseconds=1)

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.hints = handle.getValueState("hints", "at array<long>, weight array<long>")

    def _stored(self) -> np.ndarray:
        return np.array(self.hints.get() or ([], []), np.int64).T

    def _keep(self, hints: np.ndarray, until: int) -> None:
        alive = hints[hints[:, 0] > until - self.ttl]
        if len(alive):
            self.hints.update(tuple(alive.T.tolist()))
            self.handle.registerTimer(int((alive[-1, 0] + self.ttl) // 1000 + 1))
        else:
            self.hints.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        ids, at, weight = _columns(rows, ["id", "micros", "weight"])
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        ids, at, weight = ids[order], at[order].astype(np.int64), weight[order].astype(np.int64)
        hints = np.concatenate([self._stored(), np.stack([at, weight], axis=1)])
        hints = hints[np.argsort(hints[:, 0], kind="stable")]
        sums = np.concatenate([[0], np.cumsum(hints[:, 1])])
        first, end = np.searchsorted(hints[:, 0], at - self.ttl, "right"), np.searchsorted(hints[:, 0], at, "right")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep(hints, int(hints[-1, 0]))
        name = lambda k: pd.Series(np.full(len(ids), key[k], object), dtype=object)
        yield pd.DataFrame({"brand": name(0), "store": name(1), "id": ids, "live": end - first, "strength": sums[end] - sums[first]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        self._keep(self._stored(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame({c: pd.Series([], dtype=object) for c in ("brand", "store", "id", "live", "strength")})

    def close(self) -> None:
        pass


def live_hints(stream: DataFrame, ts: str, ttl: dt.timedelta = dt.timedelta(hours=72), late: str = "1 hour") -> DataFrame:
    """For each hint (``id, brand, store, weight`` and its time) how many of its key are alive then, itself included, and
    their weight. An entry lives ``ttl`` from the moment it was seen, whatever the batches; state goes with it. Hints
    later than ``late`` behind the watermark are left out; hints of the same time belong in one batch."""
    with_state_store(stream.sparkSession)
    rows = stream.withWatermark(ts, late).select("id", "brand", "store", ts, F.unix_micros(ts).alias("micros"), F.col("weight").cast("long").alias("weight"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"brand {kinds['brand']}, store {kinds['store']}, id {kinds['id']}, live long, strength long"
    return rows.groupBy("brand", "store").transformWithStateInPandas(LiveHints(ttl), schema, "Append", "EventTime")


#: Parts of the lake keys, a number that stored state depends on. A call of the state is a round trip between Python and
#: the JVM, so keys don't have state of their own: a part's keys are read and written at once.
KEY_PARTS = 512


class Manifest(StatefulProcessor):
    """The last stored hash of each lake key of a part of the keys."""

    def __init__(self, order: str, key_types: list[str]):
        self.order = order
        self.schema = ", ".join(f"{k} array<{t}>" for k, t in zip([*LAKE_KEY, "hash"], [*key_types, "string"], strict=True))

    def init(self, handle) -> None:  # noqa: ANN001
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        good = []
        for part in rows:
            part = part.drop(columns="_part", errors="ignore")
            yield part[~part["ok"]]  # to be set aside
            good.append(part[part["ok"]])
        fresh = pd.concat(good).sort_values(self.order, kind="stable") if good else pd.DataFrame()
        if not len(fresh):
            return
        stored = dict(zip([*LAKE_KEY, "content_hash"], self.last.get() or [[]] * (len(LAKE_KEY) + 1), strict=True))
        names = [*LAKE_KEY, "content_hash"]
        known = pd.concat([pd.DataFrame(stored, dtype=object), fresh[names].astype(object)], ignore_index=True)
        by_key = known.groupby(LAKE_KEY, dropna=False, sort=False)["content_hash"]
        new = (known["content_hash"] != by_key.shift()).to_numpy()[len(known) - len(fresh) :]
        yield fresh[new]
        last = known[(by_key.cumcount(ascending=False) == 0).to_numpy()]
        self.last.update(tuple([None if x is None or x != x else x for x in last[n].tolist()] for n in names))

    def close(self) -> None:
        pass


def drained(stream: DataFrame, order: str = "fetched_at") -> DataFrame:
    """The rows of an inbox to store, ``ok``, or to set aside: those whose hash is right and isn't the one stored last
    for their key, and those whose hash is wrong. A key's batches must come in order; rows of one batch may be in any."""
    with_state_store(stream.sparkSession)
    marked = stream.withColumn("ok", F.sha2("payload", 256).eqNullSafe(F.col("content_hash")) & F.col("content_hash").isNotNull())
    part = F.pmod(F.xxhash64(*LAKE_KEY), F.lit(KEY_PARTS)).alias("_part")
    processor = Manifest(order, [marked.schema[k].dataType.simpleString() for k in LAKE_KEY])
    return marked.select("*", part).groupBy("_part").transformWithStateInPandas(processor, marked.schema, "Append", "None")


def drain_inbox_by_key(stream: DataFrame, lake: str, quarantine: str, checkpoint: str, order: str = "fetched_at") -> StreamingQuery:
    """Appends each micro-batch of raw rows to the lake, verified and without repeats; bad ones are set aside. The last
    hash of each key is state, so a batch doesn't read the lake. A batch is written under its own id in overwrite mode,
    and its state has the same id, so a replay gives the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("ok").drop("ok").write.mode("overwrite").parquet(f"{lake}/batch={batch_id}")
        batch.where("not ok").drop("ok").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        batch.unpersist()

    return drained(stream, order).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
