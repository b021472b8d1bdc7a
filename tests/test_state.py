"""Keyed state over several micro-batches and a restart."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import matching as M
from tidemill.streaming import state as S


def drain(stream, folder):
    """Runs a stream over what is there; its rows of all runs are in ``folder``."""
    mode = "append" if "live" in stream.columns or "ok" in stream.columns else "update"
    writer = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/rows/{i}"))
    writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def test_follow_equals_a_loop():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice([403, 403, 200, 500]), rng.random() < 0.4) for _ in range(rng.randint(1, 12))]
        refused, state = start = rng.choice([(0, "ok"), (1, "failing"), (3, "failing"), (0, "retired")])
        for code, fallback in rows:
            refused = refused + 1 if code == 403 else 0 if code == 200 else refused
            if state != "retired":
                state = "retired" if refused >= 2 and fallback else "failing" if refused else "ok"
        code, fallback = (np.array(x) for x in zip(*rows, strict=True))
        assert S.follow(*start, code, fallback, 2) == (refused, state)


def test_states_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"u{rng.randint(0, 4)}", i, rng.choice([403, 200, 500, None]), rng.random() < 0.5) for i in range(80)]
    schema = "url string, seq long, code int, fallback boolean"
    for lo in range(0, 80, 20):  # a run for each file, each from the state of the one before
        spark.createDataFrame(rows[lo : lo + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(S.source_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "rows" / "*")).groupBy("url").agg(F.max_by(F.struct("refused", "state"), "seq").alias("x")).select("url", "x.*")
    want = M.source_health(spark.createDataFrame([(u, s, c or 0, f) for u, s, c, f in rows], schema))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_hints_expire_one_by_one(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = sorted(start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 30)) for _ in range(300))
    at[10] = at[9] = at[8]
    rows = [(i, "b" if i % 3 else None, f"s{i % 2}", t, i % 5) for i, t in enumerate(at)]
    rows += [(900 + i, "x", "y", t, 1) for i, t in enumerate([at[0], at[0] + dt.timedelta(hours=72), at[0] + dt.timedelta(hours=143)])]
    rows.sort(key=lambda r: r[3])
    schema = "id long, brand string, store string, at timestamp, weight int"
    for lo in range(0, len(rows), 101):
        spark.createDataFrame(rows[lo : lo + 101], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(S.live_hints(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at"), str(tmp_path))
    got = {(r.id, r.live, r.strength) for r in spark.read.parquet(str(tmp_path / "rows" / "*")).collect()}
    alive = lambda r: [x for x in rows if x[1:3] == r[1:3] and r[3] - dt.timedelta(hours=72) < x[3] <= r[3]]
    assert got == {(r[0], len(alive(r)), sum(x[4] for x in alive(r))) for r in rows}


def test_inbox_by_key_equals_one_batch(spark, tmp_path):
    """A, B, A over three batches are three rows, A, A one; rows of another key and broken ones between them."""
    schema = "source string, entity_id string, endpoint string, fetched_at long, payload string, content_hash string"
    batches = [["A", "A"], ["B", "B!"], ["A", "A"], ["A"]]
    k = 0
    for values in batches:
        rows = []
        for v in values:
            rows += [("s", "e", "p", k, v[0], v), (None, "e", "p", k, "Z", "Z")]
            k += 1
        frame = spark.createDataFrame(rows, schema).withColumn("content_hash", F.when(F.col("content_hash").endswith("!"), "x").otherwise(F.sha2("payload", 256)))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        S.drain_inbox_by_key(stream, *[str(tmp_path / x) for x in ("lake", "bad", "state")]).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "lake")).collect()
    assert sorted((r.fetched_at, r.payload) for r in kept if r.source == "s") == [(0, "A"), (2, "B"), (4, "A")]
    assert [r.fetched_at for r in kept if r.source is None] == [0]
    assert [r.fetched_at for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [3]


class Handle:
    """A state of one value that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_many_keys_of_a_part_take_two_calls_a_batch():
    rng, handle, last, kept, want = random.Random(7), Handle(), {}, [], []
    manifest = S.Manifest("fetched_at", ["string", "string", "string"])
    manifest.init(handle)
    at = 0
    for batch in range(3):
        rows = []
        for _ in range(900):
            key, h, ok = (rng.choice(["s", None]), f"e{rng.randint(0, 150)}", "p"), rng.choice("AB"), rng.random() < 0.8
            rows.append((*key, at, h, ok))
            if not ok or last.get(key) != h:
                want.append(at)
            if ok:
                last[key] = h
            at += 1
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["source", "entity_id", "endpoint", "fetched_at", "content_hash", "ok"])
        for out in manifest.handleInputRows((0,), iter([frame[:400], frame[400:]]), None):
            kept += out["fetched_at"].tolist()
        assert handle.calls == 2 * (batch + 1)
    assert sorted(kept) == want
