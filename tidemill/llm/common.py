"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id lists up to this many rows (8 bytes each) may be broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 500_000

#: Rows of ids or links that one task takes at least.
ROWS_A_TASK = 50_000
#: A key with more rows than this, or than a share of all rows, is hot.
HOT_ROWS, HOT_SHARE = 200, 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters kept: ``lower`` where the text is all ASCII, which is faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Uses the cluster's shared ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, gets a
    folder of its own; a cluster, whose executors don't share one, is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return spark


#: Texts are long, so an Arrow batch of them is bounded by bytes rather than rows.
BATCH_BYTES = 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(docs: DataFrame) -> DataFrame:
    """The documents, in a session whose Arrow batches are small: a Python worker and the JVM beside it hold one or two
    of them at a time. A lower limit of the session stays."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_LIMIT).rstrip("b")) <= BATCH_BYTES:
        conf.set(_BATCH_LIMIT, f"{BATCH_BYTES}b")
    return docs


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there, so lost executors cost no lineage."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved_round(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``saved`` for what goes through many rounds of joins. A checkpoint keeps the estimated size of its plan, and the
    estimate of a join is a product, so after some rounds it has millions of digits; here the rows start afresh. They
    are counted and take a task for each ROWS_A_TASK, so that rounds over few rows don't write many small files; where there
    are no more rows than in ``like``, which was saved so, that holds for writing them too."""
    spark, done = df.sparkSession, saved(_few(df, like))
    rows = DataFrame(spark._jsparkSession.createDataFrame(done._jdf.rdd(), done._jdf.schema()), spark)
    parts = -(-max(1, rows.count()) // ROWS_A_TASK)
    rows = rows.coalesce(parts)
    rows.parts = parts
    return rows


def _few(df: DataFrame, like: DataFrame | None) -> DataFrame:
    return df if getattr(like, "parts", None) is None else df.coalesce(like.parts)


def checked(ids: DataFrame) -> DataFrame:
    """A list of ids or other short keys, marked for broadcast if it is short enough; else left to a shuffled join."""
    ids = saved(ids)
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_semi``) or is not (``left_anti``, nulls stay) in the column ``_id``."""
    ids = checked(ids.select(F.col("_id")))
    return docs.join(ids, docs["doc_id"] == ids["_id"], how)


def hot_keys(counts: DataFrame, n: str) -> tuple[DataFrame, int]:
    """The rows of ``counts`` (a row a key, with its number of rows ``n``) of hot keys, and the limit. Each has more than
    a HOT_SHARE-th of all rows, so there are fewer than HOT_SHARE, which may be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    return counts.where(F.col(n) > limit), limit


def dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``. The rows of a hot key are dealt over tasks by the hash of column ``by``,
    and the table's row of that key goes to each of them, so no key gathers its rows in one task. ``counts`` (``key``,
    rows ``_n``) may be given if they are known."""
    if counts is None:
        counts = saved(_few(rows.groupBy(key).agg(F.count("*").alias("_n")), rows))
    hot, limit = hot_keys(counts, "_n")
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0)).alias("_part")
    dealt = rows.join(hot, key, "left").select(*rows.columns, part)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)).alias("_part")
    return dealt.join(table.join(hot, key, "left").select(*table.columns, every), [key, "_part"]).drop("_part")
