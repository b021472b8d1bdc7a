"""The raw lake: hashed, deduplicated, partitioned rows; idempotent upserts; ledgers; audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.rounding import rounded

LAKE_KEY = ["source", "entity_id", "endpoint"]


def write_lake(rows: DataFrame, root: str) -> None:
    """Appends rows to ``root/source=/date=`` as zstd parquet; the date is that of ``fetched_at``."""
    dated = rows.withColumn("date", F.to_date("fetched_at"))
    dated.repartition("source", "date").write.partitionBy("source", "date").option("compression", "zstd").mode("append").parquet(root)


def read_lake(spark: SparkSession, root: str, source: str | None = None, since: str | None = None) -> DataFrame:
    """Reads the lake back; source and date prune its folders."""
    rows = spark.read.parquet(root)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows if since is None else rows.where(F.col("date") >= F.lit(since).cast("date"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_corpus(spark: SparkSession, path: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Whole text files with the category and type of the longest path prefix in ``rules``; front matter overrides."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    category, kind = F.lit("other"), F.lit("text")
    for prefix, c, k in sorted(rules, key=lambda r: len(r[0])):
        hit = F.col("path").contains(prefix)
        category, kind = F.when(hit, c).otherwise(category), F.when(hit, k).otherwise(kind)
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.regexp_extract(front, rf"(?m)^{name}:\s*(.+?)\s*$", 1), F.lit(""))
    return rows.select("path", F.col("value").alias("text"), F.coalesce(field("category"), category).alias("category"), F.coalesce(field("source_type"), kind).alias("source_type"))


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def params_hash(params: Column) -> Column:
    """The first 16 hex digits of the hash of a map's entries as JSON with sorted keys."""
    entries = F.transform(F.sort_array(F.map_entries(params)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), 256), 1, 16)


def suppress_repeats(rows: DataFrame, manifest: DataFrame | None = None, order: str = "fetched_at") -> DataFrame:
    """Drops a row whose hash equals the one stored before it for its key; A, B, A keeps three rows. The manifest gives
    the last stored hash of earlier batches."""
    before = F.lag("content_hash").over(W.partitionBy(*LAKE_KEY).orderBy(order))
    if manifest is None:
        return rows.withColumn("_before", before).where(~F.col("content_hash").eqNullSafe(F.col("_before"))).drop("_before")
    known = manifest.select(*LAKE_KEY, F.col("content_hash").alias("_known"))
    out = rows.withColumn("_before", before).join(known, LAKE_KEY, "left")
    return out.where(~F.col("content_hash").eqNullSafe(F.coalesce("_before", "_known"))).drop("_before", "_known")


def manifest_of(rows: DataFrame, order: str = "fetched_at") -> DataFrame:
    """The last hash and sighting of each key."""
    return rows.groupBy(*LAKE_KEY).agg(F.max_by("content_hash", order).alias("content_hash"), F.max(order).alias("last_seen"))


def to_archive(rows: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Pages worth keeping: those that changed, or that were parsed with little confidence."""
    settled = (~F.col("changed")) & (F.col("confidence") >= least_confidence)
    return rows.where(~F.coalesce(settled, F.lit(False)))


def integrity(rows: DataFrame) -> DataFrame:
    """Rows of each source, and how many don't hash to what is stored."""
    bad = ~F.sha2("payload", 256).eqNullSafe(F.col("content_hash"))
    return rows.groupBy("source").agg(F.count("*").alias("checked"), F.count_if(bad).alias("mismatches"))


def drain(inbox: DataFrame, manifest: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Splits an inbox into rows to ingest (verified, not repeated) and rows to quarantine."""
    good = F.sha2("payload", 256).eqNullSafe(F.col("content_hash"))
    return suppress_repeats(inbox.where(good), manifest), inbox.where(~good)


def digest(all_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows and bytes kept, and the percent that deduplication saved."""
    seen = all_rows.agg(F.count("*").alias("seen"))
    out = kept.agg(F.count("*").alias("kept"), F.sum(F.octet_length("payload")).alias("bytes"))
    return out.crossJoin(seen).select("seen", "kept", "bytes", rounded(100 * (F.col("seen") - F.col("kept")) / F.col("seen"), 1).alias("dedupe_percent"))


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key of both; columns that only one side has are null for the other."""
    both = target.unionByName(batch, allowMissingColumns=True)
    values = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def insert_new(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The target with the batch's first row of each key that it lacks; what is stored stays as it is."""
    values = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert_sightings(target: DataFrame, batch: DataFrame, key: list[str], seen: str = "seen") -> DataFrame:
    """Newest values of each key, with its first and last sighting. The target has ``first_seen, last_seen``."""
    fresh = batch.withColumn("first_seen", F.col(seen)).withColumn("last_seen", F.col(seen)).drop(seen)
    both = target.unionByName(fresh)
    values = [c for c in both.columns if c not in (*key, "first_seen", "last_seen")]
    out = both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by(F.struct(*values), "last_seen").alias("_v"))
    return out.select(*key, "first_seen", "last_seen", "_v.*")


def overwrite_partitions(df: DataFrame, root: str, by: list[str]) -> None:
    """Writes only the partitions that the rows are in."""
    df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def table_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two copies has."""
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))
