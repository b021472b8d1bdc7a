"""Operator 9: drop lines that other documents have already shown, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, hot_keys, read, saved

#: Characters stripped at both ends of a line: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _to_drop(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(``_d``, ``_v``, ``_dropped``): id and text hash of a document, and the positions of its lines that go."""
    # behind a one-row explode, so that a text is hashed once and not for each of its lines
    whole = F.struct(_version(F.col("text")).alias("v"), _lines(F.col("text")).alias("lines"))
    lines = (
        rows.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(F.array(whole)).alias("_w"))
        .select("doc_id", F.col("_w.v").alias("_v"), F.posexplode("_w.lines").alias("_at", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select(F.col("doc_id").alias("_d"), "_v", "_at", F.unhex(F.md5("_key")).alias("_hash"))
    )
    lines = saved(lines)  # read twice; the texts are split and hashed once
    holders = lines.groupBy("_hash", "_d").agg(F.count("*").alias("_m"))
    often = holders.groupBy("_hash").agg(F.min("_d").alias("_first"), F.count("*").alias("_docs"), F.sum("_m").alias("_n"))
    often = saved(often.where(F.col("_docs") >= min_docs).select("_hash", "_first", "_n"))
    # the lines of a hot hash stay where they are and meet its row by a broadcast; the others meet theirs by a shuffle
    hot, _ = hot_keys(often, "_n")
    hot = F.broadcast(hot.select(F.col("_hash").alias("_h"), F.col("_first").alias("_hot")))
    marked = lines.join(hot, lines["_hash"] == hot["_h"], "left")
    common = marked.where(F.col("_h").isNotNull()).select("_d", "_v", "_at", F.col("_hot").alias("_first"))
    rare = marked.where(F.col("_h").isNull()).select("_d", "_v", "_at", "_hash").join(often.select("_hash", "_first"), "_hash")
    found = common.unionByName(rare.select("_d", "_v", "_at", "_first")).where(F.col("_d") > F.col("_first"))
    return found.groupBy("_d", "_v").agg(F.sort_array(F.collect_set("_at")).alias("_dropped"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _left(lines: Column, dropped: Column) -> Column:
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.array_join(F.transform(F.array_except(every, dropped), lambda i: F.get(lines, i)), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Lines whose key of at least ``min_chars`` code points is in ``min_docs`` documents or more go, except in the
    document with the smallest id that holds it.

    Returns ``doc_id, text, n_lines, n_dropped, dropped`` (positions) with the text that is left.

    The lines are exploded to (key hash, doc_id, position), written once, and their distinct documents counted by hash;
    hashes take 128 bits. Rows are first counted by (hash, document), so the lines of a hot hash are dealt by document
    and reach its count as one row a task. A hash with more than a share of all lines (``common.hot_keys``) is broadcast
    to its lines, the others are joined by a shuffle, and only dropped positions go on to the texts.

    Null or empty texts are one empty line. Rows without a doc_id keep all lines and don't count. Rows that repeat an
    id with the same text count as one document and lose the same lines; with another text they are told apart by
    their texts' hashes. An empty table gives an empty result; extra columns aren't read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    drops = _to_drop(rows, min_chars, min_docs)
    return (
        rows.join(drops, (rows["doc_id"] == drops["_d"]) & (_version(rows["text"]) == drops["_v"]), "left")
        .withColumn("_lines", _lines(F.col("text")))
        .select(
            "doc_id",
            F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(_left(F.col("_lines"), F.col("_dropped"))).alias("text"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce("_dropped", F.array().cast("array<int>")).alias("dropped"),
        )
    )


def drop_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The documents without the lines that ``line_dedup`` drops, with all their columns. Texts that lose no line stay
    as they are, null ones too; ``n_chars``, if there is such a column, follows the text."""
    drops = _to_drop(docs.select("doc_id", "text"), min_chars, min_docs)
    joined = docs.join(drops, (docs["doc_id"] == drops["_d"]) & (_version(docs["text"]) == drops["_v"]), "left")
    loses = drops["_dropped"].isNotNull()
    text = F.when(loses, _left(_lines(docs["text"]), drops["_dropped"])).otherwise(docs["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(loses, n_chars).otherwise(docs["n_chars"])
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_KEY} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
often AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, o.k IS NOT NULL AND l.doc_id > o.first AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
QUERIES = {"op9_line_dedup": op9_line_dedup}
