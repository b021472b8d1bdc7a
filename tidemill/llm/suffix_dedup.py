"""Operator 2: passages that repeat in several documents, found at content-selected positions by hashes of passages.

Suffixes are kept as in a sparse suffix array, but they aren't sorted and compared with neighbours: a suffix's neighbours
need not hold its longest match, which lost passages. All passages around a kept suffix are hashed and grouped instead."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bytewords import NOT_SPACE, mix, text_slices, windows
from tidemill.llm.common import bounded_batches, dealt_join, read, saved

#: A suffix is kept where the hash of its first SEED words is the least of SPARSE neighbouring ones, so every passage
#: of SEED + SPARSE - 1 = 50 words has one, at the same place in each occurrence.
SEED, SPARSE = 16, 35
#: Bits of the largest bitmap of hashes that is broadcast (16 MB). Fuller ones let more rows pass; joins still decide.
MOST_BITS = 27


class Bitmap:
    """A set of 64-bit hashes by their first bits; may say yes to others too."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, column: str) -> Bitmap:
    """The bitmap of a saved column of hashes: about 16 bits a row, up to MOST_BITS."""
    bits = min(MOST_BITS, max(15, (16 * max(1, hashes.count()) - 1).bit_length()))
    at = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_m"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    for k, m in parts.collect():  # 4 KB each, 16 MB at most
        data[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    return Bitmap(bits, data)


def least_at(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash of every window, the first one on ties."""
    value, at, span = grams, np.arange(len(grams)), 1
    while span < width:  # windows of twice the span, then of the rest, from two that meet or overlap
        h = min(span, width - span)
        less = value[h:] < value[: len(value) - h]
        at = np.where(less, at[h:], at[: len(at) - h])
        value = np.where(less, value[h:], value[: len(value) - h])
        span += h
    return at


def passages(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the passages of ``least`` words of every document, hashes of them, and the kept suffix in each, which
    is the first with the least hash: (start, hash, suffix, hash of the suffix)."""
    grams = mix(windows(hashes, SEED))
    width = least - SEED + 1
    n = len(hashes) - least + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.flatnonzero(np.repeat(first[1:], np.diff(first))[:n] - np.arange(n) >= least)
    suffix = least_at(grams, width)
    whole = grams[:n].copy()
    for i in [*range(SEED, width, SEED), width - 1]:  # seeds that cover the passage
        whole *= np.uint64(0xD6E8FEB86659FD93)
        whole += grams[i : i + n]
    return start, mix(whole[start]), suffix[start], grams[suffix[start]]


def id_hashes(ids: pa.Array) -> np.ndarray:
    """64-bit hashes of document ids, integers or strings."""
    if pa.types.is_integer(ids.type):
        return mix(ids.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = [int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in ids.to_pylist()]
    return np.array(out, dtype=np.uint64)


def suffixes(docs: DataFrame, least: int, seeds: Bitmap | None = None, owners: Bitmap | None = None) -> DataFrame:
    """The kept suffixes of every text with the passages in which they are the kept one: ``doc_id, version`` (hash of the
    whole text), ``n_words, pos, seed`` (hash of the first words), ``start`` and ``n`` (the passages begin at the n words
    from start on), ``context`` (hash of all of them) and ``own`` (hash of context and document). With ``owners``, a
    bitmap of such hashes, a row for each passage instead, with its hash and start. ``seeds`` leaves out others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((seeds, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owners = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                starts, ends, first = texts.spans(NOT_SPACE)
                start, whole, suffix, seed = passages(texts.hashes(starts, ends), first, least)
                if not len(start):
                    continue
                doc = np.searchsorted(first, start, side="right") - 1
                begins = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (doc[1:] != doc[:-1])]))
                n = np.diff(np.append(begins, len(start)))
                context = mix(np.add.reduceat(whole, begins) + seed[begins])
                own = mix(context + id_hashes(ids.slice(lo, hi - lo))[doc[begins]])
                good = np.ones(len(begins), bool) if seeds is None else seeds.has(seed[begins])
                if owners is not None:
                    good &= owners.has(own)
                    at = np.flatnonzero(np.repeat(good, n))
                    context, own, n = np.repeat(context, n)[at], np.repeat(own, n)[at], np.ones(len(at), np.int64)
                else:
                    at, n, context, own = begins[good], n[good], context[good], own[good]
                if not len(at):
                    continue
                row = doc[at]
                version = texts.hashes(texts.offsets[:-1], texts.offsets[1:])
                columns = [
                    ids.take(pa.array(lo + row)),
                    pa.array(version[row].view(np.int64)),
                    pa.array(np.diff(first)[row].astype(np.int32)),
                    pa.array((suffix[at] - first[row]).astype(np.int32)),
                    pa.array(seed[at].view(np.int64)),
                    pa.array((start[at] - first[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(context.view(np.int64)),
                    pa.array(own.view(np.int64)),
                    pa.array(whole[at].view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_words", "pos", "seed", "start", "n", "context", "own", "passage"])

    schema = f"doc_id {kind}, version long, n_words int, pos int, seed long, start int, n int, context long, own long, passage long"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], s["end"])
        else:
            out.append({"from": s["start"], "to": s["end"]})
    return out


def repeated_passages(docs: DataFrame, least: int = SEED + SPARSE - 1) -> DataFrame:
    """Passages of ``least`` words or more that are in another document too: ``doc_id, version, n_words,
    n_repeat_words, spans`` (words from-to, merged), ``drops`` (the part of them that an earlier document has: a passage
    is kept in the document with the smallest id that holds it) and ``partners`` (least and greatest ids of the documents
    with a passage), for documents with any.

    Words are compared with A-Z lower-cased. Every passage of ``least`` words belongs to the kept suffix in it, at the
    same place in each occurrence. Suffixes whose seed is in one document are left out. All passages of a suffix
    together are its context, and one hash of them settles whether another document has them all. Seeds with several
    contexts, at the ends of longer passages and next to changed words, are also compared passage by passage; there the
    least and the greatest document of each context stand for the others that have it. All hashes are grouped with their
    least and greatest ids, pre-aggregated, so neither a passage of a third of all documents nor one that a document
    repeats many times gathers in a task.

    Null texts, null ids and texts of fewer words have no passages. Rows that repeat an id are one document; if their
    texts differ, each has a row of its own (``version`` is a hash of the lower-cased text). An empty table gives an empty
    result; extra columns aren't read.
    """
    if least <= SEED:
        raise ValueError(f"passages have more than {SEED} words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where(F.col("doc_id").isNotNull())
    holders = [F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")]
    seeds = saved(suffixes(some, least).groupBy("seed").agg(*holders).where("_a < _b").select("seed"))
    kept = saved(suffixes(some, least, bitmap(seeds, "seed")))
    held = kept.groupBy("seed", "context").agg(*holders, F.min_by("own", "doc_id").alias("_x"), F.max_by("own", "doc_id").alias("_y"), F.count("*").alias("_n"))
    held = saved(held)
    # seeds in several documents of which not all have the same passages
    mixed = held.groupBy("seed").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.count("*").alias("_contexts")).where("_contexts > 1 and _a < _b").select("seed")
    mixed = saved(mixed)
    owners = held.join(mixed, "seed", "left_semi").select(F.explode(F.array("_x", "_y")).alias("own")).distinct()
    single = saved(suffixes(some, least, bitmap(mixed, "seed"), bitmap(saved(owners), "own")))
    again = saved(single.groupBy(F.col("passage").alias("_p")).agg(*holders, F.count("*").alias("_n")).where("_a < _b"))
    span = F.struct("start", (F.col("start") + F.col("n") - 1 + least).alias("end"))
    common = held.where("_a < _b").select(F.col("seed").alias("_s"), F.col("context").alias("_c"), "_a", "_b", "_n")
    whole = dealt_join(kept.withColumn("_c", F.col("context")), common.drop("_n"), "_c", "doc_id", common.select("_c", "_n")).where("seed = _s")
    parts = dealt_join(single.withColumn("_p", F.col("passage")), again.drop("_n"), "_p", "doc_id", again.select("_p", "_n"))
    out = ["doc_id", "version", "n_words", "pos", "seed", span.alias("span"), "_a", "_b"]
    matches = whole.select(*out).unionByName(parts.select(*out)).withColumn("drop", F.when(F.col("doc_id") > F.col("_a"), F.col("span")))
    grouped = matches.groupBy("doc_id", "version").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set("drop")).alias("drops"),
        F.collect_set("_a").alias("_as"),
        F.collect_set("_b").alias("_bs"),
    )
    partners = F.array_sort(F.filter(F.array_union("_as", "_bs"), lambda x: x != F.col("doc_id")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            spans, drops = ([_merged(x) for x in batch.column(i).to_pylist()] for i in (3, 4))
            n = [sum(s["to"] - s["from"] for s in x) for x in spans]
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(drops, span), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_words", "n_repeat_words", "spans", "drops", "partners"])

    pieces = "array<struct<from:int,to:int>>"
    schema = f"doc_id {kind}, version long, n_words long, n_repeat_words long, spans {pieces}, drops {pieces}, partners array<{kind}>"
    return grouped.select("doc_id", "version", "n_words", "spans", "drops", partners.alias("partners")).mapInArrow(merge, schema)


def drop_passages(docs: DataFrame, least: int = SEED + SPARSE - 1) -> DataFrame:
    """The documents without the passages that an earlier one has (``drops`` of ``repeated_passages``), with all their
    columns. Texts that lose none stay as they are, null ones too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_passages(docs, least).where(F.size("drops") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                version = texts.hashes(texts.offsets[:-1], texts.offsets[1:]).view(np.int64)
                starts, ends, first = texts.spans(NOT_SPACE)
                rows, left = [], []
                for i in range(hi - lo):
                    drops = next((x["drops"] for x in batch.column(2)[lo + i].as_py() if x["version"] == version[i]), None)
                    if drops is None:
                        continue
                    raw, out, done = batch.column(1)[lo + i].as_py().encode("utf-8", "replace"), [], 0
                    at = lambda k, i=i: int(k) - int(texts.offsets[i])
                    for d in drops:
                        out.append(raw[done : at(starts[first[i] + d["from"]])])
                        done = at(ends[first[i] + d["to"] - 1])
                    rows.append(lo + i)
                    left.append(b"".join([*out, raw[done:]]).decode("utf-8", "replace"))
                old = batch.column(1).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), old, pa.array(left, pa.string())], ["_d", "_t", "_left"])

    drops = found.groupBy("doc_id").agg(F.collect_list(F.struct("version", "drops")).alias("_drops"))
    fewer = docs.select("doc_id", "text").join(drops, "doc_id").select("doc_id", "text", "_drops").distinct()
    fewer = bounded_batches(fewer).mapInArrow(cut, f"_d {kind}, _t string, _left string")
    joined = docs.join(fewer, (docs["doc_id"] == fewer["_d"]) & (docs["text"] == fewer["_t"]), "left")
    text = F.coalesce(fewer["_left"], docs["text"])
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
