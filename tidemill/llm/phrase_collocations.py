"""Operator 13: phrases whose words occur together more often than apart, counted in counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm import quotient_filter as Q
from tidemill.llm.bytewords import Texts, mix, text_slices
from tidemill.llm.common import bounded_batches, read, saved
from tidemill.llm.suffix_dedup import Bitmap, bitmap

#: Bytes that end a piece, ``[.,;:!?\x0A-\x0D]``, and bytes of words, all but those, blanks and tabs.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORDS = ~BREAKS
WORDS[[32, 9]] = False
#: Up to this many frequent words, ids are their places in a broadcast list of hashes (32 MB); with more, the hashes.
LISTED = 1 << 22
#: n-grams that a task holds before it hands on a filter, and occurrences behind a merged filter.
HELD, MERGED = 1 << 21, 1 << 20


def _language_hashes(langs: pa.Array) -> np.ndarray:
    codes = langs.cast(pa.string()).fill_null("und").dictionary_encode()
    each = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in codes.dictionary.to_pylist()]
    return np.array([*each, 0], np.uint64)[codes.indices.to_numpy(zero_copy_only=False)]


def _words(texts: Texts, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (of language and word) of the words, and whether the next word is in the same piece."""
    starts, ends, first = texts.spans(WORDS)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    h = mix(texts.hashes(starts, ends) ^ language[doc])
    piece = np.cumsum(BREAKS[texts.buf], dtype=np.int64)[starts] + doc
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return starts, ends, h, joined


def word_counts(docs: DataFrame) -> DataFrame:
    """(``h, lang, word, n``): occurrences of words by language; the row without a word has the language's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).cast(pa.string()).fill_null("und")
            language = _language_hashes(langs)
            hashes, counts, docs_of, words = [], [], [], []
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                starts, ends, h, _ = _words(texts, language[lo:hi])
                if not len(h):
                    continue
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                starts, sizes = starts[at], (ends - starts)[at]
                ends_of = np.cumsum(sizes)
                chars = texts.buf[np.arange(ends_of[-1]) + np.repeat(starts - ends_of + sizes, sizes)]
                offsets = np.concatenate([[0], ends_of])
                words.append(pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars)]))
                hashes.append(h)
                counts.append(n)
                docs_of.append(lo + np.searchsorted(texts.offsets, starts, side="right") - 1)
            if not hashes:
                continue
            h, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            lang = langs.take(pa.array(np.concatenate(docs_of)[at]))
            word = pa.chunked_array(words).take(pa.array(at)).combine_chunks().cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang, word, pa.array(n)], ["h", "lang", "word", "n"])
            sums = pa.table({"lang": lang, "n": n}).group_by("lang").aggregate([("n", "sum")])
            k = len(sums)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), sums["lang"].combine_chunks(), pa.nulls(k, pa.string()), sums["n_sum"].combine_chunks()], ["h", "lang", "word", "n"])

    rows = bounded_batches(docs).select("text", "lang").mapInArrow(run, "h long, lang string, word string, n long")
    return rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Ids:
    """Ids of frequent words: places in ``listed``, from 1, or, without it, hashes that are in ``some``. 0 is none."""

    bits: int
    listed: np.ndarray | None = None
    some: Bitmap | None = None

    def of(self, h: np.ndarray) -> np.ndarray:
        if self.listed is None:
            return np.where(self.some.has(h), h, np.uint64(0))
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return np.where(self.listed[at] == h, at + 1, 0).astype(np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.listed is None else self.listed[ids.astype(np.int64) - 1]


def word_ids(frequent: DataFrame, listed: int = LISTED) -> Ids:
    """Ids of the words of ``frequent`` (column ``h``). Both kinds give the same phrases; a list of up to ``listed`` words
    makes shorter numbers."""
    n = frequent.count()
    if n > listed:
        return Ids(64, some=bitmap(frequent, "h"))
    h = np.sort(np.array([r[0] for r in frequent.select("h").collect()], np.int64).view(np.uint64))
    return Ids(max(1, n.bit_length()), listed=h if n else np.zeros(1, np.uint64))


def _chain(ids: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of a phrase's words."""
    h = ids[0]
    for x in ids[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + x)
    return h


@dataclass
class _Filters:
    """n-grams of a task by their number of words; ``flush`` hands them on as filters, one for each first bits."""

    bits: int
    known: int
    held: dict[int, list] = field(default_factory=dict)
    n: int = 0

    def add(self, ids: list[np.ndarray]) -> None:
        self.held.setdefault(len(ids), []).append(ids)
        self.n += len(ids[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for size, chunks in sorted(self.held.items()):
            shape = Q.Shape(size, self.bits)
            known = min(self.known, shape.widths[0])
            lanes, counts = Q.summed(shape, shape.permute(shape.pack([np.concatenate(x) for x in zip(*chunks, strict=True)])))
            shard = (lanes[0] >> np.uint64(shape.widths[0] - known)).astype(np.int64)
            edge = np.searchsorted(shard, np.arange((1 << known) + 1))
            some = np.flatnonzero(np.diff(edge))
            blocks = [Q.encode(shape, [x[edge[s] : edge[s + 1]] for x in lanes], counts[edge[s] : edge[s + 1]], known) for s in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], ["size", "shard", "filter"])
        self.held, self.n = {}, 0


def ngram_counts(docs: DataFrame, ids: Broadcast, sizes: list[int], least: int, known: int, pairs: Broadcast | None = None) -> DataFrame:
    """(``words`` (hashes), ``key`` (one hash of them), ``n_words, a``): the n-grams of ``sizes`` words, within pieces and
    of frequent words, that occur ``least`` times or more. With ``pairs``, n-grams with another pair in them are left out.

    Each task counts its n-grams in filters of HELD at a time, cut by their first ``known`` bits; the filters of the same
    first bits are merged in a task. Since numbers are permuted, these are alike in size, whatever is frequent."""
    bits = ids.value.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = _Filters(bits, known)
        for batch in batches:
            language = _language_hashes(batch.column(1))
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                _, _, h, joined = _words(texts, language[lo:hi])
                if len(h) < 2:
                    continue
                id_ = ids.value.of(h)
                two = joined[:-1] & (id_[:-1] > 0) & (id_[1:] > 0)
                if pairs is not None:
                    two &= pairs.value.has(_chain([h[:-1], h[1:]]))
                good = two
                for size in range(2, max(sizes) + 1):
                    if size > 2:
                        good = good[:-1] & two[size - 2 :]
                    if size in sizes:
                        at = np.flatnonzero(good)
                        if len(at):
                            filters.add([id_[at + i] for i in range(size)])
                if filters.n >= HELD:
                    yield from filters.flush()
        yield from filters.flush()

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        shape, shard = Q.Shape(key[0].as_py(), bits), key[1].as_py()
        lanes, counts = Q.merge(shape, table["filter"].to_pylist(), shard, min(known, shape.widths[0]))
        often = counts >= least
        words = [ids.value.hashes(x) for x in shape.unpack(shape.restore([x[often] for x in lanes]))]
        n = int(often.sum())
        flat = np.stack(words, axis=1).ravel() if n else np.empty(0, np.uint64)
        offsets = pa.array(np.arange(n + 1) * shape.n, pa.int32())
        return pa.table({
            "words": pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))),
            "key": _chain(words).view(np.int64),
            "n_words": np.full(n, shape.n, np.int32),
            "a": counts[often].astype(np.int64),
        })

    blocks = bounded_batches(docs).select("text", "lang").mapInArrow(count, "size int, shard int, filter binary")
    return blocks.groupBy("size", "shard").applyInArrow(merged, "words array<long>, key long, n_words int, a long")


def _exact(c: str, times: int = 1) -> Column:
    return (F.col(c) * times).cast("decimal(19,0)")


def scored(grams: DataFrame, totals: DataFrame, lang_of: DataFrame) -> DataFrame:
    """Candidates (``words, n_words, a``) with ``lang, n, l, r, score`` of their lowest-scoring cut, ties to the first.
    ``grams`` has all phrases and words of at least the candidates' count."""
    # a candidate's parts are as frequent as itself, so each is a row of grams
    cands = grams.where("n_words > 1").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cands = cands.select("words", "n_words", "a", "_k", F.slice("words", 1, F.col("_k")).alias("_left"), F.slice("words", F.col("_k") + 1, F.col("n_words") - F.col("_k")).alias("_right"))
    f = grams.select(F.col("words").alias("_part"), F.col("a").alias("_f"))
    cands = cands.join(f, F.col("_left") == F.col("_part")).withColumnRenamed("_f", "l").drop("_part")
    cands = cands.join(f, F.col("_right") == F.col("_part")).withColumnRenamed("_f", "r").drop("_part")
    cands = cands.join(lang_of.select(F.col("h").alias("_h"), "lang"), F.col("words")[0] == F.col("_h")).drop("_h").join(F.broadcast(totals), "lang")
    cands = cands.withColumn("_num", _exact("a", 1000) * _exact("n")).withColumn("_den", _exact("l") * _exact("r"))
    best = F.min(F.struct(F.expr("_num div _den").alias("score"), "_k", "l", "r"))
    return cands.groupBy("words", "n_words", "a", "lang", "n").agg(best.alias("_b")).select("words", "n_words", "a", "lang", "n", "_b.l", "_b.r", "_b.score")


def uncontained(cands: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one holds with ``share`` percent of their count. One word more is enough to look at: all
    phrases between the two are as frequent as the longer one."""
    cut = lambda at: F.slice("words", at, F.col("n_words") - 1)
    longer = cands.where("n_words > 2").select(F.explode(F.array(cut(1), cut(2))).alias("words"), F.col("a").alias("_a")).groupBy("words").agg(F.max("_a").alias("_a"))
    return cands.join(longer, "words", "left").where(F.coalesce(100 * F.col("_a") < share * F.col("a"), F.lit(True))).drop("_a")


#: Candidates that are ranked in one group before the groups' best are.
RANKED = 100_000


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``; first of each group of about RANKED rows, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = -(-max(1, rows.count()) // RANKED)
    some = rows.withColumn("_g", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_g").orderBy(*order))).where(F.col("_r") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def phrase_collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, listed: int = LISTED) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words that occur at least ``least`` times.

    Returns ``lang, rank, phrase, a, l, r, n, score``: a occurrences, n words of the language, l and r occurrences of the
    two sides of the cut that scores lowest, score = floor(1000 a n / (l r)), in exact decimals. Texts are lower-cased
    (A-Z), cut into pieces and words; a null lang is ``und``.

    Three passes over the texts: words are counted; pairs of frequent words in quotient filters (``quotient_filter``);
    then longer phrases, of frequent pairs only, since a phrase is no more frequent than what it holds. What is broadcast
    is bounded: a list of LISTED word hashes, or a bitmap of 16 MB in its place if there are more, and a bitmap of
    16 MB of the frequent pairs, which lets some others pass that their counts then drop. Phrases with ``least``
    occurrences, far fewer than words, are scored by joins. Word equality rests on 64-bit hashes.

    Null and empty texts have no words; repeated rows count as often as they are there; an empty table gives an empty
    result; extra columns aren't read.
    """
    counted = saved(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", "n")
    frequent = counted.where("word is not null and n >= " + str(int(least)))
    ids = word_ids(frequent, listed)
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    n = totals.agg(F.sum("n")).first()[0] or 0
    known = min(24, max(5, (n // MERGED).bit_length()))
    pairs = saved(ngram_counts(docs, shared, [2], least, known))
    grams = frequent.select(F.array("h").alias("words"), F.lit(1).alias("n_words"), F.col("n").alias("a")).unionByName(pairs.select("words", "n_words", "a"))
    if longest > 2:
        filters = docs.sparkSession.sparkContext.broadcast(bitmap(pairs, "key"))
        longer = ngram_counts(docs, shared, list(range(3, longest + 1)), least, known, filters)
        grams = grams.unionByName(longer.select("words", "n_words", "a"))
    grams = saved(grams)
    rows = uncontained(scored(grams, totals, frequent), share)
    spelled = rows.select("words", F.posexplode("words").alias("_at", "h")).join(frequent.select("h", "word"), "h")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = saved(rows.join(spelled, "words").select("lang", "phrase", "a", "l", "r", "n", "score"))
    return best_of(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(read(spark, sf_dir, "documents"))


_F = " UNION ALL ".join(
    "SELECT lang, " + " || ' ' || ".join(f"w{i}" for i in range(k)) + f" AS p, {k} AS k FROM w" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, 6)
)

SQL = {
    "op13_phrase_collocations": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece,
    generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS pn FROM d),
t AS (SELECT rid, lang, pn, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
u AS (SELECT rid, lang, pn, unnest(ws) AS w0, generate_subscripts(ws, 1) AS pos FROM t),
w AS (SELECT lang, w0, {", ".join(f"lead(w0, {i}) OVER (PARTITION BY rid, pn ORDER BY pos) AS w{i}" for i in range(1, 5))} FROM u),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (SELECT lang, p, k, string_split(p, ' ') AS ws, count(*) AS a FROM ({_F}) GROUP BY lang, p, k HAVING count(*) >= 100),
c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.p, c.k, c.ws, c.a, c.cut, x.a AS l, y.a AS r, n, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.ws[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.ws[c.cut + 1:], ' ')
  JOIN total ON total.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) AS p, a FROM f WHERE k > 2),
m AS (SELECT lang, p, max(a) AS a FROM o GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.p = b.p WHERE m.a IS NULL OR m.a < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
}
QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
