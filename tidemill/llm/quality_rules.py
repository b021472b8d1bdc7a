"""Operator 5: quality rules, with Jensen-Shannon distances of a text's histograms from references of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bytewords import text_slices
from tidemill.llm.common import bounded_batches, read, saved
from tidemill.llm.quality_features import CLASSES, Counts

#: Texts of fewer words aren't judged by distance, nor do they count in a reference.
MIN_CHAR_WORDS, MIN_COMMON_WORDS = 50, 100
#: Largest distances from the nearest language: of character classes, and of common words.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.19, 0.45
#: After the first round, texts farther than this from every reference don't count in the next one.
TRIM_DISTANCE, ROUNDS = 0.12, 3
#: A language has a reference of its own if MIN_TEXTS of its texts count and at least a MIN_SHARE-th of all that count,
#: so there are MIN_SHARE such references at most; the texts of all other languages make one together.
MIN_TEXTS, MIN_SHARE = 20, 1000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines"]


def count(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, the base counts and the two histograms of every whole text; map only."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    counts = ", ".join(f"{c} long" for c in [*BASE, *MORE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "_text"):
                c = Counts(texts)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(columns))]
                base = [pa.array(getattr(c, name).astype(np.int64)) for name in [*BASE, *MORE]]
                histograms = [_lists(c.chars), _lists(c.words)]
                yield pa.RecordBatch.from_arrays([*kept, *base, *histograms], [*columns, *BASE, *MORE, "chars", "words"])

    rows = bounded_batches(docs).select(*columns, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{fields}, {counts}, chars array<int>, words array<int>")


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1).astype(np.int32)))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.empty((0, 0))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def distance(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence to base 2) of each row from the reference."""
    middle = (shares + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(shares > 0, shares * np.log2(shares / middle), 0.0).sum(axis=1)
        b = np.where(reference > 0, reference * np.log2(reference / middle), 0.0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0.0))


def nearest(counts: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    if not references:
        return np.zeros(len(counts))
    shares = _shares(counts)
    return np.min([distance(shares, r) for r in references], axis=0)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


References = list[tuple[np.ndarray, np.ndarray]]


def _counts_for_reference() -> Column:
    return (F.col("n_words") >= MIN_CHAR_WORDS) & ~base_failed(F.col("n_words"), F.col("n_repeat_words"))


def common_languages(counted: DataFrame) -> tuple[list[str], bool]:
    """The languages that have a reference of their own, MIN_SHARE at most, and whether any text names its language."""
    counts = saved(counted.where(_counts_for_reference() & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(MIN_TEXTS, total / MIN_SHARE)).select("lang").collect()
    return sorted(r["lang"] for r in found), total > 0


def _mean_histograms(counted: DataFrame, languages: list[str], named: bool, so_far: References) -> References:
    """Mean shares over all texts that count, for each of ``languages`` and for the other texts together; batches are
    summed before the shuffle. Texts without a language count only if no text has one."""
    near, number = [c for c, _ in so_far], {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).to_pylist()
            group = np.array([number.get(x, len(languages)) for x in langs])
            chars, words = _matrix(batch.column(1)), _matrix(batch.column(2))
            good = (nearest(chars, near) <= TRIM_DISTANCE) & np.array([x is not None or not named for x in langs])
            both = np.concatenate([_shares(chars), _shares(words)], axis=1)
            for g in np.unique(group[good]).tolist():
                rows = good & (group == g)
                sums, n = both[rows].sum(axis=0), both.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums), pa.array(np.full(n, rows.sum(), np.int64))],
                    ["g", "at", "total", "n"],
                )

    some = counted.where(_counts_for_reference()).select(F.col("lang").cast("string"), "chars", "words")
    parts = some.mapInArrow(run, "g int, at int, total double, n long")
    width = len(CLASSES)
    found: dict[int, dict[int, float]] = {}
    for row in parts.groupBy("g", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # MIN_SHARE + 1 histograms at most
        found.setdefault(row["g"], {})[row["at"]] = row["total"] / row["n"]
    means = [np.array([values[i] for i in range(len(values))]) for _, values in sorted(found.items())]
    return [(m[:width], m[width:]) for m in means]


def references(counted: DataFrame) -> References:
    """Mean histograms of the languages over the corpus, trimmed of texts that are far from every one."""
    languages, named = common_languages(counted)
    found: References = []
    for _ in range(ROUNDS):
        found = _mean_histograms(counted, languages, named, found)
    return found


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and a verdict for every whole text: ``doc_id``, the counts of ``BASE``, ``base_failed``,
    ``char_distance``, ``word_distance`` and ``kept``.

    A text is kept if the base rules pass and, unless it is too short to tell, its histograms of character classes and
    of common words are near those of some language: of the nearest one, not of the one that ``lang`` names, since that
    may be wrong or missing and a good text shouldn't go for its label. The references are means over all texts with a
    ``lang``. Languages with few texts share a reference; the languages with one of their own follow from shares of the
    corpus, so their number is bounded at every size and no text is left out.

    Two map passes: the counts (small beside the texts) are written once and read for the references and the verdicts.
    A null text has no words and fails; a null ``lang`` only keeps a text out of the references, unless no text has one,
    when all texts make one reference. If no text is long enough for a reference the distances are 0. A distance equal
    to a limit passes. Repeated rows and null ids are judged row by row; an empty table gives an empty result. Extra
    columns aren't read.
    """
    counted = saved(count(docs, ["doc_id", "lang"]))
    found = references(counted)
    chars, words = [c for c, _ in found], [w for _, w in found]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ["doc_id", *BASE, "base_failed", "char_distance", "word_distance", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, repeats = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            failed = base_failed(n_words, repeats)
            by_char, by_word = nearest(_matrix(batch.column(6)), chars), nearest(_matrix(batch.column(7)), words)
            far = (n_words >= MIN_CHAR_WORDS) & (by_char > MAX_CHAR_DISTANCE)
            far |= (n_words >= MIN_COMMON_WORDS) & (by_word > MAX_WORD_DISTANCE)
            verdict = [pa.array(x) for x in (failed, by_char, by_word, ~failed & ~far)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *verdict], out)

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return counted.select("doc_id", *BASE, "chars", "words").mapInArrow(judge, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
