"""Operator 7: find and cut benchmark passages with generalised suffix automata over words."""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.bytewords import ALNUM, Texts, text_slices
from tidemill.llm.common import bounded_batches, read, saved

#: Words of items in one automaton (about 7 MB), and automata that a worker holds at once. A larger benchmark takes more
#: passes over the texts, one after the other in the same tasks.
PART_WORDS, PARTS_A_PASS = 100_000, 8
_SPAN = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


class Builder:
    """Grows a suffix automaton word by word; sequences are held apart by separators that no text has."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]

    def extend(self, last: int, word: int) -> int:
        cur = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.next.append({})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                twin = len(self.length)
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                self.next.append(dict(self.next[q]))
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = twin
                    p = self.link[p]
                self.link[q] = self.link[cur] = twin
        return cur


class ItemAutomaton:
    """A suffix automaton of items' word sequences in flat arrays: transitions as sorted keys state * words + word, and
    for each class of windows its items once. Words are told apart by 64-bit hashes."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        items = [(item, words) for item, words in items if len(words)]
        self.window = window
        #: the shortest run of words that can be a hit
        self.least = min([window, *(len(w) for _, w in items)])
        self.hashes = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64)
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        n_words = len(self.hashes)
        grown, last = Builder(), 0
        ends, owners, shorts = array("i"), array("i"), []
        for k, (item, words) in enumerate(items):
            for w in np.searchsorted(self.hashes, words).tolist():
                last = grown.extend(last, w)
                ends.append(last)
                owners.append(number[item])
            if len(words) < window:
                shorts.append((last, len(words), number[item]))
            last = grown.extend(last, n_words + k)
        length, link = np.array(grown.length), np.array(grown.link)
        self.length, self.link = array("i", grown.length), array("i", grown.link)
        #: for states of a window or longer: the state up the links whose class has the last window, else -1
        order = np.argsort(length, kind="stable").tolist()
        anchor = [-1] * len(order)
        for v in order:
            if grown.length[v] >= window:
                up = grown.link[v]
                anchor[v] = anchor[up] if grown.length[up] >= window else v
        #: a window's items are those with an occurrence that ends in its class or below it, each once
        at = np.array(anchor)[np.array(ends, dtype=np.int64)] if len(ends) else np.empty(0, np.int64)
        pairs = np.unique(at[at >= 0] * max(1, len(self.items)) + np.array(owners, dtype=np.int64)[at >= 0])
        heads, first = np.unique(pairs // max(1, len(self.items)), return_index=True)
        self.owner_first = array("q", [*first.tolist(), len(pairs)])
        self.owner_items = array("i", (pairs % max(1, len(self.items))).astype(np.int32).tolist())
        self.anchor = array("i", np.where(np.array(anchor) >= 0, np.searchsorted(heads, anchor), -1).tolist())
        self.short_items: dict[int, list[tuple[int, int]]] = {}
        for v, size, item in shorts:
            while length[link[v]] >= size:
                v = int(link[v])
            if (size, item) not in self.short_items.setdefault(v, []):
                self.short_items[v].append((size, item))
        #: the next state up the links, itself first, where short items end as a whole, else -1
        self.short = array("i", [-1] * len(order))
        if self.short_items:
            for v in order[1:]:
                self.short[v] = v if v in self.short_items else self.short[grown.link[v]]
        states = np.repeat(np.arange(len(order)), [len(x) for x in grown.next])
        words = np.fromiter((w for x in grown.next for w in x), np.int64, len(states))
        targets = np.fromiter((t for x in grown.next for t in x.values()), np.int64, len(states))
        real = words < n_words
        keys = states[real] * max(1, n_words) + words[real]
        by_key = np.argsort(keys)
        self.keys, self.targets = array("q", keys[by_key].tolist()), array("i", targets[real][by_key].tolist())

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, else -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        if not hasattr(self, "seen"):
            self.seen = np.zeros(1 << 16, dtype=bool)
            self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        out = np.full(len(hashes), -1)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[where] == hashes[at]
        out[at[good]] = where[good]
        return out

    def stream(self, words: list[int], hit: np.ndarray) -> set[int]:
        """Follows the words, marks those inside occurring windows in ``hit`` and returns the windows' items."""
        keys, targets, link, length, n_words, n = self.keys, self.targets, self.link, self.length, len(self.hashes), len(self.keys)
        state = size = 0
        ends, classes, items = [], set(), set()
        for i, word in enumerate(words):
            while True:
                key = state * n_words + word
                at = bisect_left(keys, key)
                if at < n and keys[at] == key:
                    state, size = targets[at], size + 1
                    break
                if not state:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            if size >= self.window:
                ends.append(i)
                classes.add(self.anchor[state])
            up = self.short[state]
            while up > 0:
                for k, item in self.short_items[up]:
                    if k <= size:
                        hit[i - k + 1 : i + 1] = True
                        items.add(item)
                up = self.short[link[up]]
        for back in range(self.window if ends else 0):
            hit[np.array(ends) - back] = True
        for c in classes:
            items.update(self.owner_items[self.owner_first[c] : self.owner_first[c + 1]])
        return items


def _scan(texts: Texts, automata: list[ItemAutomaton]) -> Iterator[tuple[int, np.ndarray | None, set[str], np.ndarray, np.ndarray]]:
    """(words, hit flags or None, items, word starts, word ends) for each text."""
    starts, ends, first = texts.spans(ALNUM)
    hashes = texts.hashes(starts, ends)
    cut = np.zeros(len(starts) + 1, dtype=bool)
    cut[first] = True
    found: dict[int, tuple[np.ndarray, set[str]]] = {}
    for auto in automata:
        words = auto.known(hashes)
        may = np.append(words >= 0, False)
        begins = np.flatnonzero(may & (cut | ~np.concatenate([[False], may[:-1]])))
        stops = np.flatnonzero(may[:-1] & (cut[1:] | ~may[1:])) + 1
        enough = stops - begins >= auto.least
        rows = np.searchsorted(first, begins, side="right") - 1
        for row, a, b in zip(rows[enough].tolist(), begins[enough].tolist(), stops[enough].tolist(), strict=True):
            hit = np.zeros(b - a, dtype=bool)
            items = auto.stream(words[a:b].tolist(), hit)
            if items:
                if row not in found:
                    found[row] = (np.zeros(first[row + 1] - first[row], dtype=bool), set())
                found[row][0][a - first[row] : b - first[row]] |= hit
                found[row][1].update(auto.items[i] for i in items)
    for i in range(len(texts)):
        hits, items = found.get(i, (None, set()))
        yield int(first[i + 1] - first[i]), hits, items, starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]


def _ranges(hits: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _item_words(benchmark: DataFrame, window: int) -> DataFrame:
    """(``item``, ``words`` hashes, ``n``) of the items; long items in pieces that share all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in text_slices(batch, "text", lower=True):
                starts, ends, first = texts.spans(ALNUM)
                hashes = texts.hashes(starts, ends)
                rows, pieces = [], []
                for i in range(len(texts)):
                    words = hashes[first[i] : first[i + 1]]
                    for at in range(0, max(1, len(words) - window + 1), PART_WORDS):
                        rows.append(lo + i)
                        pieces.append(words[at : at + PART_WORDS + window - 1])
                data = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([x.tobytes() for x in pieces], pa.binary()), pa.array([len(x) for x in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(data, ["item", "words", "n"])

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = bounded_batches(rows).select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, words binary, n long").where("n > 0").distinct()


def build(benchmark: DataFrame, window: int = 10) -> list[Broadcast]:
    """The automata of a benchmark (``item_id``, ``text``), as a list for each pass. Items without an id, words or text
    have no windows. Executors build them, each from about PART_WORDS words, so neither a task nor a pass's broadcast
    grows with the benchmark."""
    spark = benchmark.sparkSession
    words = saved(_item_words(benchmark, window))
    parts = -(-(words.agg(F.sum("n")).first()[0] or 0) // PART_WORDS)

    def grow(group: pa.Table) -> pa.Table:
        rows = zip(group.column("item").to_pylist(), group.column("words").to_pylist(), strict=True)
        items = [(item, np.frombuffer(raw, np.uint64)) for item, raw in sorted(rows)]
        return pa.table({"part": group.column("part")[:1], "automaton": pa.array([pickle.dumps(ItemAutomaton(items, window))], pa.binary())})

    dealt = words.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, parts))).cast("int"))
    grown = saved(dealt.groupBy("part").applyInArrow(grow, "part int, automaton binary"))
    passes = []
    for lo in range(0, max(1, parts), PARTS_A_PASS):
        rows = grown.where(F.col("part").between(lo, lo + PARTS_A_PASS - 1)).orderBy("part").collect()  # PARTS_A_PASS rows
        passes.append(spark.sparkContext.broadcast([pickle.loads(r["automaton"]) for r in rows]))
    return passes


Finish = Callable[[pa.RecordBatch, list], pa.RecordBatch]


def _over(docs: DataFrame, passes: list[Broadcast], finish: Finish, schema: str) -> DataFrame:
    """Runs the passes over the texts, each adding its hits to those before, and ``finish`` on every batch in the last:
    it gets the batch and (words, hit flags or None, items, word starts, word ends) of each row."""
    names = docs.columns
    extra = [next(x for k in range(len(names) + 1) if (x := f"_{what}{k}") not in names) for what in ("spans", "items")]
    span = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
    kinds = (T.ArrayType(span), T.ArrayType(T.StringType()))
    fields = T.StructType([*docs.schema.fields, *map(T.StructField, extra, kinds)])

    def run(batches: Iterator[pa.RecordBatch], shared: Broadcast, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for batch in batches:
            rows = []
            for lo, _, texts in text_slices(batch.select(names), "text", lower=True):
                for i, (n, hits, items, starts, ends) in enumerate(_scan(texts, automata)):
                    if not first:
                        for s in batch.column(len(names))[lo + i].as_py():
                            hits = np.zeros(n, dtype=bool) if hits is None else hits
                            hits[s["from"] : s["to"]] = True
                        items |= set(batch.column(len(names) + 1)[lo + i].as_py())
                    base = int(texts.offsets[i])
                    rows.append((n, hits, items, starts - base, ends - base))
            if last:
                yield finish(batch.select(names), rows)
            else:
                spans = [[] if x[1] is None else [{"from": a, "to": b} for a, b in _ranges(x[1])] for x in rows]
                more = [pa.array(spans, _SPAN), pa.array([sorted(x[2]) for x in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *more], [*names, *extra])

    out = bounded_batches(docs)
    for k, shared in enumerate(passes):
        last = k == len(passes) - 1
        out = out.mapInArrow(lambda b, s=shared, f=k == 0, e=last: run(b, s, f, e), schema if last else fields)
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """What of each text is in the benchmark: ``doc_id, n_words, n_hit, items`` (sorted ids), ``spans`` (words from-to).

    Words are lower-cased in A-Z. A word is hit inside any occurrence of ``window`` consecutive words of an item, or of
    a whole shorter item. Only runs of benchmark words as long as the shortest window are followed through an automaton.
    A benchmark of many words has several automata (``build``), whose hits are joined exactly, since every window is in
    one of them. Nothing of the texts is shuffled.

    A null text has no words; repeated rows, null ids and an empty table are judged row by row. With an empty benchmark
    nothing is hit; items that repeat count once by id. Extra columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tell(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        columns = [
            batch.column(0),
            pa.array([x[0] for x in rows], pa.int64()),
            pa.array([0 if x[1] is None else int(x[1].sum()) for x in rows], pa.int64()),
            pa.array([sorted(x[2]) for x in rows], pa.list_(pa.string())),
            pa.array([[] if x[1] is None else [{"from": a, "to": b} for a, b in _ranges(x[1])] for x in rows], _SPAN),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])

    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<from:int,to:int>>"
    return _over(docs.select("doc_id", "text"), build(benchmark, window), tell, schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 0.5
) -> DataFrame:
    """The documents without the benchmark's passages, with all their columns.

    Spans of more than ``max_words`` hit words are cut from the text; a document of whose words more than
    ``max_coverage`` are hit goes as a whole. Others stay as they are, null texts too. ``n_chars``, if there is such a
    column, follows the text. Repeated rows and null ids are treated row by row; an empty table gives an empty one, and
    an empty benchmark cuts nothing.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        if all(x[1] is None for x in rows):
            return batch
        texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, dtype=bool)
        for i, (n, hits, _, starts, ends) in enumerate(rows):
            if hits is None:
                continue
            if hits.sum() > max_coverage * n:
                keep[i] = False
                continue
            raw, out, done = texts[i].encode("utf-8", "replace"), [], 0
            for a, b in _ranges(hits):
                if b - a > max_words:
                    out.append(raw[done : int(starts[a])])
                    done = int(ends[b - 1])
            texts[i] = b"".join([*out, raw[done:]]).decode("utf-8", "replace")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(keep))

    out = _over(docs, build(benchmark, window), cut, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_words(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = {
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM starts),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, x.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw) x JOIN win USING (s, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
QUERIES = {"op7_decontamination": op7_decontamination}
