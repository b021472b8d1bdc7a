"""Operator 1: near-duplicate documents by b-bit MinHash, every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bytewords import NOT_SPACE, Texts, mix, text_slices, windows
from tidemill.llm.common import bounded_batches, checked, dealt_join, keep_ids, read, saved, saved_round
from tidemill.llm.components import components

#: 28 bands of 4 minima: a pair with similarity 0.8 shares no band with probability (1 - 0.8**4)**28 < 4e-7.
BANDS, ROWS = 28, 4
PERMS = BANDS * ROWS
#: Low bits kept of each minimum; 16 minima fill one long.
BITS = 4
#: Candidates are confirmed if the estimate is over the threshold less this, about five standard errors.
SLACK = 0.2
#: Rounds in which each bucket is a star around another of its texts.
ROUNDS = 2
#: What is left open of buckets of up to SMALL texts is compared by signatures, of larger ones by shared prefixes and, if
#: that leaves any, in blocks of about BLOCK texts or BLOCK_SHINGLES shingles. Full sets decide each way, so the result
#: doesn't depend on these numbers.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 256, 400_000
#: Counters by which shingles are ordered from rare to common, and rows that a task's counters are handed on in.
COUNTERS, TALLIES = 1 << 16, 16

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text; a text of fewer words is one shingle."""
    starts, ends, first = texts.spans(NOT_SPACE)
    hashes = texts.hashes(starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(windows(hashes[a:b], min(size, b - a))) if b > a else hashes[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    low, out = shingles.astype(np.uint32), np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (low[i : i + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def pack(found: np.ndarray) -> np.ndarray:
    """The low bits of each row's minima, 16 to a long."""
    nibbles = (found & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(found), -1, 64 // BITS)
    return (nibbles << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash of each band's full minima and of the band's number."""
    parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix(mix((parts * _BAND).sum(axis=2, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _fixed(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the whole set), ``packed`` b-bit signature and ``bands`` keys; map only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                n, found, digests = [], np.empty((hi - lo, PERMS), np.uint32), []
                for i, s in enumerate(shingle_sets(texts, size)):
                    n.append(len(s))
                    found[i] = minima(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _fixed(pack(found)), _fixed(band_keys(found))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", "n_shingles", "digest", "packed", "bands"])

    schema = f"doc_id {kind}, n_shingles long, digest binary, packed array<long>, bands array<long>"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def estimate(x: Column, y: Column) -> Column:
    """Similarity from the count of equal low bits, less the share that is equal by chance."""
    differ = None
    for i in range(PERMS * BITS // 64):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = F.bit_count(d) if differ is None else differ + F.bit_count(d)
    chance = 1 / (1 << BITS)
    return ((PERMS - differ) / PERMS - chance) / (1 - chance)


class Sets:
    """The shingle sets of the documents that have been asked for, each built once and written to the shared folder."""

    def __init__(self, docs: DataFrame, size: int):
        self.docs, self.size, self.kind = docs, size, docs.schema["doc_id"].dataType.simpleString()
        self.found: DataFrame | None = None

    def of(self, ids: DataFrame) -> DataFrame:
        """(``id``, ``shingles``) of the ids (column ``_id``) and of those asked for before."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, texts in text_slices(batch, "text", lower=True):
                    sets = pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["id", "shingles"])

        ids = ids.distinct()
        if self.found is not None:
            ids = ids.join(self.found.select(F.col("id").alias("_known")), F.col("_id") == F.col("_known"), "left_anti")
        ids = checked(ids)
        if self.found is None or not ids.isEmpty():
            few = bounded_batches(self.docs).select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
            new = saved(few.mapInArrow(run, f"id {self.kind}, shingles binary"))
            self.found = new if self.found is None else self.found.unionByName(new)
        return self.found


def confirm(sets: Sets, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) with 100 * intersection >= percent * union on the full sets."""
    every = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("_id")))
    both = dealt_join(pairs, every.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a", "b")
    both = both.join(every.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")  # few pairs have the same b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {sets.kind}, b {sets.kind}")


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """``key, rep, component`` of the buckets that hold several components."""
    now = members.select("key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    keys = now.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.count("*").alias("_n"))
    keys = saved_round(keys.where("_x <> _y").select("key", "_n"), members)
    return dealt_join(now, keys.select("key"), "key", "rep", keys).select("key", "rep", "component")


def _stars(open_members: DataFrame, turn: int) -> DataFrame:
    """Pairs (``a`` pivot, ``b`` member) of each bucket's pivot with its members of other components. The pivot is of the
    bucket's largest component, so there are no more pairs than other members."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")
    parts = open_members.groupBy("key", "component").agg(F.count("*").alias("m"), F.min(order).alias("p"))
    pivot = F.max(F.struct("m", F.col("p.rep").alias("rep"), "component")).alias("_p")
    pivots = saved_round(parts.groupBy("key").agg(pivot, F.sum("m").alias("_n")).select("key", F.col("_p.rep").alias("pivot"), F.col("_p.component").alias("_c"), "_n"), open_members)
    rows = dealt_join(open_members, pivots.drop("_n"), "key", "rep", pivots.select("key", "_n")).where("component <> _c")
    return rows.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def _near(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Of each member ``b`` the pair whose signatures give the highest estimate, if that is ``least`` or more. What its
    other pairs would link is found in a later round, or is left open and compared in full."""
    both = dealt_join(pairs, packed.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a", "b")
    both = both.join(packed.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")  # a member has few pivots
    good = both.withColumn("_e", estimate(F.col("pa"), F.col("pb"))).where(F.col("_e") >= least)
    return good.groupBy("b").agg(F.max(F.struct("_e", "a")).alias("_m")).select(F.col("_m.a").alias("a"), "b")


def _from_small(open_members: DataFrame, packed: DataFrame, least: float, kind: str) -> DataFrame:
    """Candidates of small buckets: pairs of different components with a high estimate. A bucket is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for bucket in batch.column(0).to_pylist():
                ids = [x["rep"] for x in bucket]
                comps = np.unique([x["component"] for x in bucket], return_inverse=True)[1]
                packed = np.array([x["packed"] for x in bucket], dtype=np.int64).view(np.uint64)
                d = packed[:, None, :] ^ packed[None, :, :]
                d |= d >> np.uint64(2)
                d |= d >> np.uint64(1)
                differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=2)
                chance = 1 / (1 << BITS)
                near = ((PERMS - differ) / PERMS - chance) / (1 - chance) >= least
                for i, j in np.argwhere(np.triu(near & (comps[:, None] != comps[None, :]))).tolist():
                    out_a.append(min(ids[i], ids[j]))
                    out_b.append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, batch_kind), pa.array(out_b, batch_kind)], ["a", "b"])

    batch_kind = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    rows = open_members.join(packed.withColumnRenamed("id", "rep"), "rep")
    rows = rows.groupBy("key").agg(F.collect_list(F.struct("rep", "component", "packed")).alias("members"))
    return rows.select("members").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _prefixes(sets: Sets, ids: DataFrame, percent: int) -> DataFrame:
    """Buckets (``key``, ``rep``) of the documents with the given ids (``rep``) by the shingles of their prefixes.

    Sets of which ``percent`` of the union is common share a shingle among the first n - ceil(percent n / 100) + 1 of
    each, in any order of all shingles that is the same for every set. From rare to common, as counted over these
    documents, texts that share only what many have meet nowhere.
    """
    asked = ids.select(F.col("rep").alias("id"))
    rows = saved(sets.of(asked.withColumnRenamed("id", "_id")).join(asked, "id", "left_semi").select("id", "shingles"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(1):
                n += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if n.any():
            parts = [x.tobytes() for x in n.reshape(TALLIES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TALLIES)), pa.array(parts, pa.binary())], ["part", "n"])

    def add(part: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // TALLIES, np.int64)
        for batch in batches:
            for x in batch.column("n"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["part", "n"])

    # a task's counters are TALLIES rows, however many texts it has and whatever they share
    tallies = rows.mapInArrow(tally, "part long, n binary").groupBy("part").applyInArrow(add, "part long, n binary")
    counts = np.zeros((TALLIES, COUNTERS // TALLIES), np.int64)
    for row in tallies.collect():  # TALLIES rows, half a megabyte in all
        counts[row["part"]] = np.frombuffer(row["n"], np.int64)
    counts = counts.reshape(-1)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for row, x in enumerate(batch.column(1)):
                shingles = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((shingles, counts[(shingles % np.uint64(COUNTERS)).astype(np.int64)]))
                head = shingles[order[: len(shingles) + (-percent * len(shingles)) // 100 + 1]]
                ids = pa.array([batch.column(0)[row].as_py()] * len(head), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), ids], ["key", "rep"])

    return rows.mapInArrow(first, f"key long, rep {sets.kind}")


def common_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set with every other set, by products of 0/1 matrices over slices of the hashes."""
    sizes = np.array([len(s) for s in [*sets, *others]])
    hashes = np.concatenate([*sets, *others]) if len(sizes) else np.empty(0, np.uint64)
    words, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[keep], shared[at[keep]]
    out = np.zeros((len(sets), len(others)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        m = np.zeros((len(sizes), 8192), dtype=np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[: len(sets)] @ m[len(sets) :].T
    return out.astype(np.int64)


def _from_large(sets: Sets, members: DataFrame, percent: int) -> DataFrame:
    """Links between different components of each cluster (``cluster, rep, component, n_shingles``), on the full sets.

    What is outside the largest component of a cluster meets all of the cluster, in blocks of both. Of a pair of blocks
    only links that join different components are returned, fewer than it has texts.
    """
    kind = sets.kind
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("t"))
    clusters = parts.groupBy("cluster").agg(
        F.sum("m").alias("m"), F.sum("t").alias("t"), F.max(F.struct("m", "t", "component")).alias("main")
    )
    n_blocks = lambda m, t: F.greatest(F.lit(1), F.ceil(F.greatest(m / BLOCK, t / BLOCK_SHINGLES))).cast("int")
    clusters = clusters.select(
        "cluster",
        F.col("main.component").alias("main"),
        n_blocks(F.col("m"), F.col("t")).alias("columns"),
        n_blocks(F.col("m") - F.col("main.m"), F.col("t") - F.col("main.t")).alias("rows"),
    )
    dealt = members.join(clusters, "cluster")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_row = F.when(F.col("component") != F.col("main"), F.transform(every("columns"), lambda j: F.struct(block("rows").alias("i"), j.alias("j"), F.lit(True).alias("row"))))
    as_column = F.transform(every("rows"), lambda i: F.struct(i.alias("i"), block("columns").alias("j"), F.lit(False).alias("row")))
    places = F.explode(F.concat(as_column, F.coalesce(as_row, F.slice(as_column, 1, 0)))).alias("at")
    dealt = dealt.select("cluster", "rep", "component", places).select("cluster", "at.*", "rep", "component")
    shingles = sets.of(members.select(F.col("rep").alias("_id"))).select(F.col("id").alias("rep"), "shingles")
    dealt = dealt_join(dealt, shingles, "rep", "i")

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        ids, comps, row = (group.column(c).to_pylist() for c in ("rep", "component", "row"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        left, right = [k for k in range(len(ids)) if row[k]], [k for k in range(len(ids)) if not row[k]]
        common = common_counts([sets[k] for k in left], [sets[k] for k in right])
        total = np.array([len(sets[k]) for k in left])[:, None] + np.array([len(sets[k]) for k in right])[None, :] - common
        head = {c: c for c in comps}

        def find(c):
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        a, b = [], []
        for x, y in np.argwhere(100 * common >= percent * total).tolist():
            p, q = find(comps[left[x]]), find(comps[right[y]])
            if p != q:
                head[max(p, q)] = min(p, q)
                a.append(ids[left[x]])
                b.append(ids[right[y]])
        return pa.table({"a": pa.array(a, group.column("rep").type), "b": pa.array(b, group.column("rep").type)})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(link, f"a {kind}, b {kind}")


class _Links:
    """The components that the confirmed links make so far: each is a star of links to its least id."""

    def __init__(self, docs: DataFrame, classes: DataFrame, links: DataFrame, size: int, percent: int):
        self.sets, self.percent, self.least = Sets(docs, size), percent, percent / 100 - SLACK
        self.packed = classes.select(F.col("rep").alias("id"), "packed")
        self.found = components(links)

    def add(self, links: DataFrame) -> None:
        so_far = self.found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        self.found = components(so_far.unionByName(links))

    def star(self, members: DataFrame) -> DataFrame:
        """Stars over the buckets (``key, rep, pivot``) in rounds; returns what is still open, with its components."""
        pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        rest = members
        for turn in range(ROUNDS):
            pairs = saved_round(pairs, rest)
            near = saved_round(_near(pairs, self.packed, self.least), pairs)
            if not near.isEmpty():
                self.add(confirm(self.sets, near, self.percent))
            if turn == 0 or not near.isEmpty():
                rest = saved_round(_with_components(rest, self.found), rest)
            if turn + 1 == ROUNDS or rest.isEmpty():
                break
            pairs = _stars(rest, turn + 1)
        return rest if ROUNDS else saved_round(_with_components(members.select("key", "rep"), self.found))

    def compare(self, rest: DataFrame) -> DataFrame:
        """Compares open buckets of up to SMALL texts by signatures; returns the larger ones that are open."""
        if rest.isEmpty():
            return rest
        sizes = saved_round(rest.groupBy("key").agg(F.count("*").alias("_n")), rest)
        few = rest.join(sizes.where(F.col("_n") <= SMALL), "key", "left_semi")
        pairs = saved_round(_from_small(few, self.packed, self.least, self.sets.kind))
        if not pairs.isEmpty():
            self.add(confirm(self.sets, pairs, self.percent))
        many = sizes.where(F.col("_n") > SMALL)
        return saved_round(_with_components(dealt_join(rest, many.select("key"), "key", "rep", many), self.found), rest)


def _crowded(members: DataFrame) -> DataFrame:
    """Buckets with more than one text, ``key, rep`` and ``pivot``, the least of the bucket."""
    several = saved_round(members.groupBy("key").agg(F.count("*").alias("_n"), F.min("rep").alias("pivot")).where("_n > 1"), members)
    return saved_round(dealt_join(members, several.select("key", "pivot"), "key", "rep", several.select("key", "_n")).select("key", "rep", "pivot"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document; links are pairs of documents whose sets of
    ``size``-word shingles have 100 * intersection >= percent * union.

    Exact copies of a set are one class first, by a grouped minimum, so thousands of copies cost no pairs. Class
    representatives meet in band buckets. Each bucket is a star around its least member, then, while it holds several
    components, around others; a star's pairs are estimated from the packed signatures and confirmed on the full sets.
    What is still open is compared in full: small buckets pair by pair from the signatures; the texts of larger ones
    by the rarest shingles of each, again in stars, and what even those leave open in blocks on the full sets. So no
    link between different components of a bucket is lost, and texts that only share what many have don't meet. Pairs
    of a group are never all written out, and components are found by joins and grouped minima.

    A text without words, and a null text, has an empty set and is linked with nothing. A null id has no component
    and is kept. Rows that repeat an id are one document: it is linked with whatever any of its texts is, and all its
    rows have the same component. An empty table gives an empty result; extra columns aren't read.
    """
    signed = saved(signatures(docs, size))
    known = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = saved(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("packed").alias("packed"), F.first("bands").alias("bands")
        )
    )
    # ids with several texts: their classes are linked
    again = known.groupBy("doc_id").agg(F.min("digest").alias("_x"), F.max("digest").alias("_y")).where("_x <> _y")
    texts = known.select("doc_id", "digest").join(checked(again.select(F.col("doc_id").alias("_id"))), F.col("doc_id") == F.col("_id"), "left_semi")
    texts = saved(texts.distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"))
    same = texts.groupBy("doc_id").agg(F.min("rep").alias("b"))
    linked = _Links(docs, classes, texts.join(same, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct(), size, percent)

    rest = linked.compare(linked.star(_crowded(classes.select("rep", F.explode("bands").alias("key")).distinct())))
    if not rest.isEmpty():
        crowd = saved(rest.select("rep").distinct())
        rest = linked.compare(linked.star(_crowded(_prefixes(linked.sets, crowd, percent))))
        if not rest.isEmpty():
            heads = rest.groupBy("key").agg(F.min("rep").alias("a"))
            clusters = components(rest.join(heads, "key").select("a", F.col("rep").alias("b")))
            crowd = rest.select("rep", "component").distinct().join(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "rep", "left")
            crowd = crowd.withColumn("cluster", F.coalesce("cluster", "rep")).join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
            linked.add(_from_large(linked.sets, saved_round(crowd), percent))

    found = linked.found
    own = classes.select("digest", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    own = own.select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("_component"))
    joined = signed.select("doc_id", "n_shingles", "digest").join(
        own, (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left"
    )
    # an id that has other texts beside an empty one is one document too
    whole = signed.groupBy(F.col("doc_id").alias("_id")).agg(F.min("n_shingles").alias("_least"), F.max("n_shingles").alias("_most"))
    whole = whole.where("_least = 0 and _most > 0").join(known.select("doc_id", "digest"), F.col("_id") == F.col("doc_id")).select("_id", "digest")
    whole = whole.join(own, F.col("digest") == F.col("_digest")).groupBy("_id").agg(F.min("_component").alias("_whole"))
    joined = joined.join(whole, F.col("doc_id") == F.col("_id"), "left")
    joined = joined.withColumn("component_id", F.coalesce("_component", "_whole", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, with all its columns."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return keep_ids(docs, gone, "left_anti")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
