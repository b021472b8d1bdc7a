"""Operator 10: judge urls by host and path rules, then by a cascade of Bloom filters, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, read, saved

#: The rules of the production query, as (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The file of listed domains of the production query, one a line; a listed domain stands for its subdomains too.
LISTED_FILE = Path(__file__).with_name("listed_domains.txt")
#: Bits of the filters of one shard of the keys at most (8 MB), and shards whose filters a task holds at once. A longer
#: list has more shards, by a hash of the key, and more passes over the rows.
SHARD_BITS, SHARDS_A_PASS = 1 << 26, 4
MAX_LEVELS = 64


def listed_domains(path: Path | str = LISTED_FILE) -> list[str]:
    """The domains of a list: lines without those that are empty or begin with ``#``."""
    lines = (line.strip().lower() for line in Path(path).read_text("utf-8").splitlines())
    return sorted({x for x in lines if x and not x.startswith("#")})


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def domains(host: Column) -> Column:
    """A host and all domains above it: ``a.b.c`` gives ``a.b.c, b.c, c``."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


class BloomFilter:
    """Bits set at hashed positions of keys; the positions come from ``xxhash64`` with a seed for each level and hash."""

    def __init__(self, level: int, n_keys: int, fpr: float):
        self.level = level
        self.n_bits = max(64, 64 * math.ceil(1.4427 * math.log2(1 / fpr) * n_keys / 64))
        self.n_hashes = max(1, round(math.log2(1 / fpr)))
        self.words: list[int] = []

    def _position(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.level * 100 + i), key), F.lit(self.n_bits))

    def fill(self, keys: DataFrame) -> BloomFilter:
        """Sets the bits by a grouped bitmap; the driver gets rows of 4 KB, as many as the filter is long."""
        at = F.explode(F.array(*[self._position(F.col("key"), i) + 1 for i in range(self.n_hashes)])).alias("at")
        parts = keys.select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
        out = np.zeros(-(-self.n_bits // 32768) * 4096, dtype=np.uint8)
        for row in parts.collect():
            out[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(row["m"], np.uint8)
        self.words = out.view("<i8")[: self.n_bits // 64].tolist()
        return self

    def holds(self, words: Column, key: Column) -> Column:
        """Whether the filter, given as a column of its words, may hold the key."""
        hit = None
        for i in range(self.n_hashes):
            at = self._position(key, i)
            bit = F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
            hit = bit if hit is None else hit & bit
        return hit


class Cascade:
    """Exact membership for every key of ``universe`` (column ``key``, distinct) in the list ``listed`` without a join.

    Level 0 encodes the listed keys; each later level encodes those of the other side that pass the level before, until
    none is left. A key's level of first refusal tells its side. Keys are dealt to shards by a hash, so that no shard's
    filters are longer than SHARD_BITS; each shard is a cascade of its own.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame):
        universe = saved(universe)
        listed = listed.select("key").distinct()
        inside = saved(universe.join(listed, "key", "left_semi"))
        outside = saved(universe.join(listed, "key", "left_anti"))
        n_in, n_out = inside.count(), outside.count()
        # the first level lets through about as many others as there are listed keys, later ones half of what is left
        bits = 1.45 * (math.log2(max(2, n_out / max(1, n_in))) + 3) * n_in
        self.n_shards = max(1, math.ceil(bits / SHARD_BITS))
        self.shards = [self._levels(inside.where(self._shard(F.col("key")) == k), outside.where(self._shard(F.col("key")) == k)) for k in range(self.n_shards)]

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.n_shards))

    @staticmethod
    def _table(spark: SparkSession, filters: dict[str, BloomFilter]) -> DataFrame:
        """One row with a column of words for each filter."""
        return F.broadcast(spark.createDataFrame([[f.words for f in filters.values()]], ", ".join(f"{c} array<long>" for c in filters)))

    def _levels(self, inside: DataFrame, outside: DataFrame) -> list[BloomFilter]:
        levels: list[BloomFilter] = []
        n, others = inside.count(), outside.count()
        fpr = min(0.5, math.sqrt(0.5) * n / max(1, others))
        while n:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the filters don't separate the keys; are keys of the universe repeated?")
            level = BloomFilter(len(levels), n, 0.5 if levels else fpr).fill(inside)
            levels.append(level)
            passing = outside.crossJoin(self._table(inside.sparkSession, {"_f": level})).where(level.holds(F.col("_f"), F.col("key")))
            inside, outside = saved(passing.select("key")), inside
            n = inside.count()
        return levels

    def _held(self, lo: int, key: Column) -> Column:
        """Whether the key is listed, by the shards of the pass that begins with shard ``lo``; false for others' keys."""
        out = F.lit(False)
        for k, levels in enumerate(self.shards[lo : lo + SHARDS_A_PASS], lo):
            inner = F.lit(False)
            for i, level in reversed(list(enumerate(levels))):
                inner = level.holds(F.col(f"_f{k}_{i}"), key) & ~inner
            out = F.when(self._shard(key) == k, inner).otherwise(out)
        return out

    def mark(self, rows: DataFrame, keys: Callable[[], Column], name: str) -> DataFrame:
        """``rows`` with a boolean ``name``: whether any of the keys (an array of keys of the universe) is listed. The
        filters of SHARDS_A_PASS shards are one broadcast row (SHARD_BITS each at most); with more the rows are written
        between passes."""
        rows = rows.withColumn(name, F.lit(False))
        for lo in range(0, self.n_shards, SHARDS_A_PASS):
            filters = {f"_f{k}_{i}": f for k, levels in enumerate(self.shards[lo : lo + SHARDS_A_PASS], lo) for i, f in enumerate(levels)}
            if not filters:
                continue
            rows = rows if lo == 0 else saved(rows)

            held = partial(self._held, lo)
            table = self._table(rows.sparkSession, filters)  # one row
            rows = rows.crossJoin(table).withColumn(name, F.col(name) | F.exists(keys(), lambda key: held(key))).drop(*filters)
        return rows


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def url_filter(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """Judges every row's ``url``: by the longest rule that fits, else block if its host or a domain above it is in
    ``listed`` (column ``key``), else allow.

    Returns ``page_id, host, path, rule, verdict``. The key universe is all domains of all hosts of ``pages``, found by
    a partial aggregation, so a host with a third of the rows costs a row a task. The filters' size follows the list;
    a list of any length is judged by filters, in shards (``Cascade``).

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed; urls may be of any length.
    Of rules of the same length the first fits. Repeated rows are judged alike; an empty table gives an empty result; ids
    may be null. Extra columns aren't read.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = rows.select("host").where(F.col("host") != "").distinct()
    universe = hosts.select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    rows = Cascade(universe, listed).mark(rows, lambda: domains(F.col("host")), "_listed")
    return rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in listed_domains()], "key string")
    return url_filter(read(spark, sf_dir, "pages"), listed)


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"


_ORDER = sorted(RULES, key=lambda r: -len(r[0]))
SQL = {
    "op10_url_filter": f"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _ORDER)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{v}'" for r, v in _ORDER)}
    WHEN {" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in listed_domains())} THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""
}
QUERIES = {"op10_url_filter": op10_url_filter}
