"""Operator 12: spelling variants, by PartEnum signatures of letter multisets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, read, saved

#: Letters of a word.
LETTERS = "[A-Za-zÀ-ÿ]"
#: One edit changes two elements of a letter multiset at most.
DISTANCE = 2
#: Partitions of PartEnum; a signature leaves out DISTANCE of them.
PARTS = 3
#: Stretches of a word; an edit lies in one of them and leaves the others alone.
STRETCHES = 3


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, damage: int = 31) -> DataFrame:
    """Distinct words (``word, n``) of at least ``least_chars`` code points and ``least_n`` occurrences.

    Words are maximal runs of LETTERS with A-Z lower-cased. If ``damage`` divides the crc32 h of ``<doc_id>:<run>``, the
    run loses its code point h % length. A null doc_id counts as an empty string, a null text has no words."""
    # a maximal run that is too short never matches, since each of its tails is shorter still
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_chars},}}+"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), runs.alias("_run"))
    run = ascii_lower(F.col("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), run).cast("binary"))
    cut = F.pmod(h, F.char_length(run)).cast("int")
    whole = F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.char_length(run)))
    words = rows.select(F.when(h % damage == 0, whole).otherwise(run).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _elements(word: Column, order: str) -> Column:
    """The letter multiset as a set of (letter, how many before it): hash ``h`` and part ``p`` of each element. The
    letters, from common to rare, are dealt to the parts in turn, so that the parts are even."""
    letters = F.sort_array(F.split(word, ""))

    def element(c: Column, i: Column) -> Column:
        before = i + 1 - F.array_position(letters, c)
        return F.struct(F.pmod(F.instr(F.lit(order), c) + before, F.lit(PARTS)).alias("p"), F.xxhash64(c, before).alias("h"))

    return F.transform(letters, element)


def _projection(elements: Column, p: int) -> Column:
    return F.aggregate(elements, F.lit(0).cast("long"), lambda a, e: F.when(e["p"] == p, a.bitwiseXOR(e["h"])).otherwise(a))


def letters_by_use(words: DataFrame) -> str:
    """The letters of the words, most used first; LETTERS bounds their number."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return "".join(r["c"] for r in rows.orderBy(F.desc("n"), "c").collect())


def signatures(words: DataFrame) -> DataFrame:
    """(``key, word, n, longer``): the keys under which a word meets those one edit away.

    A signature is a choice of PARTS - DISTANCE parts with the word's elements in them: of two multisets at Hamming
    distance DISTANCE or less, some choice holds no difference. All anagrams have the same signatures, so a key also
    has what the edit leaves in place: if the shorter of the two words, of m code points, is cut into STRETCHES, all
    but one of them are equal in both, counted from the start or from the end. A word takes part as one of m and as the
    ``longer`` one of m + 1."""
    # behind a one-row explode, so that elements are made once and not for each projection
    rows = words.select("word", "n", F.explode(F.array(_elements(F.col("word"), letters_by_use(words)))).alias("_e"))
    rows = rows.select("word", "n", F.char_length("word").alias("_len"), F.array(*[_projection(F.col("_e"), p) for p in range(PARTS)]).alias("_p"))
    sizes = F.explode(F.array(F.struct(F.col("_len").alias("m"), F.lit(False).alias("longer")), F.struct((F.col("_len") - 1).alias("m"), F.lit(True).alias("longer"))))
    rows = rows.select("word", "n", "_p", "_len", sizes.alias("_s"))
    cut = lambda i: F.floor(F.col("_s.m") * i / STRETCHES).cast("int")
    keys = []
    for i in range(STRETCHES):
        left, right = cut(i), F.col("_s.m") - cut(i + 1)
        placed = (F.substring("word", F.lit(1), left), F.substring(F.col("word"), F.col("_len") - right + 1, right))
        for s, parts in enumerate(combinations(range(PARTS), PARTS - DISTANCE)):
            keys.append(F.xxhash64(F.lit(i), F.lit(s), F.col("_s.m"), *placed, *[F.col("_p")[p] for p in parts]))
    return rows.select(F.explode(F.array(*keys)).alias("key"), "word", "n", F.col("_s.longer").alias("longer"))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (``word, n, near, near_n``), both ways, of words that differ by one inserted, deleted or replaced code point.

    Signatures meet in an equi-join and pairs are verified in it; those of several keys are one."""
    a = signatures(words)
    b = a.select(*[F.col(c).alias(f"{c}_b") for c in a.columns])
    meet = (F.col("key") == F.col("key_b")) & (F.col("word") < F.col("word_b")) & ~(F.col("longer") & F.col("longer_b"))
    pairs = a.join(b, meet & (F.levenshtein("word", "word_b", 1) == 1)).select("word", "n", F.col("word_b").alias("near"), F.col("n_b").alias("near_n"))
    pairs = pairs.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("_x")).select("_x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(``word, root``): the end of the chain that (``word, form``) starts; each round doubles the links passed. The
    forms must hold no circle."""
    state = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        state = saved(state.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("_moved")))
        if state.where("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")


def spelling_variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, damage: int = 31, ratio: int = 10) -> DataFrame:
    """Words of the corpus with the near word that they are a variant of.

    Returns ``word, form, root, n, n_near, form_n``. ``form`` is the near word of largest n (ties: the first in
    code-point order), if it has ``ratio`` times the word's n or more; ``root`` the last word that forms lead to.

    Words are counted in one pass; everything after it works on distinct words. No group is held in one task: pairs come
    from a join on 64-bit keys whose groups are words that share two thirds of their letters in place and a part of the rest,
    and a chain of forms takes a round for each doubling (n grows ``ratio``-fold a step, so there are few).

    Null texts and texts without letters have no words, an empty table gives an empty result, repeated rows count as
    often as they are there, extra columns aren't read.
    """
    words = saved(word_counts(docs, least_chars, least_n, damage))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_b"))
    found = saved(found.select("word", "n_near", F.col("_b.w").alias("_form"), (-F.col("_b.m")).alias("_form_n")))
    isform = F.col("_form_n") >= ratio * F.col("n")
    rows = words.join(found, "word", "left").select(
        "word", F.when(isform, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(isform, F.col("_form_n")).alias("form_n")
    )
    rows = saved(rows)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


#: No SQL: DuckDB has no crc32. Tested against plain Python.
QUERIES = {"op12_spelling_variants": op12_spelling_variants}
