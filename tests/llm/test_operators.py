"""The corpus operators against plain versions on small fixtures, with awkward rows."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import (
    byte_bpe,
    bytewords,
    decontamination,
    language_id,
    line_dedup,
    minhash_dedup,
    quality_classifier,
    quality_features,
    quality_rules,
    suffix_dedup,
    toxicity,
    url_filter,
)
from tidemill.llm.components import components

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, a int, _id long, text_slices int"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def awkward_rows():
    base = words(200, 1)
    near = base[:]
    near[100] = "changed"
    passage = words(60, 2)
    texts = {
        1: " ".join(base),
        2: " ".join(near),
        3: " ".join(base),
        4: "",
        5: None,
        6: " \t\n\x0b ",
        7: "Two Words",
        8: "two words",
        9: "É É über 😀 straße\nA line that repeats\n  a LINE that Repeats  \n",
        10: "a line that repeats\nshort\nshort\nother text here",
        11: " ".join(words(150, 3) + passage + words(30, 4)),
        12: " ".join(words(10, 5) + passage + words(120, 6)),
        13: "x" * 3000 + " " + "spam " * 300,
        14: " ".join(words(20_000, 7)),
        15: "12345 #### $$$ 67890",
        16: "…",
    }
    rows = [(i, t, ["en", None, "fr"][i % 3], None if i % 5 == 0 else f"s{i % 2}", len(t or ""), "k", 1, i, 2) for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    rows.append((None, " ".join(base), "en", "s1", 3, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 17)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def shingles(text, n):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def reachable(sets):
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: find(i) for i in ids}


def test_minhash_awkward_rows(docs):
    rows = minhash_dedup.near_duplicates(docs, size=4).collect()
    texts = {r[0]: r[1] for r in awkward_rows() if r[0] is not None}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = reachable(sets)
    assert len(rows) == 18
    for r in rows:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_crowded_bucket(spark):
    """A large group of near copies whose links are at the threshold, so that stars alone don't join it."""
    rng = np.random.default_rng(5)
    base = words(80, 9)
    texts = {}
    for i in range(150):
        w = base[:]
        for at in rng.choice(80, rng.integers(0, 4), replace=False):
            w[at] = f"x{i}-{at}"
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, size=4).collect()}
    assert got == reachable({i: shingles(t, 4) for i, t in texts.items()})


def test_minhash_ids_that_repeat_are_one_document(spark):
    a, b, c = (" ".join(words(60, k)) for k in (61, 62, 63))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, ""), (11, None), (11, "")]
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k, True] for k in (3, 5, 7)} == {(3, True), (3, False)} and got[5, True] == got[7, True] == (3, False)
    assert got[9, True] == got[9, False] == (9, True) and got[11, False] == (11, True)
    # an empty text of an id goes with the id's other text
    rows = [(3, a), (5, a), (5, "")]
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(3, 3), (5, 3)}


@pytest.mark.parametrize("small", [1, 1000])
@pytest.mark.parametrize("rounds", [0, 2])
def test_minhash_each_way_of_comparing_gives_the_same(spark, monkeypatch, small, rounds):
    """One crowd of texts around the threshold: by stars or not, by signatures or by prefixes and blocks."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(15)
    base, texts = words(120, 19), {}
    for i in range(70):
        w = base[:]
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            w[at] = f"x{i}-{at}" if i % 3 else f"y{at}"
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, size=4).collect()}
    want = reachable({i: shingles(t, 4) for i, t in texts.items()})
    assert got == want and 1 < len(set(want.values())) < 70


def test_counters_of_shingles_are_few_rows(spark, monkeypatch):
    """The counters reach the driver packed: a few rows, however many shingles the texts have."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)], "doc_id long, text string")
    kind, seen = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    heads = minhash_dedup._prefixes(minhash_dedup.Sets(docs, 4), docs.select(F.col("doc_id").alias("rep")), 80)
    assert heads.count() > 40 * 50
    assert max(map(len, seen)) <= minhash_dedup.TALLIES


def test_prefixes_hold_every_link_and_leave_common_texts_apart(spark):
    rng = np.random.default_rng(16)
    common, texts = words(100, 20), {}
    for i in range(40):
        texts[i] = " ".join(common + words(60, 500 + i))
        texts[100 + i] = " ".join(common + words(60, 500 + i)[:55] + words(int(rng.integers(1, 9)), 900 + i))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    keys = defaultdict(set)
    for r in minhash_dedup._prefixes(minhash_dedup.Sets(docs, 4), docs.select(F.col("doc_id").alias("rep")), 80).collect():
        keys[r.key].add(r.rep)
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    met = {(i, j) for k in keys.values() for i in k for j in k if i < j}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= met and len(met) < 3 * len(links)


def test_minhash_keeps_one_of_each_group(docs):
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and None in ids and {4, 5, 6} <= set(ids)


def test_bbit_estimate_and_common_counts():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    same = np.mean(minhash_dedup.minima(a) == minhash_dedup.minima(b))
    assert abs(same - 900 / 1100) < 0.15
    assert minhash_dedup.common_counts([a, b], [b]).tolist() == [[900], [len(b)]]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, 9), (9, 7), (3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 131)} | {7: 5, 9: 5}


def test_suffix_passages(docs):
    rows = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs).collect()}
    texts = {r[0]: WORD.findall((r[1] or "").translate(UPPER)) for r in awkward_rows() if r[0] is not None}
    where = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    for i, w in texts.items():
        want = {p for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for p in range(k, k + 50)}
        got = {p for s in rows[i].spans for p in range(s["from"], s["to"])} if i in rows else set()
        assert got == want, i
    assert set(rows[11].partners) == {12}


def plain_passages(texts):
    where = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    held = lambda i, w, more: {p for k in range(len(w) - 49) if more(i, where[tuple(w[k : k + 50])]) for p in range(k, k + 50)}
    return {i: (held(i, w, lambda i, who: len(who) > 1), held(i, w, lambda i, who: min(who) < i)) for i, w in texts.items()}


def found_passages(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").coalesce(1)
    found = {i: (set(), set()) for i in texts}
    for r in suffix_dedup.repeated_passages(docs).collect():
        found[r.doc_id] = tuple({p for s in x for p in range(s["from"], s["to"])} for x in (r.spans, r.drops))
        assert r.partners and r.doc_id not in r.partners
    return found


def test_passages_repeated_many_times_in_a_document(spark):
    """Each occurrence counts, wherever Arrow batches and partitions end, for every order of the ids."""
    passage = words(60, 31)
    own = [f"x{i}" for i in range(300)]
    texts = {i: [w for k in range(40) for w in [*passage, own[(i + k) % 300]]] for i in (1, 9)} | {5: passage + words(20, 32)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_passages(spark, texts) == plain_passages(texts)
        assert found_passages(spark, {1: texts[1], 5: texts[5]}) == plain_passages({1: texts[1], 5: texts[5]})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_of_documents_made_of_shared_pieces(spark, seed):
    """Pieces of 20 to 120 words in many orders, some changed by a word, repeated in a document and over many."""
    rng = np.random.default_rng(seed)
    pieces = [words(int(rng.integers(20, 120)), 700 + 50 * seed + k) for k in range(25)]
    texts = {}
    for i in range(80):
        w = []
        for k in rng.integers(0, 25, 6):
            piece = list(pieces[k][int(rng.integers(0, 4)) * 3 :])
            if rng.random() < 0.3:
                piece[int(rng.integers(0, len(piece)))] = f"y{i}"
            w += piece + [f"z{i}"] * int(rng.integers(0, 3))
        texts[i] = w
    assert found_passages(spark, texts) == plain_passages(texts)


def test_dropped_passages_stay_once(spark, docs):
    left = suffix_dedup.drop_passages(docs)
    assert left.columns == docs.columns and left.count() == 18
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[11].split() == words(150, 3) + words(60, 2) + words(30, 4)
    assert texts[12].split() == words(10, 5) + words(120, 6) and texts[5] is None and texts[3].split() == []
    # rows that repeat an id with other texts
    p = words(60, 40)
    rows = [(1, " ".join(p + words(5, 41))), (2, " ".join(words(7, 42) + p)), (2, " ".join(words(3, 43) + p + words(2, 44))), (None, " ".join(p))]
    left = sorted((r.doc_id or 0, r.text.split()) for r in suffix_dedup.drop_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert left == sorted([(0, p), (1, p + words(5, 41)), (2, words(7, 42)), (2, words(3, 43) + words(2, 44))])
    named = spark.createDataFrame([(f"d{i}", t) for i, t in rows if i], "doc_id string, text string")
    assert sorted(r.doc_id for r in suffix_dedup.repeated_passages(named).collect()) == ["d1", "d2", "d2"]


def kept_suffix(passage):
    """Where the kept suffix of a passage of 50 words begins."""
    data = np.frombuffer(" ".join(passage).encode(), np.uint8)
    t = bytewords.Texts(data, np.array([0, len(data)]))
    starts, ends, _ = t.spans(bytewords.NOT_SPACE)
    return int(bytewords.mix(bytewords.windows(t.hashes(starts, ends), 16)).argmin())


def test_passages_hidden_by_longer_one_sided_matches(spark):
    """Two documents share 50 words, others share more of them on one side only and so stand between the two."""
    texts = {}
    for case in range(300):
        shared, end, head = words(50, 100 + case), words(10, 200 + case), words(10, 300 + case)
        p = kept_suffix(shared)
        if not 10 < p < 24:
            continue
        pad = lambda k, case=case: [f"l{case}x{k}y{j}" for j in range(60)]
        whole, plain = pad(1) + head + shared + end + pad(2), pad(3) + shared + pad(4)
        right, left = pad(5) + shared[p:] + end + pad(6), pad(7) + head + shared[: p + 16] + pad(8)
        texts |= {case * 10 + k: d for k, d in enumerate((whole, right, left, plain))}
    assert len(texts) > 200
    assert found_passages(spark, texts) == plain_passages(texts)


def test_bitmaps_hold_their_hashes(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    held = suffix_dedup.bitmap(hashes, "h")
    mine = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    assert held.has(mine).all() and held.has(np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.2


def test_toxicity_learns_words_and_finds_sentences(spark):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(1500):
        lines = [" ".join(rng.choice(["the", "good", "day", "of", "rain", "sun"], 8)) for _ in range(5)]
        bad = i % 5 == 0
        if bad:
            lines[i % 4] += f" grumbl{'abcdefgh'[i % 8]}{i % 3} thing"
        rows.append((i, ". ".join(lines)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scored[i].score >= 0.5) == (i % 5 == 0) for i in held]
    assert np.mean(right) > 0.97
    found = next(scored[i] for i in held if i % 5 == 0 and scored[i].score >= 0.5)
    assert any("grumbl" in s.sentence for s in found.sentences)


def test_toxicity_scores_by_hand(spark):
    """The noisy-or of sentence scores from the model's weights, word by word."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    assert weights

    def features(word):
        raw = word.encode()
        t = bytewords.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for n in (len(raw), *(n for n in (4, 5, 6) if len(raw) > n)):
            h = int(t.hashes(np.array([0]), np.array([n]))[0])
            yield h if n == len(raw) else h ^ (0x5851F42D4C957F2D * n % (1 << 64))

    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id % 9 = 0").collect()}
    for r in toxicity.score(docs, model).where("doc_id % 9 = 0").collect():
        clean, bad = 1.0, []
        for sentence in re.split(r"[.!?\n]", texts[r.doc_id].translate(UPPER)):
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
            if found:
                z = model.bias + sum(weights.get(h, 0.0) for h in {h for w in found for h in features(w)})
                clean *= 1 - 1 / (1 + np.exp(-z))
                bad += [z] if z >= 0 else []
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and len(r.sentences) == len(bad)


def test_toxicity_learns_from_very_long_texts_and_any_labels(spark):
    """Long texts train like others; repeated and contradicting labels, and labels without a document, do no harm."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice(["the", "good", "day", "of", "rain", "sun"], 8)) for _ in range(900)]
        if i % 4 == 0:
            lines[i % 900] += " vileword"
        rows.append((i, "\n".join(lines)))
    marks = [(i, int(i % 4 == 0)) for i in range(400)] * 2 + [(1000 + i, 1) for i in range(3000)] + [(2, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))).collect()
    assert min(len(t) for _, t in rows) > 20_000
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored]) > 0.98


def test_toxicity_awkward_rows(docs, empty, labels):
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 18 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_in_several_passes_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs, path)).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES_A_PASS", 1)
    monkeypatch.setattr(language_id, "MEMORY_BYTES", 20_000)
    models = language_id.train(docs, path)
    assert len(models) == 4
    for r in language_id.identify(docs, models).collect():
        assert r.lang_pred == whole[r.doc_id].lang_pred and r.score == pytest.approx(whole[r.doc_id].score, rel=1e-6)


def test_language_scores_by_hand(spark):
    """A text's share of the likelihoods, from every segmentation of every word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    (model,) = language_id.train(docs, path)
    pieces = language_id.pieces_of(path)
    probs = dict(zip([pieces[i] for i in np.argsort(language_id.piece_hashes(pieces))], model.probs.astype(float), strict=True))
    longest = max(map(len, pieces))

    def total(word):
        sums = [np.ones(4)]
        for at in range(1, len(word) + 1):
            sums.append(sum((sums[at - n] * probs[word[at - n : at]] for n in range(1, min(at, longest) + 1) if word[at - n : at] in probs), np.zeros(4)))
        return np.log(sums[-1])

    some = docs.where("doc_id % 23 = 0 and n_chars < 3000")
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    for r in language_id.identify(some, [model]).collect():
        found = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", texts[r.doc_id].translate(UPPER).encode())
        if found:
            logs = sum(total(b" " + w) for w in found)
            share = np.exp(logs - logs.max())
            assert r.lang_pred == model.languages[int(logs.argmax())] and r.score == pytest.approx(1 / share.sum(), rel=1e-6)


def test_language_learns_from_long_words_and_texts(spark):
    """Words of any length, and texts of any length, take part in the fit."""
    rows = [(i, " ".join(("ab" if i % 2 else "xy") * 400 for _ in range(60)), ["p", "q"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    asked = spark.createDataFrame([(1, "ababab"), (2, "xyxyxy")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, models).collect()} == {1: "q", 2: "p"}
    assert all(np.isfinite(m.probs).all() for m in models)


def test_long_words_are_summed_in_stretches():
    """The same sums as byte by byte, for lengths around the stretches."""
    pieces = sorted({bytes([b]) for b in range(97, 101)} | {b" ", b" a", b"ab", b"abc", b"bcd", b"abcdabcdabcdabcdabcd", b"dd"})
    hashes = language_id.piece_hashes(pieces)
    order = np.argsort(hashes)
    sizes = np.array([len(p) for p in pieces])[order]
    rng = np.random.default_rng(4)
    probs = rng.random((len(pieces), 3)) * 0.1 + 1e-6
    for n in (1, 63, 64, 65, 127, 128, 700, 64 * 300 + 5):
        word = np.concatenate([[32], rng.integers(97, 101, n - 1)]).astype(np.uint8)
        word[1:41] = np.frombuffer(b"abcd" * 10, np.uint8)[: len(word[1:41])]
        lattice = language_id.Lattice(word, np.array([0, n]), hashes[order], sizes)
        each = [lattice.forward(probs[:, [j]])[0, 0] for j in range(3)]  # a model at a time, since models share a scale there
        assert np.allclose(lattice.forward_long(probs), each, rtol=1e-9)


def test_language_of_unbroken_text(spark):
    """A third of a megabyte without a blank, and texts of one long word to learn from."""
    rng = np.random.default_rng(6)
    han = lambda n, lo: "".join(map(chr, rng.integers(lo, lo + 300, n)))
    rows = [(i, han(900, 0x4E00 if i % 2 else 0x30A0), ["p", "q"][i % 2]) for i in range(30)]
    models = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    began = time.monotonic()
    asked = spark.createDataFrame([(1, han(120_000, 0x4E00)), (2, han(5000, 0x30A0))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, models).collect()} == {1: "q", 2: "p"}
    assert time.monotonic() - began < 90


def test_language_awkward_rows(docs, empty):
    model = language_id.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [m.languages for m in model] == [["en", "fr"]]
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6, 15, 16))
    assert all(rows[i].lang_pred in ("en", "fr") for i in (1, 7, 9, 13))
    none = language_id.train(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b" ab"]
    probs = {b" ": 0.2, b"a": 0.1, b"b": 0.3, b" a": 0.1, b"ab": 0.25, b" ab": 0.05}

    def total(word):
        return 1.0 if not word else sum(probs[p] * total(word[len(p) :]) for p in pieces if word.startswith(p))

    hashes = language_id.piece_hashes(pieces)
    order = np.argsort(hashes)
    column = np.array([[probs[pieces[i]]] for i in order])
    text = [b" ab", b" aab", b" b", b" abababababababababababababababab"]
    lattice = language_id.Lattice(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]), hashes[order], np.array([len(pieces[i]) for i in order]))
    assert np.allclose(lattice.forward(column)[:, 0], [np.log(total(t)) for t in text])
    uses = language_id.expected_counts(lattice, np.ones(len(text)), column[:, 0])
    spelled = sum(n * len(pieces[i]) for n, i in zip(uses, order, strict=True))
    assert np.isclose(spelled, sum(map(len, text)))


def plain_counts(text):
    w = WORD.findall(text or "")
    where = defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i : i + 5])].append(i)
    repeat = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_rules_counts(docs, empty, spark):
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in quality_rules.quality_rules(frame).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id])
            assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_verdict_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).where("n_words >= 50").join(labels, "doc_id")
    good = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert good[1] > 0.95 and good[0] < 0.2


CLASS_OF = [("a-z", 0), ("A-Z", 1), ("0-9", 2), (" \\t\\x0b\\x0c\\r", 3), ("\\n", 4), (".,;:!?'\"()\\-", 5), ("#*$%&|<>", 6), ("\\x00-\\x7f", 7)]


def plain_histograms(text):
    chars, rest = np.zeros(9), text or ""
    for pattern, at in CLASS_OF:
        chars[at] = len(re.findall(f"[{pattern}]", rest))
        rest = re.sub(f"[{pattern}]", "", rest)
    chars[8] = len(rest)
    words = np.zeros(len(quality_features.WORDS) + 1)
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER)):
        words[quality_features.WORDS.index(w) if w in quality_features.WORDS else -1] += 1
    return chars / max(1, chars.sum()), words / max(1, words.sum())


def jensen_shannon(p, q):
    total = 0.0
    for a, b in zip(p.tolist(), q.tolist(), strict=True):
        m = (a + b) / 2
        total += (a * np.log2(a / m) if a else 0) / 2 + (b * np.log2(b / m) if b else 0) / 2
    return np.sqrt(max(total, 0.0))


def test_quality_rules_verdict_by_hand(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in frame.collect()}
    counts, hists = {i: plain_counts(r.text) for i, r in rows.items()}, {i: plain_histograms(r.text) for i, r in rows.items()}
    may = [i for i, c in counts.items() if c[0] >= 50 and not c[5] and rows[i].lang is not None]
    sizes = {x: sum(rows[i].lang == x for i in may) for x in {rows[i].lang for i in may}}
    group = lambda i: rows[i].lang if sizes[rows[i].lang] >= max(20, len(may) / 1000) else ""
    refs = {}
    for _ in range(3):
        near = [i for i in may if not refs or min(jensen_shannon(hists[i][0], c) for c, _ in refs.values()) <= 0.12]
        refs = {g: tuple(np.mean([hists[i][k] for i in near if group(i) == g], axis=0) for k in (0, 1)) for g in {group(i) for i in near}}
    for r in quality_rules.quality_rules(frame).collect():
        by = [min(jensen_shannon(hists[r.doc_id][k], x[k]) for x in refs.values()) for k in (0, 1)]
        assert np.allclose([r.char_distance, r.word_distance], by, atol=1e-7)
        n, failed = counts[r.doc_id][0], counts[r.doc_id][5]
        assert r.kept == (not failed and not (n >= 50 and by[0] > 0.19) and not (n >= 100 and by[1] > 0.45))


def test_quality_rules_with_many_languages_and_with_few_texts(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    langs = [f"l{k}" for k in range(450) for _ in range(21 if k < 150 else 1)] + [None] * 5
    rows = [(i, text(), x) for i, x in enumerate(langs)] + [(10_000, "1 2 3 4 5 " + " ".join(str(k * 7) for k in range(100)), "l1")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(rows) and not got.pop(10_000).kept and all(r.kept for r in got.values())
    # no language has many texts: all texts make one reference, whether their languages are known or not
    for lang in ("'l' || doc_id", "cast(null as string)"):
        few = spark.createDataFrame([*rows[:12], rows[-1]], "doc_id long, text string, lang string").withColumn("lang", F.expr(lang))
        got = {r.doc_id: r for r in quality_rules.quality_rules(few).collect()}
        assert not got.pop(10_000).kept and all(r.kept and r.char_distance > 0 for r in got.values())


def test_priors_are_the_moments_of_nested_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(f"h{h}" if h else None, f"p{p}", float(np.clip(0.5 + 0.02 * (h - 3) + 0.03 * (p - 2) + rng.normal(0, 0.1), 0, 1))) for h in range(6) for p in range(1 + h % 4) for _ in range(4 + h * p)]
    frame = spark.createDataFrame(rows, "_host string, _path string, x double")
    got = quality_classifier.priors(frame.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q")))
    every = np.array([x for *_, x in rows])
    host = lambda h: np.array([x for a, _, x in rows if a == h])
    path = lambda h, p: np.array([x for a, b, x in rows if (a, b) == (h, p)])
    hosts, paths = sorted({a for a, *_ in rows}, key=str), sorted({(a, b) for a, b, _ in rows}, key=str)
    n = len(rows)
    chance = sum(((path(*k) - path(*k).mean()) ** 2).sum() for k in paths) / (n - len(paths))
    inner = sum(sum(len(path(*k)) ** 2 for k in paths if k[0] == h) / len(host(h)) for h in hosts)
    ss = sum(len(path(*k)) * (path(*k).mean() - host(k[0]).mean()) ** 2 for k in paths)
    between = max(0, (ss - (len(paths) - len(hosts)) * chance) / (n - inner))
    ss = sum(len(host(h)) * (host(h).mean() - every.mean()) ** 2 for h in hosts)
    squares = sum(len(path(*k)) ** 2 for k in paths)
    apart = max(0, (ss - (len(hosts) - 1) * chance - between * (inner - squares / n)) / (n - sum(len(host(h)) ** 2 for h in hosts) / n))
    assert between > 0 and apart > 0
    assert (got.n, got.total) == (n, pytest.approx(every.sum()))
    assert (got.host, got.path) == (pytest.approx(chance / apart), pytest.approx(chance / between))


def test_quality_rates_leave_the_document_itself_out(spark):
    big, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    counted = quality_rules.count(big.select("doc_id", "text"), ["doc_id"]).cache()
    _, known = quality_classifier.train(counted, marks)
    rows = quality_classifier.classify(big, marks).join(big.select("doc_id", "source", "lang"), "doc_id").collect()
    p = np.array([1 / (1 + np.exp(-(r.evidence + np.log(known / (1 - known))))) for r in rows])
    frame = spark.createDataFrame([(r.source, r.lang, float(x)) for r, x in zip(rows, p, strict=True)], "_host string, _path string, x double")
    prior = quality_classifier.priors(frame.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q")))
    for i in range(0, len(rows), 37):
        r, others = rows[i], [k for k in range(len(rows)) if k != i]
        host = [k for k in others if rows[k].source == r.source]
        path = [k for k in host if rows[k].lang == r.lang]
        rate = p[others].mean()
        for group, strength, name in ((host, prior.host, "host_rate"), (path, prior.path, "path_rate")):
            rate = rate if np.isinf(strength) else (p[group].sum() + strength * rate) / (len(group) + strength)
            assert r[name] == pytest.approx(rate, rel=1e-6)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(r.evidence + np.log(rate / (1 - rate))))), rel=1e-5)
        assert r.kept == (r.score >= 0.5)


def test_quality_classifier_follows_labels(spark, docs, empty, labels):
    big, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(big, marks).join(marks, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.95
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.8
    assert all(0 < r.host_rate < 1 and 0 < r.path_rate < 1 for r in rows)
    assert quality_classifier.classify(docs, labels).count() == 18
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.keep_good(docs, labels.limit(0)).count() == 18


def test_quality_prior_is_that_of_all_labels(spark, monkeypatch):
    """The bound on a class's sample changes neither the prior nor, by much, the rates."""
    big, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    counted = quality_rules.count(big.select("doc_id", "text"), ["doc_id"]).cache()
    share = marks.where("quality in (0, 1)").join(big, "doc_id").agg(F.avg("quality")).first()[0]
    _, whole = quality_classifier.train(counted, marks)
    rates = quality_classifier.classify(big, marks).agg(F.avg("host_rate")).first()[0]
    monkeypatch.setattr(quality_classifier, "MAX_LABELLED", 40)
    _, bounded = quality_classifier.train(counted, marks)
    assert whole == pytest.approx(share) and bounded == pytest.approx(share)
    assert abs(quality_classifier.classify(big, marks).agg(F.avg("host_rate")).first()[0] - rates) < 0.08


def test_sparse_groups_shrink_to_the_rate_above(spark):
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") == 3, "alone").otherwise(F.col("source")))
    rates = quality_classifier.classify(big, marks)
    alone = rates.where("doc_id = 3").first()
    others = rates.agg(F.avg("host_rate")).first()[0]
    assert abs(alone.host_rate - others) < 0.2


@pytest.mark.parametrize(("words_a_part", "parts_a_pass"), [(100_000, 8), (12, 2), (20, 1)])
def test_decontamination_awkward_rows(spark, docs, empty, monkeypatch, words_a_part, parts_a_pass):
    """The same with one automaton, with several in a pass, and with items that are cut over passes."""
    monkeypatch.setattr(decontamination, "PART_WORDS", words_a_part)
    monkeypatch.setattr(decontamination, "PARTS_A_PASS", parts_a_pass)
    passage = words(60, 2)
    items = [(1, " ".join(passage)), (2, "TWO words"), (3, None), (4, ""), (None, "short"), (5, " ".join(passage[30:45]).upper()), (2, "TWO words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: token.findall((t or "").translate(UPPER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    rows = {r.doc_id: r for r in decontamination.find_passages(docs, bench).collect()}
    for i, t in {r[0]: r[1] for r in awkward_rows()}.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= who
        assert (rows[i].n_words, rows[i].n_hit, rows[i].items) == (len(w), len(hit), sorted(found)), i
    clean = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert 7 not in clean and clean[1] == " ".join(words(200, 1)) and clean[5] is None
    assert clean[11].split() == words(150, 3) + words(30, 4)
    assert decontamination.decontaminate(docs, bench).columns == docs.columns
    assert decontamination.find_passages(empty, bench).count() == 0
    assert decontamination.find_passages(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_bpe_equals_the_public_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = {r.doc_id: r for r in byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    ranks = byte_bpe.vocabulary(open(path, "rb").read(), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in {r[0]: r[1] for r in awkward_rows()}.items():
        assert (list(rows[i].ids), rows[i].decoded) == (plain.encode_ordinary(t or ""), t or "")
    digests = {r.doc_id: r for r in byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, digests=True).collect()}
    assert digests[9].ids_sha256 == hashlib.sha256(np.array(rows[9].ids, dtype="<u4").tobytes()).hexdigest()
    assert byte_bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_merge_forms_agree():
    words = byte_bpe.vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(b"abcdeeetthh "), n).tolist()) for n in rng.integers(1, 33, 300)]
    pieces = [p for p in pieces if p not in words.ranks]
    for p, ids in zip(pieces, words.merge_many(pieces, 32), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.merge(p)


def test_lines_awkward_rows(docs, empty):
    texts = {r[0]: r[1] or "" for r in awkward_rows()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders[key(x)].add(i)
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
    dropped = line_dedup.drop_lines(docs)
    assert dropped.columns == docs.columns and dropped.count() == 18
    assert {r.doc_id: r.text for r in dropped.collect()}[10] == "short\nshort\nother text here"
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(docs, min_docs=3).where("n_dropped > 0 and doc_id = 10").count() == 0


def test_urls_awkward_rows(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/x?y", "https://example.org/en/1/2#z", "http://spam-farm.example.com/", "http://x.casino-win.example.net?u", "ftp://shop.com/fr/", "http://shop.com/de/1", "http://org", "://example.org/es/", "http://notexample.org/es/", "http://q.net/a\nb"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(None, "http://free-bets.example.com", "h", "k"), (3, urls[3], "h", "k")], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([(d,) for d in url_filter.listed_domains()], "key string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
    assert rows[0] == rows[1] == rows[2] == ("", "", None, "allow")
    assert rows[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rows[4] == ("example.org", "/en/1/2", "example.org/en/1", "block")
    assert rows[5][3] == rows[6][3] == rows[None][3] == "block"
    assert rows[7][2:] == ("com/fr/", "allow") and rows[8][2:] == ("com/de/", "block")
    assert rows[9] == ("org", "", None, "allow") and rows[10][2] == "example.org/es/"
    assert rows[11][2:] == ("org/", "allow") and rows[12][1] == "/a\nb"
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert url_filter.url_filter(pages, listed.limit(0)).where("rule is null and verdict = 'block'").count() == 0


@pytest.mark.parametrize("shard_bits", [1 << 26, 1 << 11])
def test_cascade_is_exact(spark, monkeypatch, shard_bits):
    """With one shard of the keys, and with several in several passes."""
    monkeypatch.setattr(url_filter, "SHARD_BITS", shard_bits)
    monkeypatch.setattr(url_filter, "SHARDS_A_PASS", 3)
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 31 = 0")
    cascade = url_filter.Cascade(universe, listed)
    assert all(len(x) > 1 for x in cascade.shards) and (len(cascade.shards) > 3) == (shard_bits < 1 << 20)
    found = cascade.mark(universe, lambda: F.array("key"), "in").where(F.col("in")).select("key")
    assert found.exceptAll(listed).count() == 0 and found.count() == listed.count()


def test_urls_that_are_very_long(spark):
    deep = ".".join(["a"] * 300) + ".spam-farm.example.com"
    pages = spark.createDataFrame([(1, "http://" + deep + "/" + "x" * 100_000), (2, "y" * 100_000), (3, "http://" + "z" * 50_000)], "page_id long, url string")
    listed = spark.createDataFrame([("spam-farm.example.com",)], "key string")
    rows = {r.page_id: (len(r.host), len(r.path), r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
    assert rows == {1: (len(deep), 100_001, "block"), 2: (0, 0, "allow"), 3: (50_000, 0, "allow")}
