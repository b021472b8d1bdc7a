"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import personal_data as P
from tidemill.llm import phrase_collocations as C
from tidemill.llm import quotient_filter as Q
from tidemill.llm import spelling_variants as V

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, word string, n long, kind int, spans string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "w", 1, 2, "x") for i, t, lang in rows], COLUMNS)


AWKWARD = [(1, None, None), (2, "", "en"), (None, "Some words some words", "en"), (None, None, None), (3, "same text here", "en"), (3, "same text here", "en"), (4, "é\U0001f600 ß", "de")]

# ---- Operator 11

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_texts():
    rng = random.Random(5)
    bits = ["a@b.c", "a@b.c_d@e.f", "x@y", "@", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "12 4111 1111 1111 1111"]
    bits += ["+1 (212) 555-0100", "+49 30 1234567", "+1 2", "++12345678901", "+1234567890123456", "é\U0001f600", " ", "-", "\n", "7", "5.5", "a.b@c-d.e-f.", "%@x.y", "1@2.3", "1.1.1.1@a.b"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(600)]


def test_personal_data_base_spans(spark):
    texts = [*base_texts(), *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), None]
    got = P.personal_data(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()
    for r in got:
        want = plain_base(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(want) <= {tuple(s) for s in r.spans}
    assert len(got) == len(texts)


def test_personal_data_query(spark):
    names = ["email", "ip", "card", "phone", "iban", "social"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in P.op11_personal_data(spark, SF).collect():
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in plain_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_personal_data_added_spans(spark):
    found = {
        "write to jane.doe (at) mail (dot) example (dot) org today": "jane.doe (at) mail (dot) example (dot) org",
        "call me: (212) 555-0147 after six": "(212) 555-0147",
        "Tel. 0049 30 123 4567 bitte": "0049 30 123 4567",
        "the account is DE89 3704 0044 0532 0130 00 there": "DE89 3704 0044 0532 0130 00",
        "ssn 123-45-6789 on file": "123-45-6789",
        "pay by card 4111.1111.1111.1111 now": "4111.1111.1111.1111",
        "card 77 4111 1111 1111 1111 please": "4111 1111 1111 1111",
    }
    clean = ["version 212-555-0147", "order 1234-56-7890", "in 1999 and 2004, 3.14 or 10:30", "look at the house", "DE89 3704 0044 0532 0130 01", "000-00-0000", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""]
    rows = [*found, *clean, *(f"mail{i}@site{i}.example.com and +1 (212) 555-{1000 + i} from 10.0.0.{i}" for i in range(40))]
    got = {r.doc_id: r for r in P.personal_data(table(spark, [(i, t, "en") for i, t in enumerate(rows)])).collect()}
    for i, (text, span) in enumerate(found.items()):
        assert [text[s.start : s.end] for s in got[i].spans] == [span], text
    for i in range(len(found), len(found) + len(clean)):
        assert not got[i].spans, rows[i]


def test_personal_data_reliabilities():
    """Labelers that agree with the truth are found, and a useless one is not trusted."""
    rng, truth = random.Random(3), []
    counts = collections.Counter()
    right = [0.9, 0.99, 0.5, 0.8, 0.85, 0.9, 0.8]
    for _ in range(40_000):
        y = rng.random() < 0.4
        truth.append(y)
        counts[(y, *((1 if y else -1) if rng.random() < a else (-1 if y else 1) for a in right))] += 1
    patterns = collections.Counter()
    for (_, *p), n in counts.items():
        patterns[tuple(p)] += n
    share, true, rates = P.reliabilities(sorted(patterns.items()))
    assert abs(share - sum(truth) / len(truth)) < 0.03
    for j, a in enumerate(right):
        assert abs(rates[j][1][1] - a) < 0.06 and abs(rates[j][0][-1] - a) < 0.06
    wrong = sum(n for (y, *p), n in counts.items() if (true[tuple(p)] >= 0.5) != y)
    assert wrong < 0.03 * len(truth)


def test_personal_data_awkward(spark):
    short = "word " * 200_000 + "1" * 1000 + " " + "a" * 1000 + " 1.1.1.1 " + "a.b." * 200 + "@c.d"
    long = "1" * 300_000 + " " + "a" * 300_000 + "a.b." * 50_000 + "@c.d"  # a match tried from each place would take hours
    rows = [*AWKWARD, (9, short, "en"), (10, "+1 212 555 0100 " * 3000, "en"), (11, long, "en")]
    got = P.personal_data(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (9, 10):
            assert [tuple(s) for s in r.base] == plain_base(dict((i, t) for i, t, _ in rows)[r.doc_id])
        elif r.doc_id == 11:
            assert [tuple(s) for s in r.base] == [(300_001, 0, len(long))]
        else:
            assert not r.spans
    assert P.personal_data(table(spark, [])).count() == 0


# ---- Operator 12


def plain_variants(rows, least_chars=7, least_n=2, damage=31, ratio=10):
    n = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}
    shorter = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            shorter[k, w[:k] + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            near[w] |= shorter[k, cut] - {w} | ({cut} & n.keys())
            if cut in n:
                near[cut].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items())


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_variants(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert variants(V.op12_spelling_variants(spark, SF)) == plain_variants([(r.doc_id, r.text, r.lang) for r in docs.collect()])


def test_spelling_variants_chains_ties_and_anagrams(spark):
    rng = random.Random(2)
    words = {"receive": 2000, "recieve": 30, "receeve": 20, "receves": 20, "recceve": 2, "étéréce": 40, "étérécf": 4, "Étérécf": 4}
    words |= {"".join(rng.sample("aeinrstl", 8)): 2 for _ in range(400)}  # many anagrams
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))): rng.randint(2, 60) for _ in range(200)}
    rows = [(i, " ".join([w] * c), "en") for i, (w, c) in enumerate(words.items())]
    assert variants(V.spelling_variants(table(spark, rows))) == plain_variants(rows)


def test_spelling_variants_awkward(spark):
    rows = [*AWKWARD, (8, "Longword " * 3 + "longwort " * 40 + "x" * 50_000 + " " + "x" * 50_000, "en"), (None, "longword", "en")]
    assert variants(V.spelling_variants(table(spark, rows))) == plain_variants(rows)
    assert V.spelling_variants(table(spark, [])).count() == 0
    assert V.spelling_variants(table(spark, AWKWARD)).count() == 0


# ---- Operator 13


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 3), (2, 17), (3, 17), (5, 17), (5, 25), (2, 64), (5, 64)])
def test_quotient_filter_is_lossless(n, bits):
    rng = np.random.default_rng(n * bits)
    ids = [rng.integers(0, min(1 << bits, 50), 4000).astype(np.uint64) for _ in range(n)]
    if bits == 64:
        ids = [Q.mix(x) for x in ids]
    shape = Q.Shape(n, bits)
    lanes = shape.permute(shape.pack(ids))
    known = min(3, shape.widths[0])
    first = lanes[0] >> np.uint64(shape.widths[0] - known)
    got = collections.Counter()
    for s in range(1 << known):
        blocks = []
        for half in (slice(0, 2000), slice(2000, None)):
            kept, counts = Q.summed(shape, [x[half][first[half] == s] for x in lanes])
            blocks.append(Q.encode(shape, kept, counts, known))
        kept, counts = Q.merge(shape, blocks, s, known)
        got.update(dict(zip(zip(*[x.tolist() for x in shape.unpack(shape.restore(kept))], strict=True), counts.tolist(), strict=True)))
    assert got == collections.Counter(zip(*[x.tolist() for x in ids], strict=True))


def test_quotient_filter_keeps_large_counts():
    shape = Q.Shape(2, 20)
    lanes = shape.permute(shape.pack([np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)]))
    kept, _ = Q.summed(shape, lanes)
    counts = np.array([1, 254, 255, 256, 1 << 40], np.uint64)
    again, n = Q.decode(shape, Q.encode(shape, kept, counts, 0), 0, 0)
    assert all((a == b).all() for a, b in zip(again, kept, strict=True)) and (n == counts).all()


def plain_phrases(rows, least, longest=5, top=2000):
    total, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    held = {(lang, p[i:j]) for (lang, p), a in cands.items() for i, j in itertools.combinations(range(len(p) + 1), 2) if j - i < len(p) and a >= f[lang, p[i:j]]}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if (lang, p) in held:
            continue
        cuts = [(Fraction(1000 * a * total[lang], f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrase_collocations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = phrases(C.op13_phrase_collocations(spark, SF))
    assert got == plain_phrases(rows, 100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.SQL['op13_phrase_collocations']})").fetchall())


@pytest.mark.parametrize("listed", [C.LISTED, 0])
def test_phrase_collocations_small_and_by_hashes(spark, listed):
    rng = random.Random(4)
    words = ["a", "b", "B", "c", "dé", "É", "x"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(60)), rng.choice(["en", "de", None, ""])) for i in range(80)]
    rows += [(100, "of the house " * 30, "en"), (100, "of the house " * 30, "en"), *AWKWARD]
    for least, top in ((3, 2000), (12, 7)):
        assert phrases(C.phrase_collocations(table(spark, rows), least=least, top=top, listed=listed)) == plain_phrases(rows, least, top=top)


def test_phrase_collocations_awkward(spark):
    long = ("alpha beta gamma " * 40_000).strip()
    rows = [*AWKWARD, (7, long, None)]
    assert phrases(C.phrase_collocations(table(spark, rows))) == plain_phrases(rows, 100)
    assert C.phrase_collocations(table(spark, [])).count() == 0
    assert C.phrase_collocations(table(spark, AWKWARD)).count() == 0
