"""Operator 11: personal data, by labelers whose reliabilities are estimated from how they agree.

DataFrame functions only: texts stay where they are, and each is read once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read, saved

# ---- Fixed values: the kinds and their patterns. Where a pattern differs in form from the plain one in the comment, it
# ---- finds the same matches, but never tries a run of characters again from its middle, so long runs take linear time.
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: ``[0-9]([\x20-]?[0-9])+``, those of 12 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
#: ``\+[0-9][\x20().0-9-]+[0-9]``
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Other ways to write them, and other kinds.
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]{1,63}){1,5}+(?![A-Za-z0-9._%+@-])"
DOTTED_CARD = r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[./_-][0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])"
FAR_PHONE = r"(?<![0-9A-Za-z+.-])(?<![0-9] )00[1-9][0-9]{0,2}[ ./-](?:\(0\))?(?:[ ./-]?[0-9]{2,5}){2,5}+(?![0-9A-Za-z])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
#: A card in a longer run of digits, of which the base pattern only sees the whole.
_CARD = r"(?:[0-9]{4}([ -])[0-9]{4}\{0}[0-9]{4}\{0}[0-9]{4}|[0-9]{16})"
INNER_CARD = rf"(?<![0-9])(?:(?<=[0-9][ -]){_CARD.replace('{0}', '1')}|{_CARD.replace('{0}', '2')}(?=[ -][0-9]))(?![0-9])"

#: Kinds in their order; ``base`` are those with a pattern that counts by itself.
KINDS = ("email", "ip", "card", "phone", "iban", "social")

#: Gazetteers: ends of domains, issuers of cards, calling codes, countries with IBANs.
DOMAINS = "com org net edu gov int info biz io co dev app me eu de fr es it nl be at ch uk us ca mx br ar cl pt pl se no dk fi ie gr cz ru cn jp kr in au nz za".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|60|62|65|35)"
CALLING = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1368]|35[1-9]|37[0-8]|38[0-9]|42[013]|97[0-9])"
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: Words before a span that speak for it, by kind, and words that speak against any.
CUES = {
    "email": r"e-?mail|mailto|contact|correo|courriel|kontakt|write|reach",
    "ip": r"\bip\b|address|adresse|host|server|client|login|from|dirección",
    "card": r"card|visa|master|amex|carte|karte|tarjeta|credit|pay",
    "phone": r"phone|\btel|call|fax|mobile|cell|handy|telefon|téléphone|teléfono|whatsapp|sms",
    "iban": r"iban|account|konto|compte|cuenta|bank|transfer",
    "social": r"ssn|social|security|insurance|tax id",
}
AGAINST = r"(?:version|\bv|isbn|issn|doi|order|invoice|section|chapter|fig\.?|figure|page|ref|sku|part|serial|no\.|nr\.|#|=)[ :.]*$"
# ---- End of fixed values.

#: Characters before and after a span that labelers look at.
AROUND = 32
#: Characters of a span that labelers look at; no kind of personal data is longer.
LONGEST = 320
#: Of each labeler how often it is taken to be right before any text is seen, and how often to vote at all; that counts
#: as much as PRIOR_VOTES spans.
LABELERS = {"form": (0.75, 0.98), "check": (0.9, 0.98), "listed": (0.7, 0.98), "cue": (0.8, 0.3), "against": (0.999, 0.3), "border": (0.75, 0.98), "variety": (0.9, 0.3)}
PRIOR_VOTES, STEPS = 500.0, 40


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(x: Column) -> Column:
    return F.transform(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0")))


def _small_octets(x: Column) -> Column:
    return F.forall(_octets(x), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _mod97(iban: Column) -> Column:
    """Whether a compact IBAN leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


@dataclass(frozen=True)
class Form:
    """A way to write a kind: its pattern, a cheap sign without which it can't match, and what a match must pass."""

    name: str
    kind: str
    pattern: str
    sign: str
    base: bool = False

    def passes(self, m: Column) -> Column:
        n = F.length(_digits(m))
        if self.kind == "ip":
            return _small_octets(m)
        if self.kind == "card":
            return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
        if self.kind == "phone":
            return n.between(9, 15)
        if self.kind == "iban":
            return _mod97(F.replace(m, F.lit(" "), F.lit("")))
        return F.lit(True)


FORMS = (
    Form("email", "email", EMAIL, "@", base=True),
    Form("ip", "ip", IP, r"[0-9]\.[0-9]+\.[0-9]", base=True),
    Form("card", "card", CARD, "[0-9](?:[ -]?[0-9]){11}", base=True),
    Form("phone", "phone", PHONE, r"\+[0-9]", base=True),
    Form("masked_email", "email", MASKED_EMAIL, r"[\[({] ?(?:at|AT) ?[\])}]"),
    Form("dotted_card", "card", DOTTED_CARD, "[0-9]{4}[./_][0-9]{4}[./_]"),
    Form("inner_card", "card", INNER_CARD, "[0-9](?:[ -]?[0-9]){17}"),
    Form("local_phone", "phone", LOCAL_PHONE, "[0-9]{3}[ .-][0-9]{4}"),
    Form("far_phone", "phone", FAR_PHONE, "00[1-9]"),
    Form("iban", "iban", IBAN, "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    Form("social", "social", SOCIAL, "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
)

#: Numbers that are summed at once; see ``_sums_before``.
_BLOCK = 64


def _sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, from sums of blocks, so that a text with very many
    matches doesn't take the square of their number."""
    add = lambda a, x: a + x
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def of(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.size(x) - 1)), lambda b: F.aggregate(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))
        before = _let(sums, lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), add)))
        inside = lambda i: F.aggregate(F.slice(x, block(i) * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK))), F.lit(0), add)
        return _let(before, lambda w: F.transform(x, lambda _, i: F.get(w, block(i)) + inside(i)))

    return _let(numbers, of)


def _vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def _votes(form: Form, m: Column, ok: Column, before: Column, after: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 it is personal data of its kind, -1 it isn't, 0 nothing."""
    digits, none = _digits(m), F.lit(0)
    mail = F.regexp_replace(F.regexp_replace(F.lower(m), r" ?[\[({] ?at ?[\])}] ?", "@"), r" ?[\[({] ?dot ?[\])}] ?", ".")
    compact = F.replace(m, F.lit(" "), F.lit(""))
    strict = {
        "email": mail.rlike(r"^[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}$"),
        "ip": m.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ ._/-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": m.rlike(r"^(?:\+[1-9]|00[1-9]|\(?[2-9])") & ~m.rlike(r"[ .-]{3}|\([^)]*$"),
        "iban": F.length(compact).between(15, 34),
        "social": m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    }
    lengths = F.create_map(*[F.lit(x) for c, n in IBAN_LENGTHS.items() for x in (c, n)])
    listed = {
        "email": _vote(F.substring_index(mail, ".", -1).isin(DOMAINS)),
        "ip": none,
        "card": _vote(digits.rlike(ISSUERS)),
        "phone": _vote(F.regexp_replace(digits, "^00", "").rlike(CALLING if form.name != "local_phone" else "^[2-9]")),
        "iban": _vote(F.coalesce(lengths[F.substring(m, 1, 2)] == F.length(compact), F.lit(False))),
        "social": none,
    }
    near = F.lower(before)
    out = {
        "form": _vote(strict[form.kind]),
        "check": _vote(ok) if form.kind in ("ip", "card", "iban") else none,
        "listed": listed[form.kind],
        "cue": F.when(near.rlike(CUES[form.kind]), 1).otherwise(0),
        "against": F.when(near.rlike(AGAINST), -1).otherwise(0),
        "border": _vote(~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"^[A-Za-z0-9_]")),
        "variety": F.when(F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]", ""), ""))) < 4, -1).otherwise(0),
    }
    return {k: out[k] for k in LABELERS}


def _shape(form: Form, m: Column, before: Column, after: Column) -> list[Column]:
    """What the classifier sees of a span beside votes and kind, each 0 or 1."""
    one = lambda c: F.when(c, 1).otherwise(0)
    n = F.length(_digits(m))
    return [
        one(m.rlike("[ ()/-]")), one(n == 16), one(n.between(10, 12)), one(F.char_length(m) > 24),
        one((before == "") | before.rlike(r"\s$")), one((after == "") | after.rlike(r"^\s")), F.lit(int(form.base)),
    ]


SHAPES = 7
_SPAN = "array<struct<start:int,kind:int,end:int,base:boolean,ok:boolean,x:array<tinyint>>>"


def _spans(text: Column, form: Form) -> Column:
    """All matches of a form with whether they pass its checks, votes and shape. Positions are code points: the text is
    split at the matches, and the lengths of what is between and of the matches are summed."""

    def span(p: Column, m: Column, i: Column) -> Column:
        start, short = F.get(p["at"], 2 * i + 1), F.left(m, F.lit(LONGEST))
        before, after = F.right(F.get(p["b"], i), F.lit(AROUND)), F.left(F.get(p["b"], i + 1), F.lit(AROUND))
        ok = form.passes(m)
        if form.name == "inner_card":  # not in a base one
            run = F.concat(F.regexp_extract(before, "((?:[0-9][ -]?)*)$", 1), m, F.regexp_extract(after, "^((?:[ -]?[0-9])*)", 1))
            ok = ok & ((run == m) | ~form.passes(run))
        made = lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(form.kind)).alias("kind"), (s["start"] + F.char_length(m)).alias("end"), F.lit(form.base).alias("base"), s["ok"].alias("ok"),
            F.array(*_votes(form, s["m"], s["ok"], s["b"], s["a"]).values(), *_shape(form, s["m"], s["b"], s["a"])).cast("array<tinyint>").alias("x"),
        )
        return _let(F.struct(start.alias("start"), ok.alias("ok"), short.alias("m"), before.alias("b"), after.alias("a")), made)

    def of(p: Column) -> Column:
        lengths = F.flatten(F.zip_with(p["b"], p["m"], lambda b, m: F.array(F.char_length(b), F.coalesce(F.char_length(m), F.lit(0)))))
        placed = F.struct(p["b"].alias("b"), p["m"].alias("m"), _sums_before(lengths).alias("at"))
        return _let(placed, lambda q: F.transform(q["m"], lambda m, i: span(q, m, i)))

    parts = F.struct(F.split(text, form.pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(form.pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(form.sign), _let(parts, of).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all ``spans`` of all forms, in order of start and kind; a base span is there once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.flatten(F.array(*[_spans(F.col("_t"), f) for f in FORMS]))
    return docs.select("doc_id", text.alias("_t")).select("doc_id", F.sort_array(found).alias("spans"))


def reliabilities(votes: list[tuple[tuple[int, ...], int]]) -> tuple[float, dict[tuple[int, ...], float], list[list[dict[int, float]]]]:
    """Expectation-maximisation over counted vote patterns: the share of true spans, how likely each pattern is a true
    one, and how often each labeler votes 1, 0, -1 on false and on true spans.

    Labelers are independent given the truth. The prior (LABELERS) keeps the two classes from changing places."""
    share = 0.5
    prior = [[{1: r * (1 - a), 0: 1 - r, -1: r * a}, {1: r * a, 0: 1 - r, -1: r * (1 - a)}] for a, r in LABELERS.values()]
    rates, true = prior, {}
    for _ in range(STEPS):
        for pattern, _n in votes:
            odds = log(share / (1 - share)) + sum(log(rates[j][1][v] / rates[j][0][v]) for j, v in enumerate(pattern))
            true[pattern] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        mass = [sum(n * (1 - true[p]) for p, n in votes), sum(n * true[p] for p, n in votes)]
        share = (mass[1] + PRIOR_VOTES / 2) / (sum(mass) + PRIOR_VOTES)
        rates = [
            [{v: (PRIOR_VOTES * prior[j][y][v] + sum(n * (true[p] if y else 1 - true[p]) for p, n in votes if p[j] == v)) / (PRIOR_VOTES + mass[y]) for v in (1, 0, -1)} for y in (0, 1)]
            for j in range(len(LABELERS))
        ]
    return share, true, rates


def _features(kind: Column, x: Column) -> list[Column]:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    votes = [one(F.get(x, F.lit(j)) == v) for j in range(len(LABELERS)) for v in (1, -1)]
    return [*[one(kind == k) for k in range(len(KINDS))], *votes, *[F.get(x, F.lit(len(LABELERS) + j)).cast("double") for j in range(SHAPES)]]


@dataclass(frozen=True)
class Model:
    """A linear span classifier; positive is personal data."""

    weights: tuple[float, ...]
    constant: float

    def odds(self, kind: Column, x: Column) -> Column:
        return sum((w * f for w, f in zip(self.weights, _features(kind, x), strict=True)), F.lit(self.constant))


def train(found: DataFrame) -> Model | None:
    """The span classifier, fitted to what the labelers agree on; None without any span. ``found`` is saved
    ``candidates``; what reaches the driver are counts of vote patterns, 3 ** 7 of each kind at most."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.x").agg(F.count("*").alias("n"))
    rows = saved(rows)
    votes = F.slice("x", 1, len(LABELERS))
    counts = rows.groupBy("kind", votes.alias("v")).agg(F.sum("n").alias("n")).orderBy("kind", "v").collect()
    if not counts:
        return None
    soft = []
    for kind in sorted({r["kind"] for r in counts}):
        _, true, _ = reliabilities([(tuple(r["v"]), r["n"]) for r in counts if r["kind"] == kind])
        soft += [(kind, list(p), y) for p, y in true.items()]
    soft = rows.sparkSession.createDataFrame(soft, "_kind int, _v array<tinyint>, p double")
    rows = rows.join(F.broadcast(soft), (F.col("kind") == F.col("_kind")) & (votes == F.col("_v")))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("p")).alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("p"))).alias("w"))))
    ready = rows.select(array_to_vector(F.array(*_features(F.col("kind"), F.col("x")))).alias("features"), both.alias("_b")).select("features", "_b.y", "_b.w")
    fit = LogisticRegression(labelCol="y", weightCol="w", maxIter=60, regParam=0.0001, standardization=False).fit(saved(ready))
    return Model(tuple(float(v) for v in fit.coefficients), float(fit.intercept))


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every text: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` (arrays of ``start, kind,
    end``, code points, end exclusive, by start and kind; ``kind`` is a place in KINDS).

    Candidates are matches of eleven forms, the four base patterns among them. Labelers vote on each: the strict form,
    a checksum or range, gazetteers (ends of domains, issuers, calling codes), words before it for and against, what it
    borders on, and how varied it is. Expectation-maximisation estimates from all candidates of the corpus how reliable
    each labeler is for each kind, and a linear classifier over votes and shape is trained on what they then say. A
    base span that passes its check always counts; another candidate does if it passes and the classifier says yes.
    Spans of different kinds may overlap, as base ones do.

    Each text is read once, in place: candidates with votes, a few bytes each, are written once and then read for
    training and for the result. Only counts are shuffled. Null texts are empty; rows that repeat stay apart; an empty
    table gives an empty result; extra columns aren't read.
    """
    found = saved(candidates(docs))
    model = train(found)
    good = lambda s: s["ok"] & (s["base"] if model is None else (s["base"] | (model.odds(s["kind"], s["x"]) >= 0)))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["base"] & s["ok"]), bare)
    rows = found.select("doc_id", base.alias("base"), F.array_distinct(F.transform(F.filter("spans", good), bare)).alias("spans"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[n(k) for k in KINDS[:4]], "base", "spans")


def _joined(spans: str) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


#: No SQL: the method's spans aren't expressible. Base spans are tested against plain Python.
QUERIES = {"op11_personal_data": op11_personal_data}
