"""Personal data and secrets by weak supervision, in DataFrame functions only.

Base spans are the strict patterns' matches that pass their tests (email; ip with parts up to 255;
card with 14 to 19 digits and a valid Luhn sum; phone with 10 to 15 digits). Looser candidates are
spelled-out emails, phones without a country code, card-like numbers that fail, and secrets: values given to names such as
token or password, and long runs of hexadecimal digits. Five labelers
vote on every candidate: pattern, checksum (for secrets: a mix of characters), gazetteer, context and shape. The votes of the
whole table are counted by pattern
of votes (a table of bounded size), expectation-maximisation estimates each kind's prior and reliabilities from
those counts, with base spans as known cases, and a logistic span classifier is trained on the posteriors. It sees more than the votes: sizes, the variety of
characters and the share of digits, and weighs all of it for each kind by itself. Base spans always stay;
a looser candidate stays when the classifier gives it ``threshold`` or more.

Null and empty texts have no spans; repeated rows are judged each alone; offsets are code points; ids are only handed on.
The patterns are written so that Java matches them in linear time without deep recursion, whatever
the text: see ``_tamed_dots`` and ``_tamed_gaps``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import stash

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with base spans.
BASE_KINDS = KINDS[:4]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]{1,64}(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z]{2,24}(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
_NAME = r"(?i:token|secret|passw(?:or)?d|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key)s?"
_GIVEN = rf"{_NAME}[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?"
SECRET = rf"(?<=[=:\x20\"'])(?<={_GIVEN})[A-Za-z0-9+/_.=-]{{8,200}}|(?<![A-Za-z0-9])[0-9a-f]{{32,128}}(?![A-Za-z0-9])"

#: Gazetteers and context words of the labelers (values of our choice).
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us")
CONTEXT = r"(?i)\b(?:mail|e-?mail|contact|write|call|phone|tel|telephone|mobile|fax|card|visa|mastercard|iban|account|address|ip|from|reach|correo|telef|kontakt|courriel)\b"
AGAINST = r"(?i)\b(?:order|invoice|isbn|version|serial|part|ticket|page|build|release|example)\b"

SECRET_CONTEXT = r"(?i)\b(?:auth|authorization|login|bearer|config|export|env|private|credentials?|session|client)\b"
SECRET_AGAINST = r"(?i)\b(?:commit|sha-?[0-9]*|md5|hash|digest|checksum|etag|revision|blob|tree|build|example)\b\W{0,4}$"

_SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tamed_dots(text: Column) -> Column:
    """Dots that cannot stand inside a host name become underscores, which the local part may hold too."""
    return F.regexp_replace(text, rf"(?<![{LABEL}])\.|\.(?![{LABEL}])", "_")


def _tamed_gaps(text: Column) -> Column:
    """Spaces and hyphens that do not stand between two digits become underscores."""
    return F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_")


def _found(text: Column, pattern: str, original: Column | None = None) -> Column:
    """All matches with their code points; texts between matches give the offsets."""
    bound = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"), (text if original is None else original).alias("t"))

    def located(s: Column) -> Column:
        zipped = F.arrays_zip(s["m"].alias("m"), F.slice(s["g"], F.lit(1), F.size(s["m"])).alias("g"))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["g"])
            b = a + F.length(x["m"])
            span = F.struct(a.alias("start"), b.alias("end"), F.substring(s["t"], a + 1, F.length(x["m"])).alias("match"), F.substring(s["t"], F.greatest(a - 39, F.lit(1)), F.least(a, F.lit(40))).alias("before"), F.substring(s["t"], b + 1, F.lit(20)).alias("after"))
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(zipped, start, step)["out"]

    return let(bound, located)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ten divides."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.substring(q, 1, 3).cast("int") <= 255)))
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(14, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, loose: bool) -> Callable[[Column], Column]:
    """A found span with its labelers' votes and the classifier's features."""

    def made(s: Column) -> Column:
        match, d = s["match"], digits(s["match"])
        number = F.lit(kind in ("card", "phone"))
        valid = F.lit(False) if loose and kind != "card" else _valid(kind, match)
        glued = s["before"].rlike(r"[\p{L}0-9]$") | s["after"].rlike(r"^[\p{L}0-9]")
        beside = F.concat(s["before"], F.lit(" "), s["after"])
        variety = F.size(F.array_distinct(F.split(match, "")))
        pattern = F.when(F.lit(loose), 0).otherwise(F.when(valid, 1).otherwise(-1))
        context = _vote(beside.rlike(CONTEXT), s["before"].rlike(AGAINST))
        checksum = _vote(valid, ~valid) if kind in ("card", "ip") else F.lit(0)
        shape = _vote(~glued & F.length(match).between(7, 64), glued | (number & d.rlike(r"^([0-9])\1*$")))
        if kind == "email":
            tld = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)\W*$", 1))
            gazetteer = _vote(tld.isin(*TOP_LEVEL), F.length(tld) < 2)
            if loose:
                pattern = _vote(match.rlike(r"[\[(]|[0-9_.%+-]|\x20at\x20[a-z0-9-]+\x20dot\x20"), F.lit(False))
        elif kind == "ip":
            gazetteer = _vote(F.lit(False), match.rlike(r"^(?:0|10|127|255|192\.168)\."))
        elif kind == "card":
            gazetteer = _vote(d.rlike(r"^(?:4|5[1-5]|3[47]|35|6011|65)"), ~d.rlike(r"^[3-6]"))
        elif kind == "phone":
            gazetteer = _vote(match.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[0-9]|9[0-9])"), d.rlike("^0{3}"))
            if loose:
                gazetteer = _vote(d.rlike("^[2-9][0-9]{2}[2-9]"), d.rlike("^[01]"))
        else:
            given = s["before"].rlike(rf"{_GIVEN}$")
            pattern = _vote(given, ~given)
            gazetteer = _vote(s["before"].rlike(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)"), s["before"].rlike(SECRET_AGAINST))
            context = _vote(beside.rlike(SECRET_CONTEXT), s["before"].rlike(SECRET_AGAINST))
            checksum = _vote((variety >= 8) & match.rlike("[0-9]") & match.rlike("[A-Za-z]"), ~match.rlike("[0-9]"))
            shape = _vote(F.length(match).between(16, 128), F.length(match) < 10)
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), (F.lit(False) if loose else valid).alias("base"),
            pattern.alias("pattern"), checksum.alias("checksum"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"),
            F.least(F.length(match) / 8, F.lit(4)).cast("int").alias("size"), F.least(variety / 5, F.lit(3)).cast("int").alias("variety"), (F.length(d) * 3 / F.length(match)).cast("int").alias("digits"),
        )

    return made


def candidates(text: Column) -> Column:
    """All candidate spans of a text, in order of start and kind; loose ones that overlap a base span are left out."""
    t = F.coalesce(text, F.lit(""))
    none = F.expr(f"cast(array() as {_SPANS})")
    at, plus = F.contains(t, F.lit("@")), F.contains(t, F.lit("+"))
    strict = {
        "email": F.when(at, _found(_tamed_dots(t), EMAIL, t)).otherwise(none),
        "ip": F.when(t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _found(t, IP)).otherwise(none),
        "card": F.when(t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _found(_tamed_gaps(t), CARD, t)).otherwise(none),
        "phone": F.when(plus, _found(t, PHONE)).otherwise(none),
    }
    loose = {
        "email": F.when(t.rlike(r"(?:\x20|[\[(])dot(?:\x20|[\])])"), _found(t, SPELLED_EMAIL)).otherwise(none),
        "phone": F.when(t.rlike(r"[0-9][\x20.-][0-9]{4}(?![0-9])"), _found(t, LOCAL_PHONE)).otherwise(none),
        "secret": F.when(t.rlike(rf"{_GIVEN}[A-Za-z0-9+/_.=-]|[0-9a-f]{{32}}"), _found(t, SECRET)).otherwise(none),
    }
    sure = F.concat(*(F.transform(v, _candidate(k, False)) for k, v in strict.items()))
    sure = F.filter(sure, lambda c: c["base"] | ((c["kind"] == KINDS.index("card")) & (c["size"] >= 1)))
    more = F.concat(*(F.transform(v, _candidate(k, True)) for k, v in loose.items()))

    def joined(s: Column) -> Column:
        free = F.filter(s["more"], lambda c: ~F.exists(s["sure"], lambda b: b["base"] & (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.array_sort(F.concat(s["sure"], free))

    return let(F.struct(sure.alias("sure"), more.alias("more")), joined)


VOTES = ("pattern", "checksum", "gazetteer", "context", "shape")


def reliabilities(counts: list[tuple[tuple, float]], known: list[bool] | None = None, rounds: int = 60) -> tuple[float, list, list[float]]:
    """Prior, each labeler's vote probabilities by class, and each pattern's posterior, from counts of patterns of votes; ``known`` ones are cases for sure."""
    known = known or [False] * len(counts)
    sure = 0.999
    posterior = [sure if k else min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for (v, _), k in zip(counts, known, strict=True)]
    prior, table = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        one = sum(n * p for (_, n), p in zip(counts, posterior, strict=True))
        prior = (one + 1) / (total + 2)
        table = []
        for k in range(len(VOTES)):
            by = {(c, v): 1.0 for c in (0, 1) for v in (-1, 0, 1)}
            for (votes, n), p in zip(counts, posterior, strict=True):
                by[1, votes[k]] += n * p
                by[0, votes[k]] += n * (1 - p)
            table.append({(c, v): x / sum(by[c, u] for u in (-1, 0, 1)) for (c, v), x in by.items()})
        new = []
        for (votes, _), k in zip(counts, known, strict=True):
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][1, v] / table[k][0, v]) for k, v in enumerate(votes))
            new.append(sure if k else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, posterior, strict=True)), default=0)
        posterior = new
        if moved < 1e-6:
            break
    return prior, table, posterior


#: What the classifier sees beside a span's kind: (field, values).
SEEN = (("base", (1,)), ("size", (0, 1, 2, 3, 4)), ("variety", (0, 1, 2, 3)), ("digits", (0, 1, 2, 3)))


def kind_posteriors(rows: list[tuple[int, bool, tuple, float]]) -> list[float]:
    """The posterior of each row (kind, base, votes, count): reliabilities are estimated for each kind; base spans are known cases."""
    out = [0.0] * len(rows)
    for kind in {r[0] for r in rows}:
        own = [k for k, r in enumerate(rows) if r[0] == kind]
        _, _, posterior = reliabilities([(rows[k][2], rows[k][3]) for k in own], [rows[k][1] for k in own])
        for k, p in zip(own, posterior, strict=True):
            out[k] = p
    return out


def _features(kind: int, fields: dict, votes: tuple) -> list[float]:
    own = [1.0, *(float(fields[f] == v) for f, values in SEEN for v in values), *map(float, votes)]
    return [x * (kind == k) for k in range(len(KINDS)) for x in own]


def fit_classifier(rows: list[tuple[list[float], float, float]], steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Weights of a logistic model of soft labels; rows (patterns of votes and features, on the driver): features, label, weight."""
    if not rows:
        return []
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * n
        w -= rate * (x.T @ error + l2 * w)
    return w.tolist()


def _kept(docs: DataFrame, id: str, text: str, threshold: float, *more: Column) -> DataFrame:
    """id, ``spans`` and ``more`` of every row."""
    found = stash(docs.select(F.col(id).alias("id"), candidates(F.col(text)).alias("c"), *more))
    fields = [f for f, _ in SEEN]
    seen = found.select(F.explode("c").alias("c")).groupBy(*(F.col(f"c.{k}").alias(k) for k in ("kind", *fields, *VOTES))).count().orderBy("kind", *fields, *VOTES).collect()
    rows = [(r["kind"], r["base"], tuple(r[v] for v in VOTES), float(r["count"])) for r in seen]
    whole = {kind: sum(n for k, *_, n in rows if k == kind) for kind, *_ in rows}  # a rare kind is learned like a frequent one
    w = fit_classifier([(_features(kind, r.asDict(), votes), p, n / whole[kind]) for r, (kind, _, votes, n), p in zip(seen, rows, kind_posteriors(rows), strict=True)])
    own = len(w) // len(KINDS)

    def score(c: Column) -> Column:
        if not w:
            return F.lit(0.0)
        x = [F.lit(1.0), *((c[f].cast("int") == v).cast("double") for f, values in SEEN for v in values), *(c[v].cast("double") for v in VOTES)]
        weights = F.array(*(F.array(*map(F.lit, w[k * own : k * own + own])) for k in range(len(KINDS))))
        return let(F.element_at(weights, c["kind"] + 1), lambda a: 1 / (1 + F.exp(-sum((a[k] * v for k, v in enumerate(x)), F.lit(0.0)))))

    named = F.array(*map(F.lit, KINDS))
    scored = F.transform("c", lambda c: F.struct(F.element_at(named, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score(c).alias("score")))
    return found.select(F.col("id").alias(id), F.filter(scored, lambda c: c["base"] | (c["score"] >= threshold)).alias("spans"), *found.columns[2:])


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, structs of kind, start, end, base and score, in order."""
    return _kept(docs, id, text, threshold)


def mask_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id`` and the text with each span that ``find_pii`` keeps replaced by its kind in brackets; of overlapping spans the first wins."""
    found = _kept(docs, id, text, threshold, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def masked(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, c: F.when(c["start"] < acc["at"], acc).otherwise(F.struct(c["end"].alias("at"), F.concat(acc["out"], F.substring(s["t"], acc["at"] + 1, c["start"] - acc["at"]), F.lit("["), c["kind"], F.lit("]")).alias("out")))
        return F.aggregate(s["c"], start, step, lambda acc: F.concat(acc["out"], F.substring(s["t"], acc["at"] + 1, F.length(s["t"]))))

    return found.select(F.col(id), let(F.struct(F.col("spans").alias("c"), F.col("_text").alias("t")), masked).alias(text))


def pii_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns: counts of base spans by kind, their digest, and all spans as text; n_spans counts these."""
    line = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])
    count = lambda kind: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long")
    return find_pii(docs, id, text).select(F.col(id), *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
