"""Personal data: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides.

DataFrame and SQL functions only. Base spans (email, ip, card, phone; see `PATTERNS`) are found in every whole text:
leftmost, non-overlapping per kind, failing matches dropped without a retry. They always stay. Looser patterns give
candidates besides (`LOOSE`: bracketed or spaced e-mail addresses, phone numbers without a country code, card numbers
with other separators, IPv6 addresses); one that touches a base span is no candidate.

Labelers (0: no vote, 1: no personal data, 2: personal data) vote on base spans and candidates alike: the strict regex, a
gazetteer (top-level domains, issuer digits, address blocks), words before the span, a checksum or digit count,
and the characters next to the span. Spans are counted by kind and votes (at most 4 x 2 x 3^4 x 4 rows, whatever
the corpus). Expectation-maximisation over these counts estimates each labeler's reliability per kind; the
posteriors train a logistic classifier over votes and length, whose weights become a column expression. Candidates that it gives
`CUT` or more are added.

The patterns take each character once: a run is entered at its first character or where the last match ended, and
left as a whole (possessively), which finds what the plain patterns find in time proportional to the text. Positions are
running sums over the lengths of matches and of what lies between them, taken in blocks of the root of their number; a span's
surroundings come from its neighbours, never from the text's start; candidates meet base spans in one sorted
list. A text of n matches takes time with n to the power 1.5 at most, of which the part above n is copying.

Null and empty texts have no spans; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from planquant.functions.arrays import let, running
from planquant.llm.common import compact, parts_for, shared_table

KINDS = ("email", "ip", "card", "phone")
CUT = 0.9

#: The contract's patterns, entered and left as described above.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without this has no match; checked before a pattern is tried.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_LOOSE_HINT = {"email": r"(?i)[(\[{]at[)\]}]|@\x20|\x20@", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][._/][0-9]{4}[._/]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

#: A part of an address: zeros in front don't count, and zeros alone are a part as well.
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
_TLD = r"(?i)(?:\.|[)\]}]\x20?)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|ch|at|it|nl|be)$"
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|correo|courriel|kontakt|write to|address)[^\n]{0,20}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|ping|addr|adresse)[^\n]{0,20}$",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta|account|payment)[^\n]{0,20}$",
    "phone": r"(?i)(?:call|phone|tel|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|contact)[^\n]{0,20}$",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(s, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    n = F.length(_digits(s))
    return n.between(12, 19) & _luhn(_digits(s)) if kind == "card" else n.between(9, 15)


_SPAN = "struct<start:int,kind:int,end:int,strict:boolean,body:string,before:string,after:string>"


def _found(text: Column, kind: str, pattern: str, hint: str, strict: bool) -> Column:
    """(start, kind, end, strict, body, 40 characters before, 1 after) of every match: matches are aligned with what lies between them."""

    def placed(m: Column, g: Column, at: Column) -> Column:
        return F.transform(
            m,
            lambda x, i: F.struct(
                (F.get(at, i) + F.length(F.get(g, i))).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(at, i + 1).alias("end"), F.lit(strict).alias("strict"), x.alias("body"),
                F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(g, i)), F.lit(40)).alias("before"), F.left(F.concat(F.get(g, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(1)).alias("after"),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, F.lit(pattern), -1).alias("g"))
    lengths = lambda m, g: F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i)))
    spans = let(both, lambda b: let(let(lengths(b["m"], b["g"]), lambda n: running(n, 0, lambda s, x: s + x)), lambda at: placed(b["m"], b["g"], at))).cast(f"array<{_SPAN}>")
    if strict:
        spans = F.filter(spans, lambda x: _passes(kind, x["body"]))
    possible = F.contains(text, F.lit("@")) if hint == "@" else F.regexp_like(text, F.lit(hint))
    return F.when(possible, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(loose: Column, base: Column) -> Column:
    """The candidates that touch no base span."""
    most = 2**31 - 1

    def merged(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x["strict"], x["end"]).otherwise(0))
        begins = F.reverse(F.transform(every, lambda x: F.when(x["strict"], x["start"]).otherwise(most)))
        before = let(ends, lambda a: running(a, 0, lambda p, q: F.greatest(p, q)))
        after = let(begins, lambda a: running(a, most, lambda p, q: F.least(p, q)))
        return let(F.struct(before.alias("e"), after.alias("b")), lambda r: F.filter(every, lambda x, i: ~x["strict"] & (F.get(r["e"], i) <= x["start"]) & (F.get(r["b"], F.size(every) - i) >= x["end"])))

    direct = F.filter(loose, lambda x: ~F.exists(base, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).when(F.size(loose).cast("long") * F.size(base) <= 1024, direct).otherwise(let(F.array_sort(F.concat(base, loose)), merged))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 1).otherwise(0)


def _features(x: Column) -> Column:
    """The span with its votes: v0 gazetteer, v1 words before, v2 checksum or count, v3 neighbours; size: a bucket of its length."""
    before = x["before"]
    left, right = F.right(before, F.lit(1)), x["after"]
    body, digits = x["body"], _digits(x["body"])
    is_kind = lambda k: x["kind"] == KINDS.index(k)
    rlike = lambda s, p: F.regexp_like(s, F.lit(p))
    gazetteer = (
        F.when(is_kind("email"), _vote(rlike(body, _TLD), F.lit(False)))
        .when(is_kind("ip"), _vote(rlike(body, r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:|^fe80:"), rlike(body, r"^0")))
        .when(is_kind("card"), _vote(rlike(digits, r"^(?:4|5[1-5]|3[47]|6(?:011|5)|35)"), rlike(digits, r"^0")))
        .otherwise(_vote(rlike(body, r"^(?:\+[1-9]|\([2-9]|[2-9])"), rlike(digits, r"^0{3}")))
    )
    words = F.lit(0)
    for k, p in _CONTEXT.items():
        words = F.when(is_kind(k), _vote(rlike(before, p), F.lit(False))).otherwise(words)
    size = F.length(digits)
    check = (
        F.when(is_kind("email"), _vote(F.length(body).between(6, 80), F.length(body) > 120))
        .when(is_kind("ip"), _vote(F.length(body) <= 39, F.lit(False)))
        .when(is_kind("card"), _vote(size.between(12, 19) & _luhn(digits), F.lit(True)))
        .otherwise(_vote(size.between(9, 15), F.lit(True)))
    )
    near = _vote(rlike(left, r"^[\s(:<\[\"']?$") & rlike(right, r"^[\s),.;:>\]\"']?$"), rlike(left, r"[0-9A-Za-z_/=.]") | rlike(right, r"[0-9A-Za-z_/=]"))
    return F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["strict"].alias("strict"),
        gazetteer.alias("v0"), words.alias("v1"), check.alias("v2"), near.alias("v3"), F.least(F.floor(F.length(body) / 10), F.lit(3)).cast("int").alias("size"),
    )


def labelled_spans(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """The columns to keep, and spans: base spans and candidates with their votes, by start, kind and end."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    given = docs.select(*keep, F.col(text_col).alias("_text"))
    base = F.concat(*[_found(text, k, PATTERNS[k], _HINT[k], True) for k in KINDS])
    loose = F.concat(*[_found(text, k, LOOSE[k], _LOOSE_HINT[k], False) for k in KINDS])
    found = given.select(*keep, base.alias("_base"), loose.alias("_loose"))
    every = F.array_sort(F.concat("_base", _apart(F.col("_loose"), F.col("_base"))))
    return found.select(*keep, F.transform(every, _features).alias("spans"))


_VOTERS = ("strict", "v0", "v1", "v2", "v3")


def _votes(r: Row) -> tuple[int, ...]:
    return (2 if r["strict"] else 0, r["v0"], r["v1"], r["v2"], r["v3"])


def reliabilities(rows: list[Row], rounds: int = 100, prior: float = 1.0) -> dict:
    """kind -> (share of personal data, vote probabilities [class][labeler][vote]) by expectation-maximisation."""
    out = {}
    for kind in {r["kind"] for r in rows}:
        own = [(_votes(r), r["n"]) for r in rows if r["kind"] == kind]
        q = [(v.count(2) + 1) / (v.count(2) + v.count(1) + 2) for v, _ in own]
        for _ in range(rounds):
            total = sum(n for _, n in own)
            share = (sum(n * p for (_, n), p in zip(own, q, strict=True)) + prior) / (total + 2 * prior)
            table = []
            for c in (0, 1):
                table.append([])
                for k in range(len(_VOTERS)):
                    n = [prior, prior * (2 - c), prior * (1 + c)]
                    for (v, w), p in zip(own, q, strict=True):
                        n[v[k]] += w * (p if c else 1 - p)
                    table[c].append([x / sum(n) for x in n])
            new = [posterior((share, table), v) for v, _ in own]
            near = max(abs(a - b) for a, b in zip(new, q, strict=True)) < 1e-9
            q = new
            if near:
                break
        out[kind] = (share, table)
    return out


def posterior(model: tuple, v: tuple[int, ...]) -> float:
    share, table = model
    a, b = (math.log(s) + sum(math.log(table[c][k][x]) for k, x in enumerate(v)) for c, s in ((0, 1 - share), (1, share)))
    return 1 / (1 + math.exp(max(-700, min(700, a - b))))


def train(rows: list[Row], models: dict, epochs: int = 300, rate: float = 0.5) -> dict:
    """(kind, feature, value) -> weight, and (kind,) -> bias: logistic regression on the posteriors.

    What the strict regex says is no feature: the classifier is for spans that it doesn't know."""
    w: dict = {}
    total = {k: sum(r["n"] for r in rows if r["kind"] == k) for k in models}
    for _ in range(epochs):
        step: dict = {}
        for r in rows:
            k = r["kind"]
            keys = [(k,), *((k, f, r[f]) for f in (*_VOTERS[1:], "size"))]
            z = max(-60.0, min(60.0, sum(w.get(x, 0.0) for x in keys)))
            miss = (1 / (1 + math.exp(-z)) - posterior(models[k], _votes(r))) * r["n"] / total[k]
            for x in keys:
                step[x] = step.get(x, 0.0) + miss
        for x, g in step.items():
            w[x] = w.get(x, 0.0) - rate * g - rate * 1e-4 * w.get(x, 0.0)
    return w


def learn(spans: DataFrame) -> dict:
    """The classifier's weights, from all spans of a table of labelled spans."""
    flat = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.strict", "s.v0", "s.v1", "s.v2", "s.v3", "s.size")
    rows = flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n")).collect()
    return train(rows, reliabilities(rows)) if rows else {}


def _score(x: Column, weights: dict) -> Column:
    z = F.lit(0.0)
    for k in sorted({key[0] for key in weights}):
        own = F.lit(float(weights[(k,)]))
        for f in (*_VOTERS[1:], "size"):
            part = F.lit(0.0)
            for key, w in sorted((key, w) for key, w in weights.items() if key[0] == k and key[1:2] == (f,)):
                part = F.when(x[f] == key[2], float(w)).otherwise(part)
            own = own + part
        z = F.when(x["kind"] == k, own).otherwise(z)
    return 1 / (1 + F.exp(-z)) if weights else F.lit(0.0)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id and spans (kind, start, end, base, score) of every row, by start, then kind, then end."""
    # Found once: the labelled spans, which are few beside the texts, are learned from and then judged.
    found = shared_table(labelled_spans(compact(docs, parts_for(docs)), text_col, id_col), "spans")
    weights = learn(found)
    names = F.array(*[F.lit(k) for k in KINDS])
    scored = F.transform("spans", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["strict"].alias("base"), _score(x, weights).alias("score")))
    return found.select(F.col(id_col).alias("doc_id"), F.filter(scored, lambda x: x["base"] | (x["score"] >= cut)).alias("spans"))
