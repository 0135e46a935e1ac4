"""Operator 8, personal data by weak supervision (DataFrame and SQL functions only).

Base spans come from exact patterns and always stay.  Wider patterns propose more candidates; four labelers vote on each
candidate (1, -1, or 0 for no opinion): the exact pattern (1 where its rule holds, -1 where a match fails the rule; of
wider matches only cards have one, the checksum), a gazetteer, the words before it, and its edges.  The votes
are counted by pattern of votes (at most 4 kinds * 3**4 rows, whatever the corpus), expectation-maximisation over these
counts estimates how reliable each labeler is per kind and how likely each pattern is to be personal data, and a
logistic span classifier is fitted to those soft labels over votes and digit count.  Its weights become literals of a
SQL expression that judges every candidate; accepted ones are added.  Wider patterns see base spans of their kind
blanked out, so an added span touches none.

Positions are code points, end exclusive.  Edge cases: a null text counts as empty; empty texts have no spans, and the
digest of the empty string; every row gives a row, repeated and null doc_ids too; equal starts are ordered by kind; a
span found twice is listed once; with no candidates at all the classifier keeps its prior and adds nothing; texts are
read whole, the work grows in proportion to a text's length and its matches, however many (``_placed``); columns of docs
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

KINDS = ("email", "ip", "card", "phone")
_EMAIL = "[A-Za-z0-9._%+-]"
# The contract's patterns, with possessive quantifiers where nothing is ever given back, so that long runs of letters or
# digits take linear time and constant stack; a run of e-mail characters is tried from its start only.
BASE = {
    "email": rf"(?:(?<!{_EMAIL})|\G){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_EMAIL}){_EMAIL}++\s{{0,3}}(?:\[at\]|\(at\)|@)\s{{0,3}}[A-Za-z0-9-]++(?:\s{{0,3}}(?:\[dot\]|\(dot\)|\.)\s{{0,3}}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\)\s?|dot\]\s?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5))",
    "phone": r"^\+(?:1|33|34|44|49|41|43|39|31)|^\(?[2-9][0-9]{2}",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|correo|courriel|kontakt)[^\n]{0,20}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|login|adresse)[^\n]{0,20}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|pay|karte|carte|tarjeta)[^\n]{0,20}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|llame|appel)[^\n]{0,20}$",
}
LABELERS = ("pattern", "gazetteer", "context", "edges")
#: How labelers vote on personal data and on other candidates, believed beforehand: the pattern, and the other three.
BELIEF = ({1: 0.9, 0: 0.09, -1: 0.01}, {1: 0.05, 0: 0.15, -1: 0.8}), ({1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.2, 0: 0.3, -1: 0.5})
#: Weight of these beliefs, of each labeler, as a share of a class's rows.
WEIGHT = (0.5, 0.1, 0.1, 0.1)
LEFT = 40
CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut_up(text: Column, pattern: str, more) -> Column:
    """struct<rows, rest>: for each match struct<gap (text before it), match, next (the character behind it), ...more(match)>, and the text behind the last one."""

    def laid(p):
        pieces, hits = p["pieces"], p["hits"]

        def row(h, i):
            # the character behind a match begins the next gap, or the next match where that gap is empty
            nxt = F.substring(F.concat(F.substring(F.get(pieces, i + 1), 1, 1), F.substring(F.coalesce(F.get(hits, i + 1), F.lit("")), 1, 1)), 1, 1)
            return F.struct(F.get(pieces, i).alias("gap"), h.alias("match"), nxt.alias("next"), *more(h))

        return F.struct(F.transform(hits, row).alias("rows"), F.get(pieces, F.size(hits)).alias("rest"))

    return _let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), laid)


_FOUND = "array<struct<start:int,end:int,match:string,left:string,next:string,base:boolean>>"


def _tail(s: Column) -> Column:
    return F.substring(s, -LEFT, LEFT)


def _placed(z: Column) -> Column:
    """Of rows struct<gap, match, next, base, use> those to use, as array<struct<start, end, match, left, next, base>>.

    Positions are running sums: folds over chunks of ``CHUNK`` rows and one over the chunks, so that appending to an
    array costs a bounded number of copies a row however many matches a text has.
    """

    def folded(c):
        # every row is a character long at least, so LEFT rows hold the left context of a chunk's first one
        before = F.transform(F.slice(z, F.greatest(c * CHUNK - LEFT + 1, F.lit(1)), F.least(c * CHUNK, F.lit(LEFT))), lambda x: F.concat(x["gap"], x["match"]))

        def step(a, x):
            def with_left(left):
                start = a["pos"] + F.length(x["gap"])
                end = start + F.length(x["match"])
                one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), left.alias("left"), x["next"].alias("next"), x["base"].alias("base"))
                return F.struct(end.alias("pos"), _tail(F.concat(left, x["match"])).alias("tail"), F.when(x["use"], F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

            return _let(_tail(F.concat(a["tail"], x["gap"])), with_left)

        return F.aggregate(F.slice(z, c * CHUNK + 1, CHUNK), F.struct(F.lit(0).alias("pos"), _tail(F.array_join(before, "")).alias("tail"), F.array().cast(_FOUND).alias("out")), step)

    def moved(a, x):
        shifted = F.transform(x["out"], lambda s: s.withField("start", s["start"] + a["pos"]).withField("end", s["end"] + a["pos"]))
        return F.struct((a["pos"] + x["pos"]).alias("pos"), F.concat(a["out"], F.array(shifted)).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), folded)
    whole = F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_FOUND}>").alias("out")), moved, lambda a: F.flatten(a["out"]))
    return F.when(F.size(z) > 0, whole).otherwise(F.array().cast(_FOUND))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Of a string of digits: is its Luhn sum divisible by ten?"""
    n = F.length(d)

    def step(a, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _octet(p: Column) -> Column:
    bare = F.regexp_replace(p, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _holds(kind: str, m: Column) -> Column:
    """The base rule's test of a base match."""
    d = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)


def _plausible(kind: str, m: Column) -> Column:
    """Is a match worth a vote?  Numbers of other lengths are neither cards nor telephone numbers, whatever stands beside them."""
    if kind == "card":
        return F.when(F.length(m) >= 12, F.length(_digits(m)).between(12, 19)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(7, 15)
    return F.lit(True)


def _judged(text: Column, kind: str) -> Column:
    """Candidates of a kind: struct<start, end, kind, base, pattern, gazetteer, context, edges, digits>."""

    def row(s, shaped):
        m = s["match"]
        # the checksum has its say on wider matches of cards too
        pattern = _vote(s["base"]) if shaped else _vote(_luhn(_digits(m))) if kind == "card" else F.lit(0)
        clean = ~s["left"].rlike(r"[\p{L}\p{N}]$") & ~s["next"].rlike(r"^[\p{L}\p{N}]")
        context = s["left"].rlike(CONTEXT[kind])
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), s["base"].alias("base"),
            pattern.alias("pattern"), _vote(m.rlike(GAZETTEER[kind])).alias("gazetteer"), _vote(context, F.lit(False)).alias("context"),
            _vote(clean).alias("edges"), F.least(F.length(_digits(m)), F.lit(20)).alias("digits"),
        )

    def both(exact):
        # Base spans are blanked out, so that no wide match touches one.
        blank = F.transform(exact["rows"], lambda x: F.concat(x["gap"], F.when(x["base"], F.repeat(F.lit("\0"), F.length(x["match"]))).otherwise(x["match"])))
        masked = F.when(F.size(exact["rows"]) > 0, F.concat(F.array_join(blank, ""), exact["rest"])).otherwise(exact["rest"])
        wide = _cut_up(masked, WIDE[kind], lambda h: [F.lit(False).alias("base"), F.lit(True).alias("use")])["rows"]
        return F.concat(F.transform(_let(exact["rows"], _placed), lambda s: row(s, True)), F.transform(_let(wide, _placed), lambda s: row(s, False)))

    return _let(_cut_up(text, BASE[kind], lambda h: [_holds(kind, h).alias("base"), _plausible(kind, h).alias("use")]), both)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found: every candidate of every kind; one pass over the whole texts."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = F.array().cast(
        "array<struct<start:int,end:int,kind:int,base:boolean,pattern:int,gazetteer:int,context:int,edges:int,digits:int>>"
    )
    per = [F.when(F.col("t").rlike("@|[\\[(]at[\\])]" if k == "email" else "[0-9]"), _judged(F.col("t"), k)).otherwise(none) for k in KINDS]
    return t.select("doc_id", F.concat(*per).alias("found"))


def estimate(counts: list[tuple], rounds: int = 50) -> dict[int, list[float]]:
    """EM over rows (kind, votes..., digits, n), then a logistic fit: kind -> weights (bias, four votes, digits / 10).

    Two classes; a labeler's vote depends on the class only.  Beliefs about the votes (``BELIEF``) count as a share
    ``WEIGHT`` of a class's rows, so that the classes can't change places and a failed checksum isn't explained away.  Starts
    from the share of yes votes, a failed rule counting five times.
    """
    weights = {}
    for kind in range(len(KINDS)):
        rows = [(r[1:5], r[5], r[6]) for r in counts if r[0] == kind]
        if not rows:
            continue
        total = sum(n for *_, n in rows)
        post = [min(0.95, max(0.05, 0.5 + 0.2 * (sum(v) - 4 * (v[0] == -1)))) for v, _, _ in rows]
        for _ in range(rounds):
            prior = (sum(p * n for p, (*_, n) in zip(post, rows, strict=True)) + 1) / (total + 2)
            like = []
            for k in range(len(LABELERS)):
                t = {}
                for p, (v, _, n) in zip(post, rows, strict=True):
                    a, b = t.get(v[k], (0.0, 0.0))
                    t[v[k]] = (a + p * n, b + (1 - p) * n)
                yes, no = sum(a for a, _ in t.values()), sum(b for _, b in t.values())
                (my, mn), (sure, unsure) = (WEIGHT[k] * c + 1 for c in (yes, no)), BELIEF[k > 0]
                like.append({x: ((a + my * sure[x]) / (yes + my), (b + mn * unsure[x]) / (no + mn)) for x, (a, b) in t.items()})
            post = []
            for v, _, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(like[k][v[k]][0] / like[k][v[k]][1]) for k in range(len(LABELERS)))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        w = [0.0] * (2 + len(LABELERS))
        x = [[1.0, *map(float, v), d / 10] for v, d, _ in rows]
        for _ in range(400):
            grad = [1e-3 * c for c in w]
            for xi, p, (*_, n) in zip(x, post, rows, strict=True):
                z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, xi, strict=True))))
                e = (1 / (1 + math.exp(-z)) - p) * n / total
                grad = [g + e * b for g, b in zip(grad, xi, strict=True)]
            w = [a - 0.8 * g for a, g in zip(w, grad, strict=True)]
        weights[kind] = w
    return weights


def _sorted(spans: Column) -> Column:
    """The spans by start, kind and end, equal ones once."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return _let(order, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(_sorted(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and all: arrays of struct<start, end, kind (index in KINDS)>, for every row of docs."""
    found = cut(candidates(docs))
    each = found.select(F.explode("found").alias("s"))
    counts = each.groupBy("s.kind", "s.pattern", "s.gazetteer", "s.context", "s.edges", "s.digits").agg(F.count(F.lit(1)).alias("n"))
    weights = estimate(sorted(tuple(r) for r in counts.collect()))  # at most 4 * 81 * 21 rows

    def accepted(s):
        out = F.lit(False)
        for kind, w in weights.items():
            z = F.lit(w[0]) + sum((s[k] * F.lit(v) for k, v in zip(LABELERS, w[1:-1], strict=True)), F.lit(0.0)) + s["digits"] / 10 * F.lit(w[-1])
            out = F.when(s["kind"] == kind, z >= math.log(threshold / (1 - threshold))).otherwise(out)
        return out

    slim = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = F.transform(F.filter("found", lambda s: s["base"]), slim)
    # Base rules reject on purpose, so a rejected base match needs the votes like any other candidate.
    kept = F.filter("found", lambda s: s["base"] | accepted(s))
    return found.select("doc_id", base.alias("base"), F.transform(kept, slim).alias("all"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    got = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    n = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return got.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
