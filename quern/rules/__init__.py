"""Filter rules over proteins and their leader candidates, compiled to columns.

    rule = Pfam.matches("PF00504") & ~KO.matches("K08910").between_aa(1, 200) & Sequence.length_between(50, 400)
    rule.evaluate(facts)          # facts: see ``facts``

A rule is an immutable tree.  Atomic rules are told apart by their label and evaluated once each; ``&``, ``|`` and ``~``
combine them by the result algebra.  ``sources`` says which inputs a tree reads, so the others are never joined.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.accessions import same_or_versioned, unversioned
from ..functions.intervals import most_disjoint, relative
from ..operators.tables import furthest


class Rule:
    sources: frozenset = frozenset()

    def __and__(self, other: Rule) -> Rule:
        return All((*self._flat(All), *other._flat(All)))

    def __or__(self, other: Rule) -> Rule:
        return Any((*self._flat(Any), *other._flat(Any)))

    def __invert__(self) -> Rule:
        return Not(self)

    def _flat(self, kind) -> tuple:
        return self.parts if type(self) is kind else (self,)

    def atoms(self) -> dict[str, Rule]:
        """Atomic rules by label, in order of appearance."""
        return {self.label: self}

    def resolve(self) -> Column:
        """The tree's result over columns named by the atoms' labels."""
        return F.col(f"`{self.label}`")

    def column(self) -> Column:
        """An atomic rule's result over a facts row."""
        raise NotImplementedError

    def scope(self, candidates: DataFrame) -> DataFrame:
        return candidates

    def aggregates(self) -> dict[str, Column] | None:
        """Aggregates over a protein's hits (accession, lo, hi, anchor) that ``settled_by`` turns into the result; None: a row rule."""
        return None

    def judged(self, proteins: DataFrame, **hits: DataFrame) -> DataFrame:
        """proteins plus a column for each atomic rule and ``pass all``, from the hits of each kind (query_accession, ...).

        Rules over hits become conditional aggregates of one grouping for each kind, over hits of the accessions they name; no array of a
        protein's hits is built, but for disjoint counts, which collect the spans they count.
        """
        out, results = proteins, {}
        for kind in sorted(k for k in self.sources if k in hits):
            asked = {k: a for k, a in self.atoms().items() if kind in a.sources and a.aggregates() is not None}
            arrays = [a for a in self.atoms().values() if kind in a.sources and a.aggregates() is None]
            if arrays:
                out = facts(out, **{kind: hits[kind]})
            if not asked:
                continue
            wanted = [a.concerns() for a in asked.values()]
            rows = hit_rows(hits[kind])
            if all(w is not None for w in wanted):
                rows = rows.where(reduce(lambda x, y: x | y, wanted))
            names = {(k, n): f"{kind}__{i}__{n}" for i, (k, a) in enumerate(asked.items()) for n in a.aggregates()}
            per = rows.groupBy("protein").agg(*(c.alias(names[k, n]) for k, a in asked.items() for n, c in a.aggregates().items()))
            out = out.join(per, "protein", "left")
            results |= {k: a.settled_by(lambda n, k=k, names=names: F.col(names[k, n])) for k, a in asked.items()}
        labelled = out.select("*", *((results[k] if k in results else a.column()).alias(k) for k, a in self.atoms().items()))
        extra = [c for c in labelled.columns if "__" in c and c.split("__")[0] in hits]
        return labelled.withColumn("pass all", logic.normalized(self.resolve())).drop(*extra)

    def evaluate(self, facts: DataFrame) -> DataFrame:
        """facts plus a column for each atomic rule and ``pass all``."""
        labelled = facts.select("*", *(a.column().alias(k) for k, a in self.atoms().items()))
        return labelled.withColumn("pass all", logic.normalized(self.resolve()))


@dataclass(frozen=True)
class All(Rule):
    parts: tuple = ()

    @property
    def sources(self):
        return frozenset().union(*(p.sources for p in self.parts))

    @property
    def label(self):
        return "(" + " & ".join(p.label for p in self.parts) + ")"

    def atoms(self):
        return {k: a for p in self.parts for k, a in p.atoms().items()}

    def resolve(self):
        return logic.all_of(*(p.resolve() for p in self.parts))

    def scope(self, candidates):
        for p in self.parts:
            candidates = p.scope(candidates)
        return candidates


class Any(All):
    @property
    def label(self):
        return "(" + " | ".join(p.label for p in self.parts) + ")"

    def resolve(self):
        return logic.any_of(*(p.resolve() for p in self.parts))

    def scope(self, candidates):
        """Candidates of every branch; equal accessions are one, the last branch's values in the first one's place."""
        out = None
        for p in self.parts:
            mine = p.scope(candidates)
            out = mine if out is None else out.join(mine.select("accession").distinct(), "accession", "left_anti").unionByName(mine)
        return candidates if out is None else out


@dataclass(frozen=True)
class Not(Rule):
    part: Rule

    @property
    def sources(self):
        return self.part.sources

    @property
    def label(self):
        return f"~{self.part.label}"

    def atoms(self):
        return self.part.atoms()

    def resolve(self):
        return logic.negated(self.part.resolve())

    def scope(self, candidates):
        return self.part.scope(candidates)


def _named(x: Column, accession: str, versions: bool) -> Column:
    return unversioned(x) == accession if versions else x == accession


@dataclass(frozen=True)
class Hits(Rule):
    """At least one hit of the accession; ``times``, ``between_aa`` and ``spans_aa`` narrow a copy of the rule."""

    kind: str
    accession: str
    count: tuple | None = None
    overlapping: bool = True
    window: tuple | None = None
    every: bool = False
    span: tuple | None = None

    @property
    def sources(self):
        return frozenset({self.kind})

    @property
    def label(self):
        out = f'{self.kind}.matches("{self.accession}")'
        if self.count:
            out += f".times({self.count[0]}, {self.count[1]}{'' if self.overlapping else ', disjoint'})"
        if self.window:
            out += f".between_aa({self.window[0]}, {self.window[1]}{', every' if self.every else ''})"
        if self.span:
            out += f".spans_aa({self.span[0]}, {self.span[1]})"
        return out

    def times(self, lowest: int, highest: int | None = None, *, overlapping: bool = True) -> Hits:
        highest = lowest if highest is None else highest
        return replace(self, count=(min(lowest, highest), max(lowest, highest)), overlapping=overlapping)

    def between_aa(self, first: int, last: int, *, every: bool = False) -> Hits:
        return replace(self, window=(min(first, last), max(first, last)), every=every)

    def spans_aa(self, shortest: int, longest: int) -> Hits:
        return replace(self, span=(min(shortest, longest), max(shortest, longest)))

    def column(self):
        versions = self.kind == "Pfam"
        mine = F.filter(self.kind, lambda h: _named(h["accession"], self.accession.split(".")[0] if versions and self.count else self.accession, versions))
        ok = F.size(mine) > 0
        if self.count:
            n = F.size(mine) if self.overlapping else most_disjoint(F.transform(mine, lambda h: F.struct(h["lo"].alias("lo"), h["hi"].alias("hi"))))
            ok = n.between(*self.count)
        if self.window:
            inside = lambda h: (h["lo"] >= self.window[0]) & (h["hi"] <= self.window[1])
            ok &= (F.size(mine) > 0) & F.forall(mine, inside) if self.every else F.exists(mine, inside)
        if self.span:
            width = F.array_max(F.transform(mine, lambda h: h["hi"])) - F.array_min(F.transform(mine, lambda h: h["lo"])) + 1
            ok &= F.coalesce(width.between(*self.span), F.lit(False))
        return logic.from_bool(ok)

    def concerns(self) -> Column:
        versions = self.kind == "Pfam"
        return _named(F.col("accession"), self.accession.split(".")[0] if versions and self.count else self.accession, versions)

    def aggregates(self):
        mine, span = self.concerns(), F.struct("lo", "hi")
        out = {"n": F.count_if(mine)}
        if self.count and not self.overlapping:
            out["spans"] = F.collect_list(F.when(mine, span))
        if self.window:
            out["inside"] = F.count_if(mine & (F.col("lo") >= self.window[0]) & (F.col("hi") <= self.window[1]))
        if self.span:
            out |= {"lo": F.min(F.when(mine, F.col("lo"))), "hi": F.max(F.when(mine, F.col("hi")))}
        return out

    def settled_by(self, got):
        n = F.coalesce(got("n"), F.lit(0))
        ok = n > 0
        if self.count:
            ok = (n if self.overlapping else F.coalesce(most_disjoint(got("spans")), F.lit(0))).between(*self.count)
        if self.window:
            inside = F.coalesce(got("inside"), F.lit(0))
            ok &= (n > 0) & (inside == n) if self.every else inside > 0
        if self.span:
            ok &= F.coalesce((got("hi") - got("lo") + 1).between(*self.span), F.lit(False))
        return logic.from_bool(ok)


@dataclass(frozen=True)
class HitSet(Rule):
    """Any hit is among the accessions, or (only) no hit is outside them; no hits satisfy ``only``."""

    kind: str
    accessions: tuple
    only: bool

    @property
    def sources(self):
        return frozenset({self.kind})

    @property
    def label(self):
        return f"{self.kind}.matches_{'only' if self.only else 'any'}({', '.join(self.accessions)})"

    def column(self):
        name = lambda h: unversioned(h["accession"]) if self.kind == "Pfam" else h["accession"]
        wanted = {a.split(".")[0] for a in self.accessions} if self.kind == "Pfam" else set(self.accessions)
        test = lambda h: name(h).isin(*sorted(wanted))
        return logic.from_bool(F.forall(self.kind, test) if self.only else F.exists(self.kind, test))

    def _among(self) -> Column:
        pfam = self.kind == "Pfam"
        wanted = {a.split(".")[0] for a in self.accessions} if pfam else set(self.accessions)
        return (unversioned(F.col("accession")) if pfam else F.col("accession")).isin(*sorted(wanted))

    def concerns(self) -> Column | None:
        """Which hits matter; None: all of them."""
        return None if self.only else self._among()

    def aggregates(self):
        return {"n": F.count_if(~self._among() if self.only else self._among())}

    def settled_by(self, got):
        n = F.coalesce(got("n"), F.lit(0))
        return logic.from_bool(n == 0 if self.only else n > 0)


class _HitFactory:
    def __init__(self, kind: str):
        self.kind = kind

    def matches(self, accession: str) -> Hits:
        return Hits(self.kind, accession)

    def matches_any(self, *accessions: str) -> HitSet:
        return HitSet(self.kind, accessions, False)

    def matches_only(self, *accessions: str) -> HitSet:
        return HitSet(self.kind, accessions, True)


Pfam, KO = _HitFactory("Pfam"), _HitFactory("KO")


@dataclass(frozen=True)
class Length(Rule):
    lowest: int
    highest: int
    sources: frozenset = frozenset()

    @property
    def label(self):
        return f"Sequence.length_between({self.lowest}, {self.highest})"

    def column(self):
        return logic.from_bool(F.length("sequence").between(self.lowest, self.highest))


@dataclass(frozen=True)
class Pattern(Rule):
    """A regular expression found within a window of residues, in protein coordinates or relative to the first Pfam hit.

    Relative positions have no zero; they need the candidate's start (column protein_start), else the result is error.
    """

    regex: str
    window: tuple | None = None
    anchor: str | None = None

    @property
    def sources(self):
        return frozenset({"Pfam"}) if self.anchor else frozenset()

    @property
    def label(self):
        where = f".between_aa({self.window[0]}, {self.window[1]})" if self.window and not self.anchor else ""
        return f'Sequence.matches_regex("{self.regex}"){where}' + (f'.relative_to("{self.anchor}", {self.window[0]}, {self.window[1]})' if self.anchor else "")

    def between_aa(self, first: int, last: int) -> Pattern:
        return replace(self, window=(min(first, last), max(first, last)), anchor=None)

    def relative_to(self, accession: str, first: int, last: int) -> Pattern:
        return replace(self, window=(min(first, last), max(first, last)), anchor=accession)

    def column(self):
        s = F.col("sequence")
        if not self.window:
            return logic.from_bool(s.rlike(self.regex))
        first, last = map(F.lit, self.window)
        if self.anchor:
            hits = F.filter("Pfam", lambda h: same_or_versioned(h["accession"], self.anchor))
            # The anchor in the candidate's own coordinates, then the window's ends in sequence positions.
            at = relative(F.array_min(F.transform(hits, lambda h: h["anchor"])), F.col("protein_start"))
            edge = lambda r: F.when(r > 0, at + r - 1).otherwise(at + r)
            first, last = edge(first), edge(last)
        a, b = F.greatest(first, F.lit(1)), F.least(last, F.length(s))
        found = (a <= b) & F.substring(s, a, b - a + 1).rlike(self.regex)
        if not self.anchor:
            return logic.from_bool(found)
        return F.when(F.size(hits) == 0, "false").when(F.col("protein_start").isNull(), "error").otherwise(logic.from_bool(found))


class Sequence:
    @staticmethod
    def length_between(lowest: int, highest: int) -> Length:
        return Length(min(lowest, highest), max(lowest, highest))

    @staticmethod
    def matches_regex(regex: str) -> Pattern:
        return Pattern(regex)


@dataclass(frozen=True)
class Profile(Rule):
    """Predicates on an HMM alignment map: column ``hmm`` has profile -> map(position -> struct<pos, aa> or null for a gap)."""

    profile: str
    test: str
    args: tuple
    window: tuple | None = None
    sources: frozenset = field(default=frozenset({"hmm"}))

    @property
    def label(self):
        return f'HMM("{self.profile}").{self.test}{self.args}' + (f".between{self.window}" if self.window else "")

    def between(self, first: int, last: int) -> Profile:
        return replace(self, window=(min(first, last), max(first, last)))

    def column(self):
        m = F.try_element_at("hmm", F.lit(self.profile))
        at = lambda p: F.try_element_at(m, p)
        if self.test == "is_at":
            text, start = self.args
            ok = F.lit(True)
            for i, c in enumerate(text):
                ok &= F.coalesce(at(F.lit(start + i))["aa"] == c, F.lit(False))
        elif self.test == "matches_regex":
            regex, start = self.args
            keys = F.filter(F.map_keys(m), lambda k: k >= start)
            # rightwards from start until the profile ends; an alignment's keys are contiguous
            text = F.array_join(F.transform(F.array_sort(keys), lambda k: F.coalesce(at(k)["aa"], F.lit("-"))), "")
            ok = F.map_contains_key(m, F.lit(start)) & (text != "") & text.rlike(f"^(?:{regex})")
        else:
            s, e = sorted(self.args)
            inside = F.filter(F.map_keys(m), lambda k: at(k).isNotNull())
            if self.test == "covers":
                ok = F.forall(F.sequence(F.lit(s), F.lit(e)), lambda p: at(p).isNotNull())
            else:
                ok = (F.array_min(inside) <= s) & (F.array_max(inside) >= e)
            if self.window:
                placed = F.transform(F.filter(inside, lambda k: k.between(s, e)), lambda k: at(k)["pos"])
                ok &= (F.size(placed) > 0) & (F.array_min(placed) >= self.window[0]) & (F.array_max(placed) <= self.window[1])
        return F.when(m.isNull(), "false").otherwise(logic.from_bool(F.coalesce(ok, F.lit(False))))


class HMM:
    def __init__(self, profile: str):
        self.profile = profile

    def is_at(self, text: str, position: int) -> Profile:
        return Profile(self.profile, "is_at", (text, position))

    def covers(self, first: int, last: int) -> Profile:
        return Profile(self.profile, "covers", (first, last))

    def spans(self, first: int, last: int) -> Profile:
        return Profile(self.profile, "spans", (first, last))

    def matches_regex(self, regex: str, position: int) -> Profile:
        return Profile(self.profile, "matches_regex", (regex, position))


@dataclass(frozen=True)
class Localized(Rule):
    """Leader predicates from tool calls.  Columns targetp: struct<p_noTP, p_mTP, p_SP> and deeploc:
    struct<localizations, signals, scores map>, null where a candidate's call is missing."""

    what: str
    value: str
    window: tuple | None = None
    original: bool = True

    @property
    def sources(self):
        return frozenset({"targetp"} if self.what == "targetp" else {"deeploc"} if self.what != "any" else ())

    @property
    def label(self):
        where = f".within({self.window[0]}, {self.window[1]})" if self.window else ""
        return f"Leader().{self.what}({self.value}){where}"

    def within(self, first: int, last: int, *, original: bool = True) -> Localized:
        return replace(self, window=(min(first, last), max(first, last)), original=original)

    def scope(self, candidates):
        """Candidates that start in the window; where a protein has none, its original sequence."""
        if not self.window:
            return candidates
        from pyspark.sql import Window

        inside = (F.col("start") != 0) & F.col("start").between(*self.window) & ~F.col("is_original")
        marked = candidates.withColumn("in__", inside).withColumn("any__", F.max(inside).over(Window.partitionBy("protein")))
        keep = F.col("in__") | (F.col("is_original") & (F.lit(self.original) | ~F.col("any__")))
        return marked.where(keep).drop("in__", "any__")

    def column(self):
        if self.what == "any":
            return F.lit("true")
        if self.what == "targetp":
            return F.when(F.col("targetp").isNull(), "error").otherwise(logic.from_bool(targetp_call(F.col("targetp")) == self.value))
        d = F.col("deeploc")
        if self.what == "localize_at":
            ok = d["localizations"] == self.value
        else:
            ok = F.array_contains(d["signals"], self.value) & (F.coalesce(F.try_element_at(d["scores"], F.lit(self.value)), F.lit(1.0)) == 1.0)
        return F.when(d.isNull(), "maybe").otherwise(logic.from_bool(F.coalesce(ok, F.lit(False))))


def targetp_call(t: Column) -> Column:
    """Largest rounded percentage; noTP wins ties over mTP over SP; nothing above zero gives an empty call."""
    choice = lambda p, rank, name: F.struct(F.bround(100 * t[p], 0).alias("v"), F.lit(rank).alias("r"), F.lit(name).alias("n"))
    best = F.array_max(F.array(choice("p_SP", 0, "SP"), choice("p_mTP", 1, "mTP"), choice("p_noTP", 2, "noTP")))
    return F.when(best["v"] > 0, best["n"]).otherwise("")


class Leader:
    def found(self) -> Localized:
        return Localized("any", "")

    def is_mTP(self) -> Localized:
        return Localized("targetp", "mTP")

    def is_SP(self) -> Localized:
        return Localized("targetp", "SP")

    def is_noTP(self) -> Localized:
        return Localized("targetp", "noTP")

    def is_NLS(self) -> Localized:
        return Localized("signal", "Nuclear localization signal")

    def is_NES(self) -> Localized:
        return Localized("signal", "Nuclear export signal")

    def localize_at(self, places: str) -> Localized:
        return Localized("localize_at", places)


@dataclass(frozen=True)
class Motifs(Rule):
    """Motif hits (column motifs: array<struct<motif, start, end, score>>, 0-based half-open) inside scope intervals
    (column scopes: array<struct<s, e>>); null motifs mean a failed scan, null scopes no genome."""

    first: str
    second: str | None = None
    distance: int | None = None
    lowest_score: float | None = None
    sources: frozenset = field(default=frozenset({"motifs"}))

    @property
    def label(self):
        more = f', "{self.second}", {self.distance}' if self.second else ""
        return f'TFMotifs.has{"_within" if self.second else ""}("{self.first}"{more})'

    def column(self):
        inside = lambda h: F.exists("scopes", lambda s: (h["start"] >= s["s"]) & (h["end"] <= s["e"]))

        def mine(name):
            ok = lambda h: same_or_versioned(h["motif"], name) & inside(h)
            return F.filter("motifs", (lambda h: ok(h) & (h["score"] >= self.lowest_score)) if self.lowest_score is not None else ok)

        a = mine(self.first)
        if self.second is None:
            result = F.when(F.size(a) > 0, "yes").otherwise(f"missing_{self.first}")
        else:
            b = mine(self.second)
            gap = lambda x, y: F.greatest(F.lit(0), x["start"] - y["end"], y["start"] - x["end"])
            near = F.exists(a, lambda x: F.exists(b, lambda y: gap(x, y) <= self.distance))
            result = (
                F.when((F.size(a) == 0) & (F.size(b) == 0), f"missing_{self.first}_and_{self.second}").when(F.size(a) == 0, f"missing_{self.first}")
                .when(F.size(b) == 0, f"missing_{self.second}").when(near, "yes").otherwise("too_far")
            )
        return F.when(F.col("scopes").isNull(), "not_applicable").when(F.size("scopes") == 0, "false").when(F.col("motifs").isNull(), "error").otherwise(result)


@dataclass(frozen=True)
class Custom(Rule):
    """A rule of the user's own: a label and a column of results."""

    label: str
    expression: object
    sources: frozenset = frozenset()

    def column(self):
        return self.expression


@dataclass(frozen=True)
class Python(Rule):
    """A rule that only Python can express: test(row) over the named columns (a dictionary) gives true, false or a result's
    name.  Rows travel in Arrow batches; an exception makes that row an error and no other."""

    label: str
    test: object
    columns: tuple
    sources: frozenset = frozenset()

    def column(self):
        test = self.test

        @F.pandas_udf("string")
        def judge(rows: pd.DataFrame) -> pd.Series:
            def one(row):
                try:
                    got = test(row)
                except Exception:  # whatever goes wrong concerns this row alone
                    return "error"
                return got if isinstance(got, str) else "true" if got else "false"

            return pd.Series([one(r) for r in rows.to_dict("records")], dtype="object")

        return judge(F.struct(*self.columns))


def end_bound(rule: Rule) -> Hits | None:
    """The one rule marked as C-terminal bound; it isn't looked for inside ``~``, and two are an error."""
    found = []

    def walk(r):
        if isinstance(r, EndBound):
            found.append(r)
        elif isinstance(r, All):
            for p in r.parts:
                walk(p)

    walk(rule)
    if len(found) > 1:
        raise ValueError("at most one C-terminal bound")
    return found[0] if found else None


@dataclass(frozen=True)
class EndBound(Hits):
    """Hits that also end the candidates: they are cut at the last endpoint."""


def bound_candidates(candidates: DataFrame, hits: DataFrame, accession: str, kind: str) -> DataFrame:
    """Cut candidates at the protein's largest endpoint of the accession and rename them; those starting after it go.

    A candidate's start has no zero: upstream starts are negative.  Its length up to the end is end - start + 1 for a
    positive start and end - start for a negative one.
    """
    from ..functions.accessions import before_pipe

    last = hits.where(same_or_versioned(F.col("target_accession"), accession)).groupBy(F.col("query_accession").alias("protein")).agg(F.max(F.greatest("query_start", "query_end")).alias("bound__"))
    n = F.when(F.col("start") > 0, F.col("bound__") - F.col("start") + 1).otherwise(F.col("bound__") - F.col("start"))
    out = candidates.join(last, "protein", "left")
    cut = out.where(F.col("bound__").isNull() | (F.col("start") <= F.col("bound__")))
    named = F.when(F.col("bound__").isNull(), F.col("accession")).otherwise(before_pipe(F.col("accession"), F.lit(f"_to_{kind}_end")))
    text = F.when(F.col("bound__").isNull(), F.col("sequence")).otherwise(F.substring("sequence", F.lit(1), n))
    return cut.withColumns({"accession": named, "sequence": text}).drop("bound__")


def hit_rows(hits: DataFrame) -> DataFrame:
    """protein, accession, lo, hi, anchor (where the model's first position would lie) of hits."""
    anchor = F.col("query_start") - (F.coalesce("target_start", F.lit(1)) - 1) if "target_start" in hits.columns else F.least("query_start", "query_end")
    return hits.select(F.col("query_accession").alias("protein"), F.col("target_accession").alias("accession"), F.least("query_start", "query_end").alias("lo"), F.greatest("query_start", "query_end").alias("hi"), anchor.cast("int").alias("anchor"))


def facts(proteins: DataFrame, **hits: DataFrame) -> DataFrame:
    """One row per protein with its hits of each kind as array<struct<accession, lo, hi, anchor>>; only given kinds are joined.

    For rules over hits alone ``Rule.judged`` needs no arrays.
    """
    out = proteins
    for kind, h in hits.items():
        per = hit_rows(h).groupBy("protein").agg(F.collect_list(F.struct("accession", "lo", "hi", "anchor")).alias(kind))
        kind_type = dict(per.dtypes)[kind]
        out = out.join(per, "protein", "left").withColumn(kind, F.coalesce(kind, F.array().cast(kind_type)))
    return out


def motif_verdicts(proteins: DataFrame, scopes: DataFrame, hits: DataFrame, failed: DataFrame, first: str, second: str | None = None, distance: int | None = None, lowest_score: float | None = None) -> DataFrame:
    """protein, result of ``Motifs`` over tables instead of arrays: hits (protein, motif, start, end, score) inside scopes (protein, s, e).

    proteins: protein, has_genome.  failed: proteins whose scan failed.  Containment and the nearest edge are sweeps along a protein's
    positions, so a protein with many hits costs a sort and no pairs.
    """
    def mine(name):
        got = hits.where(same_or_versioned(F.col("motif"), name))
        got = got if lowest_score is None else got.where(F.col("score") >= lowest_score)
        reached = furthest(got, scopes, ["protein"], F.col("start"), F.col("s"), F.col("e"))
        return reached.where(F.col("furthest") >= F.col("end")).select("protein", "start", "end")

    a = mine(first)
    t = proteins.join(scopes.select("protein").distinct().withColumn("scoped", F.lit(True)), "protein", "left").join(failed.select("protein").distinct().withColumn("failed", F.lit(True)), "protein", "left")
    t = t.join(a.select("protein").distinct().withColumn("a", F.lit(True)), "protein", "left")
    if second is None:
        result = F.when(F.col("a"), "yes").otherwise(f"missing_{first}")
    else:
        b = mine(second)
        # Some b starts at most distance behind a's end, and one of those ends at most distance before a's start.
        near = furthest(a, b.withColumnRenamed("end", "b_end"), ["protein"], F.col("end") + distance, F.col("start"), F.col("b_end")).where(F.col("furthest") >= F.col("start") - distance)
        t = t.join(b.select("protein").distinct().withColumn("b", F.lit(True)), "protein", "left").join(near.select("protein").distinct().withColumn("near", F.lit(True)), "protein", "left")
        result = (
            F.when(F.col("a").isNull() & F.col("b").isNull(), f"missing_{first}_and_{second}").when(F.col("a").isNull(), f"missing_{first}").when(F.col("b").isNull(), f"missing_{second}")
            .when(F.col("near"), "yes").otherwise("too_far")
        )
    return t.select("protein", F.when(~F.col("has_genome"), "not_applicable").when(F.col("scoped").isNull(), "false").when(F.col("failed"), "error").otherwise(result).alias("result"))


def result_counts(results: DataFrame, label: str) -> DataFrame:
    """Histogram of a rule's results."""
    return results.groupBy(F.col(f"`{label}`").alias("result")).agg(F.count(F.lit(1)).alias("n"))


def passing_rows(results: DataFrame, **wanted: str) -> DataFrame:
    """Rows by exact text of result columns; ``pass all`` = true unless asked otherwise."""
    filters = {"pass all": "true"} | wanted
    for c, v in filters.items():
        results = results.where(F.col(f"`{c}`") == v)
    return results


def load(path: str) -> Rule:
    """``package.module.name`` to a rule."""
    module, _, name = path.rpartition(".")
    rule = getattr(importlib.import_module(module), name)
    if not isinstance(rule, Rule):
        raise TypeError(f"{path} is no rule")
    return rule
