"""Operator 1, toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Main path: one Arrow pass extracts features from whole texts and scores them.  Fitting uses at most
``max_train_rows`` labelled rows (lowest hashes of doc_id), in ``FOLDS`` folds by the text's hash: the words that a
training row is judged by are learned from the other folds, and so are the trees whose scores calibration sees, so that
no row helps to choose its own.  The final lexicon and trees are learned from all folds.  The way is the same at every
size.  Only text reaches the features.

Edge cases: a null text counts as empty and is scored like any other; a null doc_id is scored, is never held out and
never used for training; repeated doc_ids are scored row by row, and the one with the lowest text hash trains; several
labels of one doc_id count as toxic if any is; null labels are ignored; without labels of both classes every score is
the smoothed share of toxic labels; texts are read whole, one at a time; other columns of docs are not read (a column
named score or toxicity__score neither), keep_clean returns them unchanged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import bounded_batches, cut, is_held_out
from ._trees import BoostedTrees, Isotonic

#: Most labelled rows used to fit the model.
MAX_TRAIN_ROWS = 20_000
FOLDS = 8
THRESHOLD = 0.7
#: Lengths of the word beginnings that the lexicon may hold beside whole words.
STEMS = (5, 6, 7, 8)

# Common words of abuse in the corpus' languages.
SEED_WORDS = """idiot idiots moron morons stupid dumb fool loser losers scum trash garbage filth clown pathetic worthless
disgusting vile hate kill ugly bastard bitch damn fuck fucking shit asshole jerk retard creep pig rat vermin
dumm dummkopf trottel vollidiot arschloch scheisse scheiße abschaum drecksau wichser hure schlampe ekelhaft
imbécile crétin débile salaud connard connasse merde ordure pute dégueulasse abruti minable
idiota imbécil estúpido estúpida tonto basura escoria cabrón mierda puta asqueroso asquerosa payaso inútil""".split()
# Second-person forms.
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre vos
tú ti usted ustedes vosotros vuestro su""".split()

_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[0-9@$!]*[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\w)")
_LEET = str.maketrans("013457@$!", "oieastasi")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _SHOUT, _MASKING = b"!\"'(),-./:;?[]{}", b"!?", b"*@$#%&^~"

FEATURES = ["seed_rate", "seed_count", "learned_rate", "learned_count", "near_second_person", "second_person_rate", "capitals",
            "shout_rate", "punctuation", "masking", "digits", "mixed_rate", "hidden_count", "log_words", "word_length"]


class Lexicon:
    """Words and word beginnings, told apart quickly by their first letters."""

    def __init__(self, entries):
        self.words = frozenset(e for e in entries if not e.endswith("*"))
        self.stems = frozenset(e[:-1] for e in entries if e.endswith("*"))
        self.heads = frozenset(e[:5] for e in self.stems)
        self.lengths = sorted({len(e) for e in self.stems})

    def __contains__(self, word: str) -> bool:
        return word in self.words or word[:5] in self.heads and any(word[:n] in self.stems for n in self.lengths)


def features(text: str | None, seed: frozenset, learned: Lexicon, near: int = 5) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    low = text.lower()
    tokens = _TOKEN.findall(low)
    words = max(1, len(tokens))
    heads, more = learned.heads, learned.words
    marks = [(i, w) for i, w in enumerate(tokens) if w in _SECOND or w in seed or w in more or w[:5] in heads and w in learned]
    you = np.array([i for i, w in marks if w in _SECOND], dtype=np.int64)
    bad = np.array([i for i, w in marks if w in seed or w in learned], dtype=np.int64)
    n_seed, n_learned = sum(w in seed for _, w in marks), sum(w in learned for _, w in marks)
    close = 0
    if len(you) and len(bad):
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(bad - you[np.clip(at - 1, 0, len(you) - 1)]), np.abs(bad - you[np.clip(at, 0, len(you) - 1)]))
        close = int((gap <= near).sum())
    mixed = _MIXED.findall(low)
    plain = [w.replace("*", "").translate(_LEET) for w in mixed] + [re.sub(r"[ .\-]", "", w) for w in _SPACED.findall(low)]
    hidden = sum(w in seed or w in learned for w in plain)
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(1, n)
    return [n_seed / words, float(n_seed), n_learned / words, float(n_learned), close / words, len(you) / words, share(_UPPER),
            share(_SHOUT), share(_PUNCT), share(_MASKING), share(_DIGIT), len(mixed) / words, float(hidden), float(np.log1p(len(tokens))),
            sum(map(len, tokens)) / words]


_SECOND = frozenset(SECOND_PERSON)


class ToxicityModel:
    """Picklable: sent to the executors inside the scoring closure (some 100 KB, whatever the corpus)."""

    def __init__(self, seed: frozenset, learned: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, base: float):
        self.seed, self.learned, self.trees, self.calibration, self.base = seed, learned, trees, calibration, base

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.seed, self.learned) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        if self.trees is None or not len(x):
            return np.full(len(x), self.base)
        return self.calibration(self.trees.raw(x))


def _training(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, y, fold of the training sample, at most max_rows rows; written once, so that the corpus is read once for it."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # At most max_rows rows of 12 bytes: safe to broadcast at any corpus size.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    once = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return cut(once.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(17)), F.lit(FOLDS))))


def learn_lexicons(rows: DataFrame, seed: frozenset, min_toxic: int = 4, min_share: float = 0.02, min_ratio: float = 20.0, size: int = 400) -> list[tuple[frozenset, frozenset]]:
    """(learned, kept) without fold 0, 1, ... and, last, from all rows.

    learned: the ``size`` words and word beginnings (``stem*``) that are the most over-represented in toxic training
    texts; kept: the seed words without those that clean texts use as often (an insult in one language can be an article
    in another).  Equal texts count once; a learned word is in at least min_toxic toxic texts and a share min_share of
    them, so that copies of one text teach none.
    """
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y"), F.first("fold").alias("fold"))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w).between(3, 40))
    begins = lambda w: [F.when(F.length(w) > n, F.concat(F.substring(w, F.lit(1), F.lit(n)), F.lit("*"))) for n in STEMS]
    entries = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array_compact(F.array(w, *begins(w))))))
    per_fold = [c for f in range(FOLDS) for c in (F.sum(F.when(F.col("fold") == f, F.col("y"))).alias(f"a{f}"), F.count_if(F.col("fold") == f).alias(f"b{f}"))]
    known = F.col("w").isin(*sorted(seed))
    counts = once.select("y", "fold", F.explode(entries).alias("w")).groupBy("w").agg(*per_fold).fillna(0)
    folds = [*([g for g in range(FOLDS) if g != f] for f in range(FOLDS)), list(range(FOLDS))]
    counts = cut(counts.where((sum((F.col(f"a{f}") for f in range(FOLDS)), F.lit(0)) >= min_toxic) | known))
    totals = once.agg(*per_fold).fillna(0).first()
    asked = None
    for k, use in enumerate(folds):
        t, n = sum(totals[f"a{f}"] for f in use), sum(totals[f"b{f}"] for f in use)
        a, b = (sum((F.col(f"{c}{f}") for f in use), F.lit(0)) for c in "ab")
        ratio = ((a + 0.5) / (t + 1)) / ((b - a + 0.5) / (n - t + 1))
        judged = counts.select(F.lit(k).alias("k"), "w", known.alias("known"), a.alias("a"), b.alias("b"), ratio.alias("ratio"))
        best = judged.where(~F.col("known") & (F.col("ratio") >= min_ratio) & (F.col("a") >= min_toxic) & (F.col("a") >= min_share * t)).orderBy(F.desc("ratio"), "w").limit(size)
        harmless = judged.where(F.col("known") & (F.col("b") >= 10) & (F.col("ratio") < 3))  # at most the seed words
        asked = best.unionByName(harmless) if asked is None else asked.unionByName(best).unionByName(harmless)
    got = asked.select("k", "w", "known").collect()
    return [(frozenset(r["w"] for r in got if r["k"] == k and not r["known"]), seed - {r["w"] for r in got if r["k"] == k and r["known"]}) for k in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    bounded_batches(docs.sparkSession)
    rows = _training(docs, labels, max_train_rows)
    lexicons = [(seed, Lexicon(learned)) for learned, seed in learn_lexicons(rows, frozenset(SEED_WORDS))]

    def extract(batches):
        for b in batches:
            x = [features(t.as_py(), *lexicons[f.as_py()]) for t, f in zip(b.column(1), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["h", "y", "fold", "x"])

    sample = rows.select(F.xxhash64("doc_id").alias("h"), "text", F.col("y").cast("int"), F.col("fold").cast("long"))
    got = sample.mapInArrow(extract, "h long, y int, fold long, x array<double>").toPandas().sort_values("h", kind="stable")  # at most max_train_rows
    base = float((got.y.sum() + 0.5) / (len(got) + 1)) if len(got) else 0.5 / 1.5
    y, fold = got.y.to_numpy(dtype=float), got.fold.to_numpy()
    seed, learned = lexicons[-1]
    if len(y) < 10 or any(len(set(y[fold != k])) < 2 for k in range(FOLDS)):
        return ToxicityModel(seed, learned, None, None, base)
    x = np.array(got.x.tolist(), dtype=float)
    raw = np.empty(len(y))
    for k in range(FOLDS):  # out-of-fold scores, so that calibration sees rows the trees have not
        raw[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return ToxicityModel(seed, learned, BoostedTrees().fit(x, y), Isotonic().fit(raw, y), base)


def score_documents(docs: DataFrame, model: ToxicityModel, *keep: str, name: str = "score") -> DataFrame:
    """The columns in ``keep`` and, as ``name``, a score of each row's text."""
    kept = docs.select(*keep)
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])
    bounded_batches(docs.sparkSession)
    at = names.index("text") if "text" in names else len(names)  # a kept text travels once
    rows = kept if "text" in names else docs.select(*keep, F.col("text").alias("text__scored"))

    def run(batches):
        for b in batches:
            s = pa.array(model.score(t.as_py() for t in b.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], s], names=[*names, name])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, max_train_rows)
    out = score_documents(docs, model, "doc_id")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold."""
    model = fit(docs, labels, max_train_rows)
    return score_documents(docs, model, *docs.columns, name="toxicity__score").where(F.col("toxicity__score") < THRESHOLD).select(*docs.columns)
