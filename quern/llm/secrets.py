"""Operator 5, secret scans: wide patterns propose findings, a random forest removes the false positives.

Features of a finding: length, class transitions between neighbouring characters, character shares and entropy, the part
covered by dictionary words and common letter triples, path-like surroundings and the neighbouring words.  The forest is
trained on labelled findings: a DataFrame (left, candidate, right, label) of at most ``MAX_TRAIN_ROWS`` rows, or, as the
tables bring none, a seeded set generated from the public formats of credentials and of their usual look-alikes (commit
and checksum digests, UUIDs, paths, identifiers, placeholders).

Edge cases: null and empty texts have no findings; a null doc_id keeps its findings; repeated rows are scanned each;
where proposals overlap, the earlier kind of ``KINDS`` stays whole and the later one goes (an assigned value wins over
a random string around it), of one kind the leftmost longest; of an assignment only the value is a finding; texts are
scanned whole, however long; columns of docs other than doc_id and text are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches
from ._trees import Forest

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.5
CONTEXT = 40

#: What stands between the lines of a key: white space, line breaks written as escapes, quotes and quoting marks.
_GAP = r"""(?:[\s"',>|#*]|\\+[rnt])"""
# Public formats of credentials.
KINDS = {
    # Through the matching END line before any other BEGIN line, or else to the end of the base64 block.
    "private_key": r"-----BEGIN (?P<label>[A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?P=label)PRIVATE KEY-----"
    rf"|(?:{_GAP}*(?:Proc-Type|DEK-Info|Comment|Key-Info):[^\n\\]*)*(?:{_GAP}*[A-Za-z0-9+/=]{{20,}})+(?:{_GAP}*(?:[A-Za-z0-9+/]+={{1,2}}|(?<=[\n\r])[A-Za-z0-9+/]+(?=\s*[\n\r]|\s*\Z)|(?<=\\n)[A-Za-z0-9+/]+(?=\\|[\"'\s]|\Z)))?)?",
    "aws_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "api_live_key": r"sk_live_[A-Za-z0-9]{16,}",
    "google_key": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned": r"""(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credentials?))["']?\s{0,3}[=:]\s{0,3}["']?(?P<value>[^\s"'<>]{6,})""",
    "random_string": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}",
}
# Words that speak for and against a secret nearby.
FOR = "token secret password passwd pwd key apikey api auth credential bearer login".split()
AGAINST = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid revision example sample dummy test placeholder integrity".split()
_COMMON = """the and ing ion tio ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive
was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ein sch ich der und die cht den ung gen ver ten ter
que les ent ment des eur ait con est par dos ado nte ara cio""".split()
_TRIPLES = frozenset(_COMMON)
# What documentation writes in a secret's place.
_INSTEAD = """required optional string number boolean hidden masked redacted change changeme incorrect expired protected reset forgot forgotten
invalid missing wrong unknown field input empty must should cannot please enter choose strong weak policy prompt manager encrypted stored""".split()
_WORDS = frozenset(FOR + AGAINST + _INSTEAD + "user name value your here insert config default null none true false data file path class method string index".split())
_PATTERNS = [(k, re.compile(v)) for k, v in KINDS.items()]
_PASSWORD = re.compile(r"(?i)(?:passw(?:or)?d|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$")
# Beginnings of public formats.
_FORMAT = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN ")
# Pieces of placeholders.
_PLACE = ("your", "insert", "example", "xxxx", "change", "placeholder", "sample", "dummy", "redacted", "****", "${", "{{", "null")
_RUN = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[a-z0-9]+")

FEATURES = ["length", "transitions", "digits", "upper", "lower", "hexadecimal", "entropy", "triples", "dictionary", "repeats", "path", "for", "against", "assigned", "quoted", "dashes", "password", "instead", "format"]


def _classes(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(left: str, value: str, right: str) -> list[float]:
    n = max(1, len(value))
    kinds = [_classes(c) for c in value]
    counts = Counter(value)
    low = value.lower()
    letters = [w.lower() for w in _RUN.findall(value)]
    triples = sum(w[i : i + 3] in _TRIPLES for w in letters for i in range(len(w) - 2))
    words = _WORD.findall(left.lower())[-6:]
    after = _WORD.findall(right.lower())[:3]
    share = Counter(kinds)
    hexa = all(c in "0123456789abcdef" for c in low)
    return [
        float(min(n, 200)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, share[0] / n, share[2] / n, share[1] / n, float(hexa),
        -sum(v / n * math.log2(v / n) for v in counts.values()), triples / n, sum(len(w) for w in letters if w in _WORDS) / n, 1 - len(counts) / n,
        float(value.count("/") + (left[-1:] in ("/", "\\", "."))), float(sum(any(w.endswith(f) for f in FOR) for w in words)),
        float(sum(w in AGAINST for w in [*words, *after])), float(bool(re.search(r"[=:]\s*[\"']?$", left))), float(left[-1:] in "\"'" and left != ""), value.count("-") / n,
        float(bool(_PASSWORD.search(left))), float(any(w in value.lower() for w in _PLACE)), float(bool(_FORMAT.match(value))),
    ]


def propose(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the proposals in code points by start, without overlaps: earlier kinds first, of one kind the leftmost longest."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        fresh = []
        for m in pattern.finditer(text):
            a, b = m.span("value") if kind == "assigned" else m.span()
            if kind == "random_string" and m[0].isalpha():
                continue  # letters only: an ordinary long word
            at = bisect.bisect_left(taken, (b,))
            if not (at and taken[at - 1][1] > a):
                fresh.append((a, b, kind))
        if fresh:
            taken = sorted(taken + fresh)
    return taken


def generated_findings(n: int = 8000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, value, right, label) by rule from a seeded generator."""
    r = np.random.default_rng(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    any_of = lambda xs: xs[int(r.integers(0, len(xs)))]
    words = ["ing", "ation", "ment", "under", "over", "config", "user", "index", "value", "file", "data", "string", "lich", "ment", "cion"]
    long_word = lambda: "".join(any_of(words) for _ in range(int(r.integers(4, 8))))
    filler = ["the of and ", "est la de ", "der die ", "los en ", "", "see here ", "we use "]
    b64, url = alnum + "+/", alnum + "_-"

    def private_key():
        name, gap = any_of(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "]), any_of(["\n", "\n", "\\n", " "])
        lines = [pick(b64, 64) for _ in range(int(r.integers(0, 27)))] + [pick(b64, int(r.integers(4, 64))) + any_of(["", "=", "=="])]
        head, end = f"-----BEGIN {name}PRIVATE KEY-----", f"-----END {name}PRIVATE KEY-----"
        return any_of([gap.join([head, *lines, end]), gap.join([head, *lines, end]), gap.join([head, *lines]), head])

    shaped = [
        private_key, lambda: any_of(["AKIA", "ASIA"]) + pick(alnum[:26] + "0123456789", 16), lambda: f"gh{any_of(list('pousr'))}_" + pick(alnum, 36),
        lambda: f"xox{any_of(list('abprs'))}-" + any_of([pick(alnum, int(r.integers(10, 50))), f"{pick(alnum[52:], 11)}-{pick(alnum[52:], 12)}-{pick(alnum, 24)}", f"{pick(alnum[52:], 12)}-{pick(alnum[52:], 12)}-{pick(hexa, 32)}"]),
        lambda: "sk_live_" + pick(alnum, int(r.integers(16, 40))), lambda: "AIza" + pick(url, 35), lambda: f"eyJ{pick(url, int(r.integers(12, 40)))}.eyJ{pick(url, int(r.integers(12, 120)))}.{pick(url, 43)}",
    ]
    out = []
    for _ in range(n):
        q = any_of(["", '"', "'"])
        draw = r.random()
        if draw < 0.25:  # formats that speak for themselves, half of them without an assignment
            name = any_of(["token", "secret", "api_key", "key", "private_key", "auth", "TOKEN", "SECRET_KEY"])
            left = any_of([*filler, "use ", "and then ", "Bearer ", "key "]) + (f"{name}{any_of([' = ', '=', ': '])}{q}" if r.random() < 0.5 else q)
            out.append((left, any_of(shaped)(), q + " " + any_of(filler), 1))
        elif draw < 0.31:  # passwords that people choose
            left = any_of(filler) + any_of(["password", "passwd", "pwd", "Password", "DB_PASSWORD", "user_password", "PASSWD"]) + any_of(["=", " = ", ": ", ":"]) + q
            word = lambda: "".join(any_of(["ba", "ko", "ri", "tu", "ne", "mo", "sal", "ter", "hun", "dra", "gon", "lin", "pe"]) for _ in range(int(r.integers(2, 4))))
            value = any_of([lambda: word() + pick("0123456789", int(r.integers(1, 5))), lambda: word().title() + pick("0123456789", 2) + any_of("!$#%&"), lambda: word() + word(), lambda: word() + any_of("-_.") + word() + pick("0123456789", 2)])()
            if len(value) >= 6:
                out.append((left, value, q + " " + any_of(filler), 1))
        elif draw < 0.35:  # other strings without an assignment, beside a word that speaks for them
            value = any_of([lambda: pick(alnum, int(r.integers(20, 48))), lambda: pick(b64, 40)])()
            out.append((any_of(filler) + any_of(["Bearer ", "bearer ", "the token ", "password ", "secret key ", "login with "]) + q, value, q + " " + any_of(filler), 1))
        elif draw < 0.58:
            name = any_of(["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "TOKEN", "SECRET_KEY", "PASSWORD"])
            value = any_of([lambda: pick(hexa, int(any_of([32, 40, 64]))), lambda: pick(hexa, 40).upper(), lambda: pick(alnum, int(r.integers(20, 48))), lambda: pick(alnum + "+/", 40), lambda: "ghp_" + pick(alnum, 36), lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16), lambda: pick(alnum + "!#%_-", int(r.integers(10, 18)))])()
            left = any_of(filler) + (f"{name}{any_of([' = ', '=', ': '])}{q}" if r.random() < 0.9 or value[:4] not in ("ghp_", "AKIA") else "")
            out.append((left, value, q + " " + any_of(filler), 1))
        else:
            left, value = any_of([
                lambda: (any_of(["commit ", "sha1: ", "sha256:", "md5 = ", "checksum ", "revision ", "etag: ", "integrity "]), pick(hexa, int(any_of([32, 40, 64])))),
                lambda: (any_of(["sha256 token of ", "the md5 of the secret is ", "hash of key ", "token checksum ", "digest of the password "]), pick(hexa, int(any_of([32, 40, 64])))),
                lambda: (any_of(["password: ", "password = ", "passwd=", "Password : ", "secret: ", "token = ", "auth: "]), any_of(_INSTEAD) + any_of(["", "", "_" + any_of(_INSTEAD), "."])),
                lambda: (any_of(["password=", "token: ", "secret = "]) + q, any_of(["${DB_PASSWORD}", "${" + "_".join(any_of(words).upper() for _ in range(int(r.integers(1, 5)))) + "}", "{{" + any_of(words) + "_" + any_of(words) + "}}", "$" + any_of(words).upper() + "_" + any_of(words).upper(), "{{secret_value}}", "os.environ", "getpass()", "process.env.TOKEN", "self.password", "config.token", "$PASSWORD_FILE"])),
                lambda: (any_of(filler), any_of(["MY_", "APP_", "THE_"]) + "_".join(any_of(words).upper() for _ in range(5)) + "_TOKEN"),
                lambda: (any_of(["id ", "uuid: ", "see ", ""]), str(uuid.UUID(bytes=r.bytes(16)))),
                lambda: (any_of(["from /", "in ", "path: ", "open ./"]), "/".join(any_of(words) + str(int(r.integers(0, 99))) for _ in range(4)) + any_of([".py", "/index", ".html"])),
                lambda: (any_of(filler), long_word() + str(int(r.integers(0, 9)))),
                lambda: (any_of(filler), long_word().title() + "_" + long_word()),
                lambda: (any_of(["token = ", "api_key: ", "password="]) + q, any_of(["your_api_key_here", "xxxxxxxxxxxxxxxx", "<insert-token-here>", "CHANGE_ME_PLEASE", "example_password_value", "************", "null_value_default"])),
                lambda: (any_of(filler), any_of(["-", "=", "_", "0", "a"]) * int(r.integers(20, 60))),
                lambda: (any_of(filler), str(int(r.integers(10**9, 10**10))) * 2 + pick("0123456789", 4)),
                lambda: (any_of(["auth: ", "the token: ", "password : "]), long_word()),
                lambda: (any_of(["", "use ", "token = ", "key: "]) + q, any_of(["ghp_", "AKIA", "xoxb-", "sk_live_", "AIza"]) + any_of(["x", "X", "0"]) * int(r.integers(16, 40))),
                lambda: (any_of(["", "use ", "token = ", "key: "]) + q, any_of(["xoxb-your-token-here", "xoxp-insert-your-token-here", "sk_live_yourliveapikeyhere", "sk_live_insertdefaultvalue"])),
            ])()
            out.append((any_of(filler) + left, value, q + " " + any_of(filler), 0))
    return out


def train(labelled: DataFrame | None = None, max_rows: int = MAX_TRAIN_ROWS) -> Forest:
    """Fit the forest; of ``labelled`` at most max_rows rows (lowest hashes) are used."""
    if labelled is None:
        rows = generated_findings()
    else:
        use = labelled.select("left", "candidate", "right", F.col("label").cast("int")).dropna(subset=["candidate", "label"]).orderBy(F.xxhash64("left", "candidate", "right"), "candidate").limit(max_rows)
        rows = [(r[0] or "", r[1], r[2] or "", r[3]) for r in use.collect()]
    y = np.array([r[3] for r in rows], dtype=float)
    if len(y) < 10 or y.min() == y.max():
        raise ValueError("labelled findings of both classes are needed")
    return Forest().fit(np.array([features(*r[:3]) for r in rows]), y)


def _judged(text: str, forest: Forest) -> list[tuple[int, int, str, str, float]]:
    found = propose(text)
    if not found:
        return []
    x = np.array([features(text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]) for a, b, _ in found])
    return [(a, b, k, hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest(), float(s)) for (a, b, k), s in zip(found, forest.predict(x), strict=True)]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each proposed finding: doc_id, start, end (code points, end exclusive), kind, secret_sha256, score, is_secret."""
    bounded_batches(docs.sparkSession)
    forest = forest or train()
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, end long, kind string, secret_sha256 string, score double, is_secret boolean"

    def run(batches):
        for b in batches:
            at, got = [], []
            for i, text in enumerate(b.column(1)):
                for f in _judged(text.as_py(), forest):
                    at.append(i)
                    got.append(f)
            cols = list(zip(*got, strict=True)) if got else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays, pa.array([s >= threshold for s in cols[4]], pa.bool_())], names=["doc_id", "start", "end", "kind", "secret_sha256", "score", "is_secret"])

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs; confirmed secrets in text become ``[kind]`` and n_chars, where there is one, follows."""
    bounded_batches(docs.sparkSession)
    forest = forest or train()
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(at):
                t = t.as_py()
                for a, e, k, _, s in reversed(_judged(t, forest) if t else []):
                    if s >= threshold:
                        t = f"{t[:a]}[{k}]{t[e:]}"
                out.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*names)
    return clean
