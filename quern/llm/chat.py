"""Operator 9, chat formatting: a small sandboxed template language, parsed to a tree, folded and compiled to closures.

    {{ expr }}   {% for x in expr %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set x = expr %}   {% generation %} .. {% endgeneration %}   {# comment #}

Expressions know strings, whole numbers, true / false / none, names, ``a.b`` and ``a["b"]`` on mappings only, ``== != in
and or not + ~`` and the filters below; there are no calls, no attributes of Python objects and no access to them.
Constant parts are folded and neighbouring texts joined at compile time.  Compiled nodes are generators of (text, is
generated), so a loop renders message by message and a conversation of any length streams through a task: rows are
sorted by conversation and turn, and neither a conversation nor a group is ever collected.

Control strings inside texts are escaped reversibly: ``<`` + backslashes + ``|`` gets one more backslash, so ``<|``
never comes from a text.  A role also has its backslashes and line ends written as escapes, as it ends at a line end.

Edge cases: null roles and texts are empty; a null turn comes last; equal turns are ordered by role and text; rows with
a null conv_id form one conversation with a null id; an empty table gives only what the query adds;
repeated rows are turns of their own; very long texts and conversations stream piece by piece; conv_id must be a whole number or its text
(another one stops the job in the cast); columns besides conv_id, turn, role and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}{# one turn #}{{ '<|im_start|>' + (message.role | role) }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}{{ '<|im_end|>' }}\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(text: str) -> str:
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda v: escape(_text(v)), "role": lambda v: escape_role(_text(v)), "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
}


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.\[\]()+~|]))""")


# Tree nodes are tuples: ("const", v), ("name", n), ("get", e, key), ("op", f, a, b), ("not", e), ("filter", name, e) and
# ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)], body), ("set", name, e), ("gen", body).
class _Expression:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, [], 0
        i = 0
        while source[i:].strip():
            m = _TOKEN.match(source, i)
            if not m:
                raise TemplateError(f"can't read {source[i:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "str", "name", "sym"), m.groups(), strict=True) if v is not None))
            i = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise TemplateError(f"{' or '.join(values) or 'more'} expected in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return e

    def either(self):
        e = self.both()
        while self.peek("or"):
            self.take()
            e = ("op", "or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.peek("and"):
            self.take()
            e = ("op", "and", e, self.negated())
        return e

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        e = self.joined()
        while self.peek("==", "!=", "in"):
            e = ("op", self.take(), e, self.joined())
        return e

    def joined(self):
        e = self.filtered()
        while self.peek("+", "~"):
            e = ("op", self.take(), e, self.filtered())
        return e

    def filtered(self):
        e = self.atom()
        while self.peek(".", "[", "|"):
            sign = self.take()
            if sign == "|":
                name = self.take()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = ("filter", name, e)
            elif sign == ".":
                e = ("get", e, ("const", self.take()))
            else:
                e = ("get", e, self.either())
                self.take("]")
        return e

    def atom(self):
        if self.peek("("):
            self.take()
            e = self.either()
            self.take(")")
            return e
        if self.at >= len(self.tokens):
            raise TemplateError(f"a value is expected in {self.source!r}")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("const", int(v))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1]))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[v]) if v in ("true", "false", "none") else ("name", v)
        raise TemplateError(f"unexpected {v!r} in {self.source!r}")


def parse(source: str) -> list:
    pieces, i = [], 0
    for m in _PIECE.finditer(source):
        if m.start() > i:
            pieces.append(("text", source[i : m.start()]))
        if m[1] is not None:
            pieces.append(("out", _Expression(m[1]).whole()))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        i = m.end()
    if i < len(source):
        pieces.append(("text", source[i:]))
    at = 0

    def body(*ends: str):
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, v = pieces[at]
            at += 1
            if kind != "tag":
                nodes.append((kind, v))
                continue
            word, _, rest = v.partition(" ")
            if word in ends:
                return nodes, word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"bad loop {v!r}")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                arms, last, cond = [], [], rest
                while True:
                    inner, end, more = body("elif", "else", "endif")
                    arms.append((_Expression(cond).whole(), inner))
                    if end == "elif":
                        cond = more
                        continue
                    if end == "else":
                        last = body("endif")[0]
                    break
                nodes.append(("if", arms, last))
            elif word == "set":
                name, _, value = rest.partition("=")
                nodes.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                nodes.append(("gen", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {v!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, "", ""

    return body()[0]


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b}


def fold(node):
    """Replace constant expressions by their value, drop dead arms, join neighbouring texts."""
    if isinstance(node, list):
        out = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if x[0] == "out" and x[1][0] == "const":
                    x = ("text", _text(x[1][1]))
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return out
    kind = node[0]
    if kind == "out":
        return ("out", fold(node[1]))
    if kind in ("op",):
        a, b = fold(node[2]), fold(node[3])
        if node[1] in ("and", "or"):
            if a[0] == "const":
                return b if bool(a[1]) == (node[1] == "and") else a
        elif a[0] == b[0] == "const":
            return ("const", _OPS[node[1]](a[1], b[1]))
        return ("op", node[1], a, b)
    if kind in ("not", "filter", "get"):
        parts = [fold(x) if isinstance(x, tuple) else x for x in node[1:]]
        if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
            return ("const", _evaluator((kind, *parts))({}))
        return (kind, *parts)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "gen":
        return ("gen", fold(node[1]))
    if kind == "if":
        arms = []
        for c, b in node[1]:
            c = fold(c)
            if c[0] == "const" and c[1]:
                return ("if", arms, fold(b)) if arms else fold(b)
            if c[0] != "const":
                arms.append((c, fold(b)))
        return ("if", arms, fold(node[2])) if arms else fold(node[2])
    return node


def _evaluator(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "not":
        f = _evaluator(e[1])
        return lambda env: not f(env)
    if kind == "filter":
        f, g = FILTERS[e[1]], _evaluator(e[2])
        return lambda env: f(g(env))
    if kind == "get":
        of, key = _evaluator(e[1]), _evaluator(e[2])

        def get(env):
            v = of(env)
            if type(v) is not dict:
                raise TemplateError("only mappings have members")
            return v.get(key(env))

        return get
    a, b = _evaluator(e[2]), _evaluator(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    f = _OPS[e[1]]
    return lambda env: f(a(env), b(env))


def _compiled(nodes: list, generated: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    parts = [_node(n, generated) for n in nodes]

    def run(env):
        for p in parts:
            yield from p(env)

    return run


def _node(n, generated: bool):
    kind = n[0]
    if kind == "text":
        return lambda env, out=((n[1], generated),): out
    if kind == "out":
        f = _evaluator(n[1])
        return lambda env: ((_text(f(env)), generated),)
    if kind == "gen":
        return _compiled(n[1], True)
    if kind == "set":
        g = _evaluator(n[2])

        def put(env, name=n[1]):
            env[name] = g(env)
            return ()

        return put
    if kind == "for":
        over, inner = _evaluator(n[2]), _compiled(n[3], generated)

        def loop(env, name=n[1]):
            for x in over(env) or ():
                yield from inner({**env, name: x})

        return loop
    arms = [(_evaluator(c), _compiled(b, generated)) for c, b in n[1]]
    last = _compiled(n[2], generated)

    def choose(env):
        return next((b for c, b in arms if c(env)), last)(env)

    return choose


class Template:
    def __init__(self, source: str = TEMPLATE):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _compiled(self.tree, False)

    def stream(self, **env) -> Iterator[tuple[str, bool]]:
        """(text, is generated) pieces, message by message."""
        return self._run(env)

    def render(self, **env) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans under the loss mask."""
        out, spans, at = [], [], 0
        for text, gen in self.stream(**env):
            if gen and text:
                spans.append((at, at + len(text)))
            at += len(text)
            out.append(text)
        return "".join(out), spans

    def __reduce__(self):
        return Template, (self.source,)


class Reader:
    """Read turns back from formatted pieces; holds one unfinished turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while True:
            if not self.rest.startswith(START):
                if START.startswith(self.rest[: len(START)]):
                    return
                raise TemplateError("a turn must open with its mark")
            end = self.rest.find(f"{END}\n")
            if end < 0:
                return
            role, _, text = self.rest[len(START) : end].partition("\n")
            yield unescape_role(role), unescape(text)
            self.rest = self.rest[end + len(END) + 1 :]


def _sorted(convs: DataFrame) -> DataFrame:
    rows = convs.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text").select("conv_id", "role", "text")


def _conversations(batches):
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for conv, turns in groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r, "content": t} for _, r, t in turns)


def _shipped(rows, schema: pa.Schema, most: int = 500):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(convs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive); each conversation's text is built whole."""
    compiled = Template(template)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        def one():
            for conv, messages in _conversations(batches):
                text, spans = compiled.render(messages=messages)
                yield conv, text, [{"start": a, "end": b} for a, b in spans]

        yield from _shipped(one(), schema, 100)

    return _sorted(convs.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest(pieces: Iterator[tuple[str, bool]]) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted pieces as they come."""
    reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
    n = chars = size = 0
    for text, gen in pieces:
        size += len(text)
        if gen:
            plain = unescape(text)
            chars += len(plain)
            loss.update(plain.encode("utf-8", "surrogatepass"))
        for role, said in reader.feed(text):
            n += 1
            turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
    if reader.rest:
        raise TemplateError("the last turn isn't closed")
    return n, turns.hexdigest(), chars, loss.hexdigest(), size


def digests(convs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; conversations stream through."""
    compiled = Template(template)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names])

    def run(batches):
        yield from _shipped(((conv, *digest(compiled.stream(messages=messages))) for conv, messages in _conversations(batches)), schema)

    return _sorted(convs.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names))
