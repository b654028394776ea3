"""Chat formatting by a template compiler.

The template language is a small sandbox: ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}`` / ``{% else %}``,
``{% generation %}`` ... ``{% endgeneration %}``.  Expressions know string literals, ``+`` (concatenation), ``==``, ``!=``,
``not``, ``and``, ``or``, the loop's message fields (``m.role``, ``m.text``), ``loop.first`` and the filters ``escape`` and
``line``; nothing else can be named or called.  ``compile_template`` parses it into a syntax tree of tuples, folds constants
(joins neighbouring text, evaluates constant expressions, drops dead branches) and generates Python closures that write
pieces to a sink; the sink notes where generation begins and ends.

Escaping is reversible: each control string gets one backslash more after its first character, ``read`` takes one away.

Rows are dealt by conversation and sorted by turn; rendering, reading back and hashing run along the sorted rows and hold
one turn at a time, so a conversation of any length fits.

Edge cases: null texts and roles are empty, rows of null conv_id are one conversation, ties and repeated rows of a turn are
ordered by role and text, an empty table gives the conversations added by the query only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat formats.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>")
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_' + 'start|>' }}{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
_ESC = re.compile("(?:" + "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS) + ")")
_UNESC = re.compile("(?:" + "|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS) + ")")


def escape(s: str) -> str:
    return _ESC.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    return _UNESC.sub(lambda m: m[0][0] + m[0][2:], s)


def line(s: str) -> str:
    """One line: backslash and line feed spelled out, control strings escaped."""
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unline(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s), flags=re.S)


FILTERS = {"escape": escape, "line": line}

# -- parser: source -> syntax tree ------------------------------------------------------------------------------
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_][\w.]*)|(==|!=|[+|()]))")


class TemplateError(ValueError):
    """The template is not in the language."""


def _lex(src: str) -> list[str]:
    out, at, src = [], 0, src.strip()
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError(f"unexpected text: {src[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Expr:
    """Recursive descent: or < and < not < (==, !=) < + < filters."""

    def __init__(self, src: str, names: set[str]):
        self.t, self.names = _lex(src), names

    def take(self, *want: str) -> str | None:
        if self.t and self.t[0] in want:
            return self.t.pop(0)
        return None

    def whole(self):
        e = self.level(0)
        if self.t:
            raise TemplateError(f"unexpected {self.t[0]!r}")
        return e

    def level(self, n: int):
        if n == 2 and self.take("not"):
            return ("not", self.level(2))
        if n == 5:
            return self.filtered()
        ops = (("or",), ("and",), (), ("==", "!="), ("+",))[n]
        left = self.level(n + 1)
        while op := self.take(*ops):
            left = (op, left, self.level(n + 1))
        return left

    def filtered(self):
        e = self.atom()
        while self.take("|"):
            name = self.t.pop(0) if self.t else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def atom(self):
        if self.take("("):
            e = self.level(0)
            if not self.take(")"):
                raise TemplateError("missing )")
            return e
        t = self.t.pop(0) if self.t else ""
        if t.startswith("'"):
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), t[1:-1]))
        if t in self.names:
            return ("name", t)
        raise TemplateError(f"unknown name {t!r}")


def parse(source: str):
    """Syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces += [("text", source[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", source[at:]))

    def block(names: set[str], ends: tuple[str, ...]):
        body = []
        while pieces:
            kind, v = pieces.pop(0)
            if kind == "text":
                body.append(("const", v))
            elif kind == "out":
                body.append(_Expr(v, names).whole())
            elif v in ends:
                return ("seq", body), v
            elif m := re.fullmatch(r"for (\w+) in messages", v):
                inner = names | {f"{m[1]}.role", f"{m[1]}.text", "loop.first"}
                body.append(("for", m[1], block(inner, ("endfor",))[0]))
            elif v.startswith("if "):
                cond = _Expr(v[3:], names).whole()
                then, end = block(names, ("else", "endif"))
                other = block(names, ("endif",))[0] if end == "else" else ("seq", [])
                body.append(("if", cond, then, other))
            elif v == "generation":
                body.append(("generation", block(names, ("endgeneration",))[0]))
            else:
                raise TemplateError(f"unexpected tag {v!r}")
        if ends != ("",):
            raise TemplateError(f"missing {ends[-1]}")
        return ("seq", body), ""

    return block(set(), ("",))[0]


# -- constant folding -------------------------------------------------------------------------------------------
def _apply(op: str, *v):
    return {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
            "and": lambda a, b: a and b, "or": lambda a, b: a or b}[op](*v)


def fold(t):
    kind = t[0]
    if kind in ("+", "==", "!=", "and", "or", "not"):
        args = [fold(x) for x in t[1:]]
        return ("const", _apply(kind, *[a[1] for a in args])) if all(a[0] == "const" for a in args) else (kind, *args)
    if kind == "filter":
        e = fold(t[2])
        return ("const", FILTERS[t[1]](e[1])) if e[0] == "const" else ("filter", t[1], e)
    if kind == "seq":
        out: list = []
        for x in map(fold, t[1]):
            for y in x[1] if x[0] == "seq" else [x]:
                if y[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", str(out[-1][1]) + str(y[1]))
                elif y != ("const", ""):
                    out.append(y)
        return ("seq", out)
    if kind == "if":
        cond = fold(t[1])
        return fold(t[2] if cond[1] else t[3]) if cond[0] == "const" else ("if", cond, fold(t[2]), fold(t[3]))
    if kind == "for":
        return ("for", t[1], fold(t[2]))
    if kind == "generation":
        return ("generation", fold(t[1]))
    return t


# -- closures ---------------------------------------------------------------------------------------------------
class Sink:
    """Pieces of the output, its length, and the spans of generated text."""

    def __init__(self):
        self.pieces, self.length, self.spans = [], 0, []

    def write(self, s: str) -> None:
        self.pieces.append(s)
        self.length += len(s)


def _value(t):
    kind = t[0]
    if kind == "const":
        return lambda env, v=t[1]: v
    if kind == "name":
        return lambda env, k=t[1]: env[k]
    if kind == "filter":
        f, e = FILTERS[t[1]], _value(t[2])
        return lambda env: f(e(env))
    args = [_value(x) for x in t[1:]]
    if kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if kind == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(kind, *[a(env) for a in args])


def _render(t):
    """Closure (env, sink) -> iterator that yields after every message of a loop, so that callers can stream."""
    kind = t[0]
    if kind == "seq":
        parts = [_render(x) for x in t[1]]

        def seq(env, sink):
            for p in parts:
                yield from p(env, sink)

        return seq
    if kind == "for":
        name, body = t[1], _render(t[2])

        def loop(env, sink):
            for i, (role, text) in enumerate(env["messages"]):
                yield from body(env | {f"{name}.role": role, f"{name}.text": text, "loop.first": i == 0}, sink)
                yield sink

        return loop
    if kind == "if":
        cond, then, other = _value(t[1]), _render(t[2]), _render(t[3])

        def branch(env, sink):
            yield from (then if cond(env) else other)(env, sink)

        return branch
    if kind == "generation":
        inner = _render(t[1])

        def mark(env, sink):
            start = sink.length
            yield from inner(env, sink)
            sink.spans.append((start, sink.length))

        return mark
    value = _value(t)

    def write(env, sink):
        sink.write(value(env))
        yield from ()

    return write


def compile_template(source: str):
    """``render(messages, sink)``: messages is an iterator of (role, text); yields the sink after every message."""
    tree = _render(fold(parse(source)))
    return lambda messages, sink: tree({"messages": messages}, sink)


def format_conversation(messages, source: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans of the loss mask (code points)."""
    sink = Sink()
    for _ in compile_template(source)(iter(messages), sink):
        pass
    return "".join(sink.pieces), sink.spans


_START, _END = CONTROLS[0], CONTROLS[1] + "\n"


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of what ``TEMPLATE`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(_START, at):
            raise ValueError(f"no turn at {at}")
        nl = formatted.index("\n", at)
        end = formatted.index(_END, nl + 1)
        out.append((unline(formatted[at + len(_START) : nl]), unescape(formatted[nl + 1 : end])))
        at = end + len(_END)
    return out


class _Digest:
    """What the query returns of one conversation, read back from its output turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, sink: Sink) -> None:
        text = "".join(sink.pieces)
        base = sink.length - len(text)
        for role, said in read(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for a, b in sink.spans:
            plain = unescape(text[a - base : b - base])
            self.loss += len(plain)
            self.masked.update(plain.encode("utf-8", "surrogatepass"))
        sink.pieces, sink.spans = [], []
        self.chars = sink.length

    def row(self):
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _run(source: str):
    def run(batches):
        from itertools import groupby

        render = compile_template(source)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]

        def rows():
            for b in batches:
                yield from zip(*[b.column(i).to_pylist() for i in range(3)])

        done = []
        for conv, turns in groupby(rows(), key=lambda r: r[0]):
            digest, sink = _Digest(conv), Sink()
            for _ in render(((r or "", t or "") for _, r, t in turns), sink):
                digest.take(sink)
            done.append(digest.row())
            if len(done) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return run


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """Digests of every conversation's formatted text and loss mask, read back from the output."""
    return _sorted_turns(conversations).mapInArrow(_run(source), _SCHEMA)


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, loss): the text of each turn in order, with its loss spans inside that text."""

    def run(batches):
        from itertools import groupby

        render = compile_template(source)
        for conv, turns in groupby((r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(3)])), key=lambda r: r[0]):
            sink, n = Sink(), 0
            for _ in render(((r or "", t or "") for _, r, t in turns), sink):
                text = "".join(sink.pieces)
                base = sink.length - len(text)
                spans = [[a - base, b - base] for a, b in sink.spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([text]), pa.array([spans], pa.list_(pa.list_(pa.int64())))],
                    ["conv_id", "part", "formatted", "loss"],
                )
                sink.pieces, sink.spans, n = [], [], n + 1

    return _sorted_turns(conversations).mapInArrow(run, "conv_id long, part long, formatted string, loss array<array<long>>")
