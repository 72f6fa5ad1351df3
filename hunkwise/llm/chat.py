"""Chat formatting: a small template language, compiled to closures.

    {{ expression }}   {% for m in messages %} ... {% endfor %}
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

Expressions: names, ``m.role``, ``loop.first``, ``loop.index``, strings, integers,
true/false/none, ``+ == != and or not``, parentheses, and the filters ``escape``, ``line``,
``trim``, ``upper``, ``lower``. There are no calls, no indexing and no attributes of Python objects, so a
template reaches nothing but its inputs. Constants are folded; the closures are
generators, so a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}"
    "<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n"
    "{% endfor %}"
)

_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string can be read in the result; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def one_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": one_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not well formed."""


# --- parsing: a tree of tuples ---

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:]!r}")
        string, number, name, sign = m.groups()
        if string is not None:
            out.append(("const", _BACK.sub(lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1])))
        elif number is not None:
            out.append(("const", int(number)))
        elif name is not None:
            out.append(("const", _WORDS[name]) if name in _WORDS else ("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """or < and < not < == != < + < filter < atom, by recursive descent; every node is folded as it is made."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def parse(self) -> tuple:
        node = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind != "const" and text in texts:
                self.at += 1
                return text
        return None

    def chain(self, below: Callable[[], tuple], *signs: str) -> tuple:
        node = below()
        while sign := self.take(*signs):
            node = fold((sign, node, below()))
        return node

    def any_of(self) -> tuple:
        return self.chain(lambda: self.chain(self.negation, "and"), "or")

    def negation(self) -> tuple:
        return fold(("not", self.negation())) if self.take("not") else self.chain(lambda: self.chain(self.piped, "+"), "==", "!=")

    def piped(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = fold(("filter", name, node))
        return node

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def atom(self) -> tuple:
        if self.take("("):
            node = self.any_of()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return self.tokens[self.at - 1]
        name = self.word()
        return ("field", name, self.word()) if self.take(".") else ("name", name)


def fold(node: tuple) -> tuple:
    """A node whose inputs are all constants is a constant."""
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    if parts and all(x[0] == "const" for x in parts):
        return ("const", expression(node)({}))
    return node


def parse(template: str) -> list[tuple]:
    """The template as nodes: text, out, for, if, generation."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        pieces.append(("text", template[at : m.start()]))
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    pieces = [p for p in [*pieces, ("text", template[at:])] if p[1] or p[0] != "text"]
    nodes, rest = _block(pieces, ())
    if rest:
        raise TemplateError(f"unexpected {rest[0][1]!r}")
    return nodes


def _block(pieces: list, ends: tuple[str, ...]) -> tuple[list[tuple], list]:
    nodes: list[tuple] = []
    while pieces:
        kind, body = pieces[0]
        word = body.split(None, 1)[0] if kind == "tag" and body else ""
        if kind == "tag" and word in ends:
            return _joined(nodes), pieces
        pieces = pieces[1:]
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "out":
            node = _Expression(body).parse()
            nodes.append(("text", _shown(node[1])) if node[0] == "const" else ("out", node))
        elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", body):
            inner, pieces = _closed(pieces, "endfor")
            nodes.append(("for", m[1], m[2], inner))
        elif word == "if":
            node, pieces = _if(body[2:], pieces)
            nodes += node[1] if node[0] == "nodes" else [node]
        elif body == "generation":
            inner, pieces = _closed(pieces, "endgeneration")
            nodes.append(("generation", inner))
        else:
            raise TemplateError(f"unexpected {body!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return _joined(nodes), []


def _closed(pieces: list, end: str) -> tuple[list[tuple], list]:
    inner, rest = _block(pieces, (end,))
    return inner, rest[1:]


def _if(test: str, pieces: list) -> tuple[tuple, list]:
    cond = _Expression(test).parse()
    yes, rest = _block(pieces, ("elif", "else", "endif"))
    tag, rest = rest[0][1], rest[1:]
    no: list[tuple] = []
    if tag.startswith("elif"):
        node, rest = _if(tag[4:], rest)
        no = node[1] if node[0] == "nodes" else [node]
    elif tag == "else":
        no, rest = _closed(rest, "endif")
    if cond[0] == "const":
        return ("nodes", yes if cond[1] else no), rest
    return ("if", cond, yes, no), rest


def _joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring texts as one."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


# --- closures ---


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "field":
        return lambda scope, n=node[1], f=node[2]: (scope.get(n) or {}).get(f)
    if kind == "filter":
        inner, fn = expression(node[2]), FILTERS[node[1]]
        return lambda scope: fn(_shown(inner(scope)))
    if kind == "not":
        inner = expression(node[1])
        return lambda scope: not inner(scope)
    a, b = expression(node[1]), expression(node[2])
    return {
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "+": lambda scope: a(scope) + b(scope)
        if isinstance(a(scope), int) and isinstance(b(scope), int)
        else _shown(a(scope)) + _shown(b(scope)),
    }[kind]


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def compile_nodes(nodes: list[tuple]) -> Render:
    """A generator function of (scope, inside a generation) that yields (text, inside)."""
    parts = [_compile(node) for node in nodes]

    def render(scope: dict, inside: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope, inside)

    return render


def _compile(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda scope, inside, t=node[1]: iter(((t, inside),))
    if kind == "out":
        value = expression(node[1])
        return lambda scope, inside: iter(((_shown(value(scope)), inside),))
    if kind == "generation":
        inner = compile_nodes(node[1])
        return lambda scope, inside: inner(scope, True)
    if kind == "if":
        test, yes, no = expression(node[1]), compile_nodes(node[2]), compile_nodes(node[3])
        return lambda scope, inside: yes(scope, inside) if test(scope) else no(scope, inside)
    name, source, body = node[1], node[2], compile_nodes(node[3])

    def loop(scope: dict, inside: bool) -> Iterator[tuple[str, bool]]:
        for i, item in enumerate(scope.get(source) or ()):
            yield from body({**scope, name: item, "loop": {"index": i + 1, "first": i == 0}}, inside)

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """messages -> (text, is in a generation) pieces, lazily."""
    render = compile_nodes(parse(template))
    return lambda messages: render({"messages": messages}, False)


# --- Spark ---

BATCH_CHARS = 4_000_000
PIECES = "conv_id bigint, piece bigint, text string, in_loss boolean"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows, chars = [], 0

        def give() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ("conv_id", "piece", "text", "in_loss")
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for conv, turns in itertools.groupby(_stream(batches), key=lambda r: r[0]):
            messages = ({"role": r[1] or "", "text": r[2] or ""} for r in turns)
            for number, (text, inside) in enumerate(render(messages)):
                rows.append((conv, number, text, inside))
                chars += len(text) + 40
                if chars > BATCH_CHARS:
                    yield give()
                    rows, chars = [], 0
        if rows:
            yield give()

    return run


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """Rendered conversations as consecutive pieces: conv_id, piece, text, in_loss.

    A conversation's output is its pieces joined in order; ``in_loss`` marks what was made
    inside a generation. Rows stay in that order within their partition. A conversation is
    streamed turn by turn, so its length is not bound by memory.

    Turns are ordered by ``turn`` (nulls first), ties by role and text, so repeated rows are
    rendered each. A null role or text is empty; a null ``conv_id`` is a conversation of
    its own. An empty table gives no rows; other columns are not looked at.
    """
    return (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_formatter(template), PIECES)
    )


def _turns_in(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a formatted conversation; a turn is held at a time."""
    held = ""
    for piece in pieces:
        held += piece
        if piece.endswith("\n"):
            while (stop := held.find(END + "\n")) >= 0:
                turn, held = held[:stop], held[stop + len(END) + 1 :]
                role, _, text = turn.removeprefix(START).partition("\n")
                yield unescape(role), unescape(text)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, rows in itertools.groupby(_stream(batches), key=lambda r: r[0]):
        loss, loss_chars, chars, n_turns, turns = hashlib.sha256(), 0, 0, 0, hashlib.sha256()

        def noted(rows=rows) -> Iterator[str]:
            nonlocal loss_chars, chars
            for _, _, text, inside in rows:
                chars += len(text)
                if inside:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8", "replace"))
                yield text

        for role, text in _turns_in(noted()):
            n_turns += 1
            turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "conv_id": conv,
                    "n_turns": n_turns,
                    "turns_sha256": turns.hexdigest(),
                    "loss_chars": loss_chars,
                    "loss_sha256": loss.hexdigest(),
                    "formatted_chars": chars,
                }
            ],
            schema=pa.schema(
                [
                    ("conv_id", pa.int64()),
                    ("n_turns", pa.int64()),
                    ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()),
                ]
            ),
        )


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations as counts and digests, read from the output alone."""
    return pieces.mapInArrow(
        _reader,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
