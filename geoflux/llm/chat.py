"""Chat formatting with a small sandboxed template language.

A template is lexed and parsed into a syntax tree, constants are folded, and
the tree becomes Python closures that yield the pieces of a formatted
conversation. There is no access to attributes of Python objects, no calls
and no assignment: only the fields of the message at hand, ``loop`` counters,
strings, integers, comparisons, ``and``, ``or``, ``not``, ``+`` and the
filters ``trim``, ``upper``, ``lower``, ``length``, ``escape`` and ``escape_line``.

    {% for message in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      what is generated, for the loss mask
    {{ e | filter }}                              {# comment #}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Marks a turn and ends it; a backslash before a mark or a backslash escapes it inside texts.
TURN, END = "### ", "</turn>"
TEMPLATE = (
    "{% for message in messages %}"
    "### {{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)


def escape(s: str) -> str:
    """Control strings made harmless, reversibly: a backslash before every backslash, '#' and '<'."""
    return s.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_line(s: str) -> str:
    """As ``escape``, and a backslash before every line feed, so that the first bare one ends a line."""
    return escape(s).replace("\n", "\\\n")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {"trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len, "escape": escape, "escape_line": escape_line}
FIELDS = {"message": {"role", "text", "turn"}, "loop": {"index", "first"}}
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expr:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.toks, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] != "str" and self.toks[self.i][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.i >= len(self.toks) or kind and self.toks[self.i][0] != kind:
            raise TemplateError("expression ends too early or has another token than expected")
        self.i += 1
        return self.toks[self.i - 1][1]

    def parse(self) -> tuple:
        node = self.either()
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.total()
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            node = (self.take(), node, self.total())
        return node

    def total(self) -> tuple:
        node = self.piped()
        while self.peek("+"):
            self.take()
            node = ("+", node, self.piped())
        return node

    def piped(self) -> tuple:
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.peek("("):
            self.take()
            node = self.either()
            if not self.peek(")"):
                raise TemplateError("missing )")
            self.take()
            return node
        kind, value = self.toks[self.i] if self.i < len(self.toks) else (None, "")
        self.i += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in FIELDS and self.peek("."):
            self.take()
            field = self.take("name")
            if field not in FIELDS[value]:
                raise TemplateError(f"{value} has no {field!r}")
            return ("field", value, field)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts = re.split(r"(\{%.*?%\}|\{\{.*?\}\}|\{#.*?#\})", source, flags=re.DOTALL)
    stack: list[tuple[str, list, list]] = [("root", [], [])]
    looped = generating = False
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{#") or not part:
            continue
        if part.startswith("{{"):
            body.append(("out", _Expr(part[2:-2]).parse()))
        elif not part.startswith("{%"):
            body.append(("out", ("const", part)))
        else:
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                if rest.split() != ["message", "in", "messages"] or looped or len(stack) > 1:
                    raise TemplateError("the one loop is: for message in messages, at the top")
                looped = True
                stack.append(("for", [], []))
            elif word == "if":
                stack.append(("if", [], [_Expr(rest).parse()]))
            elif word in ("elif", "else") and stack[-1][0] == "if" and stack[-1][2][-1] is not None:
                _, done, state = stack.pop()
                state += [list(done), _Expr(rest).parse() if word == "elif" else None]
                stack.append(("if", [], state))
            elif word == "generation" and not generating:
                generating = True
                stack.append(("generation", [], []))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
                kind, done, state = stack.pop()
                if kind == "if":
                    state.append(done)
                    stack[-1][1].append(("if", list(zip(state[::2], state[1::2], strict=True))))
                else:
                    generating &= kind != "generation"
                    stack[-1][1].append((kind, done))
            else:
                raise TemplateError(f"unexpected {part!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][1]


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}",
}


def fold_expr(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("const", "field"):
        return e
    if kind == "filter":
        inner = fold_expr(e[2])
        return ("const", FILTERS[e[1]](inner[1])) if inner[0] == "const" else ("filter", e[1], inner)
    sub = [fold_expr(x) for x in e[1:]]
    if kind == "not":
        return ("const", not sub[0][1]) if sub[0][0] == "const" else ("not", sub[0])
    if kind in ("and", "or") and sub[0][0] == "const":
        return sub[1] if bool(sub[0][1]) == (kind == "and") else sub[0]
    if kind in _OPS and all(x[0] == "const" for x in sub):
        return ("const", _OPS[kind](sub[0][1], sub[1][1]))
    return (kind, *sub)


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions evaluated, dead branches gone and neighbouring constants joined."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "out":
            new = [("out", fold_expr(node[1]))]
        elif node[0] == "if":
            arms, new = [], []
            for test, body in node[1]:
                test = ("const", True) if test is None else fold_expr(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                new = arms[0][1]
            elif arms:
                new = [("if", arms)]
        else:
            new = [(node[0], fold(node[1]))]
        for x in new:
            if x[0] == "out" and x[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
                out[-1] = ("out", ("const", f"{out[-1][1][1]}{x[1][1]}"))
            else:
                out.append(x)
    return out


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "field":
        return lambda env, a=e[1], b=e[2]: env[a][b]
    if kind == "filter":
        return lambda env, f=FILTERS[e[1]], v=_value(e[2]): f(v(env))
    subs = [_value(x) for x in e[1:]]
    if kind == "not":
        return lambda env, a=subs[0]: not a(env)
    if kind == "and":
        return lambda env, a=subs[0], b=subs[1]: a(env) and b(env)
    if kind == "or":
        return lambda env, a=subs[0], b=subs[1]: a(env) or b(env)
    return lambda env, f=_OPS[kind], a=subs[0], b=subs[1]: f(a(env), b(env))


Piece = tuple[str, bool]


def _emit(nodes: list[tuple], generated: bool) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable[[dict], Iterable[Piece]]] = []
    for node in nodes:
        kind = node[0]
        if kind == "out" and node[1][0] == "const":
            steps.append(lambda env, p=((str(node[1][1]), generated),): p)
        elif kind == "out":
            steps.append(lambda env, v=_value(node[1]): ((str(v(env)), generated),))
        elif kind == "generation":
            steps.append(_emit(node[1], True))
        elif kind == "if":
            arms = [(_value(test), _emit(body, generated)) for test, body in node[1]]

            def choose(env: dict, arms: list = arms) -> Iterable[Piece]:
                for test, body in arms:
                    if test(env):
                        return body(env)
                return ()

            steps.append(choose)
        else:  # for: messages are drawn one by one, so a conversation of any length streams through
            body = _emit(node[1], generated)

            def loop(env: dict, body: Callable = body) -> Iterator[Piece]:
                for i, m in enumerate(env["messages"]):
                    yield from body({"message": m, "loop": {"index": i + 1, "first": i == 0}})

            steps.append(loop)

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (role, text, turn) to pieces (text, whether generated)."""
    run = _emit(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


def _bare(s: str, mark: str) -> int:
    """Where the mark first stands without an odd number of backslashes before it, or -1."""
    at = s.find(mark)
    while at >= 0:
        k = at
        while k and s[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at = s.find(mark, at + 1)
    return -1


class Reader:
    """Reads the default template's output back, piece by piece, in bounded memory: one turn at a time."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rest = ""
        self.mask = ""  # generated text not yet unescaped

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        self.rest += text
        if generated:
            self.mask += text
        if "</turn>\n" in text:
            self._cut()

    def _cut(self) -> None:
        # Escaped texts hold no bare '<', so a bare one starts the end mark.
        while (at := _bare(self.rest, "</turn>\n")) >= 0:
            turn, self.rest = self.rest[:at], self.rest[at + len(END) + 1 :]
            head, body = self._split(turn)
            self.n += 1
            self.turns.update(f"{unescape(head)}\n{unescape(body)}\n".encode("utf-8", "replace"))
            loss = unescape(self.mask)
            self.loss.update(loss.encode("utf-8", "replace"))
            self.loss_chars += len(loss)
            self.mask = ""

    @staticmethod
    def _split(turn: str) -> tuple[str, str]:
        if not turn.startswith(TURN):
            raise ValueError("a turn without its mark")
        at = _bare(turn, "\n")
        return turn[len(TURN) : at], turn[at + 1 :]


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn. Equal turns are ordered by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            yield from batch.slice(i, 1000).to_pylist()


def format_chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, turn, piece_no, piece, generated): the formatted text of each conversation in pieces, in order.

    Conversations stream through a task: no more than a turn is held, however
    long a conversation is. Null roles and texts are empty; a null turn comes
    first; rows with a null ``conv_id`` are one conversation; repeated rows are
    turns of their own. Other columns are not read. ``format_texts`` joins the
    pieces into a text.
    """
    ship(conversations.sparkSession)
    compile_template(template)  # errors show before the job runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        render = compile_template(template)
        for conv, rows in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            out: list[tuple] = []
            for no, (piece, generated) in enumerate(render(rows)):
                out.append((conv, no, piece, generated))
                if len(out) >= 1000:
                    yield _pieces(out)
                    out = []
            yield _pieces(out)

    return _ordered(conversations).mapInArrow(run, "conv_id long, piece_no long, piece string, generated boolean")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
        names=["conv_id", "piece_no", "piece", "generated"],
    )


def format_texts(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, text, loss_spans array<struct<start, end>>): whole formatted texts with the generated spans in code points."""
    ship(conversations.sparkSession)
    compile_template(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        render = compile_template(template)
        for conv, rows in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            pieces, spans, at = [], [], 0
            for piece, generated in render(rows):
                if generated:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(piece)
                    else:
                        spans.append({"start": at, "end": at + len(piece)})
                pieces.append(piece)
                at += len(piece)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(pieces)]), pa.array([spans], kind)], names=["conv_id", "text", "loss_spans"])

    return _ordered(conversations).mapInArrow(run, "conv_id long, text string, loss_spans array<struct<start: long, end: long>>")


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The digests of the contract, read back from the formatted output as it streams."""
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        render, out = compile_template(template), []
        for conv, rows in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            r = Reader()
            for piece, generated in render(rows):
                r.feed(piece, generated)
            if r.rest:
                raise ValueError("the output does not end with a turn")
            out.append((conv, r.n, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars))
            if len(out) >= 1000:
                yield _table(out)
                out = []
        yield _table(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(conversations.select("conv_id", "turn", "role", "text").union(extra))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), s AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), chr(10), '\' || chr(10)) AS r, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS t FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 13)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
