"""Chat formatting by a compiled, sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested Python
closures that stream their output.  The language has literals, names, fields of a record, a fixed set of
filters, ``==``, ``!=``, ``and``, ``or``, ``not``, ``~`` (joining), and the blocks ``for``, ``if`` /
``else`` and ``generation``.  Nothing else of Python can be reached.  Text rendered inside a
``generation`` block carries the loss mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: The control strings of the production template.
TURN, END = "### ", " </turn>\n"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '###' ~ ' ' }}{{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ ' </turn>' ~ '\\n' }}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Puts a backslash before every backslash and before every control string."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return regex.sub(r"(?s)\\(.)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_role": lambda s: escape(s).replace(":", "\\:"),
    "upper": str.upper,
    "lower": str.lower,
    "trim": str.strip,
}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_TOKENS = regex.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|~()]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class Parser:
    def __init__(self, source: str):
        self.pieces = [p for p in regex.split(r"(?s)(\{\{.*?\}\}|\{%.*?%\})", source) if p]
        self.at = 0

    def parse(self) -> Node:
        body = self.block(set())
        if self.at < len(self.pieces):
            raise TemplateError(f"unexpected {self.pieces[self.at]!r}")
        return body

    def block(self, ends: set[str]) -> Node:
        """Nodes up to a tag whose word is in ``ends``; the tag itself stays."""
        nodes = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            if piece.startswith("{{"):
                self.at += 1
                nodes.append(Node("out", parts=[self.expression(piece[2:-2])]))
            elif piece.startswith("{%"):
                words = piece[2:-2].split(None, 1)
                if not words:
                    raise TemplateError("empty tag")
                if words[0] in ends:
                    break
                self.at += 1
                nodes.append(self.tag(words[0], words[1].strip() if len(words) > 1 else ""))
            else:
                self.at += 1
                nodes.append(Node("text", piece))
        return Node("block", parts=nodes)

    def close(self, word: str) -> None:
        if self.at >= len(self.pieces) or self.pieces[self.at][2:-2].strip() != word:
            raise TemplateError(f"missing {word}")
        self.at += 1

    def tag(self, word: str, rest: str) -> Node:
        if word == "for":
            m = regex.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest)
            if not m:
                raise TemplateError(f"bad for: {rest!r}")
            body = self.block({"endfor"})
            self.close("endfor")
            return Node("for", m[1], [self.expression(m[2]), body])
        if word == "if":
            test, body, other = self.expression(rest), self.block({"else", "endif"}), Node("block")
            if self.at < len(self.pieces) and self.pieces[self.at][2:-2].strip() == "else":
                self.at += 1
                other = self.block({"endif"})
            self.close("endif")
            return Node("if", parts=[test, body, other])
        if word == "generation":
            body = self.block({"endgeneration"})
            self.close("endgeneration")
            return Node("generation", parts=[body])
        raise TemplateError(f"unknown tag {word!r}")

    def expression(self, source: str) -> Node:
        tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        node, rest = self.alternatives(tokens)
        if rest:
            raise TemplateError(f"unexpected {rest[0][1]!r}")
        return node

    def _chain(self, tokens: list, word: tuple, below: Callable, kind: str) -> tuple[Node, list]:
        node, tokens = below(tokens)
        while tokens and tokens[0] == word:
            other, tokens = below(tokens[1:])
            node = Node(kind, parts=[node, other])
        return node, tokens

    def alternatives(self, tokens: list) -> tuple[Node, list]:
        return self._chain(tokens, ("name", "or"), self.conjunction, "or")

    def conjunction(self, tokens: list) -> tuple[Node, list]:
        return self._chain(tokens, ("name", "and"), self.negation, "and")

    def negation(self, tokens: list) -> tuple[Node, list]:
        if tokens and tokens[0] == ("name", "not"):
            node, tokens = self.negation(tokens[1:])
            return Node("not", parts=[node]), tokens
        return self.comparison(tokens)

    def comparison(self, tokens: list) -> tuple[Node, list]:
        node, tokens = self.joined(tokens)
        if tokens and tokens[0] in (("op", "=="), ("op", "!=")):
            other, rest = self.joined(tokens[1:])
            return Node(tokens[0][1], parts=[node, other]), rest
        return node, tokens

    def joined(self, tokens: list) -> tuple[Node, list]:
        return self._chain(tokens, ("op", "~"), self.filtered, "~")

    def filtered(self, tokens: list) -> tuple[Node, list]:
        node, tokens = self.atom(tokens)
        while tokens and tokens[0] == ("op", "|"):
            if len(tokens) < 2 or tokens[1][1] not in FILTERS:
                raise TemplateError("unknown filter")
            node, tokens = Node("filter", tokens[1][1], [node]), tokens[2:]
        return node, tokens

    def atom(self, tokens: list) -> tuple[Node, list]:
        if not tokens:
            raise TemplateError("missing value")
        (kind, word), tokens = tokens[0], tokens[1:]
        if kind == "str":
            return Node("const", regex.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1])), tokens
        if kind == "int":
            return Node("const", int(word)), tokens
        if (kind, word) == ("op", "("):
            node, tokens = self.alternatives(tokens)
            if not tokens or tokens[0] != ("op", ")"):
                raise TemplateError("missing )")
            return node, tokens[1:]
        if kind != "name":
            raise TemplateError(f"unexpected {word!r}")
        node = Node("name", word)
        while len(tokens) > 1 and tokens[0] == ("op", ".") and tokens[1][0] == "name":
            node, tokens = Node("field", tokens[1][1], [node]), tokens[2:]
        return node, tokens


def _text(value: object) -> str:
    return "" if value is None else str(value)


def fold(node: Node) -> Node:
    """Evaluates what is constant, drops branches that cannot be taken and joins neighbouring text."""
    node.parts = [fold(p) for p in node.parts]
    constant = bool(node.parts) and all(p.kind == "const" for p in node.parts)
    if constant and node.kind in ("~", "==", "!=", "and", "or", "not", "filter"):
        return Node("const", evaluate(node)({}))
    if node.kind == "out" and constant:
        return Node("text", _text(node.parts[0].value))
    if node.kind == "if" and node.parts[0].kind == "const":
        return node.parts[1] if node.parts[0].value else node.parts[2]
    if node.kind == "block":
        joined: list[Node] = []
        for part in (x for p in node.parts for x in (p.parts if p.kind == "block" else [p])):
            if part.kind == "text" and joined and joined[-1].kind == "text":
                joined[-1] = Node("text", joined[-1].value + part.value)
            elif part.kind != "text" or part.value:
                joined.append(part)
        node.parts = joined
    return node


def evaluate(node: Node) -> Callable[[dict], object]:
    """Closure that computes an expression in an environment."""
    if node.kind == "const":
        return lambda env: node.value
    if node.kind == "name":
        return lambda env: env.get(node.value)
    parts = [evaluate(p) for p in node.parts]
    if node.kind == "field":

        def of_record(env: dict) -> object:
            record = parts[0](env)
            return record.get(node.value) if isinstance(record, dict) else None

        return of_record
    if node.kind == "filter":
        change = FILTERS[node.value]
        return lambda env: change(_text(parts[0](env)))
    if node.kind == "not":
        return lambda env: not parts[0](env)
    a, b = parts
    return {
        "~": lambda env: _text(a(env)) + _text(b(env)),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
    }[node.kind]


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def generate(node: Node) -> Render:
    """Closure that streams (text, under the loss mask) pieces."""
    if node.kind == "text":

        def text(env: dict, masked: bool) -> Iterator[tuple[str, bool]]:
            yield node.value, masked

        return text
    if node.kind == "out":
        value = evaluate(node.parts[0])

        def out(env: dict, masked: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(env)), masked

        return out
    if node.kind == "for":
        items, body = evaluate(node.parts[0]), generate(node.parts[1])

        def loop(env: dict, masked: bool) -> Iterator[tuple[str, bool]]:
            for item in items(env) or ():
                yield from body({**env, node.value: item}, masked)

        return loop
    if node.kind == "if":
        test, body, other = evaluate(node.parts[0]), generate(node.parts[1]), generate(node.parts[2])
        return lambda env, masked: (body if test(env) else other)(env, masked)
    if node.kind == "generation":
        inside = generate(node.parts[0])
        return lambda env, masked: inside(env, True)
    parts = [generate(p) for p in node.parts]

    def block(env: dict, masked: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(env, masked)

    return block


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts, any iterable) to a stream of (text, masked) pieces."""
    render = generate(fold(Parser(source).parse()))
    return lambda messages: render({"messages": messages}, False)


def render_text(messages: Iterable[dict], source: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for piece, masked in compile_template(source)(messages):
        if masked and piece:
            spans.append((at, at + len(piece)))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


_TURN = regex.compile(r"(?s)### ((?:[^\\:]|\\.)*+): ((?:\\.|(?! </turn>\n)[^\\])*+) </turn>\n")


def read_back(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, masked text, length) of every turn in a stream of formatted output."""
    held, spans, size = [], [], 0
    for piece, masked in pieces:
        if masked and piece:
            spans.append((size, size + len(piece)))
        held.append(piece)
        size += len(piece)
        if END in piece:
            whole = "".join(held)
            at = 0
            while m := _TURN.match(whole, at):
                loss = "".join(unescape(whole[max(s, at) : min(e, m.end())]) for s, e in spans if s < m.end() and e > at)
                yield unescape(m[1]), unescape(m[2]), loss, m.end() - at
                at = m.end()
            if at:
                spans = [(s - at, e - at) for s, e in spans if s >= at]
                held, size = [whole[at:]], len(whole) - at
    if size:
        raise ValueError("the output ends inside a turn")


def separable(source: str = TEMPLATE) -> bool:
    """The template is one loop over the messages whose body sees only its own message."""

    def free(node: Node, bound: frozenset) -> bool:
        if node.kind == "name":
            return node.value in bound
        if node.kind == "for":
            return free(node.parts[0], bound) and free(node.parts[1], bound | {node.value})
        return all(free(p, bound) for p in node.parts)

    root = fold(Parser(source).parse())
    loop = root.parts[0] if root.kind == "block" and len(root.parts) == 1 else root
    return loop.kind == "for" and (loop.parts[0].kind, loop.parts[0].value) == ("name", "messages") and free(loop.parts[1], frozenset({loop.value}))


def _digests(turns: Iterator[tuple[int, str, str, str | None, int]]) -> Iterator[tuple]:
    """One row for each run of turns of a conversation; a masked text of None stands for the text itself."""
    at, n, loss_chars, chars = None, 0, 0, 0
    whole, loss = hashlib.sha256(), hashlib.sha256()
    for conv, role, text, masked, length in turns:
        if conv != at and n:
            yield at, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars
            n, loss_chars, chars, whole, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        masked = text if masked is None else masked
        at, n, chars, loss_chars = conv, n + 1, chars + length, loss_chars + len(masked)
        whole.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        loss.update(masked.encode("utf-8", "replace"))
    if n:
        yield at, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formats and reads back every conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``df`` has conv_id, turn, role and text, one row per turn.  Turns are taken in the order of turn,
    then role and text where that ties; repeated rows are turns of their own.  Null roles and texts
    count as empty, rows without a conv_id form one conversation with a null id, null turns come
    first.  An empty table gives no rows.

    Where the template sees one message at a time, turns are rendered and read back where they are, in
    parallel; only the digests of a conversation, which are sequential by nature, are one task's work.
    Any other template streams a conversation through one task in the memory of its longest turn.
    """
    none = -(1 << 63)
    picked = df.select(F.coalesce(F.col("conv_id"), F.lit(none)).alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def render_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for batch in batches:
            read = [next(read_back(render([{"role": r, "text": t}]))) for r, t in zip(batch["role"], batch["text"], strict=True)]
            roles, texts, masked, lengths = zip(*read, strict=True) if read else ((),) * 4
            masked = [None if m == t else m for m, t in zip(masked, texts, strict=True)]
            yield batch[["conv_id", "turn"]].assign(role=roles, text=texts, masked=masked, length=lengths)

    def fold_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(b["conv_id"].tolist(), b["role"], b["text"], b["masked"], b["length"].tolist(), strict=True))
        yield from framed(_digests(rows))

    def render_and_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        rows = (row for b in batches for row in zip(b["conv_id"].tolist(), b["role"], b["text"], strict=True))

        def turns() -> Iterator[tuple]:
            for conv, mine in groupby(rows, key=lambda row: row[0]):
                for role, text, masked, length in read_back(render({"role": r, "text": t} for _, r, t in mine)):
                    yield conv, role, text, masked, length

        yield from framed(_digests(turns()))

    def framed(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while part := list(islice(rows, 5000)):
            yield pd.DataFrame(part, columns=columns)

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    alone = separable(template)
    if alone:
        kind = dict(picked.dtypes)["turn"]
        picked = picked.mapInPandas(thrifty(render_turns), f"conv_id long, turn {kind}, role string, text string, masked string, length long")
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInPandas(thrifty(fold_turns if alone else render_and_fold), schema).withColumn("conv_id", F.nullif("conv_id", F.lit(none)))


def format_tables(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans) as real texts, for conversations that fit a task's memory."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "role", "text"], kind="stable")
        text, spans = render_text([{"role": r, "text": t} for r, t in zip(group["role"], group["text"], strict=True)], template)
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "formatted": [text], "loss_spans": [[{"start": s, "end": e} for s, e in spans]]})

    picked = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.groupBy("conv_id").applyInPandas(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")
