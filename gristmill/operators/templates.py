"""Chat templates as column expressions: conversations become the text a model is trained on, inside Spark's own expressions.

Templates are written in the notation that published chat models carry: text with ``{{ value }}``, ``{% if %}``,
``{% for message in messages %}`` and ``{% set %}``. Understood are the role and content of messages, ``messages[i]`` and
``messages[i:]``, ``loop.first``, ``last``, ``index`` and ``index0``, strings, integers, ``+``, ``~``, ``%``, comparisons,
``in``, ``and``, ``or``, ``not``, ``is defined``, ``a if b else c``, ``| trim``, ``| length``, ``.strip()``, ``.startswith()``,
``.endswith()`` and ``raise_exception``. The newline after a tag and the blanks before one that begins its line are left out, as are
those next to ``{%-`` and ``-%}``. Names nobody gave are undefined, thus false and printed as nothing. What is not understood
raises ValueError when the expression is made, before any row is read.
"""

from __future__ import annotations

import ast
import re
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import let, strip
from gristmill.operators.state import answer_split, conversation

_TAG = re.compile(r"(\{%.*?%\}|\{\{.*?\}\}|\{#.*?#\})", re.S)
_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", re.S)
_FILTER = re.compile(r"\|\s*(trim|length)\b")
_END = {"for": ("endfor",), "if": ("elif", "else", "endif"), "else": ("endif",)}


class _Value(NamedTuple):
    column: Column
    kind: str  # string, bool, int, messages, message, loop, none


_NONE = _Value(F.lit, "none")  # its column is never read


def _constant(v: Any) -> _Value:
    if v is None or v is False:
        return _NONE
    kind = {bool: "bool", int: "int", str: "string"}.get(type(v))
    if kind is None:
        raise ValueError(f"a chat template cannot hold {v!r}")
    return _Value(F.lit(v), kind)


def _truth(v: _Value) -> Column:
    if v.kind == "none":
        return F.lit(False)
    test = {"string": lambda c: c != "", "bool": lambda c: c, "int": lambda c: c != 0, "messages": lambda c: F.size(c) > 0, "message": lambda c: c.isNotNull()}[v.kind]
    return F.coalesce(test(v.column), F.lit(False))


def _either(test: Column, a: _Value, b: _Value) -> _Value:
    """``a`` where ``test`` holds, else ``b``; nothing and False are one value, which any kind may stand beside."""
    if a.kind == b.kind == "none":
        return a
    if a.kind == "none":
        return _either(~test, b, a)
    if b.kind == "none":
        return _Value(F.when(test, a.column), a.kind)
    if a.kind != b.kind or a.kind == "loop":
        raise ValueError("a name of a chat template has values of different kinds")
    return _Value(F.when(test, a.column).otherwise(b.column), a.kind)


class _Expression:
    """One expression of a template, over names bound to values. Its notation is Python's but for filters and ``~``."""

    def __init__(self, text: str, names: dict[str, _Value]):
        outside = lambda x: re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnone\b", "None", _FILTER.sub(r".__\1__", x).replace("~", "+"))))
        source = "".join(p if i % 2 else outside(p) for i, p in enumerate(_LITERAL.split(text)))
        self.names = names
        try:
            self.tree = ast.parse(f"({source.strip()})", mode="eval").body
        except SyntaxError as e:
            raise ValueError(f"a chat template has an expression that is not understood: {text.strip()}") from e

    def value(self) -> _Value:
        return self._of(self.tree)

    def _of(self, node: ast.AST) -> _Value:
        found = getattr(self, f"_{type(node).__name__.lower()}", None)
        if found is None:
            raise ValueError(f"a chat template uses what is not understood: {ast.unparse(node)}")
        return found(node)

    def _constant(self, node: ast.Constant) -> _Value:
        return _constant(node.value)

    def _name(self, node: ast.Name) -> _Value:
        return self.names.get(node.id, _NONE)

    def _part(self, of: _Value, name: str) -> _Value:
        if of.kind == "message":
            return _Value(of.column[name], "string") if name in ("role", "content") else _NONE
        if of.kind == "none":
            return _NONE
        raise ValueError(f"a chat template asks for {name} of what has none")

    def _subscript(self, node: ast.Subscript) -> _Value:
        of, at = self._of(node.value), node.slice
        if isinstance(at, ast.Slice):
            low = 0 if at.lower is None else ast.literal_eval(at.lower)
            if of.kind != "messages" or at.upper or at.step or not isinstance(low, int) or low < 0:
                raise ValueError("a chat template may cut messages only at their beginning")
            return _Value(F.slice(of.column, F.lit(low + 1), F.greatest(F.size(of.column), F.lit(0))), "messages")
        key = ast.literal_eval(at)
        if of.kind == "messages" and isinstance(key, int):
            return _Value(F.try_element_at(of.column, F.lit(key + 1 if key >= 0 else key)), "message")
        return self._part(of, str(key))

    def _attribute(self, node: ast.Attribute) -> _Value:
        of = self._of(node.value)
        if node.attr == "__trim__" and of.kind in ("string", "none"):
            return _Value(strip(of.column), "string") if of.kind == "string" else _constant("")
        if node.attr == "__length__" and of.kind in ("string", "messages"):
            return _Value((F.length if of.kind == "string" else F.size)(of.column), "int")
        if of.kind == "loop":
            i, size = of.column
            parts = {"first": (i == 0, "bool"), "last": (i == size - 1, "bool"), "index": (i + 1, "int"), "index0": (i, "int"), "length": (size, "int")}
            if node.attr in parts:
                return _Value(*parts[node.attr])
        return self._part(of, node.attr)

    def _call(self, node: ast.Call) -> _Value:
        if isinstance(node.func, ast.Name) and node.func.id == "raise_exception":
            return _Value(F.lit(None).cast("string"), "string")  # the row has no rendering
        if isinstance(node.func, ast.Attribute):
            of, name = self._of(node.func.value), node.func.attr
            args = [self._of(a) for a in node.args]
            if of.kind == "string" and name == "strip" and not args:
                return _Value(strip(of.column), "string")
            if of.kind == "string" and name in ("startswith", "endswith") and len(args) == 1 and args[0].kind == "string":
                return _Value(getattr(of.column, name)(args[0].column), "bool")
        raise ValueError(f"a chat template calls what is not understood: {ast.unparse(node)}")

    def _binop(self, node: ast.BinOp) -> _Value:
        a, b = self._of(node.left), self._of(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "int":
            return _Value(a.column + b.column, "int")
        if isinstance(node.op, ast.Add):
            return _Value(F.concat(_shown(a), _shown(b)), "string")
        if isinstance(node.op, ast.Mod) and a.kind == b.kind == "int":
            return _Value(a.column % b.column, "int")
        raise ValueError(f"a chat template computes what is not understood: {ast.unparse(node)}")

    def _boolop(self, node: ast.BoolOp) -> _Value:
        tests = [_truth(self._of(v)) for v in node.values]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if isinstance(node.op, ast.And) else out | t
        return _Value(out, "bool")

    def _unaryop(self, node: ast.UnaryOp) -> _Value:
        if not isinstance(node.op, ast.Not):
            return _constant(ast.literal_eval(node))
        return _Value(~_truth(self._of(node.operand)), "bool")

    def _ifexp(self, node: ast.IfExp) -> _Value:
        return _either(_truth(self._of(node.test)), self._of(node.body), self._of(node.orelse))

    def _compare(self, node: ast.Compare) -> _Value:
        if len(node.ops) != 1:
            raise ValueError("a chat template compares more than two values at once")
        op, right = node.ops[0], node.comparators[0]
        a, negative = self._of(node.left), isinstance(op, ast.NotEq | ast.NotIn | ast.IsNot)
        if isinstance(op, ast.Is | ast.IsNot) and not isinstance(right, ast.Constant):
            if not isinstance(right, ast.Name) or right.id not in ("defined", "undefined", "string"):
                raise ValueError(f"a chat template tests what is not understood: {ast.unparse(node)}")
            test = F.lit(False) if a.kind == "none" or (right.id == "string" and a.kind != "string") else a.column.isNotNull()
            test = ~test if right.id == "undefined" else test
        elif isinstance(op, ast.In | ast.NotIn) and isinstance(right, ast.List | ast.Tuple):
            test = F.coalesce(a.column.isin([ast.literal_eval(x) for x in right.elts]), F.lit(False)) if a.kind != "none" else F.lit(False)
        else:
            test = self._pair(op, a, self._of(right))
        return _Value(~test if negative else test, "bool")

    def _pair(self, op: ast.cmpop, a: _Value, b: _Value) -> Column:
        if isinstance(op, ast.In | ast.NotIn) and a.kind == b.kind == "string":
            return F.coalesce(F.contains(b.column, a.column), F.lit(False))
        if isinstance(op, ast.Eq | ast.NotEq | ast.Is | ast.IsNot):
            if a.kind == b.kind and a.kind != "none":
                return a.column.eqNullSafe(b.column)
            known = [v for v in (a, b) if v.kind not in ("none", "bool")]
            if len(known) < 2:  # a value beside nothing or False
                return known[0].column.isNull() if known else ~_truth(a) & ~_truth(b) | _truth(a) & _truth(b)
            return F.lit(False)
        orders = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}
        if type(op) in orders and a.kind == b.kind == "int":
            return orders[type(op)](a.column, b.column)
        raise ValueError("a chat template compares values of different kinds")


def _shown(v: _Value) -> Column:
    if v.kind in ("string", "int"):
        return v.column.cast("string")
    if v.kind == "none":
        return F.lit("")
    raise ValueError("a chat template prints what is no text")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def _pieces(template: str) -> list[str]:
    """Texts and tags in turn, with the white space that tags take along removed."""
    pieces = _TAG.split(template[:-1] if template.endswith("\n") else template)
    for i in range(1, len(pieces), 2):
        before = pieces[i - 1]
        if pieces[i][1] in "%#" and pieces[i][2] not in "+-" and (i == 1 or "\n" in before):  # blanks of a line that a tag begins
            pieces[i - 1] = re.sub(r"(^|\n)[ \t]*$", r"\1", before)
    for i in range(1, len(pieces), 2):
        tag = pieces[i]
        if tag[2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if tag[-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
        elif tag[1] in "%#":
            pieces[i + 1] = pieces[i + 1].removeprefix("\n")
    return pieces


class _Template:
    def __init__(self, template: str):
        self.pieces, self.at = _pieces(template), 0

    def run(self, names: dict[str, _Value], until: tuple[str, ...] = ()) -> tuple[list[Column], dict[str, _Value], str]:
        """What the pieces up to a tag of ``until`` print, the names they leave behind, and that tag."""
        out: list[Column] = []
        while self.at < len(self.pieces):
            piece, is_tag = self.pieces[self.at], self.at % 2
            self.at += 1
            if not is_tag:
                out += [F.lit(piece)] if piece else []
                continue
            body = piece[2:-2].strip("-+").strip()
            if piece.startswith("{{"):
                out.append(_shown(_Expression(body, names).value()))
            elif piece.startswith("{%"):
                word, rest = (*body.split(None, 1), "")[:2]
                if word in until:
                    return out, names, body
                if word == "set":
                    name, _, value = rest.partition("=")
                    if not name.strip().isidentifier():
                        raise ValueError(f"a chat template sets what is not understood: {rest}")
                    names = names | {name.strip(): _Expression(value, names).value()}
                elif word == "for":
                    out.append(self._loop(rest, names))
                elif word == "if":
                    text, names = self._choice(rest, names)
                    out.append(text)
                else:
                    raise ValueError(f"a chat template has a tag that is not understood: {body}")
        if until:
            raise ValueError(f"a chat template lacks {until[-1]}")
        return out, names, ""

    def _choice(self, test: str, names: dict[str, _Value]) -> tuple[Column, dict[str, _Value]]:
        holds = _truth(_Expression(test, names).value())
        yes, after, end = self.run(names, _END["if"])
        no, other = [], names
        if end.startswith("elif"):
            text, other = self._choice(end.partition(" ")[2], names)
            no = [text]
        elif end == "else":
            no, other, _ = self.run(names, _END["else"])
        both = {n: after[n] if after.get(n) is other.get(n) else _either(holds, after.get(n, _NONE), other.get(n, _NONE)) for n in after.keys() | other.keys()}
        return F.when(holds, _joined(yes)).otherwise(_joined(no)), both

    def _loop(self, head: str, names: dict[str, _Value]) -> Column:
        name, _, over = head.partition(" in ")
        rows = _Expression(over, names).value()
        if rows.kind != "messages" or not name.strip().isidentifier():
            raise ValueError(f"a chat template loops over what is not understood: {head}")
        start, end = self.at, [self.at]

        def one(message: Column, i: Column) -> Column:
            self.at = start
            text, _, _ = self.run(names | {name.strip(): _Value(message, "message"), "loop": _Value((i, F.size(rows.column)), "loop")}, _END["for"])  # type: ignore[arg-type]
            end[0] = self.at
            return _joined(text)

        texts = F.transform(rows.column, one)
        self.at = end[0]
        return let(texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, "")))


def rendered(turns: Column, template: str, generation: bool = False, **names: Any) -> Column:
    """The text of ``array<struct<content, role>>``; null where the template refuses them or lacks a content.

    ``generation``: whether the beginning of an answer is asked for. ``names``: what else the template may
    name, such as ``bos_token``.
    """
    given = {n: _constant(v) for n, v in names.items()} | {"add_generation_prompt": _constant(generation)}
    return let(turns, lambda t: _joined(_Template(template).run(given | {"messages": _Value(t, "messages")})[0]))


def chat_split(template: str, state: Column | None = None, **names: Any) -> Column:
    """``struct<full, prompt, templated>``: a record as a template renders it, and what a loss on answers leaves out.

    Conversations whose last turn is the assistant's are rendered whole and, for the prompt, without that turn.
    Where the template refuses the turns, or the whole does not begin with the prompt, and for all other records,
    it is the plain rendering of ``answer_split``, and ``templated`` is false.
    """
    s = F.col("state") if state is None else state

    def split(turns: Column) -> Column:
        asked = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))
        ends = F.try_element_at(turns, F.lit(-1))["role"] == "assistant"
        return F.when(ends, F.struct(rendered(turns, template, **names).alias("full"), rendered(asked, template, True, **names).alias("prompt")))

    def choose(both: Column) -> Column:
        made, plain = both["made"], both["plain"]
        fits = F.coalesce(made["full"].startswith(made["prompt"]), F.lit(False))
        return F.struct(*(F.when(fits, made[n]).otherwise(plain[n]).alias(n) for n in ("full", "prompt")), fits.alias("templated"))

    return let(F.struct(let(conversation(s), split).alias("made"), answer_split(s).alias("plain")), choose)
