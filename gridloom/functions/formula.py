"""The cell formula language: text to a tree on the driver, once for each distinct text, and the tree to a Spark column.

Grammar, loosest first: comparison ``< > <= >= = == !=``; ``+ -``; ``* /``; unary ``- +``; number, reference, function call
or parentheses. A reference is a name in brackets, a chain ``[a][b][leaf]`` from an ancestor down, ``[name#rowN]`` with
a row hint or ``[Sheet::name]``, and may be followed by parameters ``(axis="member")``, the member being a name, a
period key or one of ``предыдущий``, ``назад(N)`` and ``вперед(N)`` (previous, back, forward).

Missing values are null: arithmetic takes them as 0, AVERAGE skips them, division by 0 gives null. Comparisons give 1 or 0.
Texts that don't fit the grammar raise ``FormulaError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import integer_part


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Param:
    """Override of one axis: by ``shift`` periods, or to ``member`` (a name or period key, lower case)."""

    axis: str
    shift: int | None = None
    member: str | None = None


@dataclass(frozen=True)
class Ref:
    chain: tuple[str, ...]
    sheet: str | None = None
    row: int | None = None
    params: tuple[Param, ...] = ()


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


Node = Ref | Num | Op

# The functions of the language with their least and greatest number of arguments, and the period words.
FUNCTIONS = {"IF": (3, 3), "SUM": (1, 255), "AVERAGE": (1, 255), "MIN": (1, 255), "MAX": (1, 255), "ABS": (1, 1), "INT": (1, 1), "ROUND": (1, 2)}
PREVIOUS, BACK, FORWARD = "предыдущий", "назад", "вперед"
KEYWORDS = ("AVERAGE", "LAST")
#: The whole formula of a cell that is to have no value.
EMPTY = "__empty__"
# Words of the older conditional dialect.
LEGACY = {"if": "если", "then": "то", "elif": "иначе_если", "else": "иначе", "end": "конец_если"}

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<op><=|>=|!=|<>|==|[-+*/<>=(),;])|(?P<word>[^\W\d]\w*))")
_SHIFT = re.compile(rf"(?:.*\.)?(?:(?P<prev>{PREVIOUS})|(?P<way>{BACK}|{FORWARD})\(\s*(?P<n>\d+)\s*\))", re.IGNORECASE | re.DOTALL)


def _bracketed(text: str, at: int) -> tuple[str, int]:
    """Content of the bracket that opens at ``at`` and the place behind it; brackets nest."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if not depth:
            return text[at + 1 : i], i + 1
    raise FormulaError(f"bracket is not closed: {text}")


def _params(text: str) -> tuple[Param, ...]:
    out = []
    for part in filter(None, (p.strip() for p in re.split(r"[,;](?![^(]*\))(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", text))):
        axis, eq, value = part.partition("=")
        axis, value = axis.strip().lower(), value.strip().strip("\"'").strip()
        if not eq:
            raise FormulaError(f"a parameter needs axis=value: {part}")
        if m := _SHIFT.fullmatch(value):
            n = -1 if m["prev"] else int(m["n"]) * (1 if m["way"].lower() == FORWARD else -1)
            out.append(Param(axis, shift=n))
        elif value.lower() != axis:
            out.append(Param(axis, member=value.lower()))
    return tuple(out)


def _reference(text: str, at: int) -> tuple[Ref, int]:
    chain: list[str] = []
    while at < len(text) and text[at] == "[":
        name, at = _bracketed(text, at)
        chain.append(name.strip())
    sheet, sep, first = chain[0].partition("::")
    if sep:
        chain[0] = first.strip()
    row = None
    if m := re.fullmatch(r"(.*)#row(\d+)", chain[-1], re.IGNORECASE | re.DOTALL):
        chain[-1], row = m[1].strip(), int(m[2])
    if not all(chain):
        raise FormulaError(f"a reference has no name: {text}")
    params: tuple[Param, ...] = ()
    if at < len(text) and text[at] == "(":
        depth, quoted = 0, False
        for i in range(at, len(text)):
            quoted ^= text[i] == '"'
            depth += 0 if quoted else (text[i] == "(") - (text[i] == ")")
            if not depth:
                params, at = _params(text[at + 1 : i]), i + 1
                break
        else:
            raise FormulaError(f"parameters are not closed: {text}")
    return Ref(tuple(c.lower() for c in chain), sheet.strip().lower() if sep else None, row, params), at


def tokens(text: str) -> list[tuple[str, object]]:
    """(kind, value) of each token; kinds are num, op, word and ref."""
    out: list[tuple[str, object]] = []
    at, text = 0, text.strip()
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == "[":
            ref, at = _reference(text, at)
            out.append(("ref", ref))
        elif m := _TOKEN.match(text, at):
            at = m.end()
            out.append((m.lastgroup, float(m["num"]) if m["num"] else m[m.lastgroup]))
        else:
            raise FormulaError(f"unexpected {text[at]!r} in {text}")
    return out


class _Parser:
    LEVELS = (("<", ">", "<=", ">=", "=", "==", "!=", "<>"), ("+", "-"), ("*", "/"))

    def __init__(self, text: str):
        self.text, self.left = text, tokens(text)[::-1]

    def peek(self, *ops: str) -> bool:
        return bool(self.left) and self.left[-1][0] == "op" and self.left[-1][1] in ops

    def expect(self, op: str) -> None:
        if not self.peek(op):
            raise FormulaError(f"{op!r} is missing in {self.text}")
        self.left.pop()

    def binary(self, level: int = 0) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            op = {"==": "=", "<>": "!="}.get(name := self.left.pop()[1], name)
            node = Op(op, (node, self.binary(level + 1)))
        return node

    def unary(self) -> Node:
        if self.peek("-"):
            self.left.pop()
            return Op("neg", (self.unary(),))
        if self.peek("+"):
            self.left.pop()
            return self.unary()
        return self.primary()

    def primary(self) -> Node:
        if not self.left:
            raise FormulaError(f"{self.text} ends too early")
        kind, value = self.left.pop()
        if kind == "num":
            return Num(value)
        if kind == "ref":
            return value
        if kind == "op" and value == "(":
            node = self.binary()
            self.expect(")")
            return node
        if kind == "word" and (name := value.upper()) in FUNCTIONS:
            self.expect("(")
            args = [] if self.peek(")") else [self.binary()]
            while self.peek(",", ";"):
                self.left.pop()
                args.append(self.binary())
            self.expect(")")
            low, high = FUNCTIONS[name]
            if not low <= len(args) <= high:
                raise FormulaError(f"{name} takes {low} to {high} arguments")
            return Op(name, tuple(args))
        raise FormulaError(f"unexpected {value!r} in {self.text}")


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.binary()
    if parser.left:
        raise FormulaError(f"unexpected {parser.left[-1][1]!r} in {text}")
    return node


def references(node: Node) -> list[Ref]:
    """Distinct references, in order of their first place."""
    if isinstance(node, Ref):
        return [node]
    return list(dict.fromkeys(r for a in node.args for r in references(a))) if isinstance(node, Op) else []


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _total(args: list[Column]) -> Column:
    out = args[0]
    for a in args[1:]:
        out = out + a
    return out


def _round(x: Column, n: Column) -> Column:
    scale = F.pow(F.lit(10.0), n)
    return F.round(x * scale, 0) / scale


#: Compilers of operators; arguments come as doubles with null for missing.
_COMPILED: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: _zero(a) + _zero(b),
    "-": lambda a, b: _zero(a) - _zero(b),
    "*": lambda a, b: _zero(a) * _zero(b),
    "/": lambda a, b: F.try_divide(_zero(a), _zero(b)),
    "neg": lambda a: -_zero(a),
    "IF": lambda c, t, f: F.when(_zero(c) != 0, _zero(t)).otherwise(_zero(f)),
    "SUM": lambda *a: _total([_zero(x) for x in a]),
    "AVERAGE": lambda *a: _zero(F.try_divide(_total([_zero(x) for x in a]), _total([x.isNotNull().cast("double") for x in a]))),
    "MIN": lambda *a: F.least(*map(_zero, a)) if len(a) > 1 else _zero(a[0]),
    "MAX": lambda *a: F.greatest(*map(_zero, a)) if len(a) > 1 else _zero(a[0]),
    "ABS": lambda a: F.abs(_zero(a)),
    "INT": lambda a: integer_part(_zero(a)),
    "ROUND": lambda x, n=None: F.round(_zero(x), 0) if n is None else _round(_zero(x), _zero(n)),
}
_COMPARED = {"<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}


def _column(node: Node, of: Callable[[Ref], Column]) -> Column:
    if isinstance(node, Num):
        return F.lit(node.value)
    if isinstance(node, Ref):
        return of(node)
    args = [_column(a, of) for a in node.args]
    if node.name in _COMPARED:
        return getattr(_zero(args[0]), _COMPARED[node.name])(_zero(args[1])).cast("double")
    return _COMPILED[node.name](*args)


def to_column(node: Node | str, of: Callable[[Ref], Column]) -> Column:
    """The value of a formula as a double column; ``of`` gives the column of a reference. A result that is missing or not finite is 0."""
    x = _column(parse(node) if isinstance(node, str) else node, of)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def over_columns(text: str) -> Column:
    """A formula whose references are columns of the same names."""
    return to_column(text, lambda r: F.col(r.chain[-1]).cast("double"))


def linear_in(node: Node, unknown: Ref, of: Callable[[Ref], Column]) -> tuple[Column, Column] | None:
    """Columns (a, b) with formula = a * unknown + b, or nothing if the formula isn't of that form; a null column says the same of a row."""

    def walk(x: Node) -> tuple[Column | None, Column] | None:
        """Factor (none where the unknown isn't there) and rest."""
        if x == unknown:
            return F.lit(1.0), F.lit(0.0)
        if unknown not in references(x):
            return None, _zero(_column(x, of))
        parts = [walk(a) for a in x.args]
        if not all(parts):
            return None
        if x.name == "neg":
            return -parts[0][0], -parts[0][1]
        if x.name in ("+", "-", "SUM"):
            sign = -1.0 if x.name == "-" else 1.0
            out = parts[0]
            for a, b in parts[1:]:
                factors = [f for f in (out[0], a if a is None else a * sign) if f is not None]
                out = (_total(factors) if factors else None), out[1] + b * sign
            return out
        if x.name == "*" and (parts[0][0] is None or parts[1][0] is None):
            (a, b), c = (parts[0], parts[1][1]) if parts[1][0] is None else (parts[1], parts[0][1])
            return a * c, b * c
        if x.name == "/" and parts[1][0] is None:
            return F.try_divide(parts[0][0], parts[1][1]), F.try_divide(parts[0][1], parts[1][1])
        return None

    got = walk(node)
    return None if got is None or got[0] is None else (got[0], got[1])


def from_legacy(text: str) -> str:
    """A formula of the older dialect, with conditions in words and members chained by points, in the present language."""
    words = "|".join(sorted(LEGACY.values(), key=len, reverse=True))
    parts = [p.strip() for p in re.split(rf"(?i)(?<!\w)({words})(?!\w)", re.sub(r"\]\s*\.\s*\[", "][", text))]
    parts, at = [p for p in parts if p], 0
    name = {v: k for k, v in LEGACY.items()}

    def word() -> str | None:
        return name.get(parts[at].lower()) if at < len(parts) else None

    def expect(what: str) -> None:
        nonlocal at
        if word() != what:
            raise FormulaError(f"{LEGACY[what]} is missing in {text}")
        at += 1

    def run() -> str:
        """Texts and whole conditions up to a word that ends them."""
        nonlocal at
        out = []
        while at < len(parts) and word() in (None, "if"):
            if word() == "if":
                at += 1
                out.append(branch())
                expect("end")
            else:
                out.append(parts[at])
                at += 1
        return " ".join(out)

    def branch() -> str:
        nonlocal at
        test = run()
        expect("then")
        yes, no = run(), "0"
        if word() == "elif":
            at += 1
            no = branch()
        elif word() == "else":
            at += 1
            no = run()
        return f"IF({test}, {yes}, {no})"

    got = run()
    if at < len(parts):
        raise FormulaError(f"unexpected {parts[at]} in {text}")
    return got
