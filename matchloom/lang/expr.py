"""The expression language: text to tree, tree to canonical text, types, and Spark columns.

    or < and < not < comparison, in < + - < * / % < unary - < .member [index]

Words and C-style symbols mean the same (``and``/``&&``, ``or``/``||``, ``not``/``!``);
comparisons do not chain.  Numbers may be durations (``10s``, ``500ms``), which are
ticks.  Functions are a closed set.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import scalar
from matchloom.lang.diagnostics import Diagnostic, RuleError

_TOKEN = re.compile(r"""\s+|(?P<duration>\d+(?:\.\d+)?(?:ms|s)\b)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!()\[\],.])""")
_WORDS = {"and": "and", "&&": "and", "or": "or", "||": "or", "not": "not", "!": "not", "in": "in"}
_COMPARE = ("==", "!=", "<=", ">=", "<", ">")
FUNCTIONS = {"min": 2, "max": 2, "abs": 1, "floor": 1, "contains": 2, "startswith": 2}


@dataclass(frozen=True)
class Node:
    """``kind``: literal, name, member, index, list, call, unary or binary."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()
    at: int = 0

    @property
    def path(self) -> str | None:
        """Dotted name, if the node is one."""
        if self.kind == "name":
            return str(self.value)
        if self.kind == "member" and (p := self.args[0].path):
            return f"{p}.{self.value}"
        return None

    def walk(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.walk()

    def names(self) -> set[str]:
        """Dotted names that the expression reads."""
        if (p := self.path) is not None:
            return {p}
        return set().union(*[a.names() for a in self.args]) if self.args else set()


class _Parser:
    def __init__(self, text: str, tick_rate: float):
        self.text, self.rate, self.tokens, self.k = text, tick_rate, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(Diagnostic("E_STRING" if text[at] in "\"'" else "E_CHAR", f"cannot read {text[at]!r}", at))
            if m.lastgroup:
                word = m[0]
                kind = "op" if m.lastgroup == "op" or word in _WORDS and m.lastgroup == "name" else m.lastgroup
                self.tokens.append((kind, _WORDS.get(word, word) if kind == "op" else word, at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.k]

    def take(self, *ops: str) -> tuple[str, str, int] | None:
        kind, word, at = self.tokens[self.k]
        if kind == "op" and word in ops:
            self.k += 1
            return kind, word, at
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            kind, word, at = self.peek()
            raise RuleError(Diagnostic("E_SYNTAX", f"expected {op!r}, found {word or kind!r}", at))

    def whole(self) -> Node:
        out = self.either()
        if self.peek()[0] != "end":
            raise RuleError(Diagnostic("E_SYNTAX", f"unexpected {self.peek()[1]!r}", self.peek()[2]))
        return out

    def level(self, ops: tuple[str, ...], below: Callable[[], Node]) -> Node:
        out = below()
        while t := self.take(*ops):
            out = Node("binary", t[1], (out, below()), t[2])
        return out

    def either(self) -> Node:
        return self.level(("or",), self.both)

    def both(self) -> Node:
        return self.level(("and",), self.negated)

    def negated(self) -> Node:
        if t := self.take("not"):
            return Node("unary", "not", (self.negated(),), t[2])
        return self.compared()

    def compared(self) -> Node:
        out = self.sum()
        if t := self.take(*_COMPARE, "in"):
            out = Node("binary", t[1], (out, self.sum()), t[2])
            if t := self.take(*_COMPARE, "in"):
                raise RuleError(Diagnostic("E_CHAIN", "comparisons do not chain", t[2]))
        return out

    def sum(self) -> Node:
        return self.level(("+", "-"), self.product)

    def product(self) -> Node:
        return self.level(("*", "/", "%"), self.signed)

    def signed(self) -> Node:
        if t := self.take("-"):
            inner = self.signed()
            if inner.kind == "literal" and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                return replace(inner, value=-inner.value, at=t[2])
            return Node("unary", "-", (inner,), t[2])
        return self.postfix()

    def postfix(self) -> Node:
        out = self.atom()
        while t := self.take(".", "["):
            if t[1] == ".":
                kind, word, at = self.peek()
                if kind != "name":
                    raise RuleError(Diagnostic("E_SYNTAX", "expected a name after '.'", at))
                self.k += 1
                out = Node("member", word, (out,), t[2])
            else:
                out = Node("index", None, (out, self.either()), t[2])
                self.need("]")
        return out

    def atom(self) -> Node:
        kind, word, at = self.peek()
        self.k += 1
        if kind == "number":
            return Node("literal", float(word) if "." in word else int(word), at=at)
        if kind == "duration":
            seconds = float(word[:-2]) / 1000 if word.endswith("ms") else float(word[:-1])
            return Node("literal", int(seconds * self.rate + 0.5), at=at)
        if kind == "string":
            body = word[1:-1]
            if bad := re.search(r"\\[^\"'\\]", body):
                raise RuleError(Diagnostic("E_STRING", f"unknown escape {bad[0]!r}", at))
            return Node("literal", re.sub(r"\\(.)", r"\1", body), at=at)
        if kind == "name":
            if word in ("true", "false", "null"):
                return Node("literal", {"true": True, "false": False, "null": None}[word], at=at)
            if self.take("("):
                args = self.listed(")")
                if word not in FUNCTIONS:
                    raise RuleError(Diagnostic("E_NAME", f"no function {word!r}", at))
                if len(args) != FUNCTIONS[word]:
                    raise RuleError(Diagnostic("E_ARGS", f"{word} takes {FUNCTIONS[word]} arguments", at))
                return Node("call", word, args, at)
            return Node("name", word, at=at)
        if word == "(":
            out = self.either()
            self.need(")")
            return out
        if word == "[":
            return Node("list", None, self.listed("]"), at)
        raise RuleError(Diagnostic("E_SYNTAX", f"unexpected {word or kind!r}", at))

    def listed(self, end: str) -> tuple[Node, ...]:
        out = []
        if self.take(end):
            return ()
        while True:
            out.append(self.either())
            if not self.take(","):
                self.need(end)
                return tuple(out)


def parse(text: str | int | float | bool, tick_rate: float = 64.0) -> Node:
    """Tree of an expression; raises RuleError."""
    if isinstance(text, (bool, int, float)):
        return Node("literal", text)
    return _Parser(text, tick_rate).whole()


def render(n: Node) -> str:
    """Canonical text: every operation in parentheses, words for logic."""
    a = [render(x) for x in n.args]
    if n.kind == "literal":
        if isinstance(n.value, str):
            return '"' + n.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return {True: "true", False: "false", None: "null"}[n.value] if n.value is None or isinstance(n.value, bool) else repr(n.value)
    return {
        "name": lambda: str(n.value),
        "member": lambda: f"{a[0]}.{n.value}",
        "index": lambda: f"{a[0]}[{a[1]}]",
        "list": lambda: f"[{', '.join(a)}]",
        "call": lambda: f"{n.value}({', '.join(a)})",
        "unary": lambda: f"({n.value} {a[0]})",
        "binary": lambda: f"({a[0]} {n.value} {a[1]})",
    }[n.kind]()


def identity(*parts: object) -> str:
    """Hash of what makes two stats the same; trees count by their canonical text."""
    text = "\x1f".join(render(p) if isinstance(p, Node) else repr(p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()


def substitute(n: Node, known: Callable[[str], Node | None], seen: tuple[str, ...] = ()) -> Node:
    """The tree with names that ``known`` has replaced by their trees; cycles are errors."""
    if (p := n.path) is not None:
        found = known(p)
        if found is None:
            return n
        if p in seen:
            raise RuleError(Diagnostic("E_CYCLE", " -> ".join((*seen, p)), n.at))
        return substitute(found, known, (*seen, p))
    return replace(n, args=tuple(substitute(a, known, seen) for a in n.args))


NUMBERS = ("int", "float", "duration", "instant")


def _of(value: object) -> str:
    return "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string"


def check(n: Node, types: Callable[[str], str | None]) -> str:
    """Type of an expression: bool, int, float, duration, instant, string, list or null; raises RuleError."""

    def fail(code: str, message: str) -> RuleError:
        return RuleError(Diagnostic(code, message, n.at))

    if (p := n.path) is not None:
        if (t := types(p)) is None:
            raise fail("E_NAME", f"unknown name {p!r}")
        return t
    if n.kind == "literal":
        return _of(n.value)
    a = [check(x, types) for x in n.args]
    number = [x in NUMBERS or x == "null" for x in a]
    if n.kind == "list":
        return "list"
    if n.kind == "index":
        return "float" if n.args[0].path else "null"
    if n.kind == "call":
        if n.value in ("contains", "startswith"):
            if a != ["string", "string"]:
                raise fail("E_TYPE", f"{n.value} takes two strings")
            return "bool"
        if not all(number):
            raise fail("E_TYPE", f"{n.value} takes numbers")
        return "float"
    if n.kind == "unary":
        if n.value == "not":
            if a[0] not in ("bool", "null"):
                raise fail("E_TYPE", "not takes a boolean")
            return "bool"
        if not number[0]:
            raise fail("E_TYPE", "- takes a number")
        return a[0]
    if n.kind == "binary":
        if n.value in ("and", "or"):
            if any(x not in ("bool", "null") for x in a):
                raise fail("E_TYPE", f"{n.value} takes booleans, not {a[0]} and {a[1]}")
            return "bool"
        if n.value == "in":
            if a[1] != "list":
                raise fail("E_TYPE", "in takes a list on its right")
            return "bool"
        if n.value in _COMPARE:
            if not (all(number) or a[0] == a[1] or "null" in a):
                raise fail("E_TYPE", f"{a[0]} and {a[1]} do not compare")
            return "bool"
        if not all(number):
            raise fail("E_TYPE", f"{n.value} takes numbers, not {a[0]} and {a[1]}")
        if n.value == "-" and a == ["instant", "instant"]:
            return "duration"
        if "instant" in a and n.value in "+-":
            return "instant"
        if "float" in a:
            return "float"
        return "duration" if "duration" in a and n.value in "+-" else "int"
    raise fail("E_SYNTAX", f"{n.kind} has no value")


def column(n: Node, columns: Callable[[str], Column], types: Callable[[str], str | None]) -> Column:
    """The expression as a Spark column, inside code generation; logic is two-valued, division by zero is 0."""
    go = lambda x: column(x, columns, types)
    if (p := n.path) is not None:
        return columns(p)
    if n.kind == "literal":
        return F.lit(n.value)
    if n.kind == "list":
        return F.array(*map(go, n.args))
    if n.kind == "index":
        if n.args[1].kind == "literal" and isinstance(n.args[1].value, int):
            return F.get(go(n.args[0]), F.lit(n.args[1].value))
        return F.try_element_at(go(n.args[0]), go(n.args[1]))
    if n.kind == "call":
        a = [go(x) for x in n.args]
        if n.value in ("contains", "startswith"):
            return scalar.truth(getattr(a[0], n.value)(a[1]))
        a = [x.cast("double") for x in a]
        if n.value in ("min", "max"):
            both = a[0].isNotNull() & a[1].isNotNull()
            return F.when(both, F.least(*a) if n.value == "min" else F.greatest(*a))
        return F.abs(a[0]) if n.value == "abs" else F.floor(a[0]).cast("double")
    if n.kind == "unary":
        return ~scalar.truth(go(n.args[0])) if n.value == "not" else -go(n.args[0])
    left, right = n.args
    if n.value == "in" and right.kind == "list":
        return scalar.truth(go(left).isin([x.value for x in right.args]))
    a, b = go(left), go(right)
    if n.value == "/":
        whole = check(left, types) == "int" and check(right, types) == "int"
        return scalar.divide(a, b, whole=whole)
    return {
        "and": lambda: scalar.truth(a) & scalar.truth(b),
        "or": lambda: scalar.truth(a) | scalar.truth(b),
        "in": lambda: scalar.truth(F.array_contains(b, a)),
        "==": lambda: a.eqNullSafe(b) if "null" in (check(left, types), check(right, types)) else scalar.truth(a == b),
        "!=": lambda: ~a.eqNullSafe(b) if "null" in (check(left, types), check(right, types)) else scalar.truth(a != b),
        "<": lambda: scalar.truth(a < b),
        "<=": lambda: scalar.truth(a <= b),
        ">": lambda: scalar.truth(a > b),
        ">=": lambda: scalar.truth(a >= b),
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "%": lambda: a % b,
    }[str(n.value)]()


def clauses(n: Node) -> list[Node]:
    """Conjuncts of a condition."""
    return [c for a in n.args for c in clauses(a)] if n.kind == "binary" and n.value == "and" else [n]


def joined(parts: list[Node]) -> Node | None:
    """A condition of conjuncts: the inverse of ``clauses``."""
    out = None
    for p in parts:
        out = p if out is None else Node("binary", "and", (out, p), p.at)
    return out
