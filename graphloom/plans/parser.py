"""The query language: text -> tokens -> Statement.

NODES [type[(k=v, ...)]] [WHERE ...] [ORDER BY f [ASC|DESC]] [LIMIT n] [OFFSET n] [RETURN f, ...]
EDGES [relation] [WHERE ...] [LIMIT n]
TRAVERSE type:id (-> | <- | --) relation [arrow [type]] ... [MAX d] [LIMIT n]
PATH type:id TO type:id [VIA relation] [MAX h]
COUNT [type] [WHERE ...]      SUM|AVG|MIN|MAX [type.]property [WHERE ...]

AND binds tighter than OR. Text that a statement doesn't use up is an error, as are NOT before a comparison, an open list
and a list without parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.conditions import OPERATORS, Condition
from ..model import Direction, NodeRef


class QueryError(ValueError):
    """The text is no query."""

    def __init__(self, what: str):
        super().__init__(f"Parse error: {what}")


@dataclass(frozen=True)
class Token:
    text: str
    kind: str  # word, string, op
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


@dataclass(frozen=True)
class Step:
    direction: Direction
    relation: str
    target: str | None = None


@dataclass
class Statement:
    kind: str
    type: str | None = None
    groups: list[list[Condition]] = field(default_factory=list)
    order: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0
    fields: list[str] = field(default_factory=list)
    property: str | None = None
    start: NodeRef | None = None
    end: NodeRef | None = None
    steps: list[Step] = field(default_factory=list)
    most: int | None = None


_TOKEN = re.compile(r"""\s+ | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*") | (?P<op>->|<-|--|==|!=|>=|<=|<>|[=<>(),]) | (?P<word>-?[\w:][\w:.\-]*|\*)""", re.X | re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CLAUSES = {"WHERE", "ORDER", "LIMIT", "OFFSET", "RETURN", "MAX", "TO", "VIA"}


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        if m["string"] is not None:
            out.append(Token(re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m["string"][1:-1], flags=re.S), "string", at))
        elif m.lastgroup:
            out.append(Token(m[m.lastgroup], m.lastgroup, at))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokenize(text), 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else None

    def next(self, what: str = "more text") -> Token:
        t = self.peek()
        if t is None:
            raise QueryError(f"expected {what} at the end")
        self.i += 1
        return t

    def take(self, *words: str) -> bool:
        """Consumes the words if they come next."""
        for k, w in enumerate(words):
            t = self.peek(k)
            if t is None or (t.upper != w and not (t.kind == "op" and t.text == w)):
                return False
        self.i += len(words)
        return True

    def name(self, what: str) -> str:
        t = self.next(what)
        if t.kind == "op":
            raise QueryError(f"expected {what}, not {t.text!r}")
        return t.text

    def number(self, what: str) -> int:
        t = self.next(what)
        if not t.text.isdigit():
            raise QueryError(f"{what} must be a number, not {t.text!r}")
        return int(t.text)

    def statement(self) -> Statement:
        head = self.next("a statement")
        parse = {"NODES": self.nodes, "EDGES": self.edges, "TRAVERSE": self.traverse, "PATH": self.path, "COUNT": self.count}.get(head.upper)
        if parse is None and head.upper in ("SUM", "AVG", "MIN", "MAX"):
            made = self.aggregate(head.upper)
        elif parse is None:
            raise QueryError(f"unknown statement {head.text!r}")
        else:
            made = parse()
        if t := self.peek():
            raise QueryError(f"unexpected {t.text!r} at {t.at}")
        return made

    def optional_type(self) -> str | None:
        t = self.peek()
        return self.name("a type") if t and t.kind != "op" and t.upper not in CLAUSES else None

    def nodes(self) -> Statement:
        s = Statement("NODES", self.optional_type())
        short = []
        if self.take("("):
            while not self.take(")"):
                key = self.name("a property")
                if not (self.take("=") or self.take("==")):
                    raise QueryError("expected = in the filter")
                short.append(Condition(key, "EQ", self.value()))
                if not self.take(",") and not (self.peek() and self.peek().text == ")"):
                    raise QueryError("the filter isn't closed")
        s.groups = self.where()
        if short:
            s.groups = [[*g, *short] for g in s.groups] or [short]
        if self.take("ORDER", "BY"):
            s.order = self.name("a property")
            s.descending = self.take("DESC") or self.take("ASC") and False
        if self.take("LIMIT"):
            s.limit = self.number("LIMIT")
        if self.take("OFFSET"):
            s.offset = self.number("OFFSET")
        if self.take("RETURN"):
            s.fields = [self.name("a property")]
            while self.take(","):
                s.fields.append(self.name("a property"))
        return s

    def edges(self) -> Statement:
        s = Statement("EDGES", self.optional_type(), self.where())
        s.limit = self.number("LIMIT") if self.take("LIMIT") else None
        return s

    def count(self) -> Statement:
        return Statement("COUNT", self.optional_type(), self.where())

    def aggregate(self, kind: str) -> Statement:
        name = self.name("a property")
        kind_of, dot, own = name.partition(".")
        return Statement(kind, kind_of if dot else None, property=own if dot else name, groups=self.where())

    def ref(self) -> NodeRef:
        name = self.name("a node").removeprefix(":")
        kind, colon, own = name.partition(":")
        if not colon or not kind or not own:
            raise QueryError(f"expected type:id, not {name!r}")
        return NodeRef(kind, own.partition(":")[0])

    def arrow(self) -> str | None:
        t = self.peek()
        if t and t.kind == "op" and t.text in ("->", "<-", "--"):
            self.i += 1
            return t.text
        return None

    def traverse(self) -> Statement:
        s = Statement("TRAVERSE", start=self.ref())
        while first := self.arrow():
            relation = self.name("a relation")
            second, target = self.arrow(), None
            t = self.peek()
            if second and t and t.kind == "word" and t.upper not in ("MAX", "LIMIT"):
                target = self.name("a type")
            both = (first, second or "")
            direction = Direction.OUT if "->" in both else Direction.IN if "<-" in both else Direction.BOTH
            s.steps.append(Step(direction, relation, None if target in (None, "*") else target))
        if self.take("MAX"):
            s.most = self.number("MAX")
        if self.take("LIMIT"):
            s.limit = self.number("LIMIT")
        return s

    def path(self) -> Statement:
        s = Statement("PATH", start=self.ref(), most=10)
        if not self.take("TO"):
            raise QueryError("expected TO")
        s.end = self.ref()
        if self.take("VIA"):
            s.property = self.name("a relation")
        if self.take("MAX"):
            s.most = self.number("MAX")
        return s

    def where(self) -> list[list[Condition]]:
        if not self.take("WHERE"):
            return []
        groups = [[self.condition()]]
        while True:
            if self.take("AND"):
                groups[-1].append(self.condition())
            elif self.take("OR"):
                groups.append([self.condition()])
            else:
                return groups

    def condition(self) -> Condition:
        if self.take("NOT", "EXISTS"):
            return Condition(self.name("a property"), "NOT_EXISTS")
        if self.take("EXISTS"):
            return Condition(self.name("a property"), "EXISTS")
        if self.peek() and self.peek().upper == "NOT":
            raise QueryError("NOT is only known before EXISTS and IN")
        name = self.name("a property")
        if self.take("EXISTS"):
            return Condition(name, "EXISTS")
        if self.take("NOT", "EXISTS"):
            return Condition(name, "NOT_EXISTS")
        if self.take("NOT", "IN"):
            return Condition(name, "NOT_IN", self.values())
        op = self.next("an operator")
        known = OPERATORS.get(op.upper or op.text)
        if known is None or op.kind == "string":
            raise QueryError(f"unknown operator {op.text!r}")
        return Condition(name, known, self.values() if known == "IN" else self.value())

    def values(self) -> list[Any]:
        if not self.take("("):
            raise QueryError("a list needs parentheses")
        out = []
        while not self.take(")"):
            out.append(self.value())
            if not self.take(",") and not (self.peek() and self.peek().text == ")" and self.peek().kind == "op"):
                raise QueryError("the list isn't closed")
        return [v for v in out if v is not None]

    def value(self) -> Any:
        t = self.next("a value")
        if t.kind == "string":
            return t.text
        if t.kind == "op":
            raise QueryError(f"expected a value, not {t.text!r}")
        if t.upper in ("TRUE", "FALSE"):
            return t.upper == "TRUE"
        if t.upper in ("NULL", "NONE", "NIL"):
            return None
        if re.fullmatch(r"-?\d+", t.text):
            return int(t.text)
        if re.fullmatch(r"-?\d*\.\d+|-?\d+\.", t.text):
            return float(t.text)
        return t.text


def parse(text: str) -> Statement:
    return Parser(text).statement()
