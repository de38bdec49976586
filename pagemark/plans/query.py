"""The query language: a recursive-descent parser to a small tree.

    query  := { '-filter:' regex {',' regex} | field | expr }
    field  := '{' name '=' or '}'        or := and { '|' and }       and := atom { atom }
    atom   := word | '(' or ')' | '"' or '"'
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The request cannot be read."""


@dataclass(frozen=True)
class Word:
    text: str
    exact: bool = False
    key: str | None = None

    def radius(self, dist: int) -> int:
        """How far a neighbour may be; negative means in order."""
        return -(len(self.text) + 4) if self.exact else dist + len(self.text)


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass
class Query:
    body: object | None = None
    fields: list[tuple[str, object]] = field(default_factory=list)
    doc_filters: list[str] = field(default_factory=list)


def radius(node, dist: int) -> int:
    if isinstance(node, Word):
        return node.radius(dist)
    a, b = radius(node.left, dist), radius(node.right, dist)
    r = max(abs(a), abs(b))
    return -r if a < 0 and b < 0 else r


def words(node) -> list[Word]:
    return [node] if isinstance(node, Word) else words(node.left) + words(node.right)


class _Parser:
    def __init__(self, text: str, stops: set[str], short: bool, key: str | None = None):
        self.items = re.findall(r'[()|"]|[\w?]+', text)
        self.at, self.stops, self.short, self.key, self.quoted = 0, stops, short, key, False

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def either(self):
        node = self.both()
        while self.peek() == "|":
            self.at += 1
            right = self.both()
            if node is None or right is None:
                raise QueryError("an operand is missing")
            node = Either(node, right)
        return node

    def both(self):
        node = None
        while (x := self.peek()) is not None and x not in ")|" and not (x == '"' and self.quoted):
            part = self.atom()
            if part is not None:
                node = part if node is None else Both(node, part)
        return node

    def atom(self):
        x = self.peek()
        self.at += 1
        if x in '("':
            quoted, self.quoted = self.quoted, self.quoted or x == '"'
            node = self.either()
            self.quoted = quoted
            if self.peek() != (")" if x == "(" else '"'):
                raise QueryError("a bracket or quote is not closed")
            self.at += 1
            return node
        if x in self.stops or not self.short and len(x) < 3:
            return None
        exact = self.quoted or "?" in x or not any(c.isalpha() for c in x)
        return Word(x, exact, self.key)


def parse(request: str, stops: set[str] = frozenset()) -> Query:
    """The tree of a request; upper case plays no part, quotes make words exact."""
    out = Query()
    text = request.lower()
    for m in re.finditer(r"-filter:(\S+)", text):
        out.doc_filters += [x for x in m[1].split(",") if x]
    text = re.sub(r"-filter:\S+", " ", text)

    def take(m: re.Match) -> str:
        p = _Parser(m[2], set(stops), True, m[1])
        node = p.either()
        if node is None or p.peek() is not None:
            raise QueryError("a field's value cannot be read")
        out.fields.append((m[1], node))
        return " "

    text = re.sub(r"\{\s*(\w+)\s*=([^{}]*)\}", take, text)
    text = re.sub(r"\{[^}]*\}?", " ", text)
    p = _Parser(re.sub(r'[^\w()|?"]|_', " ", text), set(stops), False)
    out.body = p.either()
    if p.peek() is not None:
        raise QueryError("a bracket is never opened")
    if out.body is None and not out.fields:
        raise QueryError("the request is empty")
    return out
