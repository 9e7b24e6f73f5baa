"""Query strings to predicates: a tree of nodes, and its Column.

Grammar: OR, XOR, AND, SUB (minus), NOT, comparisons, BETWEEN, LIKE, IN, parentheses,
``value[field]`` search, and bare values that search the default fields.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>'(?:[^']|'')*'|\"[^\"]*\")|(?P<op><=|>=|<>|!=|==|=|<|>|\(|\)|\[|\]|,)|(?P<word>[A-Za-z_][\w.]*))")
_LEVELS = (("OR",), ("XOR",), ("AND", "SUB", "MINUS"))
_COMPARE = {"=": "eq", "==": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


@dataclass
class Node:
    kind: str
    value: object = None
    kids: list[Node] = field(default_factory=list)

    def show(self, depth: int = 0) -> str:
        line = "  " * depth + self.kind + ("" if self.value is None else f" {self.value!r}")
        return "\n".join([line, *(k.show(depth + 1) for k in self.kids)])


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read query at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in what and self.tokens[self.at][0] != "str"

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, what: str) -> None:
        if not self.peek(what):
            raise ValueError(f"{what} expected")
        self.at += 1

    def level(self, k: int = 0) -> Node:
        if k == len(_LEVELS):
            return self.unary()
        node = self.level(k + 1)
        while self.peek(*_LEVELS[k]):
            op = self.take()[1].upper().replace("MINUS", "SUB")
            node = Node(op.lower(), None, [node, self.level(k + 1)])
        return node

    def unary(self) -> Node:
        if self.peek("NOT"):
            self.take()
            return Node("not", None, [self.unary()])
        if self.peek("("):
            self.take()
            node = self.level()
            self.need(")")
            return node
        return self.predicate()

    def atom(self) -> Node:
        kind, text = self.take()
        if kind == "num":
            return Node("const", float(text) if "." in text else int(text))
        if kind == "str":
            return Node("const", text[1:-1].replace("''", "'"))
        if kind == "word":
            if text.upper() in ("TRUE", "FALSE"):
                return Node("const", text.upper() == "TRUE")
            if self.peek("("):
                self.take()
                args = [] if self.peek(")") else [self.atom()]
                while self.peek(","):
                    self.take()
                    args.append(self.atom())
                self.need(")")
                return Node("call", text, args)
            return Node("name", text)
        raise ValueError(f"unexpected {text!r}")

    def predicate(self) -> Node:
        left = self.atom()
        if self.peek("["):
            self.take()
            name = self.take()[1]
            self.need("]")
            return Node("search", name, [left])
        if self.peek(*_COMPARE):
            return Node(_COMPARE[self.take()[1]], None, [left, self.atom()])
        negated = self.peek("NOT")
        if negated:
            self.take()
        if self.peek("BETWEEN"):
            self.take()
            low = self.atom()
            self.need("AND")
            node = Node("between", None, [left, low, self.atom()])
        elif self.peek("LIKE"):
            self.take()
            node = Node("like", self.take()[1].strip("'\""), [left])
        elif self.peek("IN"):
            self.take()
            self.need("(")
            items = [self.atom()]
            while self.peek(","):
                self.take()
                items.append(self.atom())
            self.need(")")
            node = Node("in", None, [left, *items])
        else:
            node = left
        return Node("not", None, [node]) if negated else node


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.level()
    if p.at < len(p.tokens):
        raise ValueError(f"unexpected {p.tokens[p.at][1]!r}")
    return node


class Executor:
    """Builds the Column of a tree. Functions are registered by name; an unknown one is an error."""

    def __init__(self, default_fields: Sequence[str] = ()):
        self.default_fields = list(default_fields)
        self.functions: dict[str, Callable[..., Column]] = {"lower": F.lower, "upper": F.upper, "length": F.length, "abs": F.abs}
        self.elapsed: dict[str, float] = {}

    def register(self, name: str, f: Callable[..., Column]) -> None:
        self.functions[name.lower()] = f

    def column(self, node: Node, logical: bool = True) -> Column:
        began = time.perf_counter()
        try:
            return self._column(node, logical)
        finally:
            self.elapsed[node.kind] = self.elapsed.get(node.kind, 0) + time.perf_counter() - began

    def _column(self, node: Node, logical: bool) -> Column:
        k, kids = node.kind, node.kids
        if k in ("and", "or", "xor", "sub"):
            a, b = self.column(kids[0]), self.column(kids[1])
            return {"and": a & b, "or": a | b, "xor": a != b, "sub": a & ~b}[k]
        if k == "not":
            return ~self.column(kids[0])
        if k == "name":
            return F.col(node.value)
        if k == "const":
            if logical and not isinstance(node.value, bool):
                if not self.default_fields:
                    raise ValueError("a bare value needs default fields")
                return reduce(Column.__or__, [F.contains(F.col(f).cast("string"), F.lit(str(node.value))) for f in self.default_fields])
            return F.lit(node.value)
        if k == "search":
            value = kids[0].value
            return F.contains(F.col(node.value).cast("string"), F.lit(str(value)))
        if k == "call":
            if node.value.lower() not in self.functions:
                raise ValueError(f"unknown function {node.value}")
            return self.functions[node.value.lower()](*[self.column(a, False) for a in kids])
        args = [self.column(a, False) for a in kids]
        if k == "between":
            return args[0].between(args[1], args[2])
        if k == "like":
            return args[0].like(node.value)
        if k == "in":
            return args[0].isin(*[n.value for n in kids[1:]])
        compare = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
        return compare[k](args[0], args[1])


def predicate(text: str, default_fields: Sequence[str] = ()) -> Column:
    return Executor(default_fields).column(parse(text))
