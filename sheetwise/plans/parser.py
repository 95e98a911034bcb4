"""A Pratt parser for formulas.

Trees are tuples: ("num", x) ("str", s) ("bool", b) ("err", e) ("omit",) ("name", sheet, name) ("range", a, b)
("array", rows) ("call", name, args) ("bin", op, l, r) ("un", op, x) ("post", op, x).
"""

from __future__ import annotations

import re

DEPTH = 200


class FormulaError(ValueError):
    """The text is no formula."""


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | "(?P<str>(?:[^"]|"")*)"
    | (?P<err>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA|SPILL!|CALC!|UNSUPPORTED!|BLOCKED!|RESOURCE!))
    | '(?P<quoted>(?:[^']|'')+)'!
    | \[(?P<column>[^\]]+)\]
    | (?P<name>\$?[A-Za-z_\\][A-Za-z0-9_.\\]*(?:\$\d+)?|\$\d+)
    | (?P<op><=|>=|<>|[-+*/^&=<>%(),;:{}!@\#])
    )""",
    re.X,
)

#: Binding powers. Unary signs bind tighter than ^, and all operators group to the left.
_POWER = {"=": 10, "<>": 10, "<": 10, "<=": 10, ">": 10, ">=": 10, "&": 20, "+": 30, "-": 30, "*": 40, "/": 40, "^": 50, "%": 60, ":": 90, "#": 95}
_SIGN = 70


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"can't read {text[at : at + 20]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _lex(text), 0, 0

    def peek(self, value: str | None = None) -> bool:
        kind, got = self.tokens[self.at]
        return kind == "end" if value is None else kind == "op" and got == value

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if value is not None and not self.peek(value):
            raise FormulaError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def expression(self, power: int = 0):
        self.depth += 1
        if self.depth > DEPTH:
            raise FormulaError("nested too deeply")
        left = self.prefix()
        while True:
            kind, op = self.tokens[self.at]
            binding = _POWER.get(op, -1) if kind == "op" else -1
            if binding <= power or binding < 0:
                break
            self.take()
            if op in "%#":
                left = ("post", op, left)
            elif op == ":":
                left = ("range", left, self.expression(binding))
            else:
                left = ("bin", op, left, self.expression(binding))
        self.depth -= 1
        return left

    def prefix(self):
        kind, text = self.take()
        if kind == "num":
            return ("num", float(text))
        if kind == "str":
            return ("str", text.replace('""', '"'))
        if kind == "err":
            return ("err", text)
        if kind == "quoted":
            return ("name", text.replace("''", "'"), self.name())
        if kind == "column":
            return ("name", None, text)
        if kind == "op" and text in "+-@":
            return ("un", text, self.expression(_SIGN if text != "@" else 85))
        if kind == "op" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "op" and text == "{":
            return self.array()
        if kind == "name":
            if self.peek("!"):
                self.take()
                return ("name", text, self.name())
            if self.peek("("):
                return self.call(text.upper())
            if text.upper() in ("TRUE", "FALSE"):
                return ("bool", text.upper() == "TRUE")
            return ("name", None, text)
        raise FormulaError(f"unexpected {text!r}")

    def name(self) -> str:
        kind, text = self.take()
        if kind not in ("name", "column"):
            raise FormulaError(f"expected a name, found {text!r}")
        return text

    def call(self, name: str):
        name = name.removeprefix("_XLFN.").removeprefix("_XLWS.")
        self.take("(")
        args = []
        if not self.peek(")"):
            while True:
                args.append(("omit",) if self.peek(",") or self.peek(")") else self.expression())
                if self.peek(")"):
                    break
                self.take(",")
        self.take(")")
        node = ("call", name, args)
        while self.peek("("):  # a lambda called at once
            node = ("apply", node, self.call("")[2])
        return node

    def array(self):
        rows, row = [], []
        while True:
            node = self.expression()
            row.append(node)
            _, op = self.take()
            if op in ";}":
                rows.append(row)
                row = []
            if op == "}":
                break
            if op not in ",;":
                raise FormulaError(f"unexpected {op!r} in an array")
        if len({len(r) for r in rows}) != 1:
            raise FormulaError("array rows differ in length")
        return ("array", rows)


def parse(text: str):
    """The tree of a formula, with or without its leading =."""
    text = text.strip()
    p = _Parser(text[1:] if text.startswith("=") else text)
    tree = p.expression()
    if not p.peek():
        raise FormulaError(f"unexpected {p.take()[1]!r}")
    return tree
