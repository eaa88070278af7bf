"""A passive expression language over property columns.

Literals, ``${key:default}`` placeholders, comparison, arithmetic, ``and or not
&& || !``, ``c ? a : b`` and ``a ?: b``; no methods, types, beans or variables.
Expressions compile to columns; a property without value and default makes
what depends on it null (unknown).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(\$\{)|(==|!=|<=|>=|&&|\|\||\?:|[-+*/%<>!?:()])|([A-Za-z_]\w*))")
WORDS = {"and": "&&", "or": "||", "not": "!", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
#: Bounds of one expression.
MAX_CHARACTERS, MAX_DEPTH = 4096, 64


#: The key of a placeholder with what ends it, and the pieces of a text.
KEY = re.compile(r"\s*([\w.\-]+)\s*([:}])")
PIECE = re.compile(r"(\$\{)|(\})|((?:[^$}]|\$(?!\{))+)")


def _joined(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else F.lit("")


class ExpressionError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, prefix: str):
        if len(text) > MAX_CHARACTERS:
            raise ExpressionError("RESOURCE_LIMIT")
        self.prefix, self.depth, self.at = prefix, 0, 0
        self.tokens: list[tuple[str, object]] = []
        i = 0
        while i < len(text.rstrip()):
            m = TOKEN.match(text, i)
            if not m:
                raise ExpressionError("EXPRESSION_INVALID")
            number, string, hole, op, word = m.groups()
            i = m.end()
            if hole:
                body, i = self.hole(text, i)
                self.tokens.append(("value", body))
            elif number:
                self.tokens.append(("number", number))
            elif string:
                self.tokens.append(("string", string[1:-1].replace(string[0] * 2, string[0])))
            elif op:
                self.tokens.append(("op", op))
            elif word.lower() in WORDS:
                self.tokens.append(("op", WORDS[word.lower()]))
            elif word.lower() in ("true", "false", "null"):
                self.tokens.append(("constant", word.lower()))
            else:
                raise ExpressionError("EXPRESSION_UNSUPPORTED")

    # hole := "${" key ( "}" | ":" pieces "}" );  pieces := ( hole | text )*
    def hole(self, text: str, i: int) -> tuple[Column, int]:
        """A placeholder from behind its '${'; a default may hold others."""
        m = KEY.match(text, i)
        if not m:
            raise ExpressionError("EXPRESSION_UNSUPPORTED" if "}" in text[i:] else "EXPRESSION_INVALID")
        value = F.col(f"{self.prefix}{re.sub(r'[.-]', '_', m.group(1))}")
        if m.group(2) == "}":
            return value, m.end()
        default, i = self.pieces(text, m.end(), inside=True)
        return F.coalesce(value, default), i

    def pieces(self, text: str, i: int, inside: bool) -> tuple[Column, int]:
        """Text and placeholders in turn, up to the closing brace if ``inside``
        a placeholder, else to the end; unknown if any part is."""
        parts: list[Column] = []
        while i < len(text):
            opening, closing, plain = PIECE.match(text, i).groups()
            i += len(opening or closing or plain)
            if opening:
                part, i = self.hole(text, i)
                parts.append(part)
            elif closing and inside:
                return _joined(parts), i
            else:
                parts.append(F.lit(closing or plain))
        if inside:
            raise ExpressionError("EXPRESSION_INVALID")
        return _joined(parts), i

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self) -> tuple[str, object]:
        if self.at >= len(self.tokens):
            raise ExpressionError("EXPRESSION_INVALID")
        self.at += 1
        return self.tokens[self.at - 1]

    # every level returns (kind, column); kind is number, string, boolean or text
    # (a placeholder, which takes the kind of what it is used with)
    def expression(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError("RESOURCE_LIMIT")
        left = self.binary(0)
        if self.peek("?:"):
            self.take()
            kind, right = self.expression()
            left = (kind, F.coalesce(F.when(self.string(left) != "", self.typed(left, kind)), right))
        elif self.peek("?"):
            self.take()
            a = self.expression()
            if self.take() != ("op", ":"):
                raise ExpressionError("EXPRESSION_INVALID")
            b = self.expression()
            kind = b[0] if a[0] == "text" else a[0]
            test = self.typed(left, "boolean")
            left = (kind, F.when(test, self.typed(a, kind)).when(~test, self.typed(b, kind)))
        self.depth -= 1
        return left

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            op = self.take()[1]
            left = self.apply(op, left, self.binary(level + 1))
        return left

    def apply(self, op, a, b):
        if op in ("||", "&&"):
            x, y = self.typed(a, "boolean"), self.typed(b, "boolean")
            return "boolean", (x | y) if op == "||" else (x & y)
        kinds = {a[0], b[0]} - {"text"}
        if op == "+" and "string" in kinds:
            return "string", F.concat(self.string(a), self.string(b))
        kind = kinds.pop() if len(kinds) == 1 else "string" if not kinds else None
        if op in ("-", "*", "/", "%", "<", ">", "<=", ">=") and kind == "string" and "string" not in (a[0], b[0]):
            kind = "number"
        if kind is None:
            if op in ("==", "!="):
                return "boolean", F.lit(op == "!=")
            raise ExpressionError("EXPRESSION_INVALID")
        x, y = self.typed(a, kind), self.typed(b, kind)
        if op == "==":
            return "boolean", x == y
        if op == "!=":
            return "boolean", x != y
        if op in ("<", ">", "<=", ">="):
            return "boolean", {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if kind != "number":
            raise ExpressionError("EXPRESSION_INVALID")
        return "number", {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op]

    def unary(self):
        if self.peek("!"):
            self.take()
            return "boolean", ~self.typed(self.unary(), "boolean")
        if self.peek("-", "+"):
            op = self.take()[1]
            x = self.typed(self.unary(), "number")
            return "number", -x if op == "-" else x
        kind, value = self.take()
        if kind == "number":
            return "number", F.lit(value).cast("decimal(38,10)")
        if kind == "string":
            return "string", self.pieces(value, 0, inside=False)[0]
        if kind == "constant":
            return ("text", F.lit(None).cast("string")) if value == "null" else ("boolean", F.lit(value == "true"))
        if kind == "value":
            return "text", value
        if value == "(":
            inner = self.expression()
            if self.take() != ("op", ")"):
                raise ExpressionError("EXPRESSION_INVALID")
            return inner
        raise ExpressionError("EXPRESSION_INVALID")

    def string(self, x) -> Column:
        return x[1].cast("string")

    def typed(self, x, kind: str) -> Column:
        have, column = x
        if have == kind or kind == "text":
            return column
        if have != "text":
            raise ExpressionError("EXPRESSION_INVALID")
        if kind == "number":
            return column.try_cast("decimal(38,10)")
        if kind == "boolean":
            return F.when(F.lower(column) == "true", True).when(F.lower(column) == "false", False)
        return column


def compile_expression(text: str, prefix: str = "property_") -> Column:
    """Column of an expression; ``#{...}`` around it is taken off."""
    m = re.fullmatch(r"\s*#\{(.*)\}\s*", text, re.S)
    p = _Parser(m.group(1) if m else text, prefix)
    kind, column = p.expression()
    if p.at < len(p.tokens):
        raise ExpressionError("EXPRESSION_INVALID")
    return column


def property_keys(text: str) -> set[str]:
    """Keys of the placeholders of an expression, defaults included."""
    return set(re.findall(r"\$\{([\w.\-]+)", text))
