"""Java 17 compilation units."""

from __future__ import annotations

import re

from .base import BAD, END, Fail, Lexemes, Parser, Shapes, keywords, near

WORDS = """abstract assert break case catch class continue default do else enum extends final
finally for if implements import instanceof interface native new package private protected
public return static strictfp super switch synchronized this throw throws transient try
volatile while goto const"""
K = keywords(WORDS, 0x100)
PRIMITIVE, LITERAL, VOID = "p", "n", "v"
TABLE = {
    **K,
    **dict.fromkeys("boolean byte char short int long float double".split(), PRIMITIVE),
    **dict.fromkeys(("true", "false", "null"), LITERAL),
    "void": VOID, "_": BAD,
    **{c: c for c in "(){}[];,.@?:=<&|^"},
    ">": ">", "> ": "G", "||": "O", "&&": "N", "==": "E", "!=": "E", "<=": "R", ">=": "R", "<<": "L",
    "+": "+", "-": "+", "*": "*", "/": "/", "%": "/", "!": "!", "~": "!", "++": "P", "--": "P",
    "->": "W", "::": "D", "...": "V",
    **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split(), "A"),
}
#: Contextual words keep their own class but count as identifiers.
SOFT = {
    "requires": "q", "transitive": "t", "exports": "e", "opens": "e", "uses": "u", "provides": "b", "to": "k", "with": "w",
    "record": "r", "sealed": "z", "permits": "y", "yield": "d", "var": "i", "module": "m", "open": "o"}
TABLE |= SOFT
NAME = frozenset("irzydmoqteubkw")
DIRECTIVES = frozenset("qeub")
TOKEN = re.compile(
    r"""\s*("""
    r"""(?:[^\W\d]|\$)[\w$]*"""
    r"""|//[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"""
    r'''|"""[ \t\f]*\r?\n(?:[^\\"]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}|\r?\n)|"(?!""))*"""'''
    r'''|"(?:[^"\\\r\n]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*"'''
    r"""|'(?:[^'\\\r\n]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"""
    r"""|\.?\d(?:[eEpP][+-]|[\w.])*"""
    r"""|>>>=|>>=|<<=|>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<|[-+*/%&|^]=|>(?=>)|\S)"""
)
NUMBER = re.compile(
    r"0[xX](?:[\da-fA-F](?:[\da-fA-F_]*[\da-fA-F])?[lL]?"
    r"|(?:[\da-fA-F][\da-fA-F_]*\.?[\da-fA-F]*|\.[\da-fA-F]+)[pP][+-]?\d[\d_]*[fFdD]?)"
    r"|0[bB][01](?:[01_]*[01])?[lL]?"
    r"|\d(?:[\d_]*\d)?[lLfFdD]?"
    r"|(?:\d(?:[\d_]*\d)?\.(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d[\d_]*)?[fFdD]?"
    r"|\d(?:[\d_]*\d)?[eE][+-]?\d[\d_]*[fFdD]?"
)


def classify(x: str) -> str:
    c = x[0]
    if c.isalpha() or c in "_$":
        return "i"
    if x.startswith(("//", "/*")) and len(x) > 1:
        return ""
    if c in "\"'":
        return LITERAL if len(x) > 1 else BAD
    if c.isdigit() or c == "." and len(x) > 1:
        return LITERAL if NUMBER.fullmatch(x) and not re.fullmatch(r"0[\d_]*[89][\d_]*[lL]?", x) else BAD
    return BAD


BINARY = {"O": 1, "N": 2, "|": 3, "^": 4, "&": 5, "E": 6, "<": 7, ">": 7, "R": 7, "L": 8, "G": 8, "+": 9, "*": 10, "/": 10, K["instanceof"]: 7}
MODIFIERS = frozenset(K[w] for w in "abstract final native private protected public static strictfp synchronized transient volatile default".split())
TYPE_WORDS = frozenset((K["class"], K["interface"], K["enum"]))
STARTS = NAME | frozenset((LITERAL, "(", "!", PRIMITIVE, VOID, K["this"], K["super"], K["new"], K["switch"]))
FOLLOW = K["else"] + K["catch"] + K["finally"] + K["while"]
B0 = r"\{[^{}]*\}"
UNIT = re.compile(rf"[^{{}};]*(?:;|{B0}(?:{K['else']}[^{{}};]*{B0})*(?![{FOLLOW}.;,)]))")
LONG = re.compile(rf"(?:[^{{}};]|\{{(?:[^{{}}]|{B0})*\}})*;")
HEAD = re.compile(r"[^{};=]*\{")


class JavaParser(Parser):
    language = "java"
    token = TOKEN
    lexemes = Lexemes(TABLE, classify)
    units = Shapes()
    heads = Shapes()
    fields = Shapes()

    def classes(self, text: str) -> str:
        s = super().classes(text)
        return s.replace(">>", "G>").replace("G>>", "GG>") if ">>" in s else s

    # -- declarations ------------------------------------------------------
    def file(self, i: int) -> int:
        s = self.s
        if s[0] == "﻿":
            i = 1
        if self.is_module(i):
            return self.module(i)
        start = i
        while True:
            try:
                j = self.annotations(i)
                if s[j] == K["package"]:
                    i = self.need(self.name(j + 1), ";", "EXPECTED_SEMICOLON")
                break
            except Fail as e:
                i = self.recover(e, i)
                break
        types = False
        while s[i] != END:
            try:
                if s[i] == ";":
                    i += 1
                elif s[i] == K["import"] and not types:
                    i = self.imports(i)
                else:
                    types = True
                    j = self.modifiers(i)
                    if not self.at_type(j):
                        raise Fail(j, "EXPECTED_TYPE_DECLARATION")
                    i = self.type_declaration(j)
            except Fail as e:
                j = self.recover(e, i)
                i = j + 1 if s[j] == "}" or j == i and s[j] != END else j
        return i if i > start else start

    def is_module(self, i: int) -> bool:
        s = self.s
        j = i + 1 if s[i] == "o" else i
        return s[j] == "m" and s[j + 1] in NAME

    def module(self, i: int) -> int:
        s = self.s
        i = self.need(self.name(i + 2 if s[i] == "o" else i + 1), "{", "EXPECTED_MODULE_BODY")
        while s[i] in DIRECTIVES:
            word = s[i]
            i += 1
            if word == "q":  # requires
                while s[i] == K["static"] or s[i] == "t" and s[i + 1] in NAME:
                    i += 1
                i = self.name(i)
            else:
                i = self.name(i)
                if word == "e" and s[i] == "k" or word == "b":  # exports, opens .. to; provides .. with
                    i = self.name(self.need(i, "w" if word == "b" else "k", "EXPECTED_WITH"))
                    while s[i] == ",":
                        i = self.name(i + 1)
            i = self.need(i, ";", "EXPECTED_SEMICOLON")
        i = self.need(i, "}", "EXPECTED_CLOSING_BRACE")
        return self.need(i, END, "TRAILING_TOKENS")

    def imports(self, i: int) -> int:
        s = self.s
        i += 2 if s[i + 1] == K["static"] else 1
        i = self.need_name(i)
        while s[i] == ".":
            if s[i + 1] == "*":
                i += 2
                break
            i = self.need_name(i + 1)
        return self.need(i, ";", "EXPECTED_SEMICOLON")

    def need_name(self, i: int) -> int:
        if self.s[i] not in NAME:
            raise Fail(i, "UNEXPECTED_END" if self.s[i] == END else "EXPECTED_IDENTIFIER")
        return i + 1

    def name(self, i: int) -> int:
        i = self.need_name(i)
        while self.s[i] == "." and self.s[i + 1] in NAME:
            i += 2
        return i

    def annotations(self, i: int) -> int:
        s = self.s
        while s[i] == "@" and s[i + 1] != K["interface"]:
            i = self.name(i + 1)
            if s[i] == "(":
                i += 1
                if s[i] != ")":
                    while True:
                        if s[i] in NAME and s[i + 1] == "=":
                            i += 2
                        i = self.element(i)
                        if s[i] != ",":
                            break
                        i += 1
                i = self.need(i, ")", "EXPECTED_CLOSING_PAREN")
        return i

    def element(self, i: int) -> int:
        s = self.s
        if s[i] == "@":
            return self.annotations(i)
        if s[i] == "{":
            i += 1
            while s[i] != "}":
                i = self.element(i)
                if s[i] == ",":
                    i += 1
                elif s[i] != "}":
                    raise Fail(i, "EXPECTED_CLOSING_BRACE")
            return i + 1
        return self.ternary(i)

    def modifiers(self, i: int) -> int:
        s, seen = self.s, ""
        while True:
            c = s[i]
            if c in MODIFIERS:
                if c == K["default"] and s[i + 1] in ":W":
                    return i
                if c in seen:
                    raise Fail(i, "REPEATED_MODIFIER")
                seen += c
                i += 1
            elif c == "@" and s[i + 1] != K["interface"]:
                i = self.annotations(i)
            elif c == "z" and (s[i + 1] in MODIFIERS or s[i + 1] in TYPE_WORDS or s[i + 1] == "@"):
                i += 1
            elif c == "i" and s[i + 1] == "+" and s[i + 2] == "z":  # non-sealed
                i += 3
            else:
                return i

    def at_type(self, j: int) -> bool:
        s = self.s
        return s[j] in TYPE_WORDS or s[j] == "@" and s[j + 1] == K["interface"] or s[j] == "r" and s[j + 1] in NAME and s[j + 2] in "(<"

    def type_declaration(self, i: int) -> int:
        """From the word class, interface, enum, record or @interface on."""
        s = self.s
        word = s[i]
        if word == "@":
            i += 1
        i = self.need_name(i + 1)
        if s[i] == "<":
            i = self.type_parameters(i)
        if word == "r":
            i = self.parameters(i)
        while s[i] in (K["extends"], K["implements"], "y"):
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        return self.enum_body(i) if word == K["enum"] else self.class_body(i)

    def type_parameters(self, i: int) -> int:
        s = self.s
        i += 1
        while True:
            i = self.need_name(self.annotations(i))
            if s[i] == K["extends"]:
                i = self.type(i + 1)
                while s[i] == "&":
                    i = self.type(i + 1)
            if s[i] == ",":
                i += 1
                continue
            if s[i] in ">G":
                return i + 1
            raise Fail(i, "EXPECTED_TYPE_PARAMETER")

    def enum_body(self, i: int) -> int:
        s = self.s
        i = self.need(i, "{", "EXPECTED_BODY")
        while s[i] != "}" and s[i] != ";":
            i = self.need_name(self.annotations(i))
            if s[i] == "(":
                i = self.arguments(i)
            if s[i] == "{":
                i = self.class_body(i)
            if s[i] == ",":
                i += 1
            elif s[i] not in "};":
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_ENUM_CONSTANT")
        if s[i] == ";":
            return self.members(i + 1)
        return i + 1

    def class_body(self, i: int) -> int:
        return self.members(self.need(i, "{", "EXPECTED_BODY"))

    def members(self, i: int) -> int:
        s = self.s
        while s[i] != "}":
            if s[i] == END:
                raise Fail(i, "UNEXPECTED_END")
            start = i
            try:
                i = self.member(i)
            except Fail as e:
                if e.code == "UNEXPECTED_END":
                    raise
                i = max(self.recover(e, i), start)
                if i == start:
                    i += 1
        return i + 1

    def member(self, i: int) -> int:
        s = self.s
        m = near(HEAD, s, i)
        if m and m.group() in self.heads:
            return self.block(m.end() - 1)
        m = near(UNIT, s, i)
        if m and m.group() in self.fields:
            return m.end()
        start, before = i, len(self.errors)
        if s[i] == ";":
            return i + 1
        if s[i] == "{":
            return self.block(i)
        if s[i] == K["static"] and s[i + 1] == "{":
            return self.block(i + 1)
        i = self.modifiers(i)
        if self.at_type(i):
            return self.type_declaration(i)
        if s[i] == "<":
            i = self.annotations(self.type_parameters(i))
        if s[i] in NAME and s[i + 1] in "({":  # constructor, compact constructor
            i += 1
            if s[i] == "(":
                i = self.throws(self.parameters(i))
            self.heads.learn(s[start : i + 1]) if s[i] == "{" else None
            return self.block(i)
        i = i + 1 if s[i] == VOID else self.type(i)
        i = self.need_name(i)
        if s[i] == "(":
            i = self.parameters(i)
            while s[i] == "[" and s[i + 1] == "]":
                i += 2
            i = self.throws(i)
            if s[i] == K["default"]:
                i = self.element(i + 1)
            if s[i] == ";":
                i += 1
                if before == len(self.errors):
                    self.fields.learn(s[start:i])
                return i
            if s[i] == "{":
                self.heads.learn(s[start : i + 1])
            return self.block(i)
        i = self.declarators(i)
        i = self.need(i, ";", "EXPECTED_SEMICOLON")
        if before == len(self.errors):
            self.fields.learn(s[start:i])
        return i

    def throws(self, i: int) -> int:
        if self.s[i] == K["throws"]:
            i = self.type(i + 1)
            while self.s[i] == ",":
                i = self.type(i + 1)
        return i

    def declarators(self, i: int) -> int:
        """Behind the first name: dimensions, initialiser, further names."""
        s = self.s
        while True:
            while s[i] == "[" and s[i + 1] == "]":
                i += 2
            if s[i] == "=":
                i = self.initialiser(i + 1)
            if s[i] != ",":
                return i
            i = self.need_name(i + 1)

    def initialiser(self, i: int) -> int:
        s = self.s
        if s[i] != "{":
            return self.expression(i)
        i += 1
        while s[i] != "}":
            i = self.initialiser(i)
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_BRACE")
        return i + 1

    def parameters(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(", "EXPECTED_PARAMETERS")
        if s[i] == ")":
            return i + 1
        while True:
            i = self.type(self.modifiers(i))
            i = self.annotations(i)
            if s[i] == "V":
                i += 1
            if s[i] == K["this"]:
                i += 1
            else:
                i = self.need_name(i)
                while s[i] == "." and s[i + 1] in (K["this"], *NAME):
                    i += 2
            while s[i] == "[" and s[i + 1] == "]":
                i += 2
            if s[i] == ",":
                i += 1
                continue
            return self.need(i, ")", "EXPECTED_CLOSING_PAREN")

    # -- types -------------------------------------------------------------
    def type(self, i: int) -> int:
        s = self.s
        i = self.annotations(i)
        if s[i] == PRIMITIVE:
            i += 1
        else:
            i = self.need_name(i)
            while True:
                if s[i] == "<":
                    i = self.type_arguments(i)
                if s[i] == "." and (s[i + 1] in NAME or s[i + 1] == "@"):
                    i = self.need_name(self.annotations(i + 1))
                else:
                    break
        while True:
            j = self.annotations(i) if s[i] == "@" else i
            if s[j] == "[" and s[j + 1] == "]":
                i = j + 2
            else:
                return i

    def type_arguments(self, i: int, diamond: bool = False) -> int:
        s = self.s
        i += 1
        if s[i] in ">G" and diamond:
            return i + 1
        while True:
            i = self.annotations(i)
            if s[i] == "?":
                i += 1
                if s[i] in (K["extends"], K["super"]):
                    i = self.type(i + 1)
            else:
                i = self.type(i)
            if s[i] == ",":
                i += 1
            elif s[i] in ">G":
                return i + 1
            else:
                raise Fail(i, "EXPECTED_TYPE_ARGUMENT")

    def maybe_type(self, i: int) -> int:
        try:
            return self.type(i)
        except Fail:
            return -1

    # -- statements --------------------------------------------------------
    def block(self, i: int) -> int:
        s = self.s
        i = self.need(i, "{", "EXPECTED_BLOCK")
        while s[i] != "}":
            if s[i] == END:
                raise Fail(i, "UNEXPECTED_END")
            start = i
            try:
                i = self.statement(i)
            except Fail as e:
                if e.code == "UNEXPECTED_END":
                    raise
                i = self.recover(e, start)
                if i == start:
                    i += s[i] != "}"
        return i + 1

    def statement(self, i: int) -> int:
        s = self.s
        m = near(UNIT, s, i)
        if m:
            if m.group() in self.units:
                return m.end()
            n = near(LONG, s, i)
            if n and n.group() in self.units:
                return n.end()
        before = len(self.errors)
        j = self.real_statement(i)
        if before == len(self.errors):
            if m and j == m.end() or m and (n := near(LONG, s, i)) and j == n.end():
                self.units.learn(s[i:j])
        return j

    def condition(self, i: int) -> int:
        return self.need(self.expression(self.need(i, "(", "EXPECTED_OPENING_PAREN")), ")", "EXPECTED_CLOSING_PAREN")

    def body(self, i: int) -> int:
        """A statement that is no declaration."""
        s = self.s
        if self.declares(i):
            raise Fail(i, "DECLARATION_NOT_ALLOWED")
        return self.statement(i)

    def declares(self, i: int) -> bool:
        s = self.s
        if s[i] in NAME or s[i] == PRIMITIVE:
            if s[i] == "d":
                return False
            j = self.maybe_type(i)
            return j > 0 and s[j] in NAME and s[j + 1] in "=;,:["
        return False

    def real_statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        if c >= "Ā":
            if c == K["if"]:
                i = self.body(self.condition(i + 1))
                return self.body(i + 1) if s[i] == K["else"] else i
            if c == K["while"]:
                return self.body(self.condition(i + 1))
            if c == K["return"]:
                return self.end(i + 1 if s[i + 1] == ";" else self.expression(i + 1))
            if c == K["for"]:
                return self.for_statement(i)
            if c == K["break"] or c == K["continue"]:
                return self.end(i + 2 if s[i + 1] in NAME else i + 1)
            if c == K["throw"]:
                return self.end(self.expression(i + 1))
            if c == K["do"]:
                i = self.need(self.body(i + 1), K["while"], "EXPECTED_WHILE")
                return self.end(self.condition(i))
            if c == K["try"]:
                return self.try_statement(i)
            if c == K["switch"]:
                j = self.switch(i)
                return j if s[j] not in ".D" else self.end(self.expression(i))
            if c == K["synchronized"]:
                return self.block(self.condition(i + 1))
            if c == K["assert"]:
                i = self.expression(i + 1)
                return self.end(self.expression(i + 1) if s[i] == ":" else i)
        if c == "d" and s[i + 1] not in "=.[(;" or c == "d" and s[i + 1] == "(" and s[self.closing(i + 1) + 1] not in ".;":
            return self.end(self.expression(i + 1))
        if c == "d" and s[i + 1] == "(":
            return self.end(self.expression(i + 1))
        if c in NAME and s[i + 1] == ":":
            return self.statement(i + 2)
        if c in MODIFIERS or c == "@" or c in TYPE_WORDS or c == "z" or c == "r" or c == "i" and s[i + 1] == "+" and s[i + 2] == "z":
            j = self.modifiers(i)
            if self.at_type(j):
                return self.type_declaration(j)
            if j > i:
                j = self.need_name(self.type(j))
                return self.end(self.declarators(j))
        if c in NAME or c == PRIMITIVE:
            j = self.maybe_type(i)
            if j > 0 and s[j] in NAME and s[j + 1] in "=;,[":
                return self.end(self.declarators(j + 1))
        j = self.expression(i)
        if self.kind not in "CPAN" or not self.kind:
            raise Fail(i if s[j] == ";" else j, "UNEXPECTED_END" if s[j] == END else "NOT_A_STATEMENT")
        return self.end(j)

    def end(self, i: int) -> int:
        return self.need(i, ";", "EXPECTED_SEMICOLON")

    def for_statement(self, i: int) -> int:
        s = self.s
        i = self.need(i + 1, "(", "EXPECTED_OPENING_PAREN")
        j = self.modifiers(i)
        k = self.maybe_type(j) if s[j] in NAME or s[j] == PRIMITIVE else -1
        if k > 0 and s[k] in NAME and s[k + 1] in "=;,:[":
            k += 1
            if s[k] == ":":
                return self.body(self.need(self.expression(k + 1), ")", "EXPECTED_CLOSING_PAREN"))
            i = self.declarators(k)
        elif s[i] != ";":
            i = self.expression(i)
            while s[i] == ",":
                i = self.expression(i + 1)
        i = self.end(i)
        i = self.end(i if s[i] == ";" else self.expression(i))
        if s[i] != ")":
            i = self.expression(i)
            while s[i] == ",":
                i = self.expression(i + 1)
        return self.body(self.need(i, ")", "EXPECTED_CLOSING_PAREN"))

    def try_statement(self, i: int) -> int:
        s = self.s
        i += 1
        resources = s[i] == "("
        if resources:
            i += 1
            while True:
                j = self.modifiers(i)
                k = self.maybe_type(j)
                if k > 0 and s[k] in NAME and s[k + 1] == "=":
                    i = self.expression(k + 2)
                else:
                    i = self.expression(i)
                if s[i] == ";":
                    i += 1
                    if s[i] != ")":
                        continue
                break
            i = self.need(i, ")", "EXPECTED_CLOSING_PAREN")
        i = self.block(i)
        handlers = 0
        while s[i] == K["catch"]:
            i = self.need(i + 1, "(", "EXPECTED_OPENING_PAREN")
            i = self.type(self.modifiers(i))
            while s[i] == "|":
                i = self.type(i + 1)
            i = self.block(self.need(self.need_name(i), ")", "EXPECTED_CLOSING_PAREN"))
            handlers += 1
        if s[i] == K["finally"]:
            return self.block(i + 1)
        if not handlers and not resources:
            raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CATCH")
        return i

    def switch(self, i: int) -> int:
        s = self.s
        i = self.need(self.condition(i + 1), "{", "EXPECTED_BLOCK")
        while s[i] != "}":
            if s[i] == END:
                raise Fail(i, "UNEXPECTED_END")
            if s[i] == K["default"]:
                i += 1
            elif s[i] == K["case"]:
                i += 1
                while True:
                    i = i + 1 if s[i] == K["default"] else self.label(i)
                    if s[i] != ",":
                        break
                    i += 1
            else:
                raise Fail(i, "EXPECTED_CASE")
            if s[i] == ":":
                i += 1
                while s[i] not in ("}", K["case"], END) and not (s[i] == K["default"] and s[i + 1] in ":W"):
                    start = i
                    try:
                        i = self.statement(i)
                    except Fail as e:
                        if e.code == "UNEXPECTED_END":
                            raise
                        i = self.recover(e, start)
                        if i == start and s[i] != "}":
                            i += 1
            elif s[i] == "W":
                i += 1
                if s[i] == "{":
                    i = self.block(i)
                elif s[i] == K["throw"]:
                    i = self.statement(i)
                else:
                    i = self.end(self.expression(i))
            else:
                raise Fail(i, "EXPECTED_COLON")
        return i + 1

    def label(self, i: int) -> int:
        s = self.s
        if s[i] in NAME and s[i + 1] == "W":
            return i + 1
        return self.ternary(i)

    # -- expressions -------------------------------------------------------
    def expression(self, i: int) -> int:
        s = self.s
        i = self.ternary(i)
        if s[i] == "=" or s[i] == "A":
            if self.kind not in "vf[":
                raise Fail(i, "NOT_ASSIGNABLE")
            i = self.expression(i + 1)
            self.kind = "A"
        return i

    def ternary(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            i = self.need(self.expression(i + 1), ":", "EXPECTED_COLON")
            i = self.ternary(i)
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        """Precedence climbing."""
        s = self.s
        i = self.unary(i)
        while True:
            c = s[i]
            p = BINARY.get(c, 0)
            if p == 0 or p < least:
                return i
            if c == "G":
                i += 1 if s[i + 1] == "G" else 0
                if s[i + 1] != ">":
                    raise Fail(i, "EXPECTED_EXPRESSION")
                i += 1
            if c == K["instanceof"]:
                i = self.type(self.modifiers(i + 1))
                if s[i] in NAME:
                    i += 1
            else:
                i = self.binary(i + 1, p + 1)
            self.kind = "x"

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "+" or c == "!":
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if c == "P":
            i = self.unary(i + 1)
            if self.kind not in "vf[":
                raise Fail(i, "NOT_ASSIGNABLE")
            self.kind = "P"
            return i
        if c == "(":
            j = self.closing(i)
            if j < 0:
                raise Fail(len(s) - 1, "UNEXPECTED_END")
            if s[j + 1] == "W":
                return self.lambda_body(self.lambda_parameters(i))
            nxt = s[j + 1]
            if nxt in STARTS or nxt in "+P" and s[i + 1] == PRIMITIVE or nxt == "n":
                k = self.maybe_type(i + 1)
                while k > 0 and s[k] == "&":
                    k = self.maybe_type(k + 1)
                if k == j:
                    i = self.unary(j + 1)
                    self.kind = "x"
                    return i
        return self.postfix(i)

    def lambda_parameters(self, i: int) -> int:
        s = self.s
        j = i + 1
        if s[j] == ")":
            return j + 1
        if s[j] in NAME and s[j + 1] in ",)":
            while True:
                j = self.need_name(j)
                if s[j] != ",":
                    return self.need(j, ")", "EXPECTED_CLOSING_PAREN")
                j += 1
        return self.parameters(i)

    def lambda_body(self, i: int) -> int:
        i = self.need(i, "W", "EXPECTED_ARROW")
        i = self.block(i) if self.s[i] == "{" else self.expression(i)
        self.kind = "x"
        return i

    def arguments(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(", "EXPECTED_ARGUMENTS")
        if s[i] == ")":
            return i + 1
        while True:
            i = self.expression(i)
            if s[i] == ",":
                i += 1
                continue
            return self.need(i, ")", "EXPECTED_CLOSING_PAREN")

    def postfix(self, i: int) -> int:
        s = self.s
        c = s[i]
        kind = "x"
        if c in NAME:
            if s[i + 1] == "W":
                return self.lambda_body(i + 1)
            kind = "v"
            i += 1
            if s[i] == "<":
                k = self.maybe_type(i - 1)
                if k > 0 and s[k] == "D":
                    i = k
                    kind = "x"
            elif s[i] == "[" and s[i + 1] == "]":
                k = self.maybe_type(i - 1)
                if k > 0 and (s[k] == "D" or s[k] == "." and s[k + 1] == K["class"]):
                    i, kind = k, "x"
        elif c == LITERAL:
            i += 1
        elif c == "(":
            i = self.need(self.expression(i + 1), ")", "EXPECTED_CLOSING_PAREN")
            kind = self.kind if self.kind in "vf[" and self.kind else "x"
        elif c == K["this"]:
            i += 1
            if s[i] == "(":
                kind = "x"
        elif c == K["super"]:
            i += 1
            if s[i] not in ".D(":
                raise Fail(i, "EXPECTED_MEMBER")
        elif c == K["new"]:
            i, kind = self.creation(i)
        elif c == K["switch"]:
            i = self.switch(i)
        elif c == PRIMITIVE:
            i = self.type(i)
            if not (s[i] == "D" or s[i] == "." and s[i + 1] == K["class"]):
                raise Fail(i, "EXPECTED_EXPRESSION")
        elif c == VOID and s[i + 1] == "." and s[i + 2] == K["class"]:
            i += 1
        else:
            raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_EXPRESSION")
        while True:
            c = s[i]
            if c == ".":
                d = s[i + 1]
                if d in NAME:
                    i += 2
                    kind = "f"
                    if s[i] == "<" or s[i] == "[" and s[i + 1] == "]":
                        # a qualified generic or array type before '::' or '.class'
                        j = i
                        try:
                            if s[j] == "<":
                                j = self.type_arguments(j)
                            while s[j] == "[" and s[j + 1] == "]":
                                j += 2
                            if s[j] == "D" or s[j] == "." and s[j + 1] == K["class"]:
                                i, kind = j, "x"
                        except Fail:
                            pass
                elif d == "<":
                    i = self.type_arguments(i + 1)
                    if s[i] == K["super"]:
                        i += 1
                    else:
                        i = self.need_name(i)
                    if s[i] != "(":
                        raise Fail(i, "EXPECTED_ARGUMENTS")
                elif d == K["new"]:
                    i, kind = self.creation(i + 1)
                elif d in (K["this"], K["super"], K["class"]):
                    i += 2
                    kind = "x"
                else:
                    raise Fail(i + 1, "UNEXPECTED_END" if d == END else "EXPECTED_MEMBER")
            elif c == "[":
                i = self.need(self.expression(i + 1), "]", "EXPECTED_CLOSING_BRACKET")
                kind = "["
            elif c == "(":
                if kind not in "vf" and s[i - 1] not in (K["this"], K["super"]) and not (s[i - 1] in NAME):
                    raise Fail(i, "UNEXPECTED_PAREN")
                i = self.arguments(i)
                kind = "C"
            elif c == "P":
                if kind not in "vf[":
                    raise Fail(i, "NOT_ASSIGNABLE")
                i += 1
                kind = "P"
            elif c == "D":
                i += 1
                if s[i] == "<":
                    i = self.type_arguments(i)
                if s[i] == K["new"]:
                    i += 1
                else:
                    i = self.need_name(i)
                kind = "x"
            else:
                self.kind = kind
                return i

    def creation(self, i: int) -> tuple[int, str]:
        s = self.s
        i += 1
        if s[i] == "<":
            i = self.type_arguments(i)
        i = self.annotations(i)
        if s[i] == PRIMITIVE:
            i += 1
        else:
            i = self.need_name(i)
            while True:
                if s[i] == "<":
                    i = self.type_arguments(i, True)
                if s[i] == ".":
                    i = self.need_name(self.annotations(i + 1))
                else:
                    break
        i = self.annotations(i)
        if s[i] == "[":
            if s[i + 1] == "]":
                while s[i] == "[" and s[i + 1] == "]":
                    i += 2
                if s[i] != "{":
                    raise Fail(i, "EXPECTED_INITIALISER")
                return self.initialiser(i), "x"
            while s[i] == "[" and s[i + 1] != "]":
                i = self.need(self.expression(i + 1), "]", "EXPECTED_CLOSING_BRACKET")
            while s[i] == "[" and s[i + 1] == "]":
                i += 2
            return i, "x"
        i = self.arguments(i)
        if s[i] == "{":
            i = self.class_body(i)
        return i, "N"
