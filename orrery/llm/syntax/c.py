"""C translation units before preprocessing.

Directives are checked for themselves (conditionals must nest and close) and
then taken out.  If the text of all branches together does not parse and there
are alternatives, variants are parsed that take one branch of each conditional:
every branch is part of at least one variant, all variants must parse, and a
condition has the same truth throughout a variant.  Type names need no
declaration, and a macro call may stand for a declaration or statement.
"""

from __future__ import annotations

import re

from .base import BAD, END, Fail, Lexemes, Parser, Shapes, keywords, near

WORDS = """break case continue default do else enum extern for goto if return sizeof static
struct switch typedef union while register auto _Alignof _Generic _Static_assert asm
inline const volatile restrict _Noreturn _Thread_local _Alignas _Atomic __attribute__ __extension__ typeof"""
K = keywords(WORDS, 0x100)
TYPE, LITERAL = "p", "n"
DIRECTIVE = "#"
TABLE = {
    **K,
    **dict.fromkeys("void char short int long float double signed unsigned _Bool _Complex".split(), TYPE),
    "__inline": K["inline"], "__inline__": K["inline"], "__attribute": K["__attribute__"], "__asm__": K["asm"],
    "__asm": K["asm"], "static_assert": K["_Static_assert"], "__volatile__": K["volatile"], "__restrict": K["restrict"],
    "__restrict__": K["restrict"], "__const": K["const"], "__typeof__": K["typeof"], "alignof": K["_Alignof"],
    **{c: c for c in "(){}[];,.?:=<>&|^"},
    "<:": "[", ":>": "]", "<%": "{", "%>": "}",
    "||": "O", "&&": "N", "==": "E", "!=": "E", "<=": "<", ">=": "<", ">": "<", "<<": "L", ">>": "L",
    "+": "+", "-": "+", "*": "*", "/": "/", "%": "/", "!": "!", "~": "!", "++": "P", "--": "P", "->": ".", "...": "V",
    **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>=".split(), "A"),
}
TOKEN = re.compile(
    r"""\s*("""
    r"""(?:[^\W\d]|\$|\\u[\da-fA-F]{4})[\w$]*(?:(?<=\bL)|(?<=\bu)|(?<=\bU)|(?<=\bu8))(?=["'])"""
    r"""|(?:[^\W\d]|\$)[\w$]*"""
    r"""|//(?:[^\r\n\\]|\\\r?\n|\\[^\n])*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"""
    r'''|"(?:[^"\\\r\n]|\\(?:\r?\n|.))*"'''
    r"""|'(?:[^'\\\r\n]|\\(?:\r?\n|.))+'"""
    r"""|\.?\d(?:[eEpP][+-]|[\w.])*"""
    # a directive up to the end of its last line, comments and continuations within
    r"""|(?:(?<=\n)|(?<![\s\S]))(?:\#)(?:[^\r\n\\/]|\\\r?\n|\\.|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/)*"""
    r"""|<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%&|^]=|<:|:>|<%|%>|\\\r?\n|\S)"""
)
NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F]+|0[bB][01]+|\d+)[uUlL]{0,3}"
    r"|(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?"
    r"|0[xX](?:[\da-fA-F]+\.?[\da-fA-F]*|\.[\da-fA-F]+)[pP][+-]?\d+[fFlL]?"
)
BRANCH = re.compile(r"#\s*(\w*)")
COMMENT = re.compile(r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|//.*|\\\r?\n")
DEFINED = re.compile(r"(!?)\s*defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")


def classify(x: str) -> str:
    c = x[0]
    if c == "#":
        return DIRECTIVE
    if c.isalpha() or c in "_$":
        return "i"
    if x.startswith(("//", "/*")) and len(x) > 1:
        return ""
    if c in "\"'":
        return BAD if len(x) == 1 else "s" if c == '"' else LITERAL
    if c.isdigit() or c == "." and len(x) > 1:
        return LITERAL if NUMBER.fullmatch(x) else BAD
    if c == "\\" and len(x) > 1:
        return ""
    return BAD


BINARY = {"O": 1, "N": 2, "|": 3, "^": 4, "&": 5, "E": 6, "<": 7, "L": 8, "+": 9, "*": 10, "/": 10}
SPECIFIERS = frozenset([K[w] for w in "extern static typedef register auto inline const volatile restrict _Noreturn _Thread_local _Atomic __extension__".split()] + [TYPE])
TAGS = frozenset((K["struct"], K["union"]))
QUALIFIERS = frozenset(K[w] for w in "const volatile restrict _Atomic static".split())
B0 = r"\{[^{}]*\}"
UNIT = re.compile(rf"[^{{}};]*(?:;|{B0}(?:{K['else']}[^{{}};]*{B0})*(?![{K['else']}{K['while']};,.)]))")
LONG = re.compile(rf"(?:[^{{}};]|\{{(?:[^{{}}]|{B0})*\}})*;")
HEAD = re.compile(r"[^{};=]*\{")


class Group:
    """One conditional: its branches as [condition, start, end]."""

    def __init__(self, line: int, within: list[tuple[Group, int]]):
        self.line, self.within = line, within
        self.branches: list[list] = []

    @property
    def last(self) -> bool:
        """Has the branch without a condition been seen?"""
        return self.branches[-1][0] is None

    def open(self, of: tuple[str, bool] | None, at: int) -> None:
        self.branches.append([of, at, at])

    def close(self, at: int) -> None:
        self.branches[-1][2] = at


def condition(word: str, directive: str) -> tuple[str, bool] | None:
    """(what must hold, whether it must be true); None of ``else``."""
    if word == "else":
        return None
    text = " ".join(COMMENT.sub(" ", BRANCH.sub("", directive, count=1)).split())
    if word.endswith("def"):
        return text, not word.endswith("ndef")
    m = DEFINED.fullmatch(text)
    return (m.group(2) or m.group(3), not m.group(1)) if m else (text, True)


def variants(text: str, groups: list[Group]) -> list[str]:
    """Texts with one branch of each conditional (lines kept) that have every
    branch in at least one of them; each takes in what is still missing."""
    missing = {(k, b) for k, g in enumerate(groups) for b in range(len(g.branches))}
    place = {id(g): k for k, g in enumerate(groups)}
    out = []
    while missing:
        k, b = min(missing, key=lambda x: (x[1], x[0]))
        chosen = {place[id(g)]: n for g, n in groups[k].within} | {k: b}
        holds: dict[str, bool] = {}
        for j, n in chosen.items():
            assume(groups[j].branches, n, holds)
        for j, g in enumerate(groups):
            if j not in chosen:
                chosen[j] = choose(g.branches, holds, [n for n in range(len(g.branches)) if (j, n) in missing])
                assume(g.branches, chosen[j], holds)
        missing -= {(j, n) for j, n in chosen.items() if all(chosen[place[id(g)]] == m for g, m in groups[j].within)}
        cut = sorted((a, z) for j, g in enumerate(groups) for n, (_, a, z) in enumerate(g.branches) if n != chosen[j])
        parts, at = [], 0
        for a, z in cut:
            if z > at:
                parts += [text[at : max(a, at)], "\n" * text.count("\n", max(a, at), z)]
                at = z
        out.append("".join(parts) + text[at:])
    return out


def assume(branches: list[list], chosen: int, holds: dict[str, bool]) -> None:
    """What a choice says about the conditions; -1 is no branch."""
    for n, (of, _, _) in enumerate(branches):
        if of is not None and (chosen < 0 or n <= chosen):
            holds.setdefault(of[0], of[1] == (n == chosen))


def choose(branches: list[list], holds: dict[str, bool], wanted: list[int]) -> int:
    """The branch that the known conditions lead to; where they leave it open,
    one that is still wanted, else the last."""
    open_ = []
    for n, (of, _, _) in enumerate(branches):
        if of is None or holds.get(of[0]) == of[1]:
            open_.append(n)
            break
        if of[0] not in holds:
            open_.append(n)
    else:
        open_.append(-1)
    return next((n for n in open_ if n in wanted), open_[-1])


class CParser(Parser):
    language = "c"
    token = TOKEN
    lexemes = Lexemes(TABLE, classify)
    units = Shapes()
    heads = Shapes()

    def check(self, text: str) -> list[tuple[int, str]]:
        if "#" not in text:
            return super().check(text)
        self.errors = []
        problems, groups = self.directives(text)
        found = super().check(text)
        if found and any(len(g.branches) > 1 for g in groups):
            found = [e for v in variants(text, groups) for e in super(CParser, self).check(v)]
        return sorted(set(problems + found))

    def classes(self, text: str) -> str:
        s = super().classes(text)
        if "#" in s:
            s = s.replace("#", "")
        return re.sub("s{2,}", "s", s)

    def located(self, text: str) -> list[tuple[int, str]]:
        starts, last, get = [], "", self.lexemes.__getitem__
        for m in self.token.finditer(text):
            c = get(m.group(1))
            if c and c != "#" and not (c == "s" and last == "s"):
                starts.append(m.start(1))
                last = c
        return [(1 + text.count("\n", 0, starts[p] if p < len(starts) else len(text)), code) for p, code in sorted(set(self.errors))]

    def directives(self, text: str) -> tuple[list[tuple[int, str]], list[Group]]:
        """Problems of the conditionals, and the conditionals in the order in
        which they open."""
        problems: list[tuple[int, str]] = []
        stack: list[Group] = []
        groups: list[Group] = []
        at, line = 0, 1
        for m in TOKEN.finditer(text):
            x = m.group(1)
            if x[0] != "#":
                continue
            line += text.count("\n", at, m.start(1))
            at = m.start(1)
            b = BRANCH.match(x)
            word = b.group(1) if b else ""
            if word in ("if", "ifdef", "ifndef"):
                stack.append(Group(line, [(g, len(g.branches) - 1) for g in stack]))
                groups.append(stack[-1])
                stack[-1].open(condition(word, x), m.end(1))
            elif word in ("elif", "else", "elifdef", "elifndef"):
                if not stack:
                    problems.append((line, "UNEXPECTED_DIRECTIVE"))
                    continue
                if stack[-1].last:
                    problems.append((line, "UNEXPECTED_DIRECTIVE"))
                stack[-1].close(m.start(1))
                stack[-1].open(condition(word, x), m.end(1))
            elif word == "endif":
                if not stack:
                    problems.append((line, "UNEXPECTED_DIRECTIVE"))
                    continue
                stack.pop().close(m.start(1))
            elif word not in ("define", "undef", "include", "error", "pragma", "line", "warning", "include_next", "ident", "import", "embed", ""):
                problems.append((line, "UNKNOWN_DIRECTIVE"))
            elif word == "include" and not re.match(r"#\s*include\s*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_])", x) or word in ("define", "undef") and not re.match(r"#\s*\w+\s+[^\W\d]", x):
                problems.append((line, "BAD_DIRECTIVE"))
        problems += [(g.line, "UNTERMINATED_CONDITIONAL") for g in stack]
        for g in stack:
            g.close(len(text))
        return problems, groups

    # -- declarations --------------------------------------------------------
    def file(self, i: int) -> int:
        s = self.s
        if s[0] == "﻿":
            i = 1
        depth = 0
        while s[i] != END:
            start = i
            try:
                if s[i] == K["extern"] and s[i + 1] == "s":
                    i += 2
                    if s[i] == "{":
                        depth += 1
                        i += 1
                    continue
                if s[i] == "}" and depth:
                    depth -= 1
                    i += 1
                    continue
                i = self.external(i)
            except Fail as e:
                i = self.recover(e, start)
                if i == start or s[i] == "}":
                    i += s[i] != END
        if depth:
            raise Fail(i, "UNEXPECTED_END")
        return i

    def external(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        m = near(HEAD, s, i)
        if m and m.group() in self.heads:
            return self.block(m.end() - 1)
        start = i
        if s[i] == K["_Static_assert"]:
            return self.end(self.arguments(i + 1))
        if s[i] == K["asm"]:
            return self.end(self.arguments(i + 1))
        if s[i] == "i" and s[i + 1] == "(":
            # a macro call, or a function without a written type
            j = self.closing(i + 1)
            if j < 0:
                raise Fail(len(s) - 1, "UNEXPECTED_END")
            c = s[j + 1]
            if c == ";":
                return self.arguments(i + 1) + 1
            if c != "{" and not (c == "i" or c in SPECIFIERS and self.old_parameters(j + 1) != j + 1 and s[self.old_parameters(j + 1)] == "{"):
                return self.macro_arguments(i + 1)
        i = self.specifiers(i)
        if s[i] == ";":
            return i + 1
        first = True
        while True:
            i = self.declarator(i)
            i = self.attributes(i)
            if first:
                j = self.old_parameters(i)
                if s[j] == "{":
                    if ")" not in s[start:j]:
                        raise Fail(j, "UNEXPECTED_BLOCK")
                    if j == i:
                        self.heads.learn(s[start : j + 1])
                    return self.block(j)
            first = False
            if s[i] == "=":
                i = self.initialiser(i + 1)
            if s[i] != ",":
                return self.end(i)
            i += 1

    def old_parameters(self, i: int) -> int:
        """K&R parameter declarations between ')' and '{'."""
        s = self.s
        j = i
        while s[j] in SPECIFIERS or s[j] == "i" or s[j] in TAGS:
            try:
                k = self.specifiers(j)
                while True:
                    k = self.declarator(k)
                    if s[k] != ",":
                        break
                    k += 1
                j = self.end(k)
            except Fail:
                return i
        return j if s[j] == "{" else i

    def macro_arguments(self, i: int) -> int:
        j = self.closing(i)
        if j < 0:
            raise Fail(len(self.s) - 1, "UNEXPECTED_END")
        if BAD in self.s[i:j]:
            raise Fail(i, "INVALID_TOKEN")
        return j + 1

    def attributes(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == K["__attribute__"] or s[i] in (K["asm"], K["_Alignas"]):
                i = self.macro_arguments(self.opening(i + 1))
            elif s[i] == "[" and s[i + 1] == "[":
                i = self.closing(i) + 1
                if i == 0:
                    raise Fail(len(s) - 1, "UNEXPECTED_END")
            else:
                return i

    def opening(self, i: int) -> int:
        self.need(i, "(", "EXPECTED_OPENING_PAREN")
        return i

    def specifiers(self, i: int) -> int:
        """Declaration specifiers; at least one type."""
        s = self.s
        start, typed = i, False
        while True:
            i = self.attributes(i)
            c = s[i]
            if c == TYPE:
                typed = True
                i += 1
            elif c in SPECIFIERS:
                i += 1
            elif c in TAGS or c == K["enum"]:
                i = self.tagged(i)
                typed = True
            elif c == K["typeof"]:
                i = self.macro_arguments(self.opening(i + 1))
                typed = True
            elif c == "i" and not typed:
                # the last of several names is the declarator, unless a star
                # or another name follows it; the others are macros or types
                typed = True
                i += 1
                if s[i] == "(" and s[i + 1] != "*" and self.closing(i) > 0 and (s[self.closing(i) + 1] == "i" or s[self.closing(i) + 1] in SPECIFIERS):
                    i = self.macro_arguments(i)
                    typed = False
                while s[i] == "i" and (s[i + 1] == "i" or s[i + 1] == "*" or s[i + 1] in SPECIFIERS or s[i + 1] in TAGS):
                    i += 1
                if s[i] in SPECIFIERS or s[i] in TAGS or s[i] == K["enum"]:
                    typed = False
            elif c == "i" and typed and s[i - 1] not in "i" and (s[i + 1] == "i" or s[i + 1] == "*" and s[i - 1] in QUALIFIERS):
                i += 1  # a macro between the type and the name
            else:
                if i == start:
                    raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_DECLARATION")
                return i

    def tagged(self, i: int) -> int:
        s = self.s
        word = s[i]
        i = self.attributes(i + 1)
        named = s[i] == "i"
        while s[i] == "i" and s[i + 1] in "i{":
            i += 1
        if s[i] == "i":
            i += 1
        i = self.attributes(i)
        if s[i] == "{":
            if word == K["enum"]:
                i += 1
                while s[i] != "}":
                    if s[i] != "i":
                        raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_ENUM_CONSTANT")
                    i = self.attributes(i + 1)
                    if s[i] == "(":
                        i = self.macro_arguments(i)
                    if s[i] == "=":
                        i = self.ternary(i + 1)
                    if s[i] == ",":
                        i += 1
                    elif s[i] != "}":
                        raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_BRACE")
                return self.attributes(i + 1)
            i += 1
            while s[i] != "}":
                if s[i] == END:
                    raise Fail(i, "UNEXPECTED_END")
                start = i
                try:
                    i = self.field(i)
                except Fail as e:
                    if e.code == "UNEXPECTED_END":
                        raise
                    i = self.recover(e, start)
                    if i == start and s[i] != "}":
                        i += 1
            return self.attributes(i + 1)
        if not named:
            raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_TAG")
        return i

    def field(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] == K["_Static_assert"]:
            return self.end(self.arguments(i + 1))
        if s[i] == "i" and s[i + 1] == "(" and self.closing(i + 1) > 0 and s[self.closing(i + 1) + 1] != "(":
            i = self.macro_arguments(i + 1)
            return i + 1 if s[i] == ";" else i
        i = self.specifiers(i)
        if s[i] == ";":
            return i + 1
        while True:
            if s[i] != ":":
                i = self.declarator(i)
            if s[i] == ":":
                i = self.ternary(i + 1)
            i = self.attributes(i)
            if s[i] != ",":
                return self.end(i)
            i += 1

    def declarator(self, i: int, abstract: bool = False) -> int:
        s = self.s
        i = self.attributes(i)
        while s[i] == "*" or s[i] == "^":
            i = self.attributes(i + 1)
            while s[i] in QUALIFIERS or s[i] == "i" and s[i + 1] in "i*":
                i += 1
        i = self.attributes(i)
        if s[i] == "i":
            i += 1
        elif s[i] == "(" and not (abstract and (s[i + 1] in SPECIFIERS or s[i + 1] in TAGS or s[i + 1] in ")i" or s[i + 1] == K["enum"])):
            i = self.need(self.declarator(i + 1, abstract), ")", "EXPECTED_CLOSING_PAREN")
        elif not abstract:
            raise Fail(i, "UNEXPECTED_END" if s[i] == END else "INVALID_TOKEN" if s[i] == BAD else "EXPECTED_DECLARATOR")
        while True:
            if s[i] == "(":
                i = self.parameters(i)
            elif s[i] == "[":
                i += 1
                while s[i] in QUALIFIERS:
                    i += 1
                if s[i] == "*" and s[i + 1] == "]":
                    i += 1
                if s[i] != "]":
                    i = self.assignment(i)
                i = self.need(i, "]", "EXPECTED_CLOSING_BRACKET")
            else:
                return i

    def parameters(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ")":
            return i + 1
        while True:
            if s[i] == "V":
                i += 1
                break
            i = self.specifiers(i)
            i = self.attributes(self.declarator(i, True))
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ")", "EXPECTED_CLOSING_PAREN")

    def initialiser(self, i: int) -> int:
        s = self.s
        if s[i] != "{":
            return self.assignment(i)
        i += 1
        while s[i] != "}":
            if s[i] in ".[" :
                while s[i] in ".[":
                    if s[i] == ".":
                        i = self.need(i + 1, "i", "EXPECTED_MEMBER")
                    else:
                        i = self.ternary(i + 1)
                        if s[i] == "V":
                            i = self.ternary(i + 1)
                        i = self.need(i, "]", "EXPECTED_CLOSING_BRACKET")
                i = self.need(i, "=", "EXPECTED_INITIALISER")
            elif s[i] == "i" and s[i + 1] == ":":
                i += 2
            i = self.initialiser(i)
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_BRACE")
        return i + 1

    # -- statements ----------------------------------------------------------
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
                if i == start and s[i] != "}":
                    i += 1
        return i + 1

    def statement(self, i: int) -> int:
        s = self.s
        m = near(UNIT, s, i)
        if m and m.group() in self.units:
            return m.end()
        n = near(LONG, s, i)
        if n and n.group() in self.units:
            return n.end()
        before = len(self.errors)
        j = self.real_statement(i)
        if before == len(self.errors) and (m and j == m.end() or n and j == n.end()):
            self.units.learn(s[i:j])
        return j

    def end(self, i: int) -> int:
        return self.need(i, ";", "EXPECTED_SEMICOLON")

    def condition(self, i: int) -> int:
        return self.need(self.expression(self.need(i, "(", "EXPECTED_OPENING_PAREN")), ")", "EXPECTED_CLOSING_PAREN")

    def body(self, i: int) -> int:
        if self.s[i] == "}":
            raise Fail(i, "EXPECTED_STATEMENT")
        return self.statement(i)

    def real_statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        if c == K["if"]:
            i = self.body(self.condition(i + 1))
            return self.body(i + 1) if s[i] == K["else"] else i
        if c == K["while"] or c == K["switch"]:
            return self.body(self.condition(i + 1))
        if c == K["return"]:
            return self.end(i + 1 if s[i + 1] == ";" else self.expression(i + 1))
        if c == K["for"]:
            i = self.need(i + 1, "(", "EXPECTED_OPENING_PAREN")
            if s[i] == ";":
                i += 1
            elif self.declares(i):
                i = self.declaration(i)
            else:
                i = self.end(self.expression(i))
            i = self.end(i if s[i] == ";" else self.expression(i))
            if s[i] != ")":
                i = self.expression(i)
            return self.body(self.need(i, ")", "EXPECTED_CLOSING_PAREN"))
        if c == K["do"]:
            i = self.need(self.body(i + 1), K["while"], "EXPECTED_WHILE")
            return self.end(self.condition(i))
        if c == K["break"] or c == K["continue"]:
            return self.end(i + 1)
        if c == K["goto"]:
            return self.end(self.expression(i + 2 if s[i + 1] == "*" else i + 1))
        if c == K["case"]:
            i = self.ternary(i + 1)
            if s[i] == "V":
                i = self.ternary(i + 1)
            i = self.need(i, ":", "EXPECTED_COLON")
            return i if s[i] == "}" else self.statement(i)
        if c == K["default"]:
            i = self.need(i + 1, ":", "EXPECTED_COLON")
            return i if s[i] == "}" else self.statement(i)
        if c == K["asm"]:
            i += 1
            while s[i] in QUALIFIERS or s[i] == K["goto"]:
                i += 1
            return self.end(self.macro_arguments(self.opening(i)))
        if c == K["_Static_assert"]:
            return self.end(self.arguments(i + 1))
        if c == "i" and s[i + 1] == ":":
            i = self.attributes(i + 2)
            return i if s[i] == "}" else self.statement(i)
        if self.declares(i):
            return self.declaration(i)
        if c == "i" and s[i + 1] == "(":
            # a macro that opens a block or stands alone on its line
            j = self.closing(i + 1)
            if j > 0 and (s[j + 1] == "{" or s[j + 1] == "}" or s[j + 1] in "i" or s[j + 1] >= "Ā" and s[j + 1] not in SPECIFIERS):
                return self.macro_arguments(i + 1)
        return self.end(self.expression(i))

    def declares(self, i: int) -> bool:
        s = self.s
        c = s[i]
        if c in SPECIFIERS or c in TAGS or c in (K["enum"], K["typeof"], K["__attribute__"], K["_Alignas"]) or c == "[" and s[i + 1] == "[":
            return True
        if c != "i":
            return False
        j = i + 1
        if s[j] == "i" or s[j] in SPECIFIERS or s[j] in TAGS:
            return True
        if s[j] == "*":
            while s[j] == "*" or s[j] in QUALIFIERS:
                j += 1
            return s[j] == "i" and s[j + 1] in "=;,["
        return False

    def declaration(self, i: int) -> int:
        s = self.s
        i = self.specifiers(i)
        if s[i] == ";":
            return i + 1
        while True:
            i = self.attributes(self.declarator(i))
            if s[i] == "=":
                i = self.initialiser(i + 1)
            if s[i] == "{" and s[i - 1] == ")":  # nested function, an extension
                return self.block(i)
            if s[i] != ",":
                return self.end(i)
            i += 1

    # -- expressions ---------------------------------------------------------
    def expression(self, i: int) -> int:
        i = self.assignment(i)
        while self.s[i] == ",":
            i = self.assignment(i + 1)
        return i

    def assignment(self, i: int) -> int:
        s = self.s
        i = self.ternary(i)
        if s[i] == "=" or s[i] == "A":
            if self.kind == "x":
                raise Fail(i, "NOT_ASSIGNABLE")
            i = self.assignment(i + 1)
            self.kind = "x"
        return i

    def ternary(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            i = i + 1 if s[i + 1] == ":" else self.expression(i + 1)
            i = self.ternary(self.need(i, ":", "EXPECTED_COLON"))
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        """Precedence climbing."""
        s = self.s
        i = self.unary(i)
        while True:
            p = BINARY.get(s[i], 0)
            if p == 0 or p < least:
                return i
            i = self.binary(i + 1, p + 1)
            self.kind = "x"

    def type_name(self, i: int) -> int:
        """A type in parentheses must be one: keyword, tag, or name with
        stars; -1 if it isn't."""
        try:
            return self.declarator(self.specifiers(i), True)
        except Fail:
            return -1

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "+!&*P" or c == "N" and s[i + 1] == "i":
            i = self.unary(i + 1)
            self.kind = "v" if c == "*" else "x"
            return i
        if c == K["sizeof"] or c == K["_Alignof"]:
            if s[i + 1] == "(":
                j = self.closing(i + 1)
                if j > 0 and self.type_name(i + 2) == j:
                    if s[j + 1] != "{":
                        self.kind = "x"
                        return j + 1
                    return self.postfix_tail(self.initialiser(j + 1))
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if c == K["__extension__"]:
            return self.unary(i + 1)
        if c == "(":
            d = s[i + 1]
            if d == "{":  # statement expression, an extension
                i = self.postfix_tail(self.need(self.block(i + 1), ")", "EXPECTED_CLOSING_PAREN"))
                return i
            j = self.closing(i)
            if j < 0:
                raise Fail(len(s) - 1, "UNEXPECTED_END")
            e = s[j + 1]
            typed = d in SPECIFIERS or d in TAGS or d in (K["enum"], K["typeof"])
            if typed or d == "i" and e in "ins(!{" or d == "i" and e in (K["sizeof"],) or d == "i" and s[j - 1] == "*":
                if self.type_name(i + 1) == j:
                    if e == "{":
                        return self.postfix_tail(self.initialiser(j + 1))
                    if not (d == "i" and e == "(" and j == i + 2):
                        i = self.unary(j + 1)
                        self.kind = "x"
                        return i
        return self.postfix(i)

    def arguments(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(", "EXPECTED_ARGUMENTS")
        if s[i] == ")":
            return i + 1
        while True:
            # a type may be handed to a macro
            j = -1
            if s[i] in SPECIFIERS or s[i] in TAGS or s[i] == K["enum"] or s[i] == "i" and s[i + 1] in "*i":
                j = self.type_name(i)
            i = j if j > 0 and s[j] in ",)" else self.assignment(i)
            if s[i] != ",":
                return self.need(i, ")", "EXPECTED_CLOSING_PAREN")
            i += 1

    def postfix(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.kind = "v"
        if c == "i":
            i += 1
            while s[i] == "s" or s[i] == "i" and s[i - 1] == "s":  # "a" MACRO "b", L"a"
                i += 1
        elif c == "s":
            i += 1
            while s[i] in "si":
                i += 1
        elif c == LITERAL:
            i += 1
            self.kind = "x"
        elif c == "(":
            i = self.need(self.expression(i + 1), ")", "EXPECTED_CLOSING_PAREN")
            self.kind = "v"
        elif c == K["_Generic"]:
            i = self.macro_arguments(self.opening(i + 1))
        else:
            raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_EXPRESSION")
        return self.postfix_tail(i)

    def postfix_tail(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == "(":
                i = self.arguments(i)
                self.kind = "v"
            elif c == "[":
                i = self.need(self.expression(i + 1), "]", "EXPECTED_CLOSING_BRACKET")
                self.kind = "v"
            elif c == ".":
                i = self.need(i + 1, "i", "EXPECTED_MEMBER")
                self.kind = "v"
            elif c == "P":
                i += 1
                self.kind = "x"
            else:
                return i
