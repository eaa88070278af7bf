"""JavaScript files as CommonJS scripts (the body of a function)."""

from __future__ import annotations

import re

from .base import BAD, END, Fail, Lexemes, Parser, Shapes, keywords, near

WORDS = """break case catch class const continue debugger default delete do else export extends
finally for function if import in instanceof new return super switch this throw try typeof
var void while with enum"""
K = keywords(WORDS, 0x100)
LITERAL = "n"
TABLE = {
    **K,
    **dict.fromkeys(("true", "false", "null"), LITERAL),
    **{c: c for c in "(){}[];,.?:=<>&|^@"},
    ">=": "<", "<=": "<", ">": "<", "||": "O", "??": "O", "&&": "N", "==": "E", "!=": "E", "===": "E", "!==": "E",
    "<<": "L", ">>": "L", ">>>": "L", "+": "+", "-": "+", "*": "*", "/": "/", "%": "/", "**": "X",
    "!": "!", "~": "!", "++": "P", "--": "P", "=>": "W", "?.": "Q", "...": "V",
    **dict.fromkeys("+= -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split(), "A"),
    # contextual words
    "async": "a", "of": "o", "get": "g", "set": "g", "static": "t", "let": "l", "yield": "y", "await": "w", "target": "z",
}
NAME = frozenset("iaogtlywz")
#: Words that may stand as a property name.
PROPERTY = NAME | frozenset(K.values()) | {LITERAL}
TEMPLATE_OPEN, TEMPLATE_CLOSE = "\x04", "\x05"
REGEX = r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/\w*"
STRING = r"""'(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*'|"(?:[^"\\\r\n]|\\(?:\r\n|(?s:.)))*\""""
COMMENT = r"//[^\r\n\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
TOKEN = re.compile(
    # a regular expression stands where an operand is due; the lexeme then
    # begins right behind the token before it, so that look-behind sees that
    r"((?:(?<=[=(,;:!&|?{}\[+\-*%<>~^])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|^)\s*" + REGEX +
    r"|[ \t\f\v\ufeff\xa0]*(?:(?:[^\W\d]|\$|\\u[\da-fA-F]{4})[\w$\u200c\u200d]*"
    r"|[\r\n\u2028\u2029]\s*"
    r"|" + COMMENT + r"|" + STRING +
    r"|`(?:[^`\\$]|\\(?s:.)|\$(?!\{))*`"
    r"|\#!?(?:[^\W\d]|\$)[\w$]*"
    r"|0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?"
    r"|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?[\w$]*"
    r"|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|>>>|\.\.\.|===|!==|=>|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|==|!=|<=|>=|<<|>>|[-+*/%&|^]=|\S))"
)
NUMBER = re.compile(
    r"0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|0\d+"
    r"|(?:0|[1-9]\d*(?:_\d+)*)n"
    r"|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"
)
ESCAPE = re.compile(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4}|\{[\da-fA-F]{1,6}\}))")
#: Flags that a regular expression may have, each once.
FLAGS = "dgimsuvy"


def classify(x: str) -> str:
    if x.lstrip()[:1] == "/" and x[0] in "\r\n\u2028\u2029":
        x = x.lstrip()  # a regular expression behind a line break
    c = x[0]
    if c in "\r\n\u2028\u2029":
        return "\n"
    if c.isalpha() or c in "_$\\":
        return "i"
    if c == "/" and len(x) > 1:
        if x[1] == "*":
            return "\n" if "\n" in x else ""
        if x[1] == "/":
            return ""
        flags = x[x.rindex("/") + 1 :]
        body = x[1 : x.rindex("/")]
        ok = len(set(flags)) == len(flags) and not set(flags) - set(FLAGS) and balanced(body)
        return LITERAL if ok else BAD
    if c in "\"'":
        return LITERAL if len(x) > 1 and not ("\\" in x and ESCAPE.search(x.replace("\\\\", ""))) else BAD
    if c == "`":
        return "T" if len(x) > 1 else BAD
    if c == "#":
        return "#" if len(x) > 1 else BAD
    if c.isdigit() or c == "." and len(x) > 1:
        return LITERAL if NUMBER.fullmatch(x) else BAD
    return BAD


def balanced(body: str) -> bool:
    """Groups of a regular expression close, classes aside."""
    depth, k, inside = 0, 0, False
    while k < len(body):
        c = body[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
        elif c in "*+?" and (k == 0 or body[k - 1] in "(|" and (k < 2 or body[k - 2] != "\\")) and not (c == "?" and k and body[k - 1] == "("):
            return False
        k += 1
    return depth == 0 and not inside


BINARY = {"O": 1, "N": 2, "|": 3, "^": 4, "&": 5, "E": 6, "<": 7, K["instanceof"]: 7, K["in"]: 7, "L": 8, "+": 9, "*": 10, "/": 10, "X": 11}
UNARY = frozenset(("+", "!", K["typeof"], K["void"], K["delete"]))
#: A line break after these, or before those, never ends a statement.
BREAK_AFTER = re.compile("(?<=[({\\[;,.?:=<&|^+*/!A-FLNOQVWX" + "".join(K[w] for w in "case delete else in instanceof new typeof void do".split()) + "])\n+|^\n+")
BREAK_BEFORE = re.compile("\n+(?=[)\\],;.?:=<&|^+*/A-FLNOQXT(\\[\x04" + K["in"] + K["instanceof"] + "])")
BREAKS = re.compile("\n{2,}")
RESTRICTED = "".join(K[w] for w in "return break continue throw".split()) + "yP"
KEEP = re.compile("(?<=[" + RESTRICTED + "])\n+(?=[(\\[+/T\x04])")
B0 = r"\{[^{}]*\}"
FOLLOW = K["else"] + K["catch"] + K["finally"] + K["while"]
UNIT = re.compile(rf"\n*[^{{}};\n]*(?:;|{B0}(?:{K['else']}[^{{}};\n]*{B0})*(?=[\n{K['if']}{K['while']}{K['return']}{K['for']}{K['switch']}{K['function']}{K['const']}{K['var']}l}}])(?!\n*[{FOLLOW}]))")
LONG = re.compile(rf"\n*(?:[^{{}};\n]|\{{(?:[^{{}}]|{B0})*\}})*;")
TEMPLATE = re.compile(r"`|" + COMMENT + "|" + STRING + r"|(?:(?<=[=(,;:!&|?{}\[+\-*%<>~^\r\n])|(?<=return )|(?<=[=(,:\[!&|?{};] ))" + REGEX)


class JavaScriptParser(Parser):
    language = "javascript"
    token = TOKEN
    lexemes = Lexemes(TABLE, classify, " \t\f\v\ufeff\xa0")
    units = Shapes()

    def __init__(self) -> None:
        super().__init__()
        self.no_in = False
        self.generator = self.asynchronous = False

    # -- lexing ------------------------------------------------------------
    def classes(self, text: str) -> str:
        if text.startswith("#!"):
            text = "//" + text[2:]
        s = self.templated(text) if "`" in text and "${" in text else super().classes(text)
        if "\n" in s:
            # a break after 'return' and the like is kept even before an operator
            s = KEEP.sub("\x06", s)
            s = BREAK_BEFORE.sub("", BREAK_AFTER.sub("", BREAKS.sub("\n", s)))
            s = s.replace("\x06", "\n")
        return s

    def located(self, text: str) -> list[tuple[int, str]]:
        """Line breaks are dropped from the class string, so positions are
        found by counting the other tokens."""
        kept = [k for k, c in enumerate(self.s) if c != "\n"]
        rank = {k: r for r, k in enumerate(kept)}
        starts, get = [], self.lexemes.__getitem__
        if not ("`" in text and "${" in text):
            for m in self.token.finditer(text):
                c = get(m.group(1))
                if c and c != "\n":
                    starts.append(m.start(1))
        out = []
        for pos, code in sorted(set(self.errors)):
            while pos < len(self.s) - 1 and pos not in rank:
                pos += 1
            r = rank.get(pos, len(kept))
            offset = starts[r] if r < len(starts) else len(text)
            out.append((1 + text.count("\n", 0, offset), code))
        return out

    def templated(self, text: str) -> str:
        """Class string of a text that holds templates with substitutions."""
        out, i, plain = [], 0, 0
        lex = super().classes
        while True:
            m = TEMPLATE.search(text, i)
            if not m:
                break
            if m.group() != "`":
                i = m.end()
                continue
            out.append(lex(text[plain : m.start()]))
            i, piece = self.template(text, m.end())
            out.append(piece)
            plain = i
        out.append(lex(text[plain:]))
        return "".join(out)

    def template(self, text: str, i: int) -> tuple[int, str]:
        """From behind the opening back-tick; (index behind the end, classes)."""
        out = [TEMPLATE_OPEN]
        n = len(text)
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                out.append(TEMPLATE_CLOSE)
                return i + 1, "".join(out)
            elif c == "$" and text.startswith("${", i):
                i, piece = self.substitution(text, i + 2)
                out.append("{" + piece + "}" if piece is not None else BAD)
            else:
                i += 1
        return n, BAD

    def substitution(self, text: str, i: int) -> tuple[int, str | None]:
        """The expression of ``${ }``; None if it never ends."""
        out, depth, plain = [], 0, i
        lex = super().classes
        while i < len(text):
            m = TEMPLATE.match(text, i)
            if m and m.group() == "`":
                out.append(lex(text[plain:i]))
                i, piece = self.template(text, i + 1)
                out.append(piece)
                plain = i
                continue
            if m:
                i = m.end()
                continue
            c = text[i]
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    out.append(lex(text[plain:i]))
                    return i + 1, "".join(out).replace("\n", "")
                depth -= 1
            i += 1
        return i, None

    # -- statements --------------------------------------------------------
    def skip(self, i: int) -> int:
        while self.s[i] == "\n":
            i += 1
        return i

    def file(self, i: int) -> int:
        return self.statements(i, END)

    def statements(self, i: int, until: str) -> int:
        s = self.s
        while True:
            i = self.skip(i)
            if s[i] == until:
                return i
            if s[i] == END:
                raise Fail(i, "UNEXPECTED_END")
            start = i
            try:
                i = self.statement(i)
            except Fail as e:
                if e.code == "UNEXPECTED_END":
                    raise
                i = self.recover(e, start)
                if i == start or s[i] == "}" and until == END:
                    i += s[i] != END

    def block(self, i: int) -> int:
        i = self.need(self.skip(i), "{", "EXPECTED_BLOCK")
        return self.statements(i, "}") + 1

    def end(self, i: int) -> int:
        c = self.s[i]
        if c == ";" or c == "\n":
            return i + 1
        if c == "}" or c == END:
            return i
        raise Fail(i, "EXPECTED_SEMICOLON")

    def statement(self, i: int) -> int:
        s = self.s
        if not (self.generator or self.asynchronous or self.no_in):
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
        return self.real_statement(i)

    def condition(self, i: int) -> int:
        return self.need(self.expressions(self.need(i, "(", "EXPECTED_OPENING_PAREN")), ")", "EXPECTED_CLOSING_PAREN")

    def body(self, i: int) -> int:
        i = self.skip(i)
        c = self.s[i]
        if c in (K["const"], K["class"]) or c == "l" and self.s[i + 1] in "i[{" or c == "}":
            raise Fail(i, "DECLARATION_NOT_ALLOWED")
        return self.statement(i)

    def real_statement(self, i: int) -> int:
        s = self.s
        i = self.skip(i)
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        if c in (K["var"], K["const"]) or c == "l" and (s[i + 1] in NAME or s[i + 1] in "[{"):
            return self.end(self.declarations(i + 1, c == K["const"]))
        if c == K["if"]:
            i = self.body(self.condition(i + 1))
            j = self.skip(i)
            return self.body(j + 1) if s[j] == K["else"] else i
        if c == K["return"]:
            i += 1
            return self.end(i if s[i] in ";\n}\x03" else self.expressions(i))
        if c == K["for"]:
            return self.for_statement(i + 1)
        if c == K["while"]:
            return self.body(self.condition(i + 1))
        if c == K["function"]:
            return self.function(i, True)
        if c == "a" and s[i + 1] == K["function"]:
            return self.function(i + 1, True, True)
        if c == K["class"]:
            return self.class_(i, True)
        if c == K["do"]:
            i = self.skip(self.body(i + 1))
            i = self.condition(self.need(i, K["while"], "EXPECTED_WHILE"))
            return i + 1 if s[i] == ";" or s[i] == "\n" else i
        if c == K["switch"]:
            return self.switch(i)
        if c == K["try"]:
            i = self.block(i + 1)
            j = self.skip(i)
            handled = False
            if s[j] == K["catch"]:
                i = j + 1
                if s[i] == "(":
                    i = self.need(self.pattern(i + 1), ")", "EXPECTED_CLOSING_PAREN")
                i = self.block(i)
                j = self.skip(i)
                handled = True
            if s[j] == K["finally"]:
                return self.block(j + 1)
            if not handled:
                raise Fail(j, "UNEXPECTED_END" if s[j] == END else "EXPECTED_CATCH")
            return i
        if c == K["throw"]:
            if s[i + 1] == "\n":
                raise Fail(i + 1, "EXPECTED_EXPRESSION")
            return self.end(self.expressions(i + 1))
        if c in (K["break"], K["continue"]):
            return self.end(i + 2 if s[i + 1] in NAME else i + 1)
        if c == K["debugger"]:
            return self.end(i + 1)
        if c == K["with"]:
            return self.body(self.condition(i + 1))
        if c in NAME and s[i + 1] == ":":
            return self.statement(i + 2)
        if c == K["import"] and s[i + 1] not in "(." or c == K["export"]:
            raise Fail(i, "MODULE_SYNTAX")
        return self.end(self.expressions(i))

    def declarations(self, i: int, constant: bool = False, loop: bool = False) -> int:
        s = self.s
        while True:
            i = self.skip(i)
            pattern = s[i] in "[{"
            i = self.pattern(i)
            if s[i] == "=":
                i = self.assignment(i + 1)
            elif (constant or pattern) and not (loop and s[i] in ("o", K["in"])):
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_INITIALISER")
            if s[i] != ",":
                return i
            i += 1

    def pattern(self, i: int) -> int:
        """A binding: name, [..] or {..}."""
        s = self.s
        i = self.skip(i)
        c = s[i]
        if c in NAME:
            return i + 1
        if c == "[":
            i += 1
            while s[i] != "]":
                if s[i] == ",":
                    i += 1
                    continue
                if s[i] == "V":
                    i = self.pattern(i + 1)
                    break
                i = self.defaulted(i)
                if s[i] != ",":
                    break
                i += 1
            return self.need(self.skip(i), "]", "EXPECTED_CLOSING_BRACKET")
        if c == "{":
            i += 1
            while True:
                i = self.skip(i)
                if s[i] == "}":
                    return i + 1
                if s[i] == "V":
                    i = self.pattern(i + 1)
                elif s[i] in NAME and s[i + 1] != ":":
                    i = self.defaulted(i)
                else:
                    i = self.defaulted(self.need(self.property_name(i), ":", "EXPECTED_COLON"))
                i = self.skip(i)
                if s[i] != ",":
                    return self.need(i, "}", "EXPECTED_CLOSING_BRACE")
                i += 1
        raise Fail(i, "UNEXPECTED_END" if c == END else "EXPECTED_BINDING")

    def defaulted(self, i: int) -> int:
        i = self.pattern(i)
        return self.assignment(i + 1) if self.s[i] == "=" else i

    def for_statement(self, i: int) -> int:
        s = self.s
        if s[i] == "w":
            i += 1
        i = self.need(i, "(", "EXPECTED_OPENING_PAREN")
        saved, self.no_in = self.no_in, True
        try:
            if s[i] in (K["var"], K["const"]) or s[i] == "l" and (s[i + 1] in NAME or s[i + 1] in "[{"):
                i = self.declarations(i + 1, s[i] == K["const"], True)
            elif s[i] != ";":
                i = self.expressions(i)
        finally:
            self.no_in = saved
        if s[i] == "o":
            i = self.assignment(i + 1)
        elif s[i] == K["in"]:
            i = self.expressions(i + 1)
        else:
            i = self.need(i, ";", "EXPECTED_SEMICOLON")
            if s[i] != ";":
                i = self.expressions(i)
            i = self.need(self.skip(i), ";", "EXPECTED_SEMICOLON")
            if s[i] != ")":
                i = self.expressions(i)
        return self.body(self.need(self.skip(i), ")", "EXPECTED_CLOSING_PAREN"))

    def switch(self, i: int) -> int:
        s = self.s
        i = self.need(self.skip(self.condition(i + 1)), "{", "EXPECTED_BLOCK")
        while True:
            i = self.skip(i)
            if s[i] == "}":
                return i + 1
            if s[i] == K["case"]:
                i = self.expressions(i + 1)
            elif s[i] == K["default"]:
                i += 1
            else:
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CASE")
            i = self.need(self.skip(i), ":", "EXPECTED_COLON")
            while True:
                i = self.skip(i)
                if s[i] in ("}", K["case"], K["default"]):
                    break
                if s[i] == END:
                    raise Fail(i, "UNEXPECTED_END")
                i = self.statement(i)

    # -- functions and classes ---------------------------------------------
    def function(self, i: int, named: bool, asynchronous: bool = False) -> int:
        """From the word ``function`` on."""
        s = self.s
        i += 1
        generator = s[i] == "*"
        i += generator
        if s[i] in NAME:
            i += 1
        elif named:
            raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_IDENTIFIER")
        return self.method(i, generator, asynchronous)

    def method(self, i: int, generator: bool = False, asynchronous: bool = False) -> int:
        """Parameters and body."""
        saved = self.generator, self.asynchronous, self.no_in
        self.generator, self.asynchronous, self.no_in = generator, asynchronous, False
        try:
            return self.block(self.parameters(i))
        finally:
            self.generator, self.asynchronous, self.no_in = saved

    def parameters(self, i: int) -> int:
        s = self.s
        i = self.need(self.skip(i), "(", "EXPECTED_PARAMETERS")
        while True:
            i = self.skip(i)
            if s[i] == ")":
                return i + 1
            if s[i] == "V":
                return self.need(self.skip(self.pattern(i + 1)), ")", "EXPECTED_CLOSING_PAREN")
            i = self.skip(self.defaulted(i))
            if s[i] != ",":
                return self.need(i, ")", "EXPECTED_CLOSING_PAREN")
            i += 1

    def class_(self, i: int, named: bool) -> int:
        s = self.s
        i += 1
        if s[i] in NAME:
            i += 1
        elif named:
            raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_IDENTIFIER")
        i = self.skip(i)
        if s[i] == K["extends"]:
            i = self.skip(self.unary(i + 1))
        i = self.need(i, "{", "EXPECTED_BODY")
        while True:
            while s[i] in ";\n":
                i += 1
            if s[i] == "}":
                return i + 1
            if s[i] == END:
                raise Fail(i, "UNEXPECTED_END")
            if s[i] == "t" and s[i + 1] not in "(=;\n}":
                i += 1
                if s[i] == "{":
                    i = self.block(i)
                    continue
            j = self.modifiers(i)
            generator, asynchronous = "*" in s[i:j], "a" in s[i:j]
            i = self.property_name(j)
            if s[self.skip(i)] == "(":
                i = self.method(i, generator, asynchronous)
            else:
                if s[i] == "=":
                    i = self.assignment(i + 1)
                i = self.end(i)

    def modifiers(self, i: int) -> int:
        """async, * , get and set in front of a member's name."""
        s = self.s
        if s[i] == "a" and s[i + 1] not in "(=;:,}\n":
            i += 1
        if s[i] == "*":
            return i + 1
        if s[i] == "g" and s[i + 1] not in "(=;:,}\n":
            i += 1
        return i

    def property_name(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "[":
            return self.need(self.skip(self.assignment(i + 1)), "]", "EXPECTED_CLOSING_BRACKET")
        if c in PROPERTY or c == "#":
            return i + 1
        raise Fail(i, "UNEXPECTED_END" if c == END else "EXPECTED_PROPERTY")

    # -- expressions -------------------------------------------------------
    def expressions(self, i: int) -> int:
        s = self.s
        i = self.assignment(i)
        while s[i] == ",":
            i = self.assignment(i + 1)
            self.kind = "x"
        return i

    def arrow_body(self, i: int, asynchronous: bool) -> int:
        saved = self.generator, self.asynchronous
        self.generator, self.asynchronous = False, asynchronous
        try:
            if self.s[i] == "{":
                kept, self.no_in = self.no_in, False
                try:
                    i = self.block(i)
                finally:
                    self.no_in = kept
            else:
                i = self.assignment(i)
        finally:
            self.generator, self.asynchronous = saved
        self.kind = "w"
        return i

    def assignment(self, i: int) -> int:
        s = self.s
        i = self.skip(i)
        c = s[i]
        if c in NAME and s[i + 1] == "W":
            return self.arrow_body(i + 2, False)
        if c == "a":
            if s[i + 1] in NAME and s[i + 2] == "W":
                return self.arrow_body(i + 3, True)
            if s[i + 1] == "(":
                j = self.closing(i + 1)
                if j > 0 and s[j + 1] == "W":
                    return self.arrow_body(self.parameters(i + 1) + 1, True)
        if c == "(":
            j = self.closing(i)
            if j < 0:
                raise Fail(len(s) - 1, "UNEXPECTED_END")
            if s[j + 1] == "W":
                return self.arrow_body(self.parameters(i) + 1, False)
        if c == "y" and self.generator:
            i += 1
            if s[i] == "*":
                i += 1
            elif s[i] in ";\n)]},:\x03":
                self.kind = "x"
                return i
            i = self.assignment(i)
            self.kind = "x"
            return i
        i = self.binary(i, 1)
        c = s[i]
        if c == "?":
            kept, self.no_in = self.no_in, False
            i = self.assignment(i + 1)
            self.no_in = kept
            i = self.assignment(self.need(self.skip(i), ":", "EXPECTED_COLON"))
            self.kind = "x"
            return i
        if c == "=" or c == "A":
            # a literal on the left is a destructuring pattern
            if self.kind not in "vf[" and not (self.kind == "{" and c == "="):
                raise Fail(i, "NOT_ASSIGNABLE")
            i = self.assignment(i + 1)
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        """Precedence climbing; ``**`` binds to the right."""
        s = self.s
        if s[i] == "#":  # #name in object
            if s[i + 1] != K["in"]:
                raise Fail(i, "EXPECTED_EXPRESSION")
            i += 1
        else:
            start = i
            i = self.unary(i)
            if s[i] == "X" and s[start] in UNARY:
                raise Fail(i, "UNARY_BEFORE_POWER")
        while True:
            c = s[i]
            p = BINARY.get(c, 0)
            if p == 0 or p < least or c == K["in"] and self.no_in:
                return i
            i = self.binary(self.skip(i + 1), p if c == "X" else p + 1)
            self.kind = "x"

    def unary(self, i: int) -> int:
        s = self.s
        i = self.skip(i)
        c = s[i]
        if c in UNARY or c == "w" and self.asynchronous:
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if c == "P":
            i = self.unary(i + 1)
            if self.kind not in "vf[":
                raise Fail(i, "NOT_ASSIGNABLE")
            self.kind = "x"
            return i
        i = self.postfix(i)
        if s[i] == "P":
            if self.kind not in "vf[":
                raise Fail(i, "NOT_ASSIGNABLE")
            self.kind = "x"
            i += 1
        return i

    def arguments(self, i: int) -> int:
        s = self.s
        i += 1
        kept, self.no_in = self.no_in, False
        while True:
            i = self.skip(i)
            if s[i] == ")":
                break
            i = self.skip(self.assignment(i + 1 if s[i] == "V" else i))
            if s[i] == ",":
                i += 1
            elif s[i] != ")":
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_PAREN")
        self.no_in = kept
        return i + 1

    def template_literal(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] == "{":
            i = self.need(self.expressions(i + 1), "}", "EXPECTED_CLOSING_BRACE")
        return self.need(i, TEMPLATE_CLOSE, "UNTERMINATED_TEMPLATE")

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.kind = "x"
        if c in NAME:
            if c == "a" and s[i + 1] == K["function"]:
                return self.function(i + 1, False, True)
            self.kind = "v"
            return i + 1
        if c == LITERAL or c == "T" or c == K["this"]:
            return i + 1
        if c == "(":
            kept, self.no_in = self.no_in, False
            i = self.need(self.skip(self.expressions(i + 1)), ")", "EXPECTED_CLOSING_PAREN")
            self.no_in = kept
            self.kind = self.kind if self.kind in "vf[" and self.kind else "x"
            return i
        if c == "[":
            kept, self.no_in = self.no_in, False
            i += 1
            while True:
                i = self.skip(i)
                if s[i] == "]":
                    break
                if s[i] == ",":
                    i += 1
                    continue
                i = self.skip(self.assignment(i + 1 if s[i] == "V" else i))
                if s[i] == ",":
                    i += 1
                elif s[i] != "]":
                    raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_BRACKET")
            self.no_in = kept
            self.kind = "{"
            return i + 1
        if c == "{":
            return self.object(i)
        if c == K["function"]:
            return self.function(i, False)
        if c == K["class"]:
            i = self.class_(i, False)
            self.kind = "x"
            return i
        if c == TEMPLATE_OPEN:
            i = self.template_literal(i)
            self.kind = "x"
            return i
        if c == K["new"]:
            if s[i + 1] == ".":
                if s[i + 2] != "z":
                    raise Fail(i + 2, "EXPECTED_TARGET")
                return i + 3
            i = self.primary(self.skip(i + 1))
            i = self.members(i, False)
            if s[i] == "(":
                i = self.arguments(i)
            self.kind = "x"
            return i
        if c == K["super"]:
            if s[i + 1] not in ".([":
                raise Fail(i, "EXPECTED_MEMBER")
            return i + 1
        if c == K["import"] and s[i + 1] in "(.":
            return i + 1
        raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_EXPRESSION")

    def members(self, i: int, calls: bool) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                i = self.skip(i + 1)
                if s[i] not in PROPERTY and s[i] != "#":
                    raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_MEMBER")
                i += 1
                self.kind = "f"
            elif c == "[":
                kept, self.no_in = self.no_in, False
                i = self.need(self.skip(self.expressions(i + 1)), "]", "EXPECTED_CLOSING_BRACKET")
                self.no_in = kept
                self.kind = "["
            elif c == "(" and calls:
                i = self.arguments(i)
                self.kind = "x"
            elif c == "Q" and calls:
                i = self.skip(i + 1)
                if s[i] == "(":
                    i = self.arguments(i)
                elif s[i] == "[":
                    i = self.need(self.skip(self.expressions(i + 1)), "]", "EXPECTED_CLOSING_BRACKET")
                elif s[i] in PROPERTY or s[i] == "#":
                    i += 1
                else:
                    raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_MEMBER")
                self.kind = "x"
            elif c == "T":
                i += 1
                self.kind = "x"
            elif c == TEMPLATE_OPEN:
                i = self.template_literal(i)
                self.kind = "x"
            else:
                return i

    def postfix(self, i: int) -> int:
        return self.members(self.primary(i), True)

    def object(self, i: int) -> int:
        s = self.s
        kept, self.no_in = self.no_in, False
        i += 1
        while True:
            i = self.skip(i)
            if s[i] == "}":
                break
            if s[i] == "V":
                i = self.assignment(i + 1)
            elif s[i] in NAME and s[self.skip(i + 1)] in ",}":
                i += 1
            elif s[i] in NAME and s[i + 1] == "=":  # only in a pattern
                i = self.assignment(i + 2)
            else:
                j = self.modifiers(i)
                generator, asynchronous = "*" in s[i:j], "a" in s[i:j]
                k = self.skip(self.property_name(j))
                if s[k] == "(":
                    i = self.method(k, generator, asynchronous)
                elif j > i:
                    raise Fail(k, "UNEXPECTED_END" if s[k] == END else "EXPECTED_PARAMETERS")
                else:
                    i = self.assignment(self.need(k, ":", "EXPECTED_COLON"))
            i = self.skip(i)
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_CLOSING_BRACE")
        self.no_in = kept
        self.kind = "{"
        return i + 1
