"""Python 3.13 modules.

The class string is cut into logical lines; each line is parsed by recursive
descent (once per shape) into a line kind, and the block structure is then
parsed by recursive descent over (indentation, kind).
"""

from __future__ import annotations

import re

from .base import BAD, END, Fail, Lexemes, Parser, allow_depth, keywords

WORDS = """and as assert async await break class continue def del elif else except finally for from
global if import in is lambda nonlocal not or pass raise return try while with yield"""
K = keywords(WORDS, 0x100)
LITERAL = "n"
TABLE = {
    **K,
    **dict.fromkeys(("True", "False", "None", "..."), LITERAL),
    **{c: c for c in "(){}[],:.;=@|^&"},
    "->": "W", ":=": "B", "**": "X", "*": "*", "/": "/", "%": "/", "//": "/", "+": "+", "-": "+", "~": "~",
    **dict.fromkeys("< > <= >= == !=".split(), "<"),
    "<<": "L", ">>": "L",
    **dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "A"),
    "match": "m", "case": "k", "type": "t",
}
NAME = frozenset("imkt")
#: Line breaks are classes of their own, by the indentation that follows.
BREAK = 0xE000
WIDEST = 0x1800
TOKEN = re.compile(
    r"""(?:[ \t\f]|\\\r?\n)*("""
    r"""(?:(?:#[^\r\n]*)?(?:\r\n|\r|\n)[ \t\f]*)+|#[^\r\n]*"""
    r"""|(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:"{3}(?:[^"\\]|\\(?s:.)|"(?!""))*"{3}|'{3}(?:[^'\\]|\\(?s:.)|'(?!''))*'{3}"""
    r"""|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|(?s:.)))*"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*')"""
    r"""|[^\W\d]\w*"""
    r"""|\.\.\.|\.?\d(?:[eE][+-]?(?=\d)|[\w.])*"""
    r"""|\*\*=|//=|<<=|>>=|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|\S)"""
)
NUMBER = re.compile(
    r"0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*"
    r"|(?:(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)[jJ]?|\d(?:_?\d)*[jJ]"
)
ESCAPE = re.compile(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!00(?:0\w|10)[\da-fA-F]{4})|N(?!\{[^}]+\}))")
STRING = re.compile(r"([a-zA-Z]*)('''|\"\"\"|'|\")(.*)\2", re.S)


def classify(x: str) -> str:
    c = x[0]
    if c == "#" and "\n" not in x and "\r" not in x:
        return ""
    if c in "#\r\n":
        tail = re.split(r"[\r\n]", x)[-1].split("\f")[-1]
        return chr(BREAK + min(WIDEST, len(tail.expandtabs(8))))
    m = STRING.fullmatch(x)
    if m and (len(x) > 1):
        prefix, body = m.group(1).lower(), m.group(3)
        if "b" in prefix:
            if not body.isascii() or "r" not in prefix and "\\x" in body and re.search(r"\\x(?![\da-fA-F]{2})", body.replace("\\\\", "")):
                return BAD
            return "b"
        if "r" not in prefix and "\\" in body and ESCAPE.search(body.replace("\\\\", "")):
            return BAD
        if "f" in prefix:
            return "s" if formatted(body) else BAD
        return "s"
    if c.isidentifier():
        return "i"
    if c.isdigit() or c == "." and len(x) > 1:
        return LITERAL if NUMBER.fullmatch(x) else BAD
    return BAD


def formatted(body: str) -> bool:
    """The replacement fields of a format string parse."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "{":
            if body.startswith("{{", i):
                i += 2
                continue
            i = field(body, i + 1)
            if i < 0:
                return False
        elif c == "}":
            if not body.startswith("}}", i):
                return False
            i += 2
        elif c == "\\" and body.startswith("\\N{", i):
            i = body.find("}", i) + 1 or n
        else:
            i += 1
    return True


def field(body: str, i: int) -> int:
    """From behind '{' to behind the matching '}'; -1 if malformed."""
    start, depth, quote, n = i, 0, "", len(body)
    while i < n:
        c = body[i]
        if quote:
            if c == "\\":
                i += 1
            elif body.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c == "#":
            return -1
        elif c in "'\"":
            quote = c * 3 if body.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif depth == 0 and (c in "}:" or c == "!" and body[i + 1 : i + 2] != "=" or c == "=" and body[i + 1 : i + 2] != "=" and body[i - 1] not in "=!<>"):
            break
        i += 1
    if i >= n:
        return -1
    inner = body[start:i].strip()
    if not inner or not expression_parses(inner):
        return -1
    if body[i] == "=":
        i += 1
        while i < n and body[i] in " \t":
            i += 1
    if i < n and body[i] == "!":
        if body[i + 1 : i + 2] not in tuple("sra"):
            return -1
        i += 2
    if i < n and body[i] == ":":
        i += 1
        while i < n and body[i] != "}":
            if body[i] == "{":
                i = field(body, i + 1)
                if i < 0:
                    return -1
            else:
                i += 1
    return i + 1 if i < n and body[i] == "}" else -1


def expression_parses(text: str) -> bool:
    p = PythonParser()
    s = "".join(map(p.lexemes.__getitem__, TOKEN.findall(text)))
    p.s = BREAKS.sub("", s) + END
    allow_depth(len(p.s))
    try:
        i = p.yielded(0) if p.s[0] == K["yield"] else p.expressions(0)
        return p.s[i] == END
    except Fail:
        return False


def plain_formats(text: str) -> str:
    """The text with its well-formed format strings replaced by plain strings of
    their size: where fields hold quotes of the string's own kind, line breaks or
    comments, the regular lexer ends the string too early."""
    parts, at, i = [], 0, 0
    while True:
        m = QUOTED.search(text, i)
        if not m:
            return "".join(parts) + text[at:]
        prefix, quote = m.group(1), m.group(2)
        if quote is None:
            i = m.end()
        elif "f" not in prefix.lower():
            i = closed(text, m.end(), quote)
        else:
            i = formatted_end(text, m.end(), quote, "r" in prefix.lower())
            if i > m.start() + 6:
                inner = re.sub(r"[^\r\n]", " ", text[m.start() + 3 : i - 3])
                parts += [text[at : m.start()], "\"\"\"", inner, "\"\"\""]
                at = i
        i = i if i > 0 else m.end()


def closed(text: str, i: int, quote: str) -> int:
    """Behind the end of a string without fields; -1 if it has none."""
    m = re.compile(rf"(?:[^\\{quote[0]}{chr(92) + 'r' + chr(92) + 'n' if len(quote) == 1 else ''}]|\\(?:\r\n|[\s\S])|(?!{quote}){quote[0]})*{quote}").match(text, i)
    return m.end() if m else -1


def formatted_end(text: str, i: int, quote: str, raw: bool) -> int:
    """Behind the end of a format string; -1 if it is malformed."""
    n = len(text)
    while i < n:
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote)
        if c == "\\" and not raw and text.startswith("\\N{", i):
            i = text.find("}", i) + 1 or n
        elif c == "\\" and text[i + 1 : i + 2] not in ("{", "}"):
            i += 2
        elif c == "\\":
            i += 1
        elif c in "{}":
            if text.startswith(c, i + 1):
                i += 2
            elif c == "}":
                return -1
            else:
                i = field_end(text, i + 1, quote, raw)
                if i < 0:
                    return -1
        elif c in "\r\n" and len(quote) == 1:
            return -1
        else:
            i += 1
    return -1


def field_end(text: str, i: int, quote: str, raw: bool) -> int:
    """Behind the brace that ends a replacement field; -1 if malformed."""
    start, depth, n = i, 0, len(text)
    while i < n:
        c = text[i]
        m = QUOTED.match(text, i)
        if m:
            if m.group(2) is None:
                i = m.end()
            elif "f" in m.group(1).lower():
                i = formatted_end(text, m.end(), m.group(2), "r" in m.group(1).lower())
            else:
                i = closed(text, m.end(), m.group(2))
            if i < 0:
                return -1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif depth == 0 and (c in "}:" or c == "!" and text[i + 1 : i + 2] != "=" or c == "=" and text[i + 1 : i + 2] != "=" and text[i - 1] not in "=!<>"):
            break
        m = WORD.match(text, i)
        i = m.end() if m else i + 1
    inner = plain_formats(text[start:i]).strip()
    if i >= n or not inner or not expression_parses(inner):
        return -1
    if text[i] == "=":
        i += 1
        while text[i : i + 1] in (" ", "\t"):
            i += 1
    if text[i : i + 1] == "!":
        if text[i + 1 : i + 2] not in tuple("sra"):
            return -1
        i += 2
    if text[i : i + 1] == ":":
        i += 1
        while i < n and text[i] != "}":
            if text[i] == "{":
                i = field_end(text, i + 1, quote, raw)
                if i < 0:
                    return -1
            elif text.startswith(quote, i):
                return -1
            else:
                i += 1
    return i + 1 if text[i : i + 1] == "}" else -1


#: A comment, or the beginning of a string.
QUOTED = re.compile(r"#[^\r\n]*|(?<!\w)([rR][bBfF]|[bBfF][rR]|[rRbBuUfF]|)('{3}|\"{3}|'|\")")
WORD = re.compile(r"\w+")
FORMAT = re.compile(r"(?:^|\W)(?:[rR][fF]|[fF][rR]?)[\"']")


BREAKS = re.compile(f"[{chr(BREAK)}-{chr(BREAK + WIDEST)}]")
PARTS = re.compile(f"([{chr(BREAK)}-{chr(BREAK + WIDEST)}])")
BINARY = {K["or"]: 1, K["and"]: 2, "<": 4, K["in"]: 4, K["is"]: 4, K["not"]: 4, "|": 5, "^": 6, "&": 7, "L": 8, "+": 9, "*": 10, "/": 10, "@": 10}
ENDS = frozenset((END, ";"))
#: Statement words and the kind of line they make.
HEADS = {K["if"]: "I", K["elif"]: "E", K["else"]: "L", K["while"]: "W", K["for"]: "F", K["try"]: "T", K["except"]: "X", K["finally"]: "Y", K["with"]: "H", K["def"]: "D", K["class"]: "C", "@": "@"}


class PythonParser(Parser):
    language = "python"
    token = TOKEN
    lexemes = Lexemes(TABLE, classify)
    #: Shape of a logical line -> its kind; shape of a physical line -> net brackets.
    kinds: dict[str, str] = {}
    nets: dict[str, int] = {}

    def check(self, text: str) -> list[tuple[int, str]]:
        found = self.module(text)
        if found and FORMAT.search(text):
            plain = plain_formats(text)
            if plain != text:
                return min(self.module(plain), found, key=len)
        return found

    def module(self, text: str) -> list[tuple[int, str]]:
        self.errors = []
        if text.startswith("\ufeff"):
            text = text[1:]
        if "\0" in text:
            return [(1 + text.count("\n", 0, text.index("\0")), "INVALID_TOKEN")]
        s = self.classes("\n" + text)  # the first line's indentation becomes a break, too
        whole = s
        allow_depth(len(s))
        lines, offset, depth = [], 0, 0  # (column, kind, token offset, shape)
        parts = PARTS.split(s)
        offset = len(parts[0])
        held, column, at = "", 0, 0
        nets, kinds = self.nets, self.kinds
        if len(nets) > 200_000:
            nets.clear()
        if len(kinds) > 200_000:
            kinds.clear()
        for k in range(1, len(parts), 2):
            br, piece = parts[k], parts[k + 1]
            offset += 1
            net = nets.get(piece)
            if net is None:
                net = sum(c in "([{" for c in piece) - sum(c in ")]}" for c in piece)
                nets[piece] = net
            if depth > 0:
                held += piece
            elif piece:
                held, column, at = piece, ord(br) - BREAK, offset
            depth += net
            offset += len(piece)
            if depth <= 0 and held:
                depth = 0
                kind = kinds.get(held)
                if kind is None:
                    before = len(self.errors)
                    kind = self.line(held, at)
                    if len(self.errors) == before and len(held) <= 2000:
                        kinds[held] = kind
                lines.append((column, kind, at))
                held = ""
        if depth > 0:
            self.errors.append((offset, "UNEXPECTED_END"))
        lines.append((-1, "", offset))
        self.lines = lines
        if len(lines) > 1:
            if lines[0][0] > 0:
                self.errors.append((lines[0][2], "UNEXPECTED_INDENT"))
            self.block(0, lines[0][0])
        if not self.errors:
            if "\t" in text and self.mixed_tabs(text):
                return [(1, "INCONSISTENT_TABS")]
            return []
        self.s = whole + END
        found = self.located("\n" + text)
        return [(max(1, n - 1), c) for n, c in found]

    def mixed_tabs(self, text: str) -> bool:
        """Indentation that depends on the width of a tab."""
        stack = [""]
        depth_known = [(c, a) for c, _, a in self.lines if c >= 0]
        s = iter(self.token.finditer("\n" + text))
        starts: dict[int, str] = {}
        n = 0
        for m in s:
            c = self.lexemes[m.group(1)]
            if c and ord(c) >= BREAK and ord(c) <= BREAK + WIDEST:
                starts[n + 1] = re.split(r"[\r\n]", m.group(1))[-1]
            n += len(c)
        for _, a in depth_known:
            lead = starts.get(a, "")
            while len(lead.expandtabs(8)) < len(stack[-1].expandtabs(8)):
                stack.pop()
            if len(lead.expandtabs(8)) == len(stack[-1].expandtabs(8)):
                if len(lead) != len(stack[-1]):
                    return True
            else:
                if len(lead) <= len(stack[-1]):
                    return True
                stack.append(lead)
        return False

    # -- block structure -----------------------------------------------------
    def block(self, k: int, column: int) -> int:
        """Statements of one indentation; the index of the line behind."""
        lines = self.lines
        while True:
            col, kind, at = lines[k]
            if col < column:
                return k
            if col > column:
                self.errors.append((at, "UNEXPECTED_INDENT"))
                k = self.block(k, col)
                if lines[k][0] < column:
                    return k
                if lines[k][0] > column:
                    self.errors.append((lines[k][2], "UNMATCHED_DEDENT"))
                    column = lines[k][0]
                continue
            k = self.compound(k, column)
            if lines[k][0] > column:
                continue

    def suite(self, k: int, column: int) -> int:
        """What hangs below the header at line k."""
        lines = self.lines
        if lines[k][1].endswith("."):
            return k + 1
        if lines[k + 1][0] <= column:
            self.errors.append((lines[k + 1][2], "UNEXPECTED_END" if lines[k + 1][0] < 0 else "EXPECTED_BLOCK"))
            return k + 1
        inner = lines[k + 1][0]
        k = self.block(k + 1, inner)
        if column < lines[k][0]:
            self.errors.append((lines[k][2], "UNMATCHED_DEDENT"))
        return k

    def compound(self, k: int, column: int) -> int:
        lines = self.lines
        kind, at = lines[k][1], lines[k][2]
        c = kind[0]
        if c in "S?":
            return k + 1

        def follows(k: int, which: str) -> bool:
            return lines[k][0] == column and lines[k][1][:1] in which and bool(lines[k][1])

        if c == "I":
            k = self.suite(k, column)
            while follows(k, "E"):
                k = self.suite(k, column)
            return self.suite(k, column) if follows(k, "L") else k
        if c in "WF":
            k = self.suite(k, column)
            return self.suite(k, column) if follows(k, "L") else k
        if c in "HDC":
            return self.suite(k, column)
        if c == "T":
            k = self.suite(k, column)
            handlers, bare, star = 0, False, None
            while follows(k, "X"):
                if bare:
                    self.errors.append((lines[k][2], "BARE_EXCEPT_NOT_LAST"))
                bare = "b" in lines[k][1]
                if star is not None and star != ("*" in lines[k][1]):
                    self.errors.append((lines[k][2], "MIXED_EXCEPT"))
                star = "*" in lines[k][1]
                k = self.suite(k, column)
                handlers += 1
            if handlers and follows(k, "L"):
                k = self.suite(k, column)
            if follows(k, "Y"):
                return self.suite(k, column)
            if not handlers:
                self.errors.append((lines[k][2], "UNEXPECTED_END" if lines[k][0] < 0 else "EXPECTED_EXCEPT"))
            return k
        if c == "@":
            k += 1
            if not follows(k, "@DC"):
                self.errors.append((lines[k][2], "UNEXPECTED_END" if lines[k][0] < 0 else "EXPECTED_DEFINITION"))
            return k
        if c == "M":
            if lines[k + 1][0] <= column:
                self.errors.append((lines[k + 1][2], "EXPECTED_BLOCK"))
                return k + 1
            inner = lines[k + 1][0]
            k += 1
            while lines[k][0] == inner:
                if lines[k][1][:1] != "K":
                    self.errors.append((lines[k][2], "EXPECTED_CASE"))
                    k = self.compound(k, inner)
                else:
                    k = self.suite(k, inner)
            if lines[k][0] > column:
                self.errors.append((lines[k][2], "UNMATCHED_DEDENT"))
            return k
        self.errors.append((at, "UNEXPECTED_CLAUSE"))
        return self.suite(k, column)

    # -- logical lines -------------------------------------------------------
    def line(self, shape: str, at: int) -> str:
        """Kind of a logical line; '?' (error recorded) if it doesn't parse."""
        self.s = shape + END
        try:
            return self.logical(0)
        except Fail as e:
            self.errors.append((at + e.pos, e.code))
            # panic mode: a line that looks like a header still opens a block
            c = shape[1] if shape[0] == K["async"] and len(shape) > 1 else shape[0]
            return "?" if shape[-1] != ":" or c not in HEADS else HEADS[c]

    def logical(self, i: int) -> str:
        s = self.s
        c = s[i]
        extra = ""
        if c == K["async"]:
            if s[i + 1] not in (K["def"], K["for"], K["with"]):
                raise Fail(i + 1, "EXPECTED_DEFINITION")
            i += 1
            c = s[i]
        kind = HEADS.get(c)
        if kind is None:
            if c == "m" and s[-2] == ":":
                try:
                    return self.simple(i)
                except Fail:
                    i = self.star_list(i + 1)
                    self.need(self.need(i, ":", "EXPECTED_COLON"), END, "TRAILING_TOKENS")
                    return "M"
            if c == "k":
                try:
                    return self.simple(i)
                except Fail as first:
                    if ":" not in s:
                        raise first
                    i = self.patterns(i + 1)
                    if s[i] == K["if"]:
                        i = self.named(i + 1)
                    return self.header_end("K", i)
            return self.simple(i)
        i += 1
        if kind in "IEW":
            i = self.named(i)
        elif kind == "F":
            i = self.targets(i)
            i = self.star_list(self.need(i, K["in"], "EXPECTED_IN"))
        elif kind == "X":
            if s[i] == "*":
                extra = "*"
                i += 1
            if s[i] == ":":
                extra += "b"
                if "*" in extra:
                    raise Fail(i, "EXPECTED_EXPRESSION")
            else:
                i = self.expression(i)
                if s[i] == K["as"]:
                    i = self.need_name(i + 1)
        elif kind == "H":
            i = self.with_items(i)
        elif kind == "D":
            i = self.type_parameters(self.need_name(i))
            i = self.parameters(self.need(i, "(", "EXPECTED_PARAMETERS"), ")", True)
            i = self.need(i, ")", "EXPECTED_CLOSING_PAREN")
            if s[i] == "W":
                i = self.expression(i + 1)
        elif kind == "C":
            i = self.type_parameters(self.need_name(i))
            if s[i] == "(":
                i = self.call(i)
        elif kind == "@":
            i = self.named(i)
            self.need(i, END, "TRAILING_TOKENS")
            return "@"
        return self.header_end(kind + extra, i)

    def header_end(self, kind: str, i: int) -> str:
        s = self.s
        i = self.need(i, ":", "EXPECTED_COLON")
        if s[i] == END:
            return kind
        self.simple(i)
        return kind + "."

    def need_name(self, i: int) -> int:
        if self.s[i] not in NAME:
            raise Fail(i, "UNEXPECTED_END" if self.s[i] == END else "EXPECTED_IDENTIFIER")
        return i + 1

    def simple(self, i: int) -> str:
        s = self.s
        while True:
            i = self.small(i)
            if s[i] == ";":
                i += 1
                if s[i] == END:
                    return "S"
                continue
            if s[i] == END:
                return "S"
            raise Fail(i, "INVALID_TOKEN" if s[i] == BAD else "TRAILING_TOKENS")

    def small(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in (K["pass"], K["break"], K["continue"]):
            return i + 1
        if c == K["return"]:
            return i + 1 if s[i + 1] in ENDS else self.star_list(i + 1)
        if c == K["raise"]:
            if s[i + 1] in ENDS:
                return i + 1
            i = self.expression(i + 1)
            return self.expression(i + 1) if s[i] == K["from"] else i
        if c in (K["global"], K["nonlocal"]):
            i = self.need_name(i + 1)
            while s[i] == ",":
                i = self.need_name(i + 1)
            return i
        if c == K["del"]:
            j = self.targets(i + 1, True)
            return j
        if c == K["assert"]:
            i = self.expression(i + 1)
            return self.expression(i + 1) if s[i] == "," else i
        if c == K["import"]:
            while True:
                i = self.dotted(i + 1)
                if s[i] == K["as"]:
                    i = self.need_name(i + 1)
                if s[i] != ",":
                    return i
        if c == K["from"]:
            return self.from_import(i + 1)
        if c == "t" and s[i + 1] in NAME and s[i + 2] in "=[":
            i = self.type_parameters(i + 2)
            return self.expression(self.need(i, "=", "EXPECTED_EQUALS"))
        if c in HEADS or c == K["async"]:
            raise Fail(i, "UNEXPECTED_COMPOUND")
        start = i
        i = self.yielded(i) if c == K["yield"] else self.star_list(i)
        kind = self.kind
        d = s[i]
        if d == "=":
            while s[i] == "=":
                if kind not in "nat":
                    raise Fail(i, "NOT_ASSIGNABLE")
                i = self.yielded(i + 1) if s[i + 1] == K["yield"] else self.star_list(i + 1)
                kind = self.kind
            return i
        if d == "A":
            if kind not in "na":
                raise Fail(i, "NOT_ASSIGNABLE")
            return self.yielded(i + 1) if s[i + 1] == K["yield"] else self.star_list(i + 1)
        if d == ":":
            if kind not in "na" or s[start] in "[{":
                raise Fail(i, "NOT_ASSIGNABLE")
            i = self.expression(i + 1)
            if s[i] == "=":
                i = self.yielded(i + 1) if s[i + 1] == K["yield"] else self.star_list(i + 1)
            return i
        return i

    def dotted(self, i: int) -> int:
        i = self.need_name(i)
        while self.s[i] == ".":
            i = self.need_name(i + 1)
        return i

    def from_import(self, i: int) -> int:
        s = self.s
        dots = i
        while s[i] == "." or s[i] == LITERAL and i == dots or s[i] == LITERAL:
            i += 1  # '...' is one token
        if s[i] != K["import"]:
            i = self.dotted(i)
        elif i == dots:
            raise Fail(i, "EXPECTED_IDENTIFIER")
        i = self.need(i, K["import"], "EXPECTED_IMPORT")
        if s[i] == "*":
            return i + 1
        closed = s[i] == "("
        i += closed
        while True:
            i = self.need_name(i)
            if s[i] == K["as"]:
                i = self.need_name(i + 1)
            if s[i] != ",":
                break
            i += 1
            if closed and s[i] == ")":
                break
        return self.need(i, ")", "EXPECTED_CLOSING_PAREN") if closed else i

    def with_items(self, i: int) -> int:
        s = self.s
        if s[i] == "(":
            # all items in parentheses, if that reading reaches the colon
            try:
                j = i + 1
                while True:
                    j = self.with_item(j)
                    if s[j] == ",":
                        j += 1
                        if s[j] == ")":
                            break
                        continue
                    break
                if s[j] == ")" and s[j + 1] == ":":
                    return j + 1
            except Fail:
                pass
        i = self.with_item(i)
        while s[i] == ",":
            i = self.with_item(i + 1)
        return i

    def with_item(self, i: int) -> int:
        i = self.expression(i)
        if self.s[i] == K["as"]:
            i = self.postfix(i + 1) if self.s[i + 1] != "*" else self.star_list(i + 1)
            if self.kind not in "nat":
                raise Fail(i, "NOT_ASSIGNABLE")
        return i

    def targets(self, i: int, deleted: bool = False) -> int:
        s = self.s
        n = 0
        while True:
            j = i + 1 if s[i] == "*" and not deleted else i
            j = self.postfix(j)
            if self.kind not in "nat":
                raise Fail(j, "NOT_ASSIGNABLE")
            i = j
            n += 1
            if s[i] != ",":
                return i
            i += 1
            if s[i] in (K["in"], END, ";"):
                return i

    def type_parameters(self, i: int) -> int:
        s = self.s
        if s[i] != "[":
            return i
        i += 1
        while True:
            star = s[i] in "*X"
            i = self.need_name(i + star)
            if s[i] == ":" and not star:
                i = self.expression(i + 1)
            if s[i] == "=":
                i = self.star_item(i + 1)
            if s[i] == ",":
                i += 1
                if s[i] == "]":
                    return i + 1
                continue
            return self.need(i, "]", "EXPECTED_CLOSING_BRACKET")

    def parameters(self, i: int, close: str, annotated: bool) -> int:
        """Of a function or lambda, up to the closing token."""
        s = self.s
        slash = star = default = double = False
        count = 0
        while s[i] != close:
            if double:
                raise Fail(i, "PARAMETER_AFTER_KEYWORDS")
            if s[i] == "/" and not slash and not star and count:
                slash = True
                i += 1
            elif s[i] == "*":
                if star:
                    raise Fail(i, "SECOND_STAR")
                star = True
                i += 1
                if s[i] in NAME:
                    i += 1
                    if annotated and s[i] == ":":
                        i = self.star_item(i + 1)
                elif s[i] != "," or s[i + 1] == close or s[i + 1] == "X":
                    raise Fail(i, "EXPECTED_PARAMETER")
            elif s[i] == "X":
                double = True
                i = self.need_name(i + 1)
                if annotated and s[i] == ":":
                    i = self.expression(i + 1)
            else:
                i = self.need_name(i)
                if annotated and s[i] == ":":
                    i = self.expression(i + 1)
                if s[i] == "=":
                    i = self.expression(i + 1)
                    default = True
                elif default and not star:
                    raise Fail(i, "DEFAULT_BEFORE_PLAIN")
            count += 1
            if s[i] != ",":
                break
            i += 1
        return i

    # -- match patterns ------------------------------------------------------
    def patterns(self, i: int) -> int:
        s = self.s
        i = self.star_pattern(i)
        while s[i] == ",":
            i += 1
            if s[i] in (":", K["if"]):
                break
            i = self.star_pattern(i)
        return i

    def star_pattern(self, i: int) -> int:
        return self.need_name(i + 1) if self.s[i] == "*" else self.pattern(i)

    def pattern(self, i: int) -> int:
        s = self.s
        i = self.closed(i)
        while s[i] == "|":
            i = self.closed(i + 1)
        if s[i] == K["as"]:
            i = self.need_name(i + 1)
        return i

    def closed(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "(":
            return self.sequence(i + 1, ")")
        if c == "[":
            return self.sequence(i + 1, "]")
        if c == "{":
            i += 1
            while s[i] != "}":
                if s[i] == "X":
                    i = self.need_name(i + 1)
                else:
                    i = self.closed(i)
                    i = self.pattern(self.need(i, ":", "EXPECTED_COLON"))
                if s[i] != ",":
                    break
                i += 1
            return self.need(i, "}", "EXPECTED_CLOSING_BRACE")
        if c == LITERAL or c == "+":
            if c == "+":
                i += 1
            i = self.need(i, LITERAL, "EXPECTED_PATTERN")
            return self.need(i + 1, LITERAL, "EXPECTED_PATTERN") if s[i] == "+" else i
        if c in "sb":
            while s[i] in "sb":
                i += 1
            return i
        i = self.dotted(i)
        if s[i] == "(":
            i += 1
            while s[i] != ")":
                if s[i] in NAME and s[i + 1] == "=":
                    i += 2
                i = self.pattern(i)
                if s[i] != ",":
                    break
                i += 1
            i = self.need(i, ")", "EXPECTED_CLOSING_PAREN")
        return i

    def sequence(self, i: int, close: str) -> int:
        s = self.s
        while s[i] != close:
            i = self.star_pattern(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, close, "EXPECTED_CLOSING_BRACKET")

    # -- expressions ---------------------------------------------------------
    def yielded(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == K["from"]:
            i = self.expression(i + 1)
        elif s[i] not in ")=;" + END + "]}:,":
            i = self.star_list(i)
        self.kind = "x"
        return i

    def star_item(self, i: int) -> int:
        if self.s[i] == "*":
            i = self.binary(i + 1, 5)
            self.kind = "*" if self.kind in "na" else "y"
            return i
        return self.named(i)

    def star_list(self, i: int) -> int:
        """One expression or an open tuple, with starred items."""
        s = self.s
        i = self.star_item(i)
        if s[i] != ",":
            if self.kind == "y":
                self.kind = "*"
            return i
        fits = self.kind in "nat*"
        while s[i] == ",":
            i += 1
            if s[i] in ENDS or s[i] in ")]}:=A" or s[i] == K["in"]:
                break
            i = self.star_item(i)
            fits = fits and self.kind in "nat*"
        self.kind = "t" if fits else "x"
        return i

    def expressions(self, i: int) -> int:
        return self.star_list(i)

    def named(self, i: int) -> int:
        s = self.s
        if s[i] in NAME and s[i + 1] == "B":
            i = self.expression(i + 2)
            self.kind = "x"
            return i
        return self.expression(i)

    def expression(self, i: int) -> int:
        s = self.s
        if s[i] == K["lambda"]:
            i = self.parameters(i + 1, ":", False)
            i = self.expression(self.need(i, ":", "EXPECTED_COLON"))
            self.kind = "x"
            return i
        i = self.binary(i, 1)
        if s[i] == K["if"]:
            j = self.binary(i + 1, 1)
            if s[j] != K["else"]:
                raise Fail(j, "UNEXPECTED_END" if s[j] == END else "EXPECTED_ELSE")
            i = self.expression(j + 1)
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        """Precedence climbing; ``not`` sits between ``and`` and comparisons."""
        s = self.s
        if s[i] == K["not"]:
            if least > 3:
                raise Fail(i, "EXPECTED_EXPRESSION")
            i = self.binary(i + 1, 3)
            self.kind = "x"
        else:
            i = self.unary(i)
        while True:
            c = s[i]
            p = BINARY.get(c, 0)
            if p == 0 or p < least:
                return i
            if c == K["not"]:
                if s[i + 1] != K["in"]:
                    raise Fail(i, "EXPECTED_IN")
                i += 1
            elif c == K["is"] and s[i + 1] == K["not"]:
                i += 1
            i = self.binary(i + 1, p + 1)
            self.kind = "x"

    def unary(self, i: int) -> int:
        s = self.s
        if s[i] in "+~":
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        i = self.postfix(i)
        if s[i] == "X":
            i = self.unary(i + 1)
            self.kind = "x"
        return i

    def postfix(self, i: int) -> int:
        s = self.s
        if s[i] == K["await"]:
            i = self.postfix(i + 1)
            self.kind = "x"
            return i
        i = self.atom(i)
        while True:
            c = s[i]
            if c == ".":
                i = self.need_name(i + 1)
                self.kind = "a"
            elif c == "(":
                i = self.call(i)
                self.kind = "x"
            elif c == "[":
                i = self.subscript(i + 1)
                self.kind = "a"
            else:
                return i

    def call(self, i: int) -> int:
        s = self.s
        i += 1
        keyword = unpacked = False
        while s[i] != ")":
            if s[i] == "*":
                if unpacked:
                    raise Fail(i, "POSITIONAL_AFTER_KEYWORD")
                i = self.expression(i + 1)
            elif s[i] == "X":
                i = self.expression(i + 1)
                unpacked = True
            elif s[i] in NAME and s[i + 1] == "=":
                i = self.expression(i + 2)
                keyword = True
            else:
                start = i
                i = self.named(i)
                if s[i] in (K["for"], K["async"]):
                    i = self.comprehension(i)
                    if s[i] != ")" and not (s[i] == "," and s[i + 1] == ")" and False):
                        raise Fail(i, "UNEXPECTED_END" if s[i] == END else "BARE_GENERATOR")
                    if s[start - 1] != "(":
                        raise Fail(start, "BARE_GENERATOR")
                elif keyword or unpacked:
                    raise Fail(start, "POSITIONAL_AFTER_KEYWORD")
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ")", "EXPECTED_CLOSING_PAREN")

    def subscript(self, i: int) -> int:
        s = self.s
        if s[i] == "]":
            raise Fail(i, "EXPECTED_EXPRESSION")
        while s[i] != "]":
            if s[i] == "*":
                i = self.binary(i + 1, 5)
            else:
                if s[i] != ":":
                    i = self.named(i)
                for _ in range(2):
                    if s[i] == ":":
                        i += 1
                        if s[i] not in ":,]":
                            i = self.expression(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]", "EXPECTED_CLOSING_BRACKET")

    def comprehension(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == K["async"]:
                i += 1
            i = self.targets(self.need(i, K["for"], "EXPECTED_FOR"))
            i = self.binary(self.need(i, K["in"], "EXPECTED_IN"), 1)
            while s[i] == K["if"]:
                j = i + 1
                i = self.need_binary(j)
            if s[i] not in (K["for"], K["async"]):
                self.kind = "x"
                return i

    def need_binary(self, i: int) -> int:
        s = self.s
        if s[i] in NAME and s[i + 1] == "B":
            return self.named(i)
        if s[i] == K["lambda"]:
            return self.expression(i)
        return self.binary(i, 1)

    def atom(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.kind = "x"
        if c in NAME:
            self.kind = "n"
            return i + 1
        if c == LITERAL:
            return i + 1
        if c == "s" or c == "b":
            while s[i] == c:
                i += 1
            if s[i] in "sb":
                raise Fail(i, "MIXED_STRINGS")
            return i
        if c == "(":
            i += 1
            if s[i] == ")":
                self.kind = "t"
                return i + 1
            if s[i] == K["yield"]:
                return self.need(self.yielded(i), ")", "EXPECTED_CLOSING_PAREN")
            start = i
            i = self.star_item(i)
            if s[i] in (K["for"], K["async"]):
                if s[start] == "*":
                    raise Fail(start, "STARRED_NOT_ALLOWED")
                i = self.comprehension(i)
                self.kind = "x"
            elif s[i] == ",":
                i = self.rest(i, ")")
            elif self.kind in "*y":
                raise Fail(start, "STARRED_NOT_ALLOWED")
            kind = self.kind
            i = self.need(i, ")", "EXPECTED_CLOSING_PAREN")
            self.kind = kind
            return i
        if c == "[":
            i += 1
            if s[i] == "]":
                self.kind = "t"
                return i + 1
            start = i
            i = self.star_item(i)
            if s[i] in (K["for"], K["async"]):
                if s[start] == "*":
                    raise Fail(start, "STARRED_NOT_ALLOWED")
                i = self.comprehension(i)
                self.kind = "x"
            else:
                i = self.rest(i, "]")
            return self.need(i, "]", "EXPECTED_CLOSING_BRACKET")
        if c == "{":
            i = self.display(i + 1)
            self.kind = "x"
            return i
        raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_EXPRESSION")

    def rest(self, i: int, close: str) -> int:
        """Further items of a tuple or list, behind the first."""
        s = self.s
        fits = self.kind in "nat*"
        while s[i] == ",":
            i += 1
            if s[i] == close:
                break
            i = self.star_item(i)
            fits = fits and self.kind in "nat*"
        self.kind = "t" if fits else "x"
        return i

    def display(self, i: int) -> int:
        """Behind the brace of a set or dictionary."""
        s = self.s
        if s[i] == "}":
            return i + 1
        dictionary = None
        first = True
        while s[i] != "}":
            if s[i] == "X":
                if dictionary is False:
                    raise Fail(i, "EXPECTED_SET_ITEM")
                dictionary = True
                i = self.binary(i + 1, 5)
            else:
                starred = s[i] == "*"
                i = self.star_item(i)
                pair = s[i] == ":"
                if pair and starred:
                    raise Fail(i, "STARRED_NOT_ALLOWED")
                if dictionary is None:
                    dictionary = pair
                if pair != dictionary:
                    raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_COLON" if dictionary else "UNEXPECTED_COLON")
                if pair:
                    i = self.expression(i + 1)
                if first and s[i] in (K["for"], K["async"]):
                    i = self.comprehension(i)
                    break
            first = False
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "}", "EXPECTED_CLOSING_BRACE")
