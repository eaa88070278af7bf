"""JSON texts and XML 1.0 documents."""

from __future__ import annotations

import re

from .base import BAD, END, Fail, Lexemes, Parser, Shapes

# -- JSON ------------------------------------------------------------------
JSON_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?[0-9]+(?:[.eE+\-0-9]*)|[A-Za-z_]\w*|[^ \t\r\n])')
JSON_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
JSON_FLAT = re.compile(r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]")


def json_class(x: str) -> str:
    if x[0] == '"':
        return "s" if len(x) > 1 else BAD
    return "n" if JSON_NUMBER.fullmatch(x) else BAD


class JsonParser(Parser):
    language = "json"
    token = JSON_TOKEN
    lexemes = Lexemes({**{c: c for c in "{}[],:"}, "true": "n", "false": "n", "null": "n"}, json_class)
    flat = Shapes()

    def file(self, i: int) -> int:
        i = self.value(i)
        if self.s[i] != END:
            self.errors.append((i, "TRAILING_TOKENS"))
        return i

    def value(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "sn":
            return i + 1
        if c not in "{[":
            raise Fail(i, "UNEXPECTED_END" if c == END else "INVALID_TOKEN" if c == BAD else "EXPECTED_VALUE")
        m = JSON_FLAT.match(s, i)
        if m and m.group() in self.flat:
            return m.end()
        start, before = i, len(self.errors)
        close = "}" if c == "{" else "]"
        i += 1
        if s[i] != close:
            while True:
                try:
                    if close == "}":
                        i = self.need(self.need(i, "s", "EXPECTED_MEMBER"), ":", "EXPECTED_COLON")
                    i = self.value(i)
                    if s[i] not in (",", close):
                        raise Fail(i, "UNEXPECTED_END" if s[i] == END else "EXPECTED_COMMA")
                except Fail as e:
                    if e.code == "UNEXPECTED_END":
                        raise
                    i = self.skip_to(e)
                if s[i] == close:
                    break
                if s[i] in "}]":
                    raise Fail(i, "MISMATCHED_BRACKET")
                i += 1
        i += 1
        if m and i == m.end() and before == len(self.errors):
            self.flat.learn(s[start:i])
        return i

    def skip_to(self, e: Fail) -> int:
        """Panic mode: to the next comma or closing bracket of this level."""
        s, i, depth = self.s, e.pos, 0
        self.errors.append((e.pos, e.code))
        while s[i] != END:
            c = s[i]
            if c in "{[":
                depth += 1
            elif c in "}]":
                if depth == 0:
                    return i
                depth -= 1
            elif c == "," and depth == 0:
                return i
            i += 1
        raise Fail(i, "UNEXPECTED_END")


# -- XML -------------------------------------------------------------------
NAME_START = ":A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
XML_NAME = f"[{NAME_START}][{NAME_START}\\-.0-9\xb7̀-ͯ‿⁀]*"
ATTRIBUTE = rf"\s+({XML_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')"
LITERAL = r"(?:\"[^\"]*\"|'[^']*')"
#: What may stand in an internal subset.
SUBSET = (
    rf"\s|%{XML_NAME};|<!--(?:[^-]|-[^-])*-->|<\?{XML_NAME}(?:\s(?s:.*?))?\?>"
    rf"|<!ENTITY\s+(?:%\s+)?{XML_NAME}\s+(?:{LITERAL}|(?:SYSTEM\s+{LITERAL}|PUBLIC\s+{LITERAL}\s+{LITERAL})(?:\s+NDATA\s+{XML_NAME})?)\s*>"
    rf"|<!ELEMENT\s+{XML_NAME}\s+(?:EMPTY|ANY|%[^;\s]+;|\([^<>]*\)[?*+]?)\s*>|<!ATTLIST\s+{XML_NAME}(?:\s+{XML_NAME}\s+(?:[A-Z]+|(?:NOTATION\s*)?\([^()<>]*\))\s+(?:#REQUIRED|#IMPLIED|(?:#FIXED\s+)?{LITERAL}))*\s*>"
    rf"|<!NOTATION\s+{XML_NAME}\s+(?:SYSTEM|PUBLIC)\s+{LITERAL}(?:\s+{LITERAL})?\s*>"
)
MARKUP = re.compile(
    rf"<(?P<open>{XML_NAME})(?P<attrs>(?:{ATTRIBUTE.replace('(', '(?:', 2).replace('(?:?:', '(?:')})*)\s*(?P<empty>/?)>"
    rf"|</(?P<close>{XML_NAME})\s*>"
    r"|(?P<comment><!--(?:[^-]|-[^-])*-->)"
    r"|<!\[CDATA\[(?P<cdata>(?s:.*?))\]\]>"
    rf"|<\?(?P<pi>{XML_NAME})(?:\s(?s:.*?))?\?>"
    rf"|(?P<doctype><!DOCTYPE\s+{XML_NAME}(?:\s+(?:SYSTEM\s+{LITERAL}|PUBLIC\s+{LITERAL}\s+{LITERAL}))?\s*(?:\[(?:{SUBSET})*\]\s*)?>)"
    r"|(?P<text>[^<]+)"
    r"|(?P<bad><)"
)
ATTRIBUTES = re.compile(ATTRIBUTE)
REFERENCE = re.compile(rf"&(?:#([0-9]+);|#x([0-9a-fA-F]+);|({XML_NAME});)?")
ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
DECLARATION = re.compile(r"""<\?xml\s+version\s*=\s*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:\s+encoding\s*=\s*(?:"[A-Za-z][\w.\-]*"|'[A-Za-z][\w.\-]*'))?(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>""")
ENTITY = re.compile(rf"<!ENTITY\s+({XML_NAME})\s")
#: The entities every document has.
ENTITIES = frozenset(("amp", "lt", "gt", "apos", "quot"))


class XmlParser:
    """Recursive descent over markup tokens; names must be compared, so the
    tokens themselves are kept instead of class characters."""

    language = "xml"

    def check(self, text: str) -> list[tuple[int, str]]:
        self.errors: list[tuple[int, str]] = []
        self.text = text
        if text.startswith("﻿"):
            self.text = text = text[1:]
        self.entities = set(ENTITIES)
        self.external = False
        bad = ILLEGAL.search(text)
        if bad:
            self.errors.append((bad.start(), "ILLEGAL_CHARACTER"))
        i = 0
        if re.match(r"<\?xml\s", text):
            m = DECLARATION.match(text)
            if m:
                i = m.end()
            else:
                self.errors.append((0, "BAD_DECLARATION"))
                i = text.find("?>") + 2 if "?>" in text else len(text)
        self.document(i)
        found, at, line = [], 0, 1
        for pos, code in sorted(set(self.errors)):
            line += text.count("\n", at, pos)
            at = pos
            found.append((line, code))
        return found

    def fail(self, pos: int, code: str) -> None:
        self.errors.append((pos, code))

    def document(self, i: int) -> None:
        text, n = self.text, len(self.text)
        roots = 0
        typed = False
        while i < n:
            m = MARKUP.match(text, i)
            kind = m.lastgroup
            if m["open"] is not None:
                roots += 1
                if roots > 1:
                    self.fail(i, "SECOND_ROOT")
                i = self.element(m)
                continue
            if m["text"] is not None:
                if m["text"].strip(" \t\r\n"):
                    self.fail(i, "TEXT_OUTSIDE_ROOT")
            elif m["pi"] is not None:
                self.instruction(m)
            elif m["doctype"] is not None:
                if roots or typed:
                    self.fail(i, "MISPLACED_DOCTYPE")
                typed = True
                self.entities |= set(ENTITY.findall(m["doctype"]))
                self.external = bool(re.match(r"<!DOCTYPE\s+\S+\s+(?:SYSTEM|PUBLIC)", m["doctype"])) or "%" in m["doctype"]
            elif m["comment"] is None:
                self.fail(i, "UNEXPECTED_CLOSING_TAG" if m["close"] is not None else "INVALID_MARKUP")
            i = m.end()
        if not roots:
            self.fail(n, "NO_ROOT")

    def instruction(self, m: re.Match) -> None:
        if m["pi"].lower() == "xml":
            self.fail(m.start(), "MISPLACED_DECLARATION")

    def references(self, value: str, at: int) -> None:
        for r in REFERENCE.finditer(value):
            dec, hexa, name = r.groups()
            if dec or hexa:
                c = int(dec) if dec else int(hexa, 16)
                if c > 0x10FFFF or ILLEGAL.match(chr(c)):
                    self.fail(at + r.start(), "ILLEGAL_CHARACTER")
            elif not name:
                self.fail(at + r.start(), "BAD_REFERENCE")
            elif name not in self.entities and not self.external:
                self.fail(at + r.start(), "UNDECLARED_ENTITY")

    def attributes(self, m: re.Match) -> None:
        attrs = m["attrs"]
        if not attrs:
            return
        names = [a for a, _ in ATTRIBUTES.findall(attrs)]
        if len(set(names)) < len(names):
            self.fail(m.start(), "DUPLICATE_ATTRIBUTE")
        if "&" in attrs:
            self.references(attrs, m.start("attrs"))

    def element(self, m: re.Match) -> int:
        """From a start tag on; the index behind its end tag.

        The open elements are an explicit stack, so depth is no limit.  In
        panic mode an end tag closes up to the nearest element of its name,
        or is skipped if there is none."""
        text, n = self.text, len(self.text)
        self.attributes(m)
        i = m.end()
        if m["empty"]:
            return i
        stack = [m["open"]]
        while i < n:
            m = MARKUP.match(text, i)
            if m["text"] is not None:
                t = m["text"]
                if "]]>" in t:
                    self.fail(i + t.index("]]>"), "CDATA_END_IN_TEXT")
                if "&" in t:
                    self.references(t, i)
            elif m["open"] is not None:
                self.attributes(m)
                if not m["empty"]:
                    stack.append(m["open"])
            elif m["close"] is not None:
                name = m["close"]
                if stack[-1] == name:
                    stack.pop()
                else:
                    self.fail(i, "MISMATCHED_TAG")
                    if name in stack:
                        while stack.pop() != name:
                            pass
                if not stack:
                    return m.end()
            elif m["pi"] is not None:
                self.instruction(m)
            elif m["comment"] is None and m["cdata"] is None:
                self.fail(i, "INVALID_MARKUP")
            i = m.end()
        self.fail(n, "UNEXPECTED_END")
        return n
