"""Shared machinery of the recursive-descent syntax checkers.

A file is lexed once, in C, by one regular expression; every token becomes
one *class character* (all identifiers the same one, each keyword and
operator its own).  The parsers are recursive-descent for statements and
precedence-climbing for expressions, working on that class string.  Because
class strings forget names and values, the same statement shape occurs over
and over; shapes that parsed completely are remembered (bounded memo), so
that a known shape costs one dictionary probe instead of a parse.

Errors never stop a parse: a failing construct is recorded and skipped in
panic mode up to a synchronising token, and parsing goes on behind it.
"""

from __future__ import annotations

import re
import sys

END = "\x03"
BAD = "\x00"

#: Bounds of the per-process memo tables (entries); a full table is emptied.
MAX_SHAPES = 200_000
MAX_LEXEMES = 400_000
MAX_SHAPE_LENGTH = 600


#: Frames of the descent that a token may need; frames of pure Python functions
#: lie on the heap, so the limit follows the file and no depth is refused.
FRAMES = 40


def allow_depth(n_tokens: int) -> None:
    need = 10_000 + FRAMES * n_tokens
    if sys.getrecursionlimit() < need:
        sys.setrecursionlimit(min(need, 2_000_000_000))


class Fail(Exception):
    """A construct does not parse; ``pos`` is a token index."""

    def __init__(self, pos: int, code: str):
        super().__init__(code)
        self.pos = pos
        self.code = code


class Lexemes(dict):
    """lexeme -> class character; unknown lexemes are classified once."""

    def __init__(self, table: dict[str, str], classify, padding: str = ""):
        super().__init__(table)
        self.padding = padding  # characters that a lexeme may carry in front
        self.table = table
        self.classify = classify

    def __missing__(self, lexeme: str) -> str:
        if len(self) > MAX_LEXEMES:
            self.clear()
            self.update(self.table)
        bare = lexeme.lstrip(self.padding) if self.padding else lexeme
        c = self.table.get(bare)
        if c is None:
            c = self.classify(bare) if bare else ""
        if len(lexeme) <= 64:
            self[lexeme] = c
        return c


class Shapes(set):
    """Known good class strings of one grammar rule."""

    def learn(self, shape: str) -> None:
        if len(shape) <= MAX_SHAPE_LENGTH:
            if len(self) >= MAX_SHAPES:
                self.clear()
            self.add(shape)


def near(pattern: re.Pattern, s: str, i: int) -> re.Match | None:
    """A match at ``i`` that is short enough to be remembered; what lies further
    on is not looked at again for every statement before it."""
    m = pattern.match(s, i, i + MAX_SHAPE_LENGTH + 100)
    return m if m and m.end() <= i + MAX_SHAPE_LENGTH else None


def keywords(words: str, start: int) -> dict[str, str]:
    """One class character for each word, from ``start`` on."""
    return {w: chr(start + k) for k, w in enumerate(words.split())}


class Parser:
    """State and helpers common to the brace languages.

    Subclasses give ``token`` (regular expression with one group),
    ``lexemes`` and ``file(i)``.  ``s`` is the class string, ended by END.
    """

    token: re.Pattern
    lexemes: Lexemes
    language = ""

    def __init__(self) -> None:
        self.s = END
        self.errors: list[tuple[int, str]] = []
        self.kind = ""
        self.pairs: tuple[str, dict[int, int]] = ("", {})

    def classes(self, text: str) -> str:
        return "".join(map(self.lexemes.__getitem__, self.token.findall(text)))

    def check(self, text: str) -> list[tuple[int, str]]:
        """All errors of ``text`` as (line, code), in order; [] = well-formed."""
        self.errors = []
        self.s = self.classes(text) + END
        allow_depth(len(self.s))
        try:
            self.file(0)
        except Fail as e:
            self.errors.append((e.pos, e.code))
        if not self.errors:
            return []
        return self.located(text)

    def file(self, i: int) -> int:
        raise NotImplementedError

    def located(self, text: str) -> list[tuple[int, str]]:
        """Token indexes to line numbers; only failing files pay for this."""
        starts: list[int] = []
        get = self.lexemes.__getitem__
        for m in self.token.finditer(text):
            k = len(get(m.group(1)))
            starts += [m.start(1)] * k
        out, at, line = [], 0, 1
        for pos, code in sorted(set(self.errors)):
            offset = starts[pos] if pos < len(starts) else len(text)
            line += text.count("\n", at, offset)
            at = max(at, offset)
            out.append((line, code))
        return out

    # -- helpers ----------------------------------------------------------
    def need(self, i: int, c: str, code: str) -> int:
        if self.s[i] != c:
            raise Fail(i, "UNEXPECTED_END" if self.s[i] == END else code)
        return i + 1

    def closing(self, i: int) -> int:
        """Index of the bracket that closes the one at ``i``; -1 if none.

        Near ones are looked for; beyond that all brackets of the file are
        matched, once."""
        s, depth, left = self.s, 0, NEAR
        for m in BRACKETS.finditer(s, i):
            if m.group() in "([{":
                depth += 1
            else:
                depth -= 1
                if depth == 0:
                    return m.start()
            left -= 1
            if not left:
                break
        else:
            return -1
        if self.pairs[0] is not s:
            pairs: dict[int, int] = {}
            held: list[int] = []
            for m in BRACKETS.finditer(s):
                if m.group() in "([{":
                    held.append(m.start())
                elif held:
                    pairs[held.pop()] = m.start()
            self.pairs = s, pairs
        return self.pairs[1].get(i, -1)

    def recover(self, e: Fail, i: int) -> int:
        """Panic mode: record, then skip behind the next ';' or balanced
        block, or to the next unmatched '}' or the end."""
        s = self.s
        self.errors.append((e.pos, e.code))
        i = max(i, min(e.pos, len(s) - 1))
        depth = 0
        while True:
            c = s[i]
            if c == END:
                return i
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    return i
                depth -= 1
                if depth == 0:
                    return i + 1
            elif c == ";" and depth == 0:
                return i + 1
            i += 1


#: Brackets that are gone through before all of a file are matched.
NEAR = 8
BRACKETS = re.compile(r"[()\[\]{}]")
