"""A strict subset of YAML for declared documents: one document of mappings,
sequences and strings, in block or flow style, with positions.

Anchors, aliases, tags, merge keys, block scalars, further documents, repeated
keys and plain scalars of other types (numbers, booleans, null) are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

KEY = re.compile(r"""([A-Za-z_][\w.\-]*|"[^"\\]*"|'[^']*')\s*:(?=\s|$)""")
PLAIN = re.compile(r"[^\s,\[\]{}:#&*!|>'\"%@`\-?][^,\[\]{}#\n]*|[\-?:](?=\S)[^,\[\]{}#\n]*")
QUOTED = re.compile(r""""(?:[^"\\\n]|\\["\\/nt])*"|'(?:[^'\n]|'')*'""")
#: Plain scalars that are no strings.
TYPED = re.compile(r"[-+]?(?:\d[\d_]*(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+|0x[\da-fA-F]+|0o[0-7]+|\.inf|\.nan)|true|false|yes|no|on|off|null|~", re.I)
MAX_DEPTH = 24


class YamlError(ValueError):
    def __init__(self, code: str, line: int, column: int = 1):
        super().__init__(f"{code} (line {line}, column {column})")
        self.code, self.line, self.column = code, line, column


@dataclass
class Node:
    """``value`` is a dict of nodes, a list of nodes or a string."""

    value: object
    line: int
    column: int


class _Reader:
    def __init__(self, text: str):
        self.rows: list[tuple[int, str, int]] = []  # indentation, content, line
        begun = False
        for no, raw in enumerate(text.splitlines(), 1):
            if "\t" in raw[: len(raw) - len(raw.lstrip())]:
                raise YamlError("TAB_INDENTATION", no)
            bare = self.uncommented(raw).rstrip()
            if not bare.strip():
                continue
            if bare in ("---", "...") or bare.startswith("--- "):
                if begun or self.rows or bare != "---":
                    raise YamlError("SINGLE_DOCUMENT_REQUIRED", no)
                begun = True
                continue
            self.rows.append((len(bare) - len(bare.lstrip()), bare.strip(), no))
        self.at = 0

    @staticmethod
    def uncommented(raw: str) -> str:
        quote = ""
        for k, c in enumerate(raw):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and (not k or raw[k - 1] in " [{,:"):
                quote = c
            elif c == "#" and (not k or raw[k - 1].isspace()):
                return raw[:k]
        return raw

    def document(self) -> Node:
        if not self.rows:
            raise YamlError("EMPTY_DOCUMENT", 1)
        out = self.block(self.rows[0][0], 0)
        if self.at < len(self.rows):
            raise YamlError("MALFORMED_YAML", self.rows[self.at][2])
        return out

    def block(self, indent: int, depth: int) -> Node:
        """All rows of one indentation: a sequence or a mapping."""
        _, content, line = self.rows[self.at]
        if depth > MAX_DEPTH:
            raise YamlError("AST_LIMIT", line)
        if content == "-" or content.startswith("- "):
            items: list[Node] = []
            while self.here(indent) and (self.rows[self.at][1] + " ").startswith("- "):
                _, content, no = self.rows[self.at]
                rest = content[1:].lstrip()
                if rest and KEY.match(rest):
                    # the mapping begins on the dash's own row
                    inner = indent + len(content) - len(rest)
                    self.rows[self.at] = inner, rest, no
                    items.append(self.block(inner, depth + 1))
                else:
                    self.at += 1
                    items.append(self.value(rest, indent, no, indent + 1 + len(content) - len(rest), depth))
            return Node(items, line, indent + 1)
        fields: dict[str, Node] = {}
        while self.here(indent) and not (self.rows[self.at][1] + " ").startswith("- "):
            _, content, no = self.rows[self.at]
            m = KEY.match(content)
            if not m:
                code = "YAML_ANCHOR_UNSUPPORTED" if content[0] in "&*" else "UNSUPPORTED_YAML_TYPE" if content[0] == "!" or content.startswith("<<") else "MALFORMED_YAML"
                raise YamlError(code, no, indent + 1)
            key = m.group(1).strip("\"'")
            if key in fields:
                raise YamlError("DUPLICATE_KEY", no, indent + 1)
            rest = content[m.end() :].strip()
            self.at += 1
            fields[key] = self.value(rest, indent, no, indent + 1 + len(content) - len(rest), depth)
        return Node(fields, line, indent + 1)

    def here(self, indent: int) -> bool:
        return self.at < len(self.rows) and self.rows[self.at][0] == indent

    def value(self, rest: str, indent: int, line: int, column: int, depth: int) -> Node:
        """What stands behind a key or dash: inline, or as a deeper block."""
        if not rest:
            if self.at < len(self.rows):
                inner, content, _ = self.rows[self.at]
                # sequences may stand below their key without indentation
                if inner > indent or inner == indent and (content + " ").startswith("- "):
                    return self.block(inner, depth + 1)
            raise YamlError("UNSUPPORTED_YAML_TYPE", line, column)  # null
        while rest[0] in "[{" and rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and self.at < len(self.rows) and self.rows[self.at][0] > indent:
            rest += " " + self.rows[self.at][1]
            self.at += 1
        node, end = self.flow(rest, 0, line, column, depth)
        if rest[end:].strip():
            raise YamlError("MALFORMED_YAML", line, column + end)
        return node

    def flow(self, text: str, i: int, line: int, column: int, depth: int) -> tuple[Node, int]:
        while i < len(text) and text[i] == " ":
            i += 1
        c, at = text[i : i + 1], column + i
        if depth > MAX_DEPTH:
            raise YamlError("AST_LIMIT", line, at)
        if c in ("&", "*") and c:
            raise YamlError("YAML_ANCHOR_UNSUPPORTED", line, at)
        if c in ("[", "{") and c:
            return self.collection(text, i, line, column, depth)
        m = QUOTED.match(text, i)
        if m:
            s = m.group()
            s = s[1:-1].replace("''", "'") if s[0] == "'" else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x.group(1), x.group(1)), s[1:-1])
            return Node(s, line, at), m.end()
        m = PLAIN.match(text, i)
        if not m or TYPED.fullmatch(m.group().strip()) or ": " in m.group():
            raise YamlError("UNSUPPORTED_YAML_TYPE" if m or c in ("!", "|", ">") else "MALFORMED_YAML", line, at)
        return Node(m.group().strip(), line, at), m.end()

    def collection(self, text: str, i: int, line: int, column: int, depth: int) -> tuple[Node, int]:
        """A flow sequence or mapping from its bracket on."""
        mapping, at = text[i] == "{", column + i
        close = "}" if mapping else "]"
        items: list[Node] = []
        fields: dict[str, Node] = {}
        i += 1
        while True:
            while i < len(text) and text[i] == " ":
                i += 1
            if text[i : i + 1] == close:
                return Node(fields if mapping else items, line, at), i + 1
            if mapping:
                m = KEY.match(text, i)
                if not m:
                    raise YamlError("MALFORMED_YAML", line, column + i)
                key = m.group(1).strip("\"'")
                if key in fields:
                    raise YamlError("DUPLICATE_KEY", line, column + i)
                fields[key], i = self.flow(text, m.end(), line, column, depth + 1)
            else:
                node, i = self.flow(text, i, line, column, depth + 1)
                items.append(node)
            while i < len(text) and text[i] == " ":
                i += 1
            if text[i : i + 1] == ",":
                i += 1
            elif text[i : i + 1] != close:
                raise YamlError("MALFORMED_YAML", line, column + i)


def read(text: str) -> Node:
    """The document's root node."""
    return _Reader(text).document()
