"""Structural index of a batch of JSON bodies, on the Arrow string buffer.

The buffer of a whole batch is read once with vectorised kernels: escapes and
quotes give the inside of strings, what lies outside gives the tokens, running
depth gives matching brackets and each token's container.  The index then holds
one entry per value with its parent, and list arrays (offsets and members) of
all arrays.  No body is parsed on its own, no Python object is made per value,
and nesting may be of any depth.

A body is valid if it is one JSON text (RFC 8259): the grammar is checked on
neighbouring tokens and their container.  NaN and Infinity are not JSON.  Of
equal member names the last counts.  Escapes are resolved in the buffer; a lone
surrogate becomes U+FFFD.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER, _SPACE, _MARK, _QUOTE = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in "{}[]:,"]] = _MARK
_CLASS[34] = _QUOTE
_OPEN, _CLOSE, _LIST, _LIST_END, _COLON, _COMMA, _STRING, _SCALAR, _START = *map(ord, '{}[]:,"'), 0, 1
#: What stands behind a backslash, and what it means.
_ESCAPED = np.zeros(256, np.uint8)
for _a, _b in zip('"\\/bfnrt', '"\\/\b\f\n\r\t', strict=True):
    _ESCAPED[ord(_a)] = ord(_b)
_HEX = np.full(256, 255, np.uint8)
for _k, _c in enumerate("0123456789abcdef"):
    _HEX[ord(_c)] = _HEX[ord(_c.upper())] = _k
SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"


def _shifted(x: np.ndarray, first) -> np.ndarray:
    """Each place's predecessor."""
    out = np.empty_like(x)
    if len(x):
        out[0] = first
        out[1:] = x[:-1]
    return out


class JsonIndex:
    """Values of all valid bodies of a string array, in the order of the text.

    ``kind`` is the first byte of containers and strings and 0 of scalars,
    ``parent`` the enclosing value or -1, ``key`` the code of the member's name
    among ``names`` or -1; ``root`` is each body's value, -1 if it is invalid."""

    def __init__(self, bodies: pa.Array, names: tuple[str, ...]):
        texts = pc.fill_null(bodies.cast(pa.large_string()), "")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = ends - ends[0]
        self.bad = np.zeros(len(texts), bool)
        self._tokens()
        self._brackets()
        self._grammar()
        self._values(names)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    # -- tokens ----------------------------------------------------------------
    def _escapes(self) -> np.ndarray:
        """Places of the characters that a backslash stands before."""
        b = np.flatnonzero(self.data == 92)
        if not len(b):
            return b
        doc = self.doc_of(b)
        new = np.concatenate([[True], (np.diff(b) != 1) | (np.diff(doc) != 0)])
        first = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        odd = (np.arange(len(b)) - first) % 2 == 0
        b, doc = b[odd], doc[odd]
        return b[b + 1 < self.bounds[doc + 1]] + 1

    def _tokens(self) -> None:
        data, n = self.data, len(self.data)
        escapes = self._escapes()
        quote = data == 34
        quote[escapes] = False
        # bodies that end inside a string are out before parity is taken
        seen = np.concatenate([[0], np.cumsum(quote, dtype=np.int64)])
        open_ended = np.diff(seen[self.bounds]) % 2 == 1
        self.bad |= open_ended
        for k in np.flatnonzero(open_ended).tolist():
            quote[self.bounds[k] : self.bounds[k + 1]] = False
        inside = (np.cumsum(quote, dtype=np.int32) & 1).astype(bool)
        self._fail((data < 32) & inside)
        self.escapes = escapes[inside[escapes]]
        self._check_escapes()
        classes = _CLASS[data]
        loose = (classes == _OTHER) & ~inside
        starts = np.zeros(n, bool)
        starts[self.bounds[:-1][self.bounds[:-1] < n]] = True
        head = loose & (starts | ~_shifted(loose, False))
        tail = loose & (np.append(starts, True)[1:] | ~np.append(loose, False)[1:])
        opened = quote & inside
        self.token = np.flatnonzero(opened | head | ((classes == _MARK) & ~inside))
        self.type = np.where(head[self.token], _SCALAR, data[self.token]).astype(np.uint8)
        self.end = self.token + 1
        self.end[self.type == _STRING] = np.flatnonzero(quote & ~inside)
        self.end[self.type == _SCALAR] = np.flatnonzero(tail) + 1
        self.doc = self.doc_of(self.token)

    def _check_escapes(self) -> None:
        e = self.escapes
        if not len(e):
            return
        c = self.data[e]
        u = e[c == 117]
        self.bad[self.doc_of(e[(c != 117) & (_ESCAPED[c] == 0)])] = True
        digits = _HEX[self.data[np.minimum(u[:, None] + np.arange(1, 5), len(self.data) - 1)]] if len(u) else np.zeros((0, 4), np.uint8)
        self.bad[self.doc_of(u[(digits == 255).any(1) | (u + 4 >= len(self.data))])] = True

    def _fail(self, mask: np.ndarray) -> None:
        self.bad[self.doc_of(np.flatnonzero(mask))] = True

    def _keep(self) -> None:
        """Drop the tokens of bodies known to be invalid."""
        keep = ~self.bad[self.doc]
        if not keep.all():
            self.token, self.type, self.end, self.doc = self.token[keep], self.type[keep], self.end[keep], self.doc[keep]

    # -- nesting ---------------------------------------------------------------
    def _brackets(self) -> None:
        self._keep()
        turn = ((self.type == _OPEN) | (self.type == _LIST)).astype(np.int64) - ((self.type == _CLOSE) | (self.type == _LIST_END))
        depth = np.cumsum(turn)
        first = np.concatenate([[True], np.diff(self.doc) != 0]) if len(self.doc) else np.zeros(0, bool)
        base = np.zeros(len(self.bad), np.int64)
        base[self.doc[first]] = (depth - turn)[first]
        low = depth - base[self.doc]
        self.bad[self.doc[low < 0]] = True
        last = np.append(first[1:], True) if len(first) else first
        self.bad[self.doc[last & (low != 0)]] = True
        some = np.zeros(len(self.bad), bool)
        some[self.doc] = True
        self.bad |= ~some
        self._keep()
        opens = (self.type == _OPEN) | (self.type == _LIST)
        closes = (self.type == _CLOSE) | (self.type == _LIST_END)
        depth = np.cumsum(opens.astype(np.int64) - closes)
        level = depth + closes  # of brackets: that of their inside
        at = np.flatnonzero(opens | closes)
        at = at[np.argsort(level[at], kind="stable")]
        o, c = at[0::2], at[1::2]
        self._fail_tokens(c[self.type[c] != self.type[o] + 2])
        self.match = np.full(len(self.token), -1)
        self.match[o], self.match[c] = c, o
        # the container of every token: the last bracket before it that opens
        # the level it lies on; closing brackets belong to their own container
        within = level - opens
        n = len(self.token) + 1
        k = np.searchsorted(level[o] * n + o, within * n + np.arange(len(within))) - 1
        self.container = np.where(within > 0, o[np.maximum(k, 0)] if len(o) else -1, -1)

    def _fail_tokens(self, at: np.ndarray) -> None:
        self.bad[self.doc[at]] = True

    # -- grammar ---------------------------------------------------------------
    def _grammar(self) -> None:
        t = self.type
        before = _shifted(t, _START)
        before[np.concatenate([[True], np.diff(self.doc) != 0]) if len(t) else []] = _START
        inside = np.where(self.container >= 0, t[self.container], 0) if len(t) else t
        name = (t == _STRING) & (inside == _OPEN) & ((before == _OPEN) | (before == _COMMA))
        after_name = _shifted(name, False)
        self.name = name
        begins = ((t == _OPEN) | (t == _LIST) | (t == _STRING) | (t == _SCALAR)) & ~name
        ended = (before == _SCALAR) | (before == _CLOSE) | (before == _LIST_END) | ((before == _STRING) & ~after_name)
        right = name | np.where(begins, np.where(
            inside == 0, before == _START, np.where(inside == _OPEN, before == _COLON, (before == _LIST) | (before == _COMMA))), False)
        right |= (t == _COLON) & after_name
        right |= (t == _COMMA) & ended & (inside != 0)
        right |= (t == _CLOSE) & (ended | (before == _OPEN))
        right |= (t == _LIST_END) & (ended | (before == _LIST))
        self.begins = begins
        self._fail_tokens(np.flatnonzero(~right))
        scalars = np.flatnonzero(t == _SCALAR)
        if len(scalars):
            words = _gather(self.data, self.token[scalars], self.end[scalars])
            fine = pc.match_substring_regex(words, SCALAR).to_numpy(zero_copy_only=False)
            self._fail_tokens(scalars[~fine])

    # -- values ----------------------------------------------------------------
    def _values(self, names: tuple[str, ...]) -> None:
        self._plain()
        at = np.flatnonzero(self.begins & ~self.bad[self.doc])
        place = np.full(len(self.token) + 1, -1)
        place[at] = np.arange(len(at))
        self.at, self.kind, self.body = at, self.type[at], self.doc[at]
        self.parent = place[self.container[at]]
        member = (self.parent >= 0) & (self.type[self.container[at]] == _OPEN)
        self.named = np.where(member, at - 2, -1)
        self.key = np.full(len(at), -1, np.int32)
        own = np.flatnonzero(member)
        if len(own):
            codes = pc.index_in(self.names_of(own), value_set=pa.array(names, pa.large_string()))
            self.key[own] = pc.fill_null(codes, -1).to_numpy()
        self.codes = {n: k for k, n in enumerate(names)}
        self.root = np.full(len(self.bad), -1)
        top = np.flatnonzero(self.parent < 0)
        self.root[self.body[top]] = top
        item = np.flatnonzero((self.parent >= 0) & ~member)
        item = item[np.argsort(self.parent[item], kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.parent[item], minlength=len(at)))])
        #: the elements of every array, by value; empty for others
        self.lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(item, pa.int64()))
        self._members: dict[str, np.ndarray] = {}

    def _plain(self) -> None:
        """The buffer with its escapes resolved, and where each byte went."""
        data, e = self.data, self.escapes
        e = e[~self.bad[self.doc_of(e)]] if len(e) else e
        if not len(e):
            self.plain, self.moved = data, None
            return
        out, keep = data.copy(), np.ones(len(data), bool)
        c = data[e]
        plain = e[c != 117]
        out[plain] = _ESCAPED[data[plain]]
        keep[plain - 1] = False
        u = e[c == 117]
        code = (_HEX[data[u[:, None] + np.arange(1, 5)]].astype(np.int64) << np.array([12, 8, 4, 0])).sum(1) if len(u) else u
        high, low = (code >= 0xD800) & (code < 0xDC00), (code >= 0xDC00) & (code < 0xE000)
        pair = high & np.append(low[1:] & (np.diff(u) == 6), False)
        second = _shifted(pair, False)
        code = np.where(pair, 0x10000 + ((code & 0x3FF) << 10) + (np.append(code[1:], 0) & 0x3FF), np.where(high | (low & ~second), 0xFFFD, code))
        keep[(u[:, None] + np.arange(-1, 5)).ravel()] = False
        u, code = u[~second], code[~second]
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        for n in (1, 2, 3, 4):
            own, x = u[size == n] - 1, code[size == n]
            for k in range(n):
                part = (x >> (6 * (n - 1 - k))) & (0x3F if k else 0x7F)
                lead = 0x80 if k else (0, 0xC0, 0xE0, 0xF0)[n - 1]
                out[own + k] = part | lead
                keep[own + k] = True
        self.plain, self.moved = out[keep], np.concatenate([[0], np.cumsum(keep)])

    def _strings(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.token[tokens] + 1, self.end[tokens]
        return (a, b) if self.moved is None else (self.moved[a], self.moved[b])

    def names_of(self, values: np.ndarray) -> pa.Array:
        """Member names of values that have one."""
        return _gather(self.plain, *self._strings(self.named[values]))

    def member(self, name: str, of: np.ndarray) -> np.ndarray:
        """The named member of each value; -1 where there is none."""
        found = self._members.get(name)
        if found is None:
            found = self._members[name] = np.full(len(self.at) + 1, -1)
            own = np.flatnonzero(self.key == self.codes[name])
            found[self.parent[own]] = own  # of equal names the last stays
        return found[of]

    def of_kind(self, values: np.ndarray, kind: str) -> np.ndarray:
        """Which values are there and of the kind, '{' or '['."""
        there = values >= 0
        there[there] = self.kind[values[there]] == ord(kind)
        return there

    def elements(self, arrays: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(place in ``arrays``, element) of all elements of the arrays."""
        lists = self.lists.take(pa.array(np.maximum(arrays, 0), mask=arrays < 0))
        return pc.list_parent_indices(lists), pc.list_flatten(lists).to_numpy()

    def sizes(self, arrays: np.ndarray) -> pa.Array:
        lists = self.lists.take(pa.array(np.maximum(arrays, 0), mask=arrays < 0))
        return pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())

    def members(self, objects: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(place in ``objects``, value, name) of all members, last of equal
        names only; ``objects`` are distinct."""
        place = np.full(len(self.at) + 1, -1)
        place[objects[objects >= 0]] = np.flatnonzero(objects >= 0)
        at = place[self.parent]
        own = np.flatnonzero((at >= 0) & (self.named >= 0))
        t = pa.table([pa.array(at[own]), self.names_of(own), pa.array(own)], names=["at", "name", "value"]).group_by(["at", "name"]).aggregate([("value", "max")]).sort_by("value_max")
        return t.column("at").to_numpy(), t.column("value_max").to_numpy(), t.column("name").combine_chunks()

    def text(self, values: np.ndarray) -> pa.Array:
        """Strings without quotes and escapes, other values as written; null
        for the value null and for -1."""
        if not len(self.at):
            return pa.nulls(len(values), pa.string())
        v = self.at[np.maximum(values, 0)]
        strings = self.type[v] == _STRING
        a, b = self.token[v].copy(), self.end[v].copy()
        nested = self.match[v] >= 0
        b[nested] = self.token[self.match[v[nested]]] + 1
        null = (values < 0) | ((self.type[v] == _SCALAR) & (self.data[np.minimum(a, len(self.data) - 1)] == 110))
        b[null], strings[null] = a[null], False
        x, y = self._strings(v[strings])
        shift = 0 if self.plain is self.data else len(self.data)
        a[strings], b[strings] = x + shift, y + shift
        source = self.data if self.plain is self.data else np.concatenate([self.data, self.plain])
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), _gather(source, a, b).cast(pa.string()))


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as one string array."""
    n = ends - starts
    to = np.concatenate([[0], np.cumsum(n)])
    held = data[np.repeat(starts - to[:-1], n) + np.arange(to[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(held)])
