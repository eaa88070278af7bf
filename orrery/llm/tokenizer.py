"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Speculate and verify.  Texts are cut into words by the vocabulary's own
pattern.  For every word not seen before, greedy longest match proposes
tokens; a word's proposal is the exact encoding if and only if no merge ever
fires across any boundary of adjacent tokens.  That test needs only the two
tokens of each boundary and is done for all boundaries of a batch at once in
numpy.  Words that fail are merged exactly (priority queue over a linked
list, O(n log n) also for words of any length).  Words are kept in a bounded
per-process memo, so that the cost of a common word is one lookup.

Defined results: null, empty -> the empty list; special-token look-alikes are
ordinary text; texts are encoded whole.  One Arrow pass, no shuffle.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..session import spread

#: Folder of the public tokenizer files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

#: The public word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII characters only.
ASCII_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")

MAX_WORDS = 400_000
MAX_KEPT = 96
MAX_IDS = 8_000_000
NEVER = np.int64(1 << 60)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable
    bytes stand for themselves, the others take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge tree and the vectorised boundary test."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import regex

        with open(os.path.join(folder, name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, alphabet = model["vocab"], byte_alphabet()
        n = max(ids.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = ids[c]
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        #: formation time of a token: bytes exist from the start
        self.order = np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = ids[a], ids[b], ids[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = z
            if self.order[z] < 0:
                self.left[z], self.right[z], self.order[z] = x, y, rank
        self.rank = {p: int(self.order[z]) for p, z in self.merge.items()}
        pairs = np.array([x * n + y for x, y in self.merge], np.int64)
        self.size, by = n, np.argsort(pairs)
        self.pair_keys = pairs[by]
        self.pair_ranks = np.array(list(self.rank.values()), np.int64)[by]
        # a token is usable if its own bytes merge to it
        made = np.flatnonzero(self.left >= 0)
        whole = self.separate(self.left[made], self.right[made], self.order[made], self.order[made])
        bad = set(made[~whole].tolist())
        self.tokens = {bytes(alphabet[c] for c in t): i for t, i in ids.items() if i not in bad}
        self.longest: dict[bytes, int] = {}
        for t in self.tokens:
            k = t[:2]
            self.longest[k] = max(self.longest.get(k, 1), len(t))
        self.findall = regex.compile(PATTERN).findall
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.words.clear()
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.count = self.used = 0
        #: entries and ids that stay; behind them lie the long words of one call
        self.kept = (0, 0)

    # -- the boundary test ---------------------------------------------------
    def separate(self, a, b, until_a=None, until_b=None) -> np.ndarray:
        """For arrays of adjacent tokens: does no merge fire across?

        Time runs backwards: of the two pieces at the boundary the one formed
        later is taken apart, until both are bytes.  In each state the merge
        of the two pieces would have fired if it comes before the left piece
        vanished into its parent and not after the right one did (of equal
        ranks the leftmost merge fires first)."""
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        px = np.full(len(x), NEVER) if until_a is None else np.array(until_a, np.int64)
        py = np.full(len(x), NEVER) if until_b is None else np.array(until_b, np.int64) - 1
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        order, left, right, keys, ranks = self.order, self.left, self.right, self.pair_keys, self.pair_ranks
        while len(live):
            u, v = x[live], y[live]
            k = u * self.size + v
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            rank = np.where(keys[at] == k, ranks[at], NEVER)
            fires = (rank < px[live]) & (rank <= py[live]) & (rank < NEVER)
            ok[live[fires]] = False
            ou, ov = order[u], order[v]
            go = ~fires & ((ou >= 0) | (ov >= 0))
            back_x = go & (ou > ov)
            back_y = go & ~(ou > ov)
            i = live[back_x]
            px[i] = ou[back_x]
            x[i] = right[u[back_x]]
            i = live[back_y]
            py[i] = ov[back_y]
            y[i] = left[v[back_y]]
            live = live[go]
        return ok

    # -- words -----------------------------------------------------------------
    def propose(self, w: bytes) -> list[int]:
        """Greedy longest match."""
        tokens, longest = self.tokens, self.longest
        t = tokens.get(w)
        if t is not None:
            return [t]
        out, i, n = [], 0, len(w)
        while i < n:
            j = min(n, i + longest.get(w[i : i + 2], 1))
            while True:
                t = tokens.get(w[i:j])
                if t is not None:
                    break
                j -= 1
            out.append(t)
            i = j
        return out

    def merged(self, w: bytes) -> list[int]:
        """Exact byte-pair merging in rank order, leftmost first."""
        rank, merge = self.rank, self.merge
        ids = [int(self.byte_id[b]) for b in w]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = merge[a, b]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def learn(self, new: list[str]) -> None:
        """Encode words that are not in the memo."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        proposals = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # no boundary behind a word's last token
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = at[~self.separate(pairs // self.size, pairs % self.size)[back]]
        if len(bad):
            for k in np.unique(np.searchsorted(ends, bad, side="right")).tolist():
                proposals[k] = self.merged(raw[k])
            lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
            flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
            ends = np.cumsum(lengths)
        m, f = len(new), len(flat)
        while self.count + m > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + f > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[self.count : self.count + m] = self.used + ends - lengths
        self.lengths[self.count : self.count + m] = lengths
        self.flat[self.used : self.used + f] = flat
        self.words.update(zip(new, range(self.count, self.count + m), strict=True))
        self.count += m
        self.used += f

    def cut(self, text: str) -> list[str]:
        return ASCII_PATTERN.findall(text) if text.isascii() else self.findall(text)

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Memo entries of all words, and the number of words of each text."""
        self.count, self.used = self.kept
        if self.count > MAX_WORDS or self.used > MAX_IDS:
            self.reset()
        if len(self.flat) > 2 * MAX_IDS:
            self.flat = self.flat[: 2 * MAX_IDS].copy()
        words = [self.cut(t) if t else [] for t in texts]
        known = self.words
        new = list({w for ws in words for w in set(ws) if w not in known})
        short = [w for w in new if len(w) <= MAX_KEPT]
        if short:
            self.learn(short)
        self.kept = self.count, self.used
        if len(short) < len(new):
            self.learn([w for w in new if len(w) > MAX_KEPT])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = int(counts.sum())
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, total)
        for w in new:
            if len(w) > MAX_KEPT:
                del known[w]
        return codes, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts' encodings, ragged."""
        codes, counts = self.codes(texts)
        lengths = self.lengths[codes]
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[codes] - (ends - lengths), lengths)
        ids = self.flat[shift + np.arange(total)]
        word_ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], ends])[word_ends]
        return offsets, ids

    def count_tokens(self, texts: list[str | None]) -> np.ndarray:
        codes, counts = self.codes(texts)
        sums = np.concatenate([[0], np.cumsum(self.lengths[codes])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return sums[ends[1:]] - sums[ends[:-1]]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Vocabulary:
    """The process-wide vocabulary; its memo lives as long as the worker."""
    if (folder, name) not in _loaded:
        _loaded[folder, name] = Vocabulary(folder, name)
    return _loaded[folder, name]


#: Texts are handed to numpy in slices of about this many characters.
SLICE_CHARACTERS = 4_000_000


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts grow long, so that memory stays bounded."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE_CHARACTERS:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): token ids of every document, no special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for whole in batches:
            for batch in slices(whole):
                offsets, ids = v.encode(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the same encoding, lengths only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for whole in batches:
            for batch in slices(whole):
                n = v.count_tokens(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, n_tokens bigint")
