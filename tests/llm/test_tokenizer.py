import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import tokenizer as K

if not os.path.exists(f"{K.TOKENIZERS}/{K.VOCABULARY}"):
    pytest.skip("no tokenizer files", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(f"{K.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    offsets, ids = K.vocabulary().encode(texts)
    return [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))]


def test_fuzz(encoding):
    r = random.Random(3)
    parts = ["a", "b", "e", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "🚦", "\x1c", "\x85", "\xa0", "\u3000", "1", "²", "Ⅷ", "\u0301", "'s", "'", "<|endoftext|>", "_", "-", "=", "\u200b", "\x00", "٣", "q", "zx"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(4000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(30))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "=-" * 3000, "x" * 100_000]
    assert encode(texts) == [encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        t = _tokenizer
    except NameError:
        t = _tokenizer = Tokenizer.from_file(f"{K.TOKENIZERS}/{K.VOCABULARY}")
        t.encode_special_tokens = True
    assert encode([text]) == [t.encode(text, add_special_tokens=False).ids]


def test_boundary_test_equals_exact_merging():
    """A pair is separate exactly when merging its bytes gives the pair back."""
    v = K.vocabulary()
    r = random.Random(5)
    tokens = list(v.tokens.items())
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(3000)]
    got = v.separate([a[1] for a, _ in pairs], [b[1] for _, b in pairs])
    for ((x, i), (y, j)), ok in zip(pairs, got.tolist(), strict=True):
        assert ok == (v.merged(x + y) == [i, j])


def test_memo_is_bounded(encoding, monkeypatch):
    monkeypatch.setattr(K, "MAX_WORDS", 10)
    texts = [f"word{k} other{k}" for k in range(50)]
    for t in texts:
        assert encode([t]) == [encoding.encode_ordinary(t)]


def test_memory_of_long_words_is_given_back(encoding, monkeypatch):
    v = K.vocabulary()
    v.reset()
    monkeypatch.setattr(K, "MAX_IDS", 50_000)
    for k in range(30):
        t = f"{k} short " + "xyz" * 20_000 + f"q{k}"
        assert encode([t]) == [encoding.encode_ordinary(t)]
        assert v.kept[1] < 1000 and len(v.flat) <= max(1 << 18, 4 * 50_000)
    for k in range(3000):
        encode([f"{'word' * 20}{k}"])
        assert v.kept[1] <= 50_000 + 100


def test_operator(spark):
    rows = [(1, "a b", 0), (2, None, 0), (3, "", 0), (4, "<|endoftext|>", 0), (1, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in K.encode_documents(df).collect())
    assert got[0] == got[1] and got[0][0] == 1 and got[2] == (2, []) and got[3] == (3, []) and len(got[4][1]) > 1
    counts = {r["doc_id"]: r["n_tokens"] for r in K.count_documents(df).collect()}
    assert counts == {k: len(v) for k, v in got}
    assert K.encode_documents(df.limit(0)).count() == 0
