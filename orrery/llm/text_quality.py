"""Problem 8: per-document text quality statistics.

Every text file gets a vector of statistics.  For each language the location
and scatter of *prose* are estimated robustly from the corpus: medians and
median deviations of all documents first, then concentration steps (sums and
cross products of the documents near to the current estimate, all documents
considered in every step).  Each document gets its Mahalanobis distance with the
contribution of every statistic.  Documents that are not among the nearest are
candidates, and only they are read again for the exact check: what the larger
share of their characters is, prose, list, table or junk.

Statistics take one Arrow pass over the texts, the check another; the estimate
is made by JVM aggregates over the statistics alone, one to (languages x
statistics^2) numbers per step, whatever the corpus.  No text is shuffled.

Defined results: null, empty and blank texts give no row; a text without
words has mean word length 0 and no common words; ties of two forms go to the
earlier of list, table, junk; a language with too few documents borrows the
estimate of all; texts are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread

EXTENSIONS = r"(?i)\.(md|txt|rst|adoc)$"
#: The statistics, in the order of the vectors.
STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share",
    "distinct_ratio", "words_per_line", "marked_lines", "cells_per_line", "long_tokens", "letter_entropy",
)
#: Least standard deviations: differences below these mean nothing.
FLOOR = (1.5, 0.6, 0.03, 0.02, 0.5, 0.08, 0.2, 8.0, 0.1, 0.3, 0.02, 0.3)
#: A language needs this many documents for an estimate of its own.
LEAST_DOCUMENTS = 50
#: Squared distances: the 0.95 and 0.10 quantiles of chi-square for the 12
#: statistics.  Documents within the first make the next estimate; documents
#: beyond the second are candidates, so prose has to be as near as the nearest
#: tenth of prose to pass unread.
BEYOND = 21.03
CANDIDATE = 6.30
STEPS = 5
#: The word list comes to the driver; a longer one is refused.
MAX_COMMON_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BULLET = re.compile(r"\s*(?:[-*+•–‣◦·▪●○■□✓✔➢→]|\(?\d{1,4}(?:\.\d{1,3})*[.):]|\(?[A-Za-z][.)]|\(?[ivxlIVXL]{1,6}[.)]|\[[ xX]?\]|\d{1,3}\s*[-–])\s+\S")
BORDER = re.compile(r"\s*[+|:=\-┌├└╔╠╚│┼─ ]*(?:-{3,}|={3,}|─{3,}|═{3,})[-+|:=┬┼┴─═╬╦╩┐┤┘ ]*\s*")
KEY_VALUE = re.compile(r"\s*[\w./ \-]{1,32}(?::|=|->|::| - )\s?\S")
GAPS = re.compile(r"\S(?:\t+| {2,})(?=\S|$)")
SENTENCE_END = re.compile(r"[.!?…。！？:;,\"”’)»]\s*$")
FULL_STOP = re.compile(r"[.!?…。！？](?:[\"”’)»*_`]*)\s*$")
HEX = re.compile(r"\s*[0-9a-fA-F]{6,}[:\s]+(?:[0-9a-fA-F]{2,8}\s*){4,}")
RUN = re.compile(r"\S{25,}")
STRAY = re.compile(r"[^\W\d_][.,;!?¿¡][^\W\d_]|\s[.,;!?][^\W\d_]")
#: What a line of prose may begin with, besides a letter.
OPENING = "\"'“‘„«»¿¡("
SEPARATORS = (" · ", "; ", ", ", " | ", " / ", " • ", " – ", " - ", " > ", " → ", " * ")
SENTENCE = re.compile(r"(?:(?<=[.!?]\s)|(?<![\s\S]))\s*[A-ZÄÖÜÁÉÍÓÚÑ¿¡][^.!?\n]*(?:\n[^.!?\n]+)*[.!?](?=\s|$)")
QUOTE = re.compile(r"\s*(?:>\s?)+")


def common_words(rows: list[tuple[str, str]]) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for lang, word in rows:
        if lang and word:
            out.setdefault(lang, set()).add(word.lower())
    return {k: frozenset(v) for k, v in out.items()}


def table_lines(lines: list[str]) -> list[bool]:
    """Which lines of a block are rows of cells."""
    n = len(lines)
    out = [False] * n
    noise = [scribble(x) for x in lines]
    for k, x in enumerate(lines):
        if BORDER.fullmatch(x) and len(x.strip()) >= 3 or x.count("|") - x.count("<|") - x.count("|>") >= 2 and not noise[k]:
            out[k] = True
    for mark in ("\t", ";", ",", "gap"):
        k = 0
        while k < n:
            if out[k] or noise[k]:
                k += 1
                continue
            c = fields(lines[k], mark)
            if c < 2:
                k += 1
                continue
            j, least, most = k, c, c
            while j < n and not out[j] and not noise[j]:
                c = fields(lines[j], mark)
                if c < 2 or mark in ";," and c != least:
                    break
                least, most = min(least, c), max(most, c)
                j += 1
            cells = [x for line in lines[k:j] for x in split(line, mark)]
            words = sum(len(x.split()) for x in cells)
            if j - k >= 2 and words <= 2.2 * len(cells) and not (mark == "," and least < 3 and j - k < 4):
                for i in range(k, j):
                    out[i] = True
            k = max(j, k + 1)
    return out


def fields(line: str, mark: str) -> int:
    if mark == "gap":
        return len(GAPS.findall(line.strip())) + 1 if "  " in line.strip() else 1
    return line.count(mark) + 1


def split(line: str, mark: str) -> list[str]:
    return re.split(r"\s{2,}", line.strip()) if mark == "gap" else line.split(mark)


def scribble(line: str) -> bool:
    """A line of many different symbols and hardly a letter."""
    x = "".join(line.split())
    symbols = [c for c in x if not c.isalnum()]
    return len(symbols) > 0.8 * len(x) and len(set(symbols)) >= 6


def mashed(lines: list[str]) -> bool:
    """Many different words, but hardly any letters of the alphabet."""
    x = " ".join(lines).lower()
    if len(set(WORD.findall(x))) < 10:
        return False
    letters = [c for c in x if c.isalpha()]
    return len(letters) >= 60 and len(set(letters)) <= 12 and len(letters) > 0.5 * (len(x) - x.count(" "))


def junk_line(line: str, common: frozenset[str]) -> bool:
    """Nothing to read in the line: symbols, encoded bytes, broken letters."""
    x = line.strip()
    n = len(x)
    if n < 4:
        return False
    if HEX.match(x):
        return True
    letters = sum(map(str.isalpha, x))
    digits = sum(map(str.isdigit, x))
    spaces = x.count(" ")
    symbols = n - letters - digits - spaces
    if symbols > 0.35 * n and not BORDER.fullmatch(line):
        return True
    long = sum(len(r) for r in RUN.findall(x) if "/" not in r[:1] and not r.startswith(("http", "www", "`")))
    return long > 0.6 * n and n >= 40 and not ("." in x and x.endswith("."))


def broken(words: list[str], lowered: list[str], text: str, common: frozenset[str]) -> bool:
    """A block of words that tells nothing: scrambled, random or repeated."""
    n = len(words)
    if n < 5:
        return False
    share = sum(w in common for w in lowered) / n
    distinct = len(set(lowered))
    if n >= 12 and (distinct <= 3 or distinct <= 15 and n >= 6 * distinct):
        return True  # the same few words over and over
    odd = sum(c in "�€™œž¼½¾¿¶¤¦§¨©¬®¯°±²³´µ·¸¹º×÷ÂÃâ" for c in text)
    if odd > 0.08 * len(text):
        return True
    if share < 0.36 and len(STRAY.findall(text)) >= max(2, 0.02 * n):
        return True  # punctuation inside the words
    return share < 0.16 and not sentences(text)


def sentences(text: str) -> bool:
    """Most of the text stands in sentences: a capital, some words, a stop."""
    found = [x for x in SENTENCE.findall(text) if 3 <= len(x.split()) <= 60]
    return sum(map(len, found)) >= 0.7 * len(text.strip())


def enumerated(text: str, share: float) -> bool:
    """Items set in a running line: short pieces between one separator."""
    for mark in SEPARATORS:
        k = text.count(mark)
        if k >= 3:
            pieces = [x for x in text.split(mark) if x.strip()]
            words = sum(len(x.split()) for x in pieces)
            if len(pieces) >= 4 and words <= 4.5 * len(pieces) and (share < 0.2 or words <= 2.5 * len(pieces) and share < 0.3) and not FULL_STOP.search(pieces[0]):
                return True
    return False


def forms(text: str, common: frozenset[str]) -> tuple[int, int, int, int]:
    """Characters of prose, lists, tables and junk, blank lines aside."""
    prose = listed = table = junk = 0
    blocks: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip():
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    loose: list[tuple[int, list[str]]] = []  # one-line blocks that look like items
    for lines in blocks:
        if not lines:
            continue
        if mashed(lines):
            junk += sum(len(x.strip()) for x in lines)
            continue
        if any(c in x for x in lines for c in "|\t;,") or any("  " in x.strip() or BORDER.fullmatch(x) for x in lines):
            rows = table_lines(lines)
        else:
            rows = [False] * len(lines)
        rest: list[str] = []
        item = False
        kinds: list[str] = []
        for x, row in zip(lines, rows, strict=True):
            n = len(x.strip())
            if row:
                table += n
                item = False
                kinds.append("t")
            elif junk_line(x, common):
                junk += n
                item = False
                kinds.append("j")
            elif BULLET.match(x):
                listed += n
                item = True
                kinds.append("l")
            elif item and (x[:1] in " \t" or len(lines) > 1 and not FULL_STOP.search(prev)):
                listed += n  # a wrapped item
                kinds.append("l")
            else:
                rest.append(x)
                item = False
                kinds.append("p")
            prev = x
        if not rest:
            continue
        n = sum(len(x.strip()) for x in rest)
        plain = [QUOTE.sub("", x) for x in rest]
        words = WORD.findall(" ".join(plain))
        lowered = [w.lower() for w in words]
        share = sum(w in common for w in lowered) / len(words) if words else 0.0
        per_line = len(words) / len(rest)
        stops = sum(bool(FULL_STOP.search(x)) for x in rest)
        keyed = sum(bool(KEY_VALUE.match(x)) for x in rest)
        if len(rest) >= 3 and keyed >= 0.7 * len(rest) and per_line <= 9 and share < 0.25:
            listed += n
        elif len(rest) >= 3 and per_line <= 6 and share < 0.2 and stops <= 0.2 * len(rest):
            listed += n
        elif len(rest) == 1 and listed and not FULL_STOP.search(rest[0]) and len(words) <= 6 and "l" in kinds:
            listed += n  # the title of a list
        elif len(rest) <= 2 and len(words) <= 6 and not stops:
            loose.append((n, rest))
        elif enumerated(" ".join(plain), share):
            listed += n
        elif broken(words, lowered, " ".join(plain), common):
            junk += n
        elif not words:
            junk += n
        else:
            prose += n
    # single short lines, set apart by blank lines: an enumeration if many,
    # headings if few
    n = sum(k for k, _ in loose)
    if len(loose) >= 4 and n > prose / 4:
        listed += n
    elif listed + table + junk > prose:
        big = max(listed, table, junk)
        if big == listed:
            listed += n
        elif big == table:
            table += n
        else:
            junk += n
    else:
        prose += n
    return prose, listed, table, junk


def describe(text: str, common: dict[str, frozenset[str]]) -> tuple[str, list[float]]:
    """(language by its common words, statistics)."""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    best, hits = "", -1
    for lang in sorted(common):
        h = sum(map(counts.__getitem__, common[lang]))
        if h > hits:
            best, hits = lang, h
    lines = [y for x in text.splitlines() if (y := x.strip())]
    m, n = max(1, len(lines)), len(words)
    joined = "".join(words)
    digits = sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))
    solid = max(1, len("".join(text.split())))
    letters = Counter(joined).values()
    total = sum(letters)
    return best, [
        math.log1p(n),
        len(joined) / n if n else 0.0,
        max(0, solid - len(joined) - digits) / solid,
        digits / solid,
        sum(bool(SENTENCE_END.search(x)) for x in lines) / m,
        max(0, hits) / n if n else 0.0,
        min(1.0, len(counts) / (n**0.75)) if n else 0.0,
        min(40.0, n / m),
        sum(not (x[0].isalpha() or x[0] in OPENING) for x in lines) / m,
        min(20.0, (text.count("|") + text.count(";") + (len(GAPS.findall(text)) if "\t" in text or "  " in text else 0)) / m),
        sum(map(len, RUN.findall(text))) / solid,
        -sum(c / total * math.log2(c / total) for c in letters),
    ]


# -- distributed part ----------------------------------------------------------
S = [f"s{k}" for k in range(len(STATISTICS))]
DESCRIBED = "doc_id bigint, language string, " + ", ".join(f"{c} double" for c in S)
#: language -> (mean, inverse scatter)
Model = dict[str, tuple[np.ndarray, np.ndarray]]


def _texts(documents: DataFrame) -> DataFrame:
    texts = documents.select("doc_id", "lang", "text", "path").where(
        F.col("path").rlike(EXTENSIONS) & F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", "lang", "text")
    return spread(texts, "doc_id")


def _known(words: DataFrame):
    rows = words.select("lang", "word").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return words.sparkSession.sparkContext.broadcast(common_words([(r[0], r[1]) for r in rows]))


def _vectors(batch: pa.RecordBatch, common: dict[str, frozenset[str]]) -> tuple[list, list[str], np.ndarray, list[tuple[str, str]]]:
    """(ids, languages, statistics, texts with the language of their words) of
    the texts that are not blank.

    The language is the recorded one if the word list knows it, else the one
    whose common words occur most."""
    ids, languages, stats, texts = [], [], [], []
    for i, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if not text.strip():
            continue
        found, x = describe(text, common)
        ids.append(i)
        languages.append(lang if lang in common else found)
        stats.append(x)
        texts.append((text, found))
    return ids, languages, np.array(stats, float).reshape(-1, len(STATISTICS)), texts


def describe_documents(documents: DataFrame, words: DataFrame) -> DataFrame:
    """One row per text file that is not blank: language and statistics."""
    known = _known(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, languages, x, _ = _vectors(batch, known.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(languages, pa.string()), *(pa.array(c) for c in x.T)], names=["doc_id", "language", *S])

    return _texts(documents).mapInArrow(run, DESCRIBED)


def start(described: DataFrame) -> Model:
    """Medians and median deviations of each language, and of all ("")."""
    both = described.unionByName(described.withColumn("language", F.lit("")))
    rows = both.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5).alias(c) for c in S]).collect()
    if not rows:
        return {}
    middle = {r["language"]: np.array([r[c] for c in S]) for r in rows if r["n"] >= LEAST_DOCUMENTS or not r["language"]}
    middle = {r["language"]: middle.get(r["language"], middle[""]) for r in rows}
    table = _table(described, {n: (m, np.zeros((0, 0))) for n, m in middle.items()})
    rows = both.join(table, "language").groupBy("language").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{k}")), 0.5).alias(c) for k, c in enumerate(S)]).collect()
    # 1.4826: a normal distribution's deviation by its median deviation
    return {r["language"]: (middle[r["language"]], np.diag(1 / np.square(np.maximum(FLOOR, 1.4826 * np.array([r[c] for c in S]))))) for r in rows}


def _table(described: DataFrame, model: Model) -> DataFrame:
    """The model as a table: one row for each language of the word list."""
    k = len(STATISTICS)
    rows = [(n, *map(float, mean), *map(float, inverse.ravel())) for n, (mean, inverse) in model.items()]
    names = [f"m{i}" for i in range(k)] + [f"p{i}_{j}" for i in range(k) for j in range(k)][: len(rows[0]) - 1 - k]
    return F.broadcast(described.sparkSession.createDataFrame(rows, "language string, " + ", ".join(f"{n} double" for n in names)))


def moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Per language: documents, sums and cross products of the statistics."""
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.groupBy("language").agg(F.count("*"), *[F.expr(f"sum({c})") for c in S], *[F.expr(f"sum(s{i} * s{j})") for i, j in pairs]).collect()
    out = {}
    for r in found:
        products = np.zeros((k, k))
        for (i, j), x in zip(pairs, r[2 + k :], strict=True):
            products[i, j] = products[j, i] = x
        out[r[0]] = float(r[1]), np.array(r[2 : 2 + k], float), products
    return out


def estimate(m: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """Mean and inverse scatter per language; "" is the estimate of all."""
    k = len(STATISTICS)
    floor = np.square(np.array(FLOOR))
    total = (sum(x[0] for x in m.values()), sum((x[1] for x in m.values()), np.zeros(k)), sum((x[2] for x in m.values()), np.zeros((k, k))))
    out = {}
    for name, (n, s, c) in {**m, "": total}.items():
        if n < LEAST_DOCUMENTS and name:
            continue
        n = max(n, 1.0)
        mean = s / n
        cov = c / n - np.outer(mean, mean)
        cov[np.diag_indices(k)] += np.maximum(0.0, floor - np.diag(cov))
        # scatter shrunk a little towards its diagonal keeps it invertible
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
        out[name] = mean, np.linalg.inv(cov)
    return out


def measure(described: DataFrame, model: Model) -> DataFrame:
    """Squared distance ``distance`` and every statistic's contribution
    ``c0``... to it."""
    k = len(STATISTICS)
    if not model:
        return described.select("*", *[F.lit(0.0).alias(f"c{i}") for i in range(k)], F.lit(0.0).alias("distance")).limit(0)
    held = described.join(_table(described, model), "language")
    # as text: one call to the JVM for a column, not one for each of its parts
    held = held.selectExpr(*described.columns, *[f"s{i} - m{i} AS d{i}" for i in range(k)], *[f"p{i}_{j}" for i in range(k) for j in range(k)])
    out = held.selectExpr(*described.columns, *[f"d{i} * ({' + '.join(f'p{i}_{j} * d{j}' for j in range(k))}) AS c{i}" for i in range(k)])
    return out.selectExpr("*", " + ".join(f"c{i}" for i in range(k)) + " AS distance")


def fit(described: DataFrame) -> Model:
    """Robust mean and inverse scatter of prose by language: from medians and
    median deviations, then from all documents near to the estimate."""
    model = start(described)
    for _ in range(STEPS if model else 0):
        new = estimate(moments(measure(described, model).where(F.col("distance") <= BEYOND)))
        model = {n: new.get(n, new[""]) for n in model}
    return model


def measure_documents(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Statistics, robust distance and contributions of every text file."""
    described = checkpointed(describe_documents(documents, words))
    return measure(described, fit(described))


CHECKED = "doc_id bigint, distance double, prose bigint, listed bigint, tabled bigint, junk bigint"


def check_candidates(documents: DataFrame, words: DataFrame, model: Model, beyond: float = CANDIDATE) -> DataFrame:
    """Characters by form of the documents beyond the distance, and of no
    others.  Statistics are computed once more where the texts are, so neither
    ids nor texts are moved."""
    known = _known(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, languages, x, texts = _vectors(batch, known.value)
            distance = np.zeros(len(ids))
            names = np.array(languages, dtype=object)
            for n in set(languages):
                mean, inverse = model[n]
                d = x[names == n] - mean
                distance[names == n] = (d * (d @ inverse)).sum(1)
            at = np.flatnonzero(distance > beyond).tolist()
            shares = [forms(text, known.value.get(found, frozenset())) for text, found in map(texts.__getitem__, at)]
            columns = list(zip(*shares, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in at], pa.int64()), pa.array(distance[at]), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "distance", "prose", "listed", "tabled", "junk"])

    return _texts(documents).mapInArrow(run, CHECKED)


def not_prose(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, form) of the documents that are no natural prose: candidates
    by distance, then the larger share of their characters."""
    model = fit(checkpointed(describe_documents(documents, words)))
    best = F.greatest("listed", "tabled", "junk")
    form = F.when(F.col("listed") == best, "list").when(F.col("tabled") == best, "table").otherwise("junk")
    return check_candidates(documents, words, model).where(best > F.col("prose")).select("doc_id", form.alias("form")).distinct()


def statistics(measured: DataFrame) -> DataFrame:
    """One row per document: the statistics by name, the distance and the
    statistic that contributes most to it."""
    k = len(STATISTICS)
    top = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(STATISTICS[i]).alias("n")) for i in range(k)]))
    return measured.select(
        "doc_id", "language",
        F.round(F.expm1(F.col("s0"))).cast("bigint").alias("n_words"),
        *[F.round(F.col(S[i]), 6).alias(STATISTICS[i]) for i in range(1, k)],
        F.round("distance", 4).alias("distance"), F.array(*[F.round(F.col(f"c{i}"), 4) for i in range(k)]).alias("contributions"),
        top["n"].alias("largest_contribution"))
