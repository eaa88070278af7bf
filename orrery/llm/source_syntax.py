"""Problem 1: source files that do not parse.

Each file is parsed, in the language its path names, by recursive-descent
statements with precedence-climbing expressions and panic-mode recovery
(``orrery.llm.syntax``).  All errors are stored in order, the first as the
cause.  Work is per file: one Arrow pass, no shuffle; only the rate reports
aggregate (with partial aggregation, so a hot repository is no hot task).

Defined results: null and empty texts are not judged (no row); a blank file
is well-formed source but no JSON and no XML document; very long texts are
parsed whole; repeated rows give repeated results (``p1_found`` is distinct by
``doc_id``, which is unique); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Extension -> language of the path.
LANGUAGES = {
    "java": "java", "py": "python", "pyi": "python", "js": "javascript", "cjs": "javascript",
    "c": "c", "h": "c", "json": "json", "xml": "xml",
}
SCHEMA = "doc_id bigint, source string, path string, language string, well_formed boolean, n_errors int, first_line int, first_cause string, errors array<struct<line:int,code:string>>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("path", pa.string()), ("language", pa.string()),
    ("well_formed", pa.bool_()), ("n_errors", pa.int32()), ("first_line", pa.int32()), ("first_cause", pa.string()),
    ("errors", pa.list_(pa.struct([("line", pa.int32()), ("code", pa.string())]))),
])

_parsers: dict = {}


def parser(language: str):
    """The process-wide parser of a language (its memo tables live on)."""
    if language not in _parsers:
        from .syntax.c import CParser
        from .syntax.data import JsonParser, XmlParser
        from .syntax.java import JavaParser
        from .syntax.javascript import JavaScriptParser
        from .syntax.python import PythonParser

        for p in (CParser, JsonParser, XmlParser, JavaParser, JavaScriptParser, PythonParser):
            _parsers[p.language] = p()
    return _parsers[language]


def diagnose(text: str, language: str) -> list[tuple[int, str]]:
    """All syntax errors of one text as (line, code); [] = well-formed."""
    return parser(language).check(text)


def _diagnose_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        languages = batch.column("language").to_pylist()
        found = [diagnose(t, g) for t, g in zip(texts, languages, strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("source"), batch.column("path"), batch.column("language"),
            pa.array([not e for e in found], pa.bool_()),
            pa.array([len(e) for e in found], pa.int32()),
            pa.array([e[0][0] if e else None for e in found], pa.int32()),
            pa.array([e[0][1] if e else None for e in found], pa.string()),
            pa.array([[{"line": n, "code": c} for n, c in e] for e in found], ARROW.field("errors").type),
        ], schema=ARROW)


def language_of(path):
    """Language column from a path column; null for other extensions."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[suffix]


def diagnose_sources(documents: DataFrame) -> DataFrame:
    """One row per source file with its verdict and all its errors."""
    files = (
        documents.select("doc_id", "source", "path", "text")
        .where(F.col("text").isNotNull() & (F.col("text") != ""))
        .withColumn("language", language_of(F.col("path")))
        .where(F.col("language").isNotNull())
    )
    return spread(files, "doc_id").mapInArrow(_diagnose_batches, SCHEMA)


def malformed(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each file that is not well-formed."""
    return diagnose_sources(documents).where(~F.col("well_formed")).select("doc_id").distinct()


def rates(diagnosed: DataFrame) -> DataFrame:
    """Files, malformed files, their rate and acceptance by repository and
    language; null repositories form their own group."""
    return diagnosed.groupBy("source", "language").agg(
        F.count("*").alias("n_files"),
        F.count_if(~F.col("well_formed")).alias("n_malformed"),
    ).withColumn("malformed_rate", F.round(F.col("n_malformed") / F.col("n_files"), 6))


def causes(diagnosed: DataFrame) -> DataFrame:
    """How often each first cause occurs in each language."""
    return diagnosed.where(~F.col("well_formed")).groupBy("language", "first_cause").agg(
        F.count("*").alias("n_files"), F.sum("n_errors").alias("n_errors"))


def against_outcomes(diagnosed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Recorded outcome of each file next to the verdict of its text.

    Of several observations of a file the latest counts (ties: the greatest
    status); a file without an observation has nulls.  ``reported`` tells
    whether the outcome row names any problem or error."""
    last = outcomes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.struct(
            "observed_at", "status", "state",
            F.coalesce(F.size("problems"), F.lit(0)).alias("n_problems"),
            F.coalesce(F.size("diagnostics"), F.lit(0)).alias("n_diagnostics"),
        )).alias("o"))
    return diagnosed.select("doc_id", "source", "language", "well_formed", "first_cause").join(last, "doc_id", "left").select(
        "doc_id", "source", "language", "well_formed", "first_cause",
        F.col("o.status").alias("status"), F.col("o.state").alias("state"),
        ((F.col("o.n_problems") > 0) | (F.col("o.n_diagnostics") > 0) | (F.col("o.status") != "DECODED")).alias("reported"))
