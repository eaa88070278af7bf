"""Readers and writers around graph and text data."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CONTEXT, EDGE, NODE, Graph

#: Entries of an archive above this size are reported, not unpacked.
MAX_ENTRY_BYTES = 64 * 1024 * 1024

#: Languages by file suffix.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "py": "python", "pyi": "python", "js": "javascript", "cjs": "javascript", "mjs": "javascript", "ts": "typescript", "c": "c", "h": "c",
    "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "properties": "properties", "md": "markdown", "rst": "restructuredtext", "adoc": "asciidoc", "txt": "text", "proto": "protobuf",
}


def save_graph(graph: Graph, folder: str) -> None:
    """Canonical save: parquet, partitioned by context, ordered by identity, so
    that a context is a folder and identities are ranges of row groups."""
    graph.contexts.dropDuplicates(["identity"]).sort("identity").write.mode("overwrite").parquet(f"{folder}/kg_contexts.parquet")
    for name, df in (("kg_nodes", graph.nodes), ("kg_edges", graph.edges)):
        rows = df.dropDuplicates(["context", "identity"])
        # a range of (context, identity) per task: a hot context is many tasks
        rows.repartitionByRange("context", "identity").sortWithinPartitions("context", "identity").write.mode("overwrite").partitionBy("context").parquet(f"{folder}/{name}.parquet")


def save_graph_json(graph: Graph, folder: str) -> None:
    for name, df in (("contexts", graph.contexts), ("nodes", graph.nodes), ("edges", graph.edges)):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def load_graph_json(spark: SparkSession, folder: str) -> Graph:
    """JSON lines with explicit schemas; a malformed line fails the read."""
    def read(name, schema):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}")

    return Graph(read("contexts", CONTEXT), read("nodes", NODE), read("edges", EDGE))


def scan_table(spark: SparkSession, path: str, after: str | None = None, size: int | None = None) -> DataFrame:
    """Ordered NDJSON table (kind, key, scope, fields) with a keyset cursor."""
    rows = spark.read.schema("kind string, key string, scope string, fields map<string,string>").option("mode", "FAILFAST").json(path)
    if after is not None:
        rows = rows.where(F.col("key") > after)
    rows = rows.orderBy("key")
    return rows if size is None else rows.limit(size)


def write_table(rows: DataFrame, path: str) -> None:
    rows.select("kind", "key", "scope", "fields").write.mode("overwrite").json(path)


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])[suffix], F.lit("unclassified"))


def role_of(path: Column) -> Column:
    """Source role by its place: MAIN, TEST, GENERATED_MAIN, GENERATED_TEST, OTHER."""
    gen = path.rlike("(^|/)(gen|generated)(/|$)")
    test = path.rlike("(^|/)(test|tests)(/|$)")
    return F.when(gen & test, "GENERATED_TEST").when(gen, "GENERATED_MAIN").when(test, "TEST").when(path.rlike("(^|/)main(/|$)"), "MAIN").otherwise("OTHER")


def classify_files(files: DataFrame) -> DataFrame:
    return files.select("source", "path", language_of(F.col("path")).alias("language"), role_of(F.col("path")).alias("role"))


def decode_text(raw: Column) -> dict[str, Column]:
    """Charset by mark, decoded text and line ends of binary content."""
    mark = F.hex(F.substring(raw, 1, 3))
    charset = F.when(mark == "EFBBBF", "UTF-8").when(mark.startswith("FEFF"), "UTF-16BE").when(mark.startswith("FFFE"), "UTF-16LE").otherwise("UTF-8")
    text = F.when(charset == "UTF-8", F.decode(raw, "UTF-8")).when(charset == "UTF-16BE", F.decode(raw, "UTF-16BE")).otherwise(F.decode(raw, "UTF-16LE"))
    text = F.regexp_replace(text, "^\ufeff", "")
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return {"charset": charset, "text": text, "n_crlf": crlf, "n_lf": F.regexp_count(text, F.lit("\n")) - crlf, "n_cr": F.regexp_count(text, F.lit("\r")) - crlf}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, size, status, content) of ZIP snapshots.

    Each archive is read by one task; entries with unsafe names, directories
    and oversized entries are reported with a status instead of content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            n = info.filename
                            if n.endswith("/"):
                                continue
                            parts = n.split("/")
                            if n.startswith("/") or "\\" in n or ".." in parts or "." in parts or ":" in parts[0]:
                                out.append((name, n, info.file_size, "UNSAFE_NAME", None))
                            elif info.file_size > MAX_ENTRY_BYTES:
                                out.append((name, n, info.file_size, "TOO_LARGE", None))
                            else:
                                out.append((name, n, info.file_size, "READ", z.read(info)))
                except (zipfile.BadZipFile, RuntimeError, ValueError):
                    out.append((name, None, None, "BAD_ARCHIVE", None))
                for k in range(0, len(out), 256):
                    part = out[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["archive", "entry", "size", "status", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, entry string, size bigint, status string, content binary")


def openapi_operations(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, route, method, operation_id) of OpenAPI documents in JSON."""
    schema = "paths map<string, map<string, struct<operationId: string>>>"
    p = F.from_json(body, schema)["paths"]
    routes = documents.select(key, F.explode(p).alias("route", "methods"))
    verbs = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
    return routes.select(key, "route", F.explode("methods").alias("method", "operation")).where(F.lower("method").isin(*verbs)).select(key, "route", F.lower("method").alias("method"), F.col("operation.operationId").alias("operation_id"))


# -- exports ------------------------------------------------------------------------
def sarif(findings: DataFrame) -> DataFrame:
    """(finding_key, result): one SARIF result object per finding.

    A log of any size is the header, these lines joined by commas, and the
    footer of ``sarif_frame``; no task gathers them."""
    level = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARNING", "warning").otherwise("note")
    return findings.select("finding_key", F.to_json(F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", F.lit("forbidden edge"), F.col("source").cast("string"), F.lit("->"), F.col("target").cast("string")).alias("text")).alias("message"),
        F.struct(F.col("finding_key").alias("findingKey")).alias("partialFingerprints"))).alias("result"))


def sarif_frame(tool: str) -> tuple[str, str]:
    head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
    return json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": {"name": ' + json.dumps(tool) + '}}, "results": [', "]}]}"


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(context, part, line): GraphML elements, nodes before edges; frame lines
    come from ``graphml_frame``."""
    from ..functions.scalars import xml_escape as x

    n = nodes.select("context", F.lit(1).alias("part"), F.concat(F.lit('<node id="'), x(F.col("identity")), F.lit('"><data key="kind">'), x(F.col("kind")), F.lit("</data></node>")).alias("line"))
    e = edges.select("context", F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), x(F.col("source")), F.lit('" target="'), x(F.col("target")), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


def graphml_frame() -> tuple[str, str]:
    return '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="node" attr.name="kind" attr.type="string"/><graph edgedefault="directed">', "</graph></graphml>"


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(context, part, element): Cytoscape element objects."""
    n = nodes.select("context", F.lit("nodes").alias("part"), F.to_json(F.struct(F.struct(F.col("identity").alias("id"), F.col("kind").alias("kind")).alias("data"))).alias("element"))
    e = edges.select("context", F.lit("edges").alias("part"), F.to_json(F.struct(F.struct(F.concat_ws("->", "source", "target").alias("id"), F.col("source"), F.col("target")).alias("data"))).alias("element"))
    return n.unionByName(e)
