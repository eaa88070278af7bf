"""Light extraction of facts from source and build files, inside the JVM."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is looked for in Java files, at the start of a line.
JAVA = {
    "import": r"(?m)^import\s+(?:static\s+)?([A-Za-z_$][\w$.]*)",
    "type": r"(?m)^(?:(?:public|protected|private|abstract|final|sealed|static|strictfp) +)*(?:class|interface|enum|record) +([A-Za-z_$][\w$]*)",
    "package": r"(?m)^package\s+([A-Za-z_$][\w$.]*)",
}


def declarations(documents: DataFrame) -> DataFrame:
    """(doc_id, what, name): distinct packages, imports and top-level types."""
    files = documents.where(F.col("path").rlike(r"(?i)\.java$") & F.col("text").isNotNull()).select("doc_id", "text")
    found = F.array(*[F.struct(F.lit(w).alias("what"), F.regexp_extract_all("text", F.lit(p), 1).alias("names")) for w, p in JAVA.items()])
    return files.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.what", F.explode("f.names").alias("name")).distinct()


def python_imports(documents: DataFrame) -> DataFrame:
    files = documents.where(F.col("path").rlike(r"(?i)\.pyi?$") & F.col("text").isNotNull())
    return files.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:from|import) +([A-Za-z_.][\w.]*)"), 1)).alias("module"))


#: Comments and literals of the brace languages, and of Python; they are taken
#: out before anything is looked for.
BRACE_NOISE = r'/\*[\s\S]*?\*/|//[^\n]*|"""[\s\S]*?"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*\''
PYTHON_NOISE = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*\'|#[^\n]*'
#: language -> (extension, noise, what -> pattern with one group), at any depth.
OUTLINE = {
    "java": (r"(?i)\.java$", BRACE_NOISE, {
        "import": r"\bimport\s+(?:static\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$*][\w$]*)*)\s*;", "type": r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)",
        "call": r"\.([a-z_$][\w$]*)\s*\(", "annotation": r"@([A-Z][\w$.]*)"}),
    "python": (r"(?i)\.pyi?$", PYTHON_NOISE, {
        "import": r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_.][\w.]*)", "type": r"(?m)^[ \t]*class[ \t]+([A-Za-z_]\w*)", "function": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", "call": r"\.([A-Za-z_]\w*)[ \t]*\("}),
    "javascript": (r"(?i)\.c?js$", r'/\*[\s\S]*?\*/|(?m)(?:^|[ \t;])//[^\n]*', {
        "import": r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)", "type": r"\bclass\s+([A-Za-z_$][\w$]*)", "function": r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)", "export": r"\bexports\.([A-Za-z_$][\w$]*)\s*="}),
    "c": (r"(?i)\.[ch]$", r"/\*[\s\S]*?\*/|//[^\n]*", {
        "import": r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", "type": r"\b(?:struct|union|enum)\s+([A-Za-z_]\w*)\s*\{", "macro": r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)"}),
}


def outline(documents: DataFrame) -> DataFrame:
    """(doc_id, language, what, name, n): imports, declarations, calls of members
    and the like, at any depth, with how often each occurs; comments and literals
    do not count.

    Null and empty texts give nothing; whole texts are searched, inside the JVM."""
    out = None
    for language, (suffix, noise, patterns) in OUTLINE.items():
        rows = documents.where(F.col("path").rlike(suffix) & F.col("text").isNotNull()).select("doc_id", F.regexp_replace("text", noise, " ").alias("bare"))
        found = F.array(*[F.struct(F.lit(w).alias("what"), F.regexp_extract_all("bare", F.lit(p), 1).alias("names")) for w, p in patterns.items()])
        part = rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", F.lit(language).alias("language"), "f.what", F.explode("f.names").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "language", "what", "name").agg(F.count("*").alias("n"))


POM = "groupId string, artifactId string, version string, dependencies struct<dependency: array<struct<groupId:string,artifactId:string,version:string,scope:string>>>"


def maven_dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, artifact, dependency, version, scope) of Maven build files; a file
    that is no such document gives nothing."""
    pom = files.where(F.col(text).isNotNull()).select(key, F.from_xml(F.col(text), POM, {"mode": "PERMISSIVE"}).alias("p"))
    rows = pom.select(key, F.col("p.artifactId").alias("artifact"), F.explode("p.dependencies.dependency").alias("x"))
    return rows.select(key, "artifact", F.concat_ws(":", "x.groupId", "x.artifactId").alias("dependency"), F.col("x.version").alias("version"), F.coalesce("x.scope", F.lit("compile")).alias("scope"))


def version_catalog(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alias, module, version) of version catalogs in TOML; references to
    the versions table are resolved, malformed catalogs give nothing."""
    kind = dict(files.dtypes)[key]

    def rows(body: str | None) -> list[tuple]:
        try:
            t = tomllib.loads(body or "")
        except tomllib.TOMLDecodeError:
            return []
        versions, out = t.get("versions", {}), []
        for alias, lib in t.get("libraries", {}).items():
            if isinstance(lib, str):
                g, a, v = ([*lib.split(":"), None, None])[:3]
            else:
                g, _, a = lib.get("module", "").partition(":") if "module" in lib else (lib.get("group"), ":", lib.get("name"))
                v = lib.get("version")
                if isinstance(v, dict):
                    v = versions.get(v.get("ref"))
            out.append((alias, f"{g}:{a}", v if isinstance(v, str) else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *r) for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True) for r in rows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(key).type), *[pa.array([r[i] for r in out], pa.string()) for i in (1, 2, 3)]], names=[key, "alias", "module", "version"])

    return files.select(key, text).mapInArrow(run, f"{key} {kind}, alias string, module string, version string")
