"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def physical_lines(text: Column) -> Column:
    """CRLF, CR and LF end one line each; an unterminated last line counts."""
    ends = F.regexp_count(text, F.lit("\r\n|\r|\n"))
    return ends + F.when((text != "") & ~text.rlike("[\r\n]\\z"), 1).otherwise(0)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def derived_identity(kind: str, *parts: Column) -> Column:
    """kind:sha256:<digest of the canonical JSON array of the parts>."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(F.to_json(F.array(*parts)), 256))


def package_of(name: Column) -> Column:
    """Prefix up to the last dot; empty if there is none."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def short_id(identity: Column) -> Column:
    return F.substring(F.element_at(F.split(identity, ":"), -1), 1, 12)


def matches_pattern(value: Column, pattern: str) -> Column:
    """Literal, ``*`` or ``prefix.**``; null stays unknown."""
    if pattern == "*":
        return F.when(value.isNotNull(), F.lit(True))
    if pattern.endswith(".**"):
        prefix = pattern[:-3]
        return (value == prefix) | value.startswith(prefix + ".")
    return value == pattern


def kleene_any(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out | v
    return out


def kleene_all(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out & v
    return out


def per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(F.floor(1000 * part / F.nullif(whole, F.lit(0)))).cast("bigint")


def ramp(value: Column, threshold: float, saturation: float) -> Column:
    """0 up to the threshold, 1 from saturation on, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - threshold) / (saturation - threshold)))


#: Ranks of severities and quantifiers.
SEVERITY = {"INFO": 1, "WARNING": 2, "ERROR": 3}
QUANTIFIER = {"NEVER": 0, "UNKNOWN": 1, "MAY": 2, "MUST": 3}


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = None
    for name, r in ranks.items():
        out = F.when(value == name, r) if out is None else out.when(value == name, r)
    return out


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cursor(query_digest: Column, last: Column) -> Column:
    """Opaque page cursor: base64url of the query's digest and the last id."""
    return F.translate(F.base64(F.encode(F.concat_ws("\n", query_digest, last), "UTF-8")), "+/=\r\n", "-_")


def cursor_valid(value: Column, query_digest: Column) -> Column:
    """Does a cursor belong to the query?  Foreign and garbled ones do not."""
    padded = F.translate(value, "-_", "+/")
    fill = F.repeat(F.lit("="), F.pmod(-F.length(value), F.lit(4)))
    text = F.decode(F.try_to_binary(F.concat(padded, fill), F.lit("base64")), "UTF-8")
    return F.coalesce(F.split(text, "\n")[0] == query_digest, F.lit(False))


def rpc_spellings(name: Column) -> Column:
    """EXACT, LOWER_CAMEL and CSHARP_ASYNC spellings of an RPC name."""
    lower = F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000))
    return F.array_distinct(F.array(name, lower, F.concat(name, F.lit("Async"))))


def safe_path(path: Column) -> Column:
    """Relative, normal, without parent steps, back-slashes or drive letters."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(^/)|(^[A-Za-z]:)|\\|(^|/)\.\.?(/|$)|//")


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON object with members in order of their names; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})
