"""Problem 5: deeply nested JSON records to related flat tables.

The string buffer of a batch is indexed as a whole (``json_index``): tokens,
containers and list offsets by vectorised kernels, without parsing rows.
Nesting is then handled level by level: a level is an array of value numbers,
its children come from the offsets of the list arrays (``list_parent_indices``
and ``list_flatten`` of the taken lists), and keys are handed down by ``take``.
Depth costs levels, not stack, and is not bounded.

``flatten`` makes all tables of the reports in one pass; each table is a
projection of it.  Who needs several of them reads them from ``tables``, which
keeps that pass once.

Defined results: null and invalid bodies give nothing; a value that is absent
or null gives no row; members of a shape the table does not know are passed
over, and of equal member names the last counts; equal rows of repeated bodies
are reported once; labels that are no strings are given as written.  One Arrow
pass; only the final ``distinct`` shuffles, after a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .json_index import JsonIndex

#: Member names that the tables know.
NAMES = ("calls", "files", "arguments", "target", "owner", "originEvidence", "kind", "callId", "caller", "file", "schema", "hasErrors", "diagnostics", "cases", "language")
#: Bodies are indexed in slices of about this many bytes; a longer body alone.
SLICE_BYTES = 4_000_000


class Level:
    """Calls of one depth: value numbers with their record, file and parent."""

    def __init__(self, index: JsonIndex, values: np.ndarray, record: pa.Array, file_no: pa.Array, parent: pa.Array):
        keep = index.of_kind(values, "{")
        self.index, self.values = index, values[keep]
        keep = pa.array(keep)
        self.record, self.file_no, self.parent = record.filter(keep), file_no.filter(keep), parent.filter(keep)
        self.ids = index.text(index.member("callId", self.values))
        #: what a call inside names as its parent: a call without id is passed over
        self.handed = pc.if_else(pc.is_valid(self.ids), self.ids, self.parent)

    def inner(self) -> Level:
        """The calls in the arguments of these."""
        at, values = self.index.elements(self.index.member("arguments", self.values))
        return Level(self.index, values, self.record.take(at), self.file_no.take(at), self.handed.take(at))

    def targets(self) -> tuple[pa.Array, np.ndarray]:
        """(place of the call, target object); one object is a list of one."""
        held = self.index.member("target", self.values)
        at, listed = self.index.elements(held)
        alone = np.flatnonzero(self.index.of_kind(held, "{"))
        place = np.concatenate([at.to_numpy(), alone])
        values = np.concatenate([listed, held[alone]])
        keep = self.index.of_kind(values, "{")
        order = np.argsort(place[keep], kind="stable")
        return pa.array(place[keep][order]), values[keep][order]


def roots(index: JsonIndex) -> tuple[pa.Array, np.ndarray]:
    """(row, value) of the bodies that are objects."""
    keep = index.of_kind(index.root, "{")
    return pa.array(np.flatnonzero(keep)), index.root[keep]


def numbered(at: pa.Array) -> pa.Array:
    """Position of each child among its parent's; ``at`` is sorted."""
    a = at.to_numpy()
    return pa.array((np.arange(len(a)) - np.searchsorted(a, a, side="left")).astype(np.int32))


def report_levels(index: JsonIndex, ids: pa.Array) -> Iterator[Level]:
    """Every depth of calls of a batch of reports, outermost first."""
    row, top = roots(index)
    record = ids.take(row)
    at, calls = index.elements(index.member("calls", top))
    file_at, files = index.elements(index.member("files", top))
    inside_at, inside = index.elements(np.where(index.of_kind(files, "{"), index.member("calls", files), -1))
    level = Level(
        index, np.concatenate([calls, inside]), pa.concat_arrays([record.take(at), record.take(file_at).take(inside_at)]),
        pa.concat_arrays([pa.nulls(len(at), pa.int32()), numbered(file_at).take(inside_at)]), pa.array([""] * (len(calls) + len(inside)), pa.string()))
    while len(level.values):
        yield level
        level = level.inner()


def _frame(df: DataFrame, columns: list[str], body: str, build: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, body):
                for part in build(batch, JsonIndex(batch.column(body), NAMES)):
                    yield from part.to_batches()

    return df.select(*columns).mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, body: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its bodies grow long."""
    n = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(n) - n) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


CALLS = "report_id bigint, call_id string, parent_call_id string, file_no int, caller string"
TARGETS = "report_id bigint, call_id string, target_no int, owner string, kind string"
CASES = "suite_id bigint, case_name string, language string, n_files int"
FOUND = "origin string, record_id bigint, item string, parent_item string, field_name string, label string"
#: Rows of all tables of the reports; ``tab`` names the table.
FLAT = ("tab string, report_id bigint, repository string, report_schema string, has_errors boolean, n_diagnostics int, "
        "file_no int, file string, n_calls int, call_id string, parent_call_id string, caller string, target_no int, owner string, kind string")
_FLAT = {x.split()[0]: {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]] for x in FLAT.split(", ")}


def _flat(tab: str, n: int, **columns: pa.Array) -> pa.Table:
    return pa.table([pa.array([tab] * n, pa.string()) if c == "tab" else columns.get(c, pa.nulls(n, t)) for c, t in _FLAT.items()], names=list(_FLAT))


def flatten(binding_reports: DataFrame) -> DataFrame:
    """Reports, files, calls and targets in one pass."""
    def build(batch, index):
        row, top = roots(index)
        ids = batch.column("report_id")
        errors = index.text(index.member("hasErrors", top))
        yield _flat(
            "report", len(top), report_id=ids.take(row), repository=batch.column("repository").take(row), report_schema=index.text(index.member("schema", top)),
            has_errors=pc.if_else(pc.is_in(errors, pa.array(["true", "false"])), pc.equal(errors, "true"), pa.scalar(None, pa.bool_())),
            n_diagnostics=index.sizes(index.member("diagnostics", top)))
        at, files = index.elements(index.member("files", top))
        known = np.where(index.of_kind(files, "{"), files, -1)
        yield _flat("file", len(files), report_id=ids.take(row).take(at), file_no=numbered(at), file=index.text(index.member("file", known)), n_calls=index.sizes(index.member("calls", known)))
        for level in report_levels(index, ids):
            yield _flat("call", len(level.values), report_id=level.record, call_id=level.ids, parent_call_id=level.parent, file_no=level.file_no,
                        caller=index.text(index.member("caller", level.values)))
            at, values = level.targets()
            origin = index.member("originEvidence", values)
            yield _flat("target", len(values), report_id=level.record.take(at), call_id=level.ids.take(at), parent_call_id=level.parent.take(at), target_no=numbered(at),
                        owner=index.text(index.member("owner", values)), kind=index.text(np.where(index.of_kind(origin, "{"), index.member("kind", origin), -1)))

    return _frame(binding_reports, ["report_id", "repository", "stdout"], "stdout", build, FLAT)


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(flat: DataFrame, tab: str, columns: list[str]) -> DataFrame:
    rows = flat.where(F.col("tab") == tab).select(*columns)
    return (rows.where("call_id is not null") if "call_id" in columns else rows).distinct()


REPORT_COLUMNS = ["report_id", "repository", "report_schema", "has_errors", "n_diagnostics"]
FILE_COLUMNS = ["report_id", "file_no", "file", "n_calls"]


def reports(binding_reports: DataFrame) -> DataFrame:
    """One row per decodable report: the root of the related tables."""
    return _table(flatten(binding_reports), "report", REPORT_COLUMNS)


def files(binding_reports: DataFrame) -> DataFrame:
    return _table(flatten(binding_reports), "file", FILE_COLUMNS)


def calls(binding_reports: DataFrame) -> DataFrame:
    """Every call with the call that encloses it ('' at the top)."""
    return _table(flatten(binding_reports), "call", _columns(CALLS))


def targets(binding_reports: DataFrame) -> DataFrame:
    return _table(flatten(binding_reports), "target", _columns(TARGETS))


def tables(binding_reports: DataFrame) -> dict[str, DataFrame]:
    """All related tables of the reports from one pass, kept in the shared folder."""
    flat = checkpointed(flatten(binding_reports))
    return {"reports": _table(flat, "report", REPORT_COLUMNS), "files": _table(flat, "file", FILE_COLUMNS),
            "calls": _table(flat, "call", _columns(CALLS)), "targets": _table(flat, "target", _columns(TARGETS))}


def cases(native_cases: DataFrame) -> DataFrame:
    def build(batch, index):
        row, top = roots(index)
        held = index.member("cases", top)
        at, values, names = index.members(np.where(index.of_kind(held, "{"), held, -1))
        known = np.where(index.of_kind(values, "{"), values, -1)
        held = index.member("files", known)
        inside, _, _ = index.members(np.where(index.of_kind(held, "{"), held, -1))
        yield pa.table([
            batch.column("suite_id").take(row).take(pa.array(at)), names.cast(pa.string()), index.text(index.member("language", known)),
            pa.array(np.bincount(inside, minlength=len(values)).astype(np.int32)),
        ], names=_columns(CASES))

    return _frame(native_cases, ["suite_id", "body"], "body", build, CASES).distinct()


def found(binding_reports: DataFrame, native_cases: DataFrame) -> DataFrame:
    """One row per present value: owner and kind of every target of every
    call, language of every case."""
    held = flatten(binding_reports).where("tab = 'target' and call_id is not null")
    called = held.select(
        F.lit("report").alias("origin"), F.col("report_id").alias("record_id"), F.col("call_id").alias("item"), F.col("parent_call_id").alias("parent_item"),
        F.explode(F.create_map(F.lit("owner"), "owner", F.lit("kind"), "kind")).alias("field_name", "label"))
    suites = cases(native_cases).select(
        F.lit("suite").alias("origin"), F.col("suite_id").alias("record_id"), F.col("case_name").alias("item"),
        F.lit("").alias("parent_item"), F.lit("language").alias("field_name"), F.col("language").alias("label"))
    return called.unionByName(suites).where(F.col("label").isNotNull() & F.col("item").isNotNull()).distinct()
