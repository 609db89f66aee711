"""Replication of a table's appends: window by window, rows first, then the offset.

At least once: a crash between the two repeats a window, which the append's key
turns into a no-op.  It halts, with a typed error, on what it cannot carry over:
a new incarnation on either side, deletes, expired or truncated history, or a
window whose files hold fewer rows than registered.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..errors import IncarnationChanged, Invalid, Unsupported
from ..operators.table import Table
from .ingest import with_retries


def window(head: int, offset: int, most: int) -> tuple[int, int] | None:
    """The next (after, until], or none."""
    return None if offset >= head else (offset, min(head, offset + most))


def row_filter(column: str, value: Any):
    """column == value; null never matches, and values that equal nothing are refused."""
    if value is None or isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise Invalid(f"a filter on {value!r}")
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def project(source: list[ty.Field], target: list[ty.Field]) -> list[str]:
    """The target's columns, each in the source under the same type; all differences are told at once."""
    have = {f["name"]: f for f in source}
    shape = lambda f: (f["type"], f.get("precision"), f.get("scale"), [(c["name"], shape(c)) for c in f.get("children") or []])
    wrong = [f"{f['name']}: {'missing' if f['name'] not in have else have[f['name']]['type'] + ' is not ' + f['type']}" for f in target if f["name"] not in have or shape(have[f["name"]]) != shape(f)]
    if wrong:
        raise Invalid("; ".join(wrong))
    return [f["name"] for f in target]


@dataclass
class Replicator:
    source: Table
    target: Table
    consumer: str
    match: tuple[str, Any] | None = None
    most_snapshots: int = 100

    def __post_init__(self) -> None:
        self.uuids = self.source.uuid, self.target.uuid

    def _resolved(self) -> tuple[Table, Table]:
        for t, known in ((self.source, self.uuids[0]), (self.target, self.uuids[1])):
            if t.row()["end"] is not None or t.uuid != known:
                raise IncarnationChanged(f"table {t.id} was dropped or made anew")
        return self.source, self.target

    def rows(self, after: int, until: int) -> DataFrame:
        source, target = self._resolved()
        changes = source.changes(after, until)
        columns = project(changes._fields(), target.fields())
        rows = changes.appended()
        if self.match:
            rows = rows.where(row_filter(*self.match))
        return rows.select(*columns)

    def run_once(self) -> dict[str, Any] | None:
        """Carry one window over; None when there is nothing new."""
        source, target = self._resolved()
        offset = source.catalog.offset(self.consumer, source.uuid)
        span = window(source.catalog.head, offset if offset is not None else max(0, source.catalog.state()["earliest"] - 1), self.most_snapshots)
        if span is None:
            return None
        changes = source.changes(*span)
        if changes.vectors:
            raise Unsupported("the window deletes rows")
        if sum(f["record_count"] for f in changes.files) != changes.appended().count():
            raise Invalid("the window's files hold fewer rows than registered")
        key = f"replicate/{self.consumer}/{source.uuid}/{span[0]}-{span[1]}"
        result = with_retries(lambda: target.append(self.rows(*span), expected_uuid=self.uuids[1], key=key)) if changes.files else {}
        source.catalog.commit_offset(self.consumer, source.uuid, span[1])
        return {"after": span[0], "until": span[1], **result}
