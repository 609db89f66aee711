"""The changefeed: what was appended to and deleted from a table in a window of snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Expired, Invalid, ReconciliationRequired
from .table import BROADCAST_ROWS, Table


@dataclass
class Changes:
    """Files and deletion vectors that began in (after, until]; files that only rewrite rows are not among them."""

    table: Table
    after: int
    until: int
    files: list[dict[str, Any]]
    vectors: list[dict[str, Any]]

    def appended(self, lineage: bool = False) -> DataFrame:
        """Rows that were appended, whether or not they were deleted since."""
        return self.table.read([(f, None) for f in self.files], self._fields(), lineage)

    def _fields(self) -> list:
        """The columns at the window's end, or the first ones of a table made after it."""
        return self.table.fields(max(self.until, self.table.row()["begin"]))

    def deleted(self) -> DataFrame:
        """Row ids that deletion vectors of the window cover and earlier ones did not."""
        state = self.table.catalog.state()
        before = {x["file_id"]: x for x in self.table._dvs(self.after).values()}
        last = {x["file_id"]: x for x in self.vectors}
        now = [(state["files"][str(i)], x) for i, x in last.items()]
        spark = self.table.spark
        if not now:
            return spark.createDataFrame([], "rowid long, data_file_id long, file_row_number long")
        rows = self.table.positions(now, before)
        # A rewritten file carries its row ids itself, so they are read from it.
        plain = spark.createDataFrame([(f["path"], f["id"], f["row_id_start"]) for f, _ in now], "__path string, data_file_id long, start long")
        rows = rows.join(F.broadcast(plain) if len(now) <= BROADCAST_ROWS else plain, "__path")
        explicit = [f for f, _ in now if f["explicit"]]
        ids = rows.withColumn("rowid", F.col("start") + F.col("__pos"))
        if explicit:
            carried = self.table.read([(f, None) for f in explicit], self._fields(), True).select(F.col("filename").alias("__path"), F.col("file_row_number").alias("__pos"), F.col("rowid").alias("own"))
            ids = ids.join(carried, ["__path", "__pos"], "left").withColumn("rowid", F.coalesce("own", "rowid"))
        return ids.select("rowid", "data_file_id", F.col("__pos").alias("file_row_number"))


def changes(table: Table, after: int, until: int | None = None) -> Changes:
    state = table.catalog.state()
    until = state["head"] if until is None else until
    if not 0 <= after <= until <= state["head"]:
        raise Invalid(f"window ({after}, {until}] is not in 0 to {state['head']}")
    if after < state["earliest"] - 1:
        raise Expired(f"snapshot {after} is below the floor {state['earliest']}")
    compacted = set()
    for s in state["snapshots"]:
        if after < s["snapshot_id"] <= until:
            own = {k for k, i in s["changes"] if i == table.id}
            if {"table_altered", "table_deleted_from"} <= own or "table_replaced" in own or "table_dropped" in own:
                raise ReconciliationRequired(f"snapshot {s['snapshot_id']} truncates or replaces the table")
            if "table_compacted" in own:
                compacted.add(s["snapshot_id"])
    files = [f for f in state["files"].values() if f["table_id"] == table.id and after < f["begin"] <= until and f["begin"] not in compacted]
    vectors = [x for x in state["dvs"].values() if x["table_id"] == table.id and after < x["begin"] <= until]
    return Changes(table, after, until, sorted(files, key=lambda f: (f["begin"], f["row_id_start"], f["id"])), sorted(vectors, key=lambda x: x["begin"]))
