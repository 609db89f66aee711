"""The changefeed of a table as a streaming source.

Offsets are snapshot ids.  A micro-batch plans the files that its snapshots
appended; executors read them in Arrow batches, so rows never pass the driver.
Truncations, replacements, deleted rows and expiry end the stream with an error
instead of a gap: it carries appends alone.  Use it with ``spark.dataSource.register(TideChanges)`` and
``spark.readStream.format("tide_changes").option("root", ...)``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .. import types as ty
from ..errors import Expired, NotFound, ReconciliationRequired
from ..sources.log import Log, visible
from ..sources.store import is_local, local, read_bytes


class _ReadOnly:
    """What the log needs of a store, without a session."""

    def read(self, path: str) -> bytes | None:
        try:
            return read_bytes(path)
        except FileNotFoundError:
            return None

    def names(self, folder: str) -> list[str]:
        return sorted(os.listdir(local(folder))) if is_local(folder) and os.path.isdir(local(folder)) else []


def _table(state: dict, namespace: str, name: str) -> dict:
    for v in state["versions"]:
        t = state["tables"].get(str(v["table_id"]))
        if v["name"] == name and v["end"] is None and t and t["end"] is None and state["namespaces"][str(t["namespace_id"])]["name"] == namespace:
            return t
    raise NotFound(f"table {namespace}.{name}")


def _fields(state: dict, table_id: int, at: int) -> list[ty.Field]:
    return next(s["fields"] for s in reversed(state["schemas"]) if s["table_id"] == table_id and visible(s, at))


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class TideChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tide_changes"

    def _log(self) -> Log:
        return Log(_ReadOnly(), self.options["root"])

    def schema(self) -> StructType:
        state = self._log().state()
        t = _table(state, self.options["namespace"], self.options["table"])
        return StructType([StructField(f.name, f.dataType, True) for f in ty.struct_type(_fields(state, t["id"], state["head"]), False).fields])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.namespace, self.name = options["root"], options["namespace"], options["table"]
        self.start = int(options.get("after", "0"))
        self.log = Log(_ReadOnly(), self.root)
        state = self.log.state()
        self.table_id = _table(state, self.namespace, self.name)["id"]
        self.ids = {f["name"]: f["id"] for f in _fields(state, self.table_id, state["head"])}
        self.names = [f.name for f in schema.fields]
        self.arrow = to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"snapshot": self.start}

    def latestOffset(self) -> dict:
        return {"snapshot": self.log.state()["head"]}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        state, after, until = self.log.state(), start["snapshot"], end["snapshot"]
        if after < state["earliest"] - 1:
            raise Expired(f"snapshot {after} is below the floor {state['earliest']}")
        compacted = set()
        for s in state["snapshots"]:
            if after < s["snapshot_id"] <= until:
                own = {k for k, i in s["changes"] if i == self.table_id}
                if {"table_altered", "table_deleted_from"} <= own or own & {"table_replaced", "table_dropped"}:
                    raise ReconciliationRequired(f"snapshot {s['snapshot_id']} truncates or replaces the table")
                if "table_compacted" in own:
                    compacted.add(s["snapshot_id"])
        if any(x["table_id"] == self.table_id and after < x["begin"] <= until for x in state["dvs"].values()):
            raise ReconciliationRequired(f"rows were deleted in ({after}, {until}], which a stream of appends cannot carry")
        return [_File(f["path"]) for f in state["files"].values() if f["table_id"] == self.table_id and after < f["begin"] <= until and f["begin"] not in compacted]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if is_local(partition.path):
            source = pq.ParquetFile(local(partition.path))
        else:
            from pyarrow import fs

            files, at = fs.FileSystem.from_uri(partition.path)
            source = pq.ParquetFile(files.open_input_file(at))
        by_id = {int(f.metadata[b"PARQUET:field_id"]): f.name for f in source.schema_arrow if f.metadata and b"PARQUET:field_id" in f.metadata}
        if by_id:
            columns = [by_id.get(self.ids[n]) for n in self.names]
        else:  # a file from elsewhere, without field ids: columns go by name
            there = {f.name.lower(): f.name for f in source.schema_arrow}
            columns = [there.get(n.lower()) for n in self.names]
        for batch in source.iter_batches(columns=[c for c in columns if c]):
            # A file may be older than a promotion of its columns.
            arrays = [pa.nulls(len(batch), f.type) if c is None else batch.column(c).cast(f.type) for c, f in zip(columns, self.arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.arrow)

    def commit(self, end: dict) -> None:
        pass
