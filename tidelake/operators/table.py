"""Tables: scans at any snapshot, appends, row-level changes and definitions."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..errors import CommitConflict, IncarnationChanged, Invalid, NotFound, Unsupported
from ..functions import bounds, transforms
from ..plans import predicates
from ..sources import dv as dvs
from ..sources.log import visible
from ..sources.store import local, read_bytes, write_bytes
from .catalog import Catalog, Draft, check_conflicts, draft_drop, draft_files
from .write import prefix_folder, stage, stays_under

#: Files in a file map that are broadcast at most; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of deletion vectors, one bit a row, that a task keeps about; it always keeps the last one.
KEPT_VECTORS = 32 << 20
#: Deleted positions that a task hands on at once.
POSITIONS_AT_ONCE = 100_000
#: Most entries of column statistics that one plan carries.
MOST_STATS = 1_000_000


def bare_path(c: Column) -> Column:
    """A file path without the local scheme, as files are registered."""
    return F.regexp_replace(c, r"^file:/+", "/")


def _outside(vectors: list[tuple[str, int, int]]):
    """Whether a row is in no deletion vector, from its vector's number and its position.

    Vectors are (path, positions, rows of the file).  Each task reads those of
    its own files: nothing of them passes the driver, and no row is shuffled.
    """
    kept: dict[int, np.ndarray] = {}

    def bits(n: int) -> np.ndarray:
        if n not in kept:
            path, count, records = vectors[n]
            gone = dvs.decode(dvs.read_puffin(read_bytes(path)), count)
            flags = np.zeros(records, bool)
            flags[gone[gone < records]] = True
            own = np.packbits(flags, bitorder="little")
            if sum(x.nbytes for x in kept.values()) + own.nbytes > KEPT_VECTORS:
                kept.clear()
            kept[n] = own
        return kept[n]

    @F.pandas_udf(T.BooleanType())
    def outside(nth: pd.Series, pos: pd.Series) -> pd.Series:
        numbers, at = nth.to_numpy(), pos.to_numpy(np.int64)
        out = np.ones(len(at), bool)
        for n in np.unique(numbers):
            own = np.flatnonzero(numbers == n)
            out[own] = bits(int(n))[at[own] >> 3] >> (at[own] & 7).astype(np.uint8) & 1 == 0
        return pd.Series(out)

    return outside


class Table:
    def __init__(self, catalog: Catalog, namespace: str, table_id: int):
        self.catalog, self.namespace, self.id = catalog, namespace, table_id
        self.spark = catalog.spark

    # -- definition at a snapshot

    def row(self, state: dict | None = None) -> dict:
        return (state or self.catalog.state())["tables"][str(self.id)]

    @property
    def uuid(self) -> str:
        return self.row()["uuid"]

    def _at(self, key: str, at: int, state: dict | None = None) -> dict:
        for row in reversed((state or self.catalog.state())[key]):
            if row["table_id"] == self.id and visible(row, at):
                return row
        raise NotFound(f"table {self.id} at snapshot {at}")

    def fields(self, at: int | None = None) -> list[ty.Field]:
        return self._at("schemas", self.catalog.head if at is None else at)["fields"]

    def spec(self, at: int | None = None) -> dict:
        return self._at("specs", self.catalog.head if at is None else at)

    def sort(self, at: int | None = None) -> list[dict]:
        return self._at("sorts", self.catalog.head if at is None else at)["fields"]

    def info(self, snapshot: int | None = None) -> dict[str, Any]:
        at = self.catalog.resolve(snapshot)
        version = self._at("versions", at)
        return {"table_id": self.id, "uuid": self.uuid, "namespace": self.namespace, "name": version["name"], "comment": version["comment"], "properties": version["properties"], "fields": self.fields(at), "spec": self.spec(at), "sort": self.sort(at), "snapshot": at, **self.totals(at)}

    def _specs(self) -> dict[int, list[dict]]:
        return {s["spec_id"]: s["fields"] for s in self.catalog.state()["specs"] if s["table_id"] == self.id}

    # -- scan plans

    def _files(self, at: int, state: dict | None = None) -> list[dict]:
        found = [f for f in (state or self.catalog.state())["files"].values() if f["table_id"] == self.id and visible(f, at)]
        return sorted(found, key=lambda f: (f["begin"], f["row_id_start"], f["id"]))

    def _dvs(self, at: int, state: dict | None = None) -> dict[int, dict]:
        return {x["file_id"]: x for x in (state or self.catalog.state())["dvs"].values() if x["table_id"] == self.id and visible(x, at)}

    def plan(self, snapshot: int | None = None, timestamp: dt.datetime | None = None, where: str | None = None) -> list[tuple[dict, dict | None]]:
        """Data files of a scan with their deletion vectors, after pruning by partition and bounds; at a snapshot or a time."""
        at = self.catalog.resolve(snapshot, timestamp)
        files, vectors = self._files(at), self._dvs(at)
        if where:
            fields, wanted = self.fields(at), []
            for column, op, values in predicates.conjuncts(self.spark, where):
                try:
                    f = ty.find(fields, column)
                    if f.get("children") or f["type"] == "variant":
                        continue
                    wanted.append((f, op, [predicates.typed(f["type"], v, f.get("scale", 0)) for v in values]))
                except (Invalid, ValueError, TypeError, OverflowError):
                    continue
            by_id, specs = {f["id"]: f for _, f in ty.leaves(fields)}, self._specs()
            files = [f for f in files if predicates.file_may_match(f, specs, by_id, wanted)]
        return [(f, vectors.get(f["id"])) for f in files]

    def scan(self, snapshot: int | None = None, timestamp: dt.datetime | None = None, where: str | None = None, columns: list[str] | None = None, lineage: bool = False, vectors: dict[int, dict] | None = None) -> DataFrame:
        """The rows at a snapshot or time; `lineage` adds rowid, snapshot_id, filename, file_row_number.

        `vectors` stand in for the registered ones, by file id.
        """
        at = self.catalog.resolve(snapshot, timestamp)
        plan = [(f, (vectors or {}).get(f["id"], x)) for f, x in self.plan(at, where=where)]
        rows = self.read(plan, self.fields(at), lineage)
        if where:
            rows = rows.where(where)
        return rows.select(*columns) if columns else rows

    def read(self, plan: list[tuple[dict, dict | None]], fields: list[ty.Field], lineage: bool = False) -> DataFrame:
        """The rows of planned files.  Only rows of files with a deletion vector are held against it."""
        out = None
        for explicit in (False, True):
            for deleted in (False, True):
                some = [(f, x) for f, x in plan if f["explicit"] == explicit and (x is not None) == deleted]
                if some:
                    part = self._read_some(some, fields, explicit, deleted, lineage)
                    out = part if out is None else out.unionByName(part)
        if out is None:
            schema = ty.struct_type(fields, False)
            if lineage:
                schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.fields), T.StructField("rowid", T.LongType()), T.StructField("snapshot_id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("file_row_number", T.LongType())])
            out = self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
        return out

    def _read_some(self, some, fields, explicit: bool, deleted: bool, lineage: bool) -> DataFrame:
        schema = ty.struct_type(fields)
        if explicit and lineage:
            schema = T.StructType([*schema.fields, T.StructField(ty.ROW_ID, T.LongType(), True, {ty.FIELD_ID: ty.ROW_ID_FIELD})])
        rows = self.spark.read.schema(schema).parquet(*[f["path"] for f, _ in some])
        names = [f"`{f['name']}`" for f in fields]
        if not deleted and not lineage:
            return rows.select(*names)
        rows = rows.select("*", bare_path(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.row_index").alias("__pos"))
        files = self.spark.createDataFrame([(f["path"], f["row_id_start"], f["begin"], n) for n, (f, _) in enumerate(some)], "__path string, __start long, __begin long, __nth int")
        rows = rows.join(F.broadcast(files) if len(some) <= BROADCAST_ROWS else files, "__path")
        if deleted:
            rows = rows.where(_outside([(x["path"], x["count"], f["record_count"]) for f, x in some])("__nth", "__pos"))
        if not lineage:
            return rows.select(*names)
        rowid = F.col(ty.ROW_ID) if explicit else F.col("__start") + F.col("__pos")
        return rows.select(*names, rowid.alias("rowid"), F.col("__begin").alias("snapshot_id"), F.col("__path").alias("filename"), F.col("__pos").alias("file_row_number"))

    def positions(self, some: list[tuple[dict, dict]], before: dict[int, dict]) -> DataFrame:
        """Positions in files' deletion vectors and not in those before, by file id; decoded on executors."""

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, at, count, old, old_count in b.itertuples(index=False):
                    own = dvs.decode(dvs.read_puffin(read_bytes(at)), count)
                    if isinstance(old, str):
                        own = np.setdiff1d(own, dvs.decode(dvs.read_puffin(read_bytes(old)), old_count), assume_unique=True)
                    for i in range(0, len(own), POSITIONS_AT_ONCE):
                        yield pd.DataFrame({"__path": path, "__pos": own[i : i + POSITIONS_AT_ONCE]})

        olds = [before.get(f["id"]) for f, _ in some]
        rows = self.spark.createDataFrame([(f["path"], x["path"], x["count"], old["path"] if old else None, old["count"] if old else 0) for (f, x), old in zip(some, olds, strict=True)], "path string, at string, count long, old string, old_count long")
        return rows.repartition(min(len(some), self.spark.sparkContext.defaultParallelism)).mapInPandas(decode, "__path string, __pos long")

    def count(self, snapshot: int | None = None) -> int:
        """Live rows, from metadata alone."""
        t = self.totals(self.catalog.resolve(snapshot))
        return t["records"] - t["deleted"]

    def totals(self, at: int) -> dict[str, int]:
        files = self._files(at)
        return {"files": len(files), "records": sum(f["record_count"] for f in files), "deleted": sum(x["count"] for x in self._dvs(at).values()), "bytes": sum(f["size"] for f in files)}

    # -- metadata as frames

    def files(self, snapshot: int | None = None, sort: str = "begin_snapshot", descending: bool = False, limit: int = 10_000, offset: int = 0, partition: dict[int, str | None] | None = None) -> DataFrame:
        """The manifest: one row per file, in a stable order; `partition` wants exact stored values by key index."""
        if sort not in ("begin_snapshot", "id", "path", "record_count", "size", "stats_state"):
            raise Invalid(f"sort {sort!r}")
        if not 0 <= limit <= 10_000 or offset < 0:
            raise Invalid("limit is 0 to 10000, offset not negative")
        at = self.catalog.resolve(snapshot)
        vectors = self._dvs(at)
        rows = [f for f in self._files(at) if all(k < len(f["values"]) and f["values"][k] == v for k, v in (partition or {}).items())]
        key = "begin" if sort == "begin_snapshot" else sort
        rows.sort(key=lambda f: f["id"])
        rows.sort(key=lambda f: f[key], reverse=descending)
        data = [(f["id"], f["path"], f["record_count"], f["size"], f["row_id_start"], f["explicit"], f["spec_id"], f["values"], f["stats_state"], f["begin"], f["split_offsets"], vectors[f["id"]]["count"] if f["id"] in vectors else 0) for f in rows[offset : offset + limit]]
        return self.spark.createDataFrame(data, "data_file_id long, path string, record_count long, size long, row_id_start long, explicit_row_ids boolean, spec_id int, partition_values array<string>, stats_state string, begin_snapshot long, split_offsets array<long>, delete_count long")

    def column_stats(self, snapshot: int | None = None, columns: list[str] | None = None, file_id: int | None = None) -> DataFrame:
        """Per file and leaf: counts and bounds, as bytes and as text."""
        at = self.catalog.resolve(snapshot)
        wanted = [(".".join(p), f) for p, f in ty.leaves(self.fields(at)) if columns is None or ".".join(p) in columns]
        files = [f for f in self._files(at) if f["stats_state"] == "provided" and (file_id is None or f["id"] == file_id)]
        if len(files) * len(wanted) > MOST_STATS:
            raise Invalid(f"more than {MOST_STATS} statistics; ask for fewer columns")
        data = []
        for f in files:
            for path, leaf in wanted:
                if s := f["stats"].get(str(leaf["id"])):
                    ends = [bytes.fromhex(s[k]) if s.get(k) is not None else None for k in ("lower", "upper")]
                    shown = [transforms.wire_value(leaf["type"], bounds.decode(leaf["type"], b, leaf.get("scale", 0))) for b in ends]
                    data.append((f["id"], leaf["id"], path, s.get("values"), s.get("nulls"), s.get("nans"), *ends, *shown))
        return self.spark.createDataFrame(data, "data_file_id long, field_id int, column string, value_count long, null_count long, nan_count long, lower_bound binary, upper_bound binary, lower_text string, upper_text string")

    def partition_values(self, snapshot: int | None = None, most: int = 500) -> tuple[DataFrame, bool]:
        """Distinct stored values of each partition key, most frequent first, and whether some were left out."""
        found: dict[tuple[int, str | None], int] = {}
        for f in self._files(self.catalog.resolve(snapshot)):
            for k, v in enumerate(f["values"]):
                found[k, v] = found.get((k, v), 0) + 1
        rows = sorted(((k, v, n) for (k, v), n in found.items()), key=lambda r: (r[0], -r[2], r[1] is not None, r[1] or ""))
        seen: dict[int, int] = {}
        kept = []
        for r in rows:
            seen[r[0]] = seen.get(r[0], 0) + 1
            if seen[r[0]] <= most:
                kept.append(r)
        return self.spark.createDataFrame(kept, "key_index int, value string, files long"), len(kept) < len(rows)

    def partitions(self, snapshot: int | None = None, prefix: dict[int, str] | None = None, small: int = 64 << 20, sort: str = "decoded", descending: bool | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Per partition of every spec: files, rows, bytes, small files, deletion vectors, with decoded values.

        `prefix` filters decoded values by case-insensitive prefix; an empty one
        means null.  The order is that of the decoded values, nulls first, or of
        a measure, largest first unless told otherwise; ties by decoded values.
        """
        measures = ("files", "records", "bytes", "small_files", "vectors", "deleted")
        if sort not in ("decoded", *measures):
            raise Invalid(f"sort {sort!r}")
        at = self.catalog.resolve(snapshot)
        by_id, specs, vectors = {f["id"]: f for _, f in ty.leaves(self.fields(at))}, self._specs(), self._dvs(at)
        groups: dict[tuple, list] = {}
        for f in self._files(at):
            shown = tuple(transforms.display(p["transform"], by_id[p["field_id"]]["type"] if p["field_id"] in by_id else "string", v) for p, v in zip(specs[f["spec_id"]], f["values"], strict=True))
            if all(k < len(shown) and ((shown[k] or "").lower().startswith(p.lower()) and shown[k] is not None if p else shown[k] is None) for k, p in (prefix or {}).items()):
                g = groups.setdefault((f["spec_id"], tuple(f["values"]), shown), [0, 0, 0, 0, 0, 0])
                x = vectors.get(f["id"])
                for i, n in enumerate((1, f["record_count"], f["size"], f["size"] < small, x is not None, x["count"] if x else 0)):
                    g[i] += int(n)
        rows = [(spec, list(stored), list(shown), *g) for (spec, stored, shown), g in sorted(groups.items(), key=lambda kv: [(v is not None, v or "") for v in kv[0][2]])]
        if sort == "decoded":
            rows = rows[::-1] if descending else rows
        else:
            rows.sort(key=lambda r: r[3 + measures.index(sort)], reverse=descending is not False)
        rows = rows[offset:] if limit is None else rows[offset : offset + limit]
        return self.spark.createDataFrame(rows, "spec_id int, partition_values array<string>, decoded array<string>, files long, records long, bytes long, small_files long, vectors long, deleted long")

    def lookup_partition(self, values: list[str | None], spec_id: int | None = None, after: int = 0, limit: int = 500, snapshot: int | None = None) -> dict[str, Any]:
        """Files of one exact partition, by pages behind a file id; the first page has the totals."""
        if not 1 <= limit <= 500:
            raise Invalid("limit is 1 to 500")
        at = self.catalog.resolve(snapshot)
        spec_id = self.spec(at)["spec_id"] if spec_id is None else spec_id
        found = sorted((f for f in self._files(at) if f["spec_id"] == spec_id and f["values"] == list(values)), key=lambda f: f["id"])
        page = [f for f in found if f["id"] > after][:limit]
        out: dict[str, Any] = {"snapshot": at, "files": page, "next": page[-1]["id"] if page and page[-1]["id"] != found[-1]["id"] else None}
        if not after:
            out["totals"] = {"files": len(found), "records": sum(f["record_count"] for f in found), "bytes": sum(f["size"] for f in found)}
        return out

    # -- appends

    def _guard(self, d: Draft, expected_uuid: str | None, read_snapshot: int | None, operation: str) -> None:
        row = self.row(d.state)
        if row["end"] is not None or expected_uuid is not None and row["uuid"] != expected_uuid:
            raise IncarnationChanged(f"table {self.id} was dropped or made anew")
        if read_snapshot is not None:
            check_conflicts(d.state, self.id, read_snapshot, operation)

    def _check_not_null(self, staged: list[dict], fields: list[ty.Field]) -> None:
        for f in fields:
            if not f.get("nullable", True) and not f.get("children"):
                if any((s := x["stats"].get(str(f["id"]))) and s.get("nulls") for x in staged):
                    raise Invalid(f"column {f['name']!r} is not nullable and holds nulls")

    def _prefix(self, spec: list[dict], values: list[str | None]) -> str | None:
        """The folder that files of one partition lie in, where the table has a prefix column."""
        row = self.row()
        if (own := row["prefix_field"]) is None:
            return None
        (name,) = (f["name"] for f in self.fields() if f["id"] == own)
        value = next((v for p, v in zip(spec, values, strict=True) if p["field_id"] == own and p["transform"] == "identity"), None)
        return prefix_folder(local(row["location"]), name, value)

    def place(self, staged: list[dict], spec: list[dict], values: list[str | None] | None = None) -> list[dict]:
        """Staged files, moved below the folder of their prefix column's value; as they are without such a column.

        Null and negative values have no folder and are refused, before any file moves.
        """
        folders = [self._prefix(spec, f["values"] if values is None else values) for f in staged]
        out = []
        for f, folder in zip(staged, folders, strict=True):
            if folder is not None:
                path = f"{folder}/{uuid.uuid4().hex}.parquet"
                self.catalog.store.move(f["path"], path)
                f = {**f, "path": path}
            out.append(f)
        return out

    def _check_prefix(self, staged: list[dict]) -> None:
        """Files lie below their value's folder, and their statistics prove that they hold nothing else."""
        if (own := self.row()["prefix_field"]) is None:
            return
        spec = self.spec()["fields"]
        (kind,) = (f["type"] for f in self.fields() if f["id"] == own)
        for f in staged:
            folder = self._prefix(spec, f["values"])
            if not stays_under(f["path"], folder):
                raise Invalid(f"{f['path']} does not lie below {folder}")
            s = f["stats"].get(str(own))
            if f["stats_state"] != "provided" or not s or s.get("nulls") or s.get("lower") is None or s["lower"] != s["upper"] or bounds.decode(kind, bytes.fromhex(s["lower"])) != int(folder.rsplit("=", 1)[1]):
                raise Invalid("the statistics do not prove that a file holds one value of the prefix column")

    def stage(self, df: DataFrame, deferred: bool = False, max_rows: int | None = None) -> list[dict]:
        """Write rows without registering them."""
        spec = self.spec()["fields"]
        return self.place(stage(self.catalog, df, self.fields(), spec, self.sort(), self.row()["location"], deferred=deferred, max_rows=max_rows), spec)

    def append(self, df: DataFrame, expected_uuid: str | None = None, read_snapshot: int | None = None, key: str | None = None, deferred_stats: bool = False, max_rows: int | None = None, author: str | None = None, message: str | None = None) -> dict[str, Any]:
        """Add rows in one snapshot.  A key makes a retry of the same append return the first result."""
        if key and (known := self.catalog.receipt(key)):
            return known["result"]
        basis = self.catalog.head if read_snapshot is None else read_snapshot
        staged = self.stage(df, deferred_stats, max_rows)
        with Transaction(self.catalog, basis, author, message, key) as t:
            t.add_files(self, staged, expected_uuid)
        return t.result

    # -- row-level changes

    def matching(self, where: str, snapshot: int | None = None) -> DataFrame:
        """Positions of the rows that satisfy a condition: (__path, __pos)."""
        return self.scan(snapshot, where=where, lineage=True).select(F.col("filename").alias("__path"), F.col("file_row_number").alias("__pos"))

    def write_vectors(self, positions: DataFrame, at: int, pending: dict[int, dict] | None = None) -> list[dict]:
        """Deletion vectors that unite positions with the ones pending, or else registered; written on executors, one task per file."""
        plan = self.plan(at)
        if len({f["path"] for f, _ in plan}) < len(plan):
            raise Unsupported("a physical file is registered twice")
        if not plan:
            return []
        folder = f"{self.row()['location']}/vectors" if self.row()["prefix_field"] is None else None  # None: beside the file
        bases = [(pending or {}).get(f["id"], x) for f, x in plan]
        files = [(f["path"], f["record_count"], x and x["path"], x["count"] if x else 0) for (f, _), x in zip(plan, bases, strict=True)]
        known = self.spark.createDataFrame([(f[0], n) for n, f in enumerate(files)], "__path string, nth int")

        def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own, records, old, old_count = files[key[0]]
            new = np.unique(rows["__pos"].to_numpy(np.int64))
            if len(new) and new[-1] >= records:
                raise ValueError(f"position {new[-1]} is not in a file of {records} rows")
            if old is not None:
                new = np.union1d(new, dvs.decode(dvs.read_puffin(read_bytes(old)), old_count))
            data, _ = dvs.puffin(dvs.encode(new), len(new), own)
            path = f"{folder or own.rsplit('/', 1)[0]}/{uuid.uuid4().hex}.puffin"
            write_bytes(path, data)
            return pd.DataFrame({"nth": [key[0]], "vector": [path], "count": [len(new)]})

        # Numbers of files, not their names, go with each position.
        numbered = positions.join(F.broadcast(known) if len(files) <= BROADCAST_ROWS else known, "__path").select("nth", "__pos")
        found = numbered.groupBy("nth").applyInPandas(write, "nth int, vector string, count long").collect()
        return [{"file_id": f["id"], "path": r.vector, "count": r["count"], "old": x["id"] if x else None, "old_count": x["count"] if x else 0} for r in found for f, x in (plan[r.nth],)]

    def delete(self, where: str, **guards: Any) -> dict[str, Any]:
        """Delete rows by deletion vectors; the files stay."""
        with Transaction(self.catalog, **guards) as t:
            t.delete(self, where)
        return t.result

    def update(self, where: str, to: dict[str, str], **guards: Any) -> dict[str, Any]:
        """Delete the rows and append them changed, in one snapshot; they get new row ids."""
        with Transaction(self.catalog, **guards) as t:
            t.update(self, where, to)
        return t.result

    def merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None = None, insert: bool = True, delete: bool = False, **guards: Any) -> dict[str, Any]:
        """Upsert by key columns: matched rows are updated (expressions over `t` and `s`) or deleted, others inserted."""
        at = self.catalog.head
        saved = f"{self.row()['location']}/merging/{uuid.uuid4().hex}"
        source.write.parquet(saved)  # read several times, and the same each time
        source = self.spark.read.schema(source.schema).parquet(saved)
        target = self.scan(at, where=self._within(source, on[0], at), lineage=True).alias("t")
        same = [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in on]
        met = target.join(source.alias("s"), same, "inner")
        if not met.groupBy("filename", "file_row_number").count().where("count > 1").isEmpty():
            raise Invalid("several source rows match one row")
        with Transaction(self.catalog, at, **guards) as t:
            fields = self.fields(at)
            if update is not None or delete:
                t.delete_positions(self, met.select(F.col("filename").alias("__path"), F.col("file_row_number").alias("__pos")))
            if update is not None and not delete:
                t.append(self, met.select(*(F.expr(update[f["name"]]).alias(f["name"]) if f["name"] in update else F.col(f"t.`{f['name']}`") for f in fields)))
            if insert:
                keys = self.scan(at, columns=on).alias("t")
                t.append(self, source.alias("s").join(keys, same, "left_anti"))
        self.catalog.store.delete(saved)
        return t.result

    def _within(self, source: DataFrame, key: str, at: int) -> str | None:
        """A condition that holds for all rows whose whole-number key is between the source's, for pruning."""
        if ty.find(self.fields(at), key)["type"] not in ("int", "long"):
            return None
        r = source.agg(F.min(key).alias("low"), F.max(key).alias("high")).head()
        return f"`{key}` >= {r.low} AND `{key}` <= {r.high}" if r.low is not None else None

    def overwrite(self, df: DataFrame, all_files: bool = False, **guards: Any) -> dict[str, Any]:
        """Replace the partitions that the rows fall into (or everything) atomically."""
        with Transaction(self.catalog, **guards) as t:
            t.overwrite(self, df, all_files)
        return t.result

    def truncate(self, expected_uuid: str | None = None) -> dict[str, Any]:
        """End all files in one snapshot."""

        def build(d: Draft) -> None:
            self._guard(d, expected_uuid, None, "overwrite")
            for x in self._dvs(d.state["head"], d.state).values():
                d.do("end", set="dvs", id=x["id"])
            for f in self._files(d.state["head"], d.state):
                d.do("end", set="files", id=f["id"])
            d.changed("table_altered", self.id)
            d.changed("table_deleted_from", self.id)

        return self.catalog.commit(build)

    def drop(self, expected_uuid: str | None = None) -> None:
        def build(d: Draft) -> None:
            self._guard(d, expected_uuid, None, "overwrite")
            draft_drop(d, self.id)

        self.catalog.commit(build)

    # -- definitions

    def alter(self, *ops: tuple) -> dict[str, Any]:
        """Apply typed changes in one snapshot; see `alter.py` for the operations."""
        from .alter import alter

        return alter(self, ops)

    def changes(self, after: int, until: int | None = None):
        from .changes import changes

        return changes(self, after, until)


class Transaction:
    """Buffered changes of several tables, committed as one snapshot on leaving the block.

    Reads are pinned at the snapshot it began with.  It sees its own deletes,
    not its own inserts, so it refuses to change a table's rows after inserting.
    """

    def __init__(self, catalog: Catalog, read_snapshot: int | None = None, author: str | None = None, message: str | None = None, key: str | None = None):
        self.catalog, self.at = catalog, catalog.head if read_snapshot is None else read_snapshot
        self.author, self.message, self.key = author, message, key
        self.files: dict[int, tuple[Table, list[dict], str | None]] = {}
        self.vectors: dict[int, tuple[Table, list[dict]]] = {}
        self.ends: dict[int, tuple[Table, list[int], str]] = {}
        self.pending: dict[int, dict[int, dict]] = {}  # vectors by file id
        self.result: dict[str, Any] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if kind is None:
            self.commit()

    def add_files(self, table: Table, staged: list[dict], expected_uuid: str | None = None) -> None:
        fields = table.fields(table.catalog.head)
        table._check_not_null(staged, fields)
        table._check_prefix(staged)
        old = self.files.get(table.id, (table, [], None))
        self.files[table.id] = (table, [*old[1], *staged], expected_uuid or old[2])

    def append(self, table: Table, df: DataFrame, expected_uuid: str | None = None) -> None:
        self.add_files(table, table.stage(df), expected_uuid)

    def scan(self, table: Table, **options: Any) -> DataFrame:
        """Rows at the transaction's snapshot, without those it deleted."""
        return table.scan(self.at, **options, vectors=self.pending.get(table.id))

    def _no_inserts(self, table: Table) -> None:
        if table.id in self.files:
            raise Unsupported("rows were inserted into this table in the same transaction")

    def delete_positions(self, table: Table, positions: DataFrame) -> None:
        self._no_inserts(table)
        vectors = table.write_vectors(positions, self.at, self.pending.get(table.id))
        if vectors:
            own = self.pending.setdefault(table.id, {})
            own.update({v["file_id"]: v for v in vectors})
            self.vectors[table.id] = (table, list(own.values()))

    def delete(self, table: Table, where: str) -> None:
        self.delete_positions(table, table.matching(where, self.at))

    def update(self, table: Table, where: str, to: dict[str, str]) -> None:
        self._no_inserts(table)
        fields = table.fields(self.at)
        for name in to:
            ty.find(fields, name)
        rows = self.scan(table, where=where, lineage=True)
        changed = rows.select(*(F.expr(to[f["name"]]).alias(f["name"]) if f["name"] in to else F.col(f"`{f['name']}`") for f in fields))
        staged = table.stage(changed)
        self.delete_positions(table, rows.select(F.col("filename").alias("__path"), F.col("file_row_number").alias("__pos")))
        self.add_files(table, staged)

    def overwrite(self, table: Table, df: DataFrame, all_files: bool = False) -> None:
        self._no_inserts(table)
        spec_id = table.spec(self.at)["spec_id"]
        live = [f for f, _ in table.plan(self.at)]
        staged = table.stage(df)
        if not all_files:
            if any(f["spec_id"] != spec_id for f in live):
                raise Unsupported("a live file was written under another partitioning")
            own = {tuple(f["values"]) for f in staged}
            live = [f for f in live if tuple(f["values"]) in own]
        self.ends[table.id] = (table, [f["id"] for f in live], "overwrite")
        self.add_files(table, staged)

    def commit(self) -> dict[str, Any]:
        if not self.files and not self.vectors and not self.ends:
            return self.result

        def build(d: Draft) -> None:
            for table, ids, operation in self.ends.values():
                table._guard(d, None, self.at, operation)
                vectors = table._dvs(d.state["head"], d.state)
                for i in ids:
                    if d.state["files"][str(i)]["end"] is not None:
                        raise CommitConflict(f"file {i} is not live any more")
                    d.do("end", set="files", id=i)
                    if i in vectors:
                        d.do("end", set="dvs", id=vectors[i]["id"])
                if ids:
                    d.changed("table_deleted_from", table.id)
            for table, vectors in self.vectors.values():
                table._guard(d, None, self.at, "delete")
                live = table._dvs(d.state["head"], d.state)
                for v in vectors:
                    if d.state["files"][str(v["file_id"])]["end"] is not None:
                        raise CommitConflict(f"file {v['file_id']} is not live any more")
                    now = live.get(v["file_id"])
                    if (now["id"] if now else None) != v["old"]:
                        raise CommitConflict(f"file {v['file_id']} has another deletion vector")
                    if v["count"] == v["old_count"]:
                        continue
                    if now:
                        d.do("end", set="dvs", id=now["id"])
                    d.do("add", set="dvs", row={"id": d.id(), "table_id": table.id, "file_id": v["file_id"], "path": v["path"], "count": v["count"]})
                    d.changed("table_deleted_from", table.id)
            for table, staged, expected in self.files.values():
                table._guard(d, expected, self.at, "append")
                row = table.row(d.state)
                draft_files(d, table.id, table._at("specs", d.state["head"], d.state)["spec_id"], row["next_row"], staged)
                if staged:
                    d.changed("table_inserted_into", table.id)

        payload = [[t.id, [[f["record_count"], f["values"]] for f in s]] for t, s, _ in self.files.values()]
        self.result = self.catalog.commit(build, self.author, self.message, self.key, payload) or {}
        return self.result

