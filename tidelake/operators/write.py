"""Writing data files: partition fan-out, per-file order, footers.

A write is one Spark job into a folder of its own; nothing is visible until the
commit that registers its files.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..errors import Invalid
from ..functions import bounds, transforms
from ..sources.store import is_local, local

#: Footers read on the driver at most; more are read by a Spark job.
FOOTERS_HERE = 64
#: Types that a prefix column may have.
PREFIX_TYPES = ("int8", "int16", "int", "long", "uint8", "uint16", "uint32")
#: Files under this size get no bounds from a deferred hydration.
SMALL_FILE = 1 << 20


def conform(df: DataFrame, fields: list[ty.Field]) -> DataFrame:
    """The rows in the table's columns and types: by name, missing columns null, no others."""
    names = {c.lower(): c for c in df.columns}
    if len(names) < len(df.columns):
        raise Invalid("column names are ambiguous")
    if extra := set(names) - {f["name"].lower() for f in fields}:
        raise Invalid(f"columns {sorted(extra)} are not in the table")
    return df.select(*(F.col(f"`{names[f['name'].lower()]}`").cast(ty.spark_type(f)).alias(f["name"]) if f["name"].lower() in names else F.lit(None).cast(ty.spark_type(f)).alias(f["name"]) for f in fields))


def order_columns(fields: list[ty.Field], sort: list[dict]) -> list[Column]:
    """A sort specification as columns: floats by total order, nulls as told whatever the direction."""
    by_id = {f["id"]: (path, f) for path, f in ty.leaves(fields)}
    out = []
    for s in sort:
        path, f = by_id[s["field_id"]]
        c = F.col(".".join(f"`{p}`" for p in path))
        ascending = s["direction"] == "asc"
        ends = {(True, "first"): "asc_nulls_first", (True, "last"): "asc_nulls_last", (False, "first"): "desc_nulls_first", (False, "last"): "desc_nulls_last"}[ascending, s["nulls"]]
        out.append(getattr(c, ends)())
        if f["type"] in ("float", "double"):  # -0.0 and 0.0 tie in Spark
            minus = F.startswith(c.cast("string"), F.lit("-"))
            out.append((~minus).asc() if ascending else (~minus).desc())
    return out


def _wires(fields: list[ty.Field], spec: list[dict]) -> list[Column]:
    by_id = {f["id"]: (path, f) for path, f in ty.leaves(fields)}
    out = []
    for s in spec:
        path, f = by_id[s["field_id"]]
        value = transforms.apply(s["transform"], f["type"], F.col(".".join(f"`{p}`" for p in path)), f.get("scale", 0))
        text = transforms.wire(transforms.result_kind(s["transform"], f["type"]), value)
        # As a folder name: never a null marker, a separator or an empty name.
        out.append(F.coalesce(F.concat(F.lit("v"), F.hex(text.cast("binary"))), F.lit("n")))
    return out


def prefix_folder(location: str, column: str, value: str | None) -> str:
    """The folder of all files that hold one value of a prefix column: a decimal without sign or leading zeros."""
    if value is None or not re.fullmatch("0|[1-9][0-9]{0,18}", value) or int(value) >= 2**63:
        raise Invalid(f"{value!r} is no value of a prefix")
    return f"{location}/{column}={value}"


def stays_under(path: str, folder: str) -> bool:
    """Whether a path lies below a folder however a reader may normalise it."""
    if not path.startswith(f"{folder}/") or re.search(r"[\s\\\x00-\x1f\x7f-\x9f]|%2[eEfF]", path):
        return False
    return not {"", ".", ".."} & set(path[len(folder) + 1 :].split("/"))


def _unfold(name: str) -> str | None:
    return None if name == "n" else bytes.fromhex(name[1:]).decode()


def stage(catalog, df: DataFrame, fields: list[ty.Field], spec: list[dict], sort: list[dict], folder: str, extra: list[T.StructField] | None = None, codec: str = "snappy", deferred: bool = False, max_rows: int | None = None, spread: bool = True) -> list[dict[str, Any]]:
    """Write rows as Parquet files with field ids; one dict per file, in path order.

    Partitioned rows are first brought together by partition, so that the
    number of files does not grow with tasks times partitions; AQE splits a
    partition that holds too much.
    """
    extra = extra or []
    rows = df if extra else conform(df, fields)
    schema = T.StructType([*ty.struct_type(fields).fields, *extra])
    keys = [f"__p{i}" for i in range(len(spec))]
    if keys:
        rows = rows.withColumns(dict(zip(keys, _wires(fields, spec), strict=True)))
        if spread:
            rows = rows.hint("rebalance", *[F.col(k) for k in keys])
    order = order_columns(fields, sort)
    if order:
        rows = rows.sortWithinPartitions(*keys, *order)
    rows = rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields), *keys)
    target = f"{folder}/{uuid.uuid4().hex}"
    writer = rows.write.option("compression", codec)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(target)
    found = []
    for path, size in catalog.store.files(target):
        if path.endswith(".parquet"):
            parts = [p.split("=", 1)[1] for p in path.split("/") if p.startswith("__p") and "=" in p]
            found.append({"path": local(path) if is_local(path) else path, "size": size, "values": [_unfold(p) for p in parts]})
    stats = footers(catalog.spark, [f["path"] for f in found], fields, deferred)
    for f in found:
        f.update(stats[f["path"]])
    return [f for f in found if f["record_count"]]


def _footer(path: str, fields: list[ty.Field], deferred: bool = False) -> dict[str, Any]:
    """Row count, row group starts and per-leaf statistics of a file, from its footer alone."""
    import pyarrow.parquet as pq

    if is_local(path):
        meta = pq.read_metadata(local(path))
    else:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(path)
        with files.open_input_file(at) as f:
            meta = pq.read_metadata(f)
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    starts = []
    for g in groups:
        c = g.column(0)
        starts.append(min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x) if g.num_columns else 0)
    out: dict[str, Any] = {"record_count": meta.num_rows, "split_offsets": starts, "stats_state": "pending" if deferred else "provided", "stats": {}}
    if deferred:
        return out
    by_path = {".".join(path): leaf for path, leaf in ty.leaves(fields)}
    places: dict[str, list] = {}
    for g in groups:
        for i in range(g.num_columns):
            c = g.column(i)
            places.setdefault(c.path_in_schema.replace(".list.element", ".element").replace(".key_value.", "."), []).append(c)
    for name, chunks in places.items():
        leaf = by_path.get(name)
        if leaf is None or leaf["type"] == "variant":
            continue
        out["stats"][str(leaf["id"])] = merge_chunks(leaf, [_chunk(c) for c in chunks])
    return out


def _chunk(c) -> dict[str, Any]:
    s = c.statistics
    known = s is not None and s.has_min_max
    try:
        low, high = (s.min, s.max) if known else (None, None)
    except (ValueError, OverflowError):
        low = high = None
    return {"values": c.num_values, "nulls": s.null_count if s is not None and s.has_null_count else None, "low": low, "high": high}


def merge_chunks(leaf: ty.Field, chunks: list[dict[str, Any]]) -> dict[str, Any]:
    """One statistic of several row groups: sums of counts, least and greatest bounds, absent where any is unreadable."""
    kind, scale = leaf["type"], leaf.get("scale", 0)
    values = sum(c["values"] for c in chunks)
    nulls = None if any(c["nulls"] is None for c in chunks) else sum(c["nulls"] for c in chunks)
    full = [c for c in chunks if c["nulls"] is None or c["nulls"] < c["values"]]
    ends: dict[str, str | None] = {"lower": None, "upper": None}
    if full and all(c["low"] is not None and c["high"] is not None for c in full):
        for side, pick, at in (("lower", min, "low"), ("upper", max, "high")):
            coded = [bounds.encode(kind, c[at], scale) for c in full if not (isinstance(c[at], float) and math.isnan(c[at]))]
            decoded = [bounds.decode(kind, b, scale) for b in coded]
            if len(decoded) == len(full):
                best = pick(decoded, key=lambda v: bounds.order_key(kind, v))
                best = bounds.normalize(kind, best, side == "upper")
                ends[side] = (coded[decoded.index(best)] if kind not in ("float", "double") else bounds.encode(kind, best)).hex()
    return bounds.sane(kind, {"values": values, "nulls": nulls, "nans": None, **ends}, scale)


def _lenient(path: str, fields: list[ty.Field]) -> dict[str, Any]:
    try:
        return _footer(path, fields)
    except FileNotFoundError:
        return {"error": "missing"}
    except OSError:
        return {"error": "unreadable"}


def footers(spark, paths: list[str], fields: list[ty.Field], deferred: bool = False, lenient: bool = False) -> dict[str, dict[str, Any]]:
    """Footers by path; a `lenient` read tells of missing and unreadable files instead of failing."""
    one = (lambda p: _lenient(p, fields)) if lenient else (lambda p: _footer(p, fields, deferred))
    if len(paths) <= FOOTERS_HERE:
        return {p: one(p) for p in paths}
    import json

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "stats": [json.dumps(one(p)) for p in b["path"]]})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return {r.path: json.loads(r.stats) for r in rows.mapInPandas(read, "path string, stats string").collect()}
