"""Partition transforms and wire strings, as Spark columns and as Python values.

Transforms follow the public Iceberg table specification.  Columns stay on the
JVM side, but for the bucket hash: no built-in computes Murmur3 with seed 0, so
it is an Arrow UDF.
"""

from __future__ import annotations

import base64
import datetime as dt
import re
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid, Unsupported
from . import bounds

M32 = 0xFFFFFFFF
_C1, _C2 = 0xCC9E2D51, 0x1B873593
BUCKETABLE = ("int8", "int16", "int", "long", "uint8", "uint16", "date", "time", "timestamp", "timestamptz", "string", "uuid", "binary", "decimal")
NOT_BUCKETABLE = {
    "boolean": "two values do not spread",
    "float": "equal numbers have several bit patterns",
    "double": "equal numbers have several bit patterns",
    "json": "equal documents have several texts",
    "uint32": "its hash would differ from that of a signed integer",
    "uint64": "wider than the hash's input",
    "timestamp_s": "its unit is not the hash's",
    "timestamp_ms": "its unit is not the hash's",
    "timestamp_ns": "its unit is not the hash's",
}
_TIMES = ("timestamp", "timestamptz", "timestamp_s", "timestamp_ms")
_EIGHT_BYTES = ("int8", "int16", "int", "long", "uint8", "uint16", "date", "time", "timestamp", "timestamptz")


def parse(transform: str) -> tuple[str, int]:
    m = re.fullmatch(r"(identity|year|month|day|hour|bucket|truncate)(?:\[(\d+)\])?", transform)
    if not m or (m[1] in ("bucket", "truncate")) != bool(m[2]) or m[2] and int(m[2]) < 1:
        raise Invalid(f"{transform!r} is not a transform")
    return m[1], int(m[2] or 0)


def check(transform: str, kind: str) -> None:
    """Whether the transform may partition a column of this type."""
    name, _ = parse(transform)
    if name == "truncate":
        raise Unsupported("truncate is a value function, not a partition transform")
    if kind in ("list", "struct", "map", "variant"):
        raise Unsupported(f"a {kind} column cannot partition")
    if name == "bucket" and kind not in BUCKETABLE:
        raise Unsupported(f"bucket of {kind}: {NOT_BUCKETABLE.get(kind, 'no hash is defined')}")
    if name in ("year", "month", "day") and kind not in ("date", *_TIMES) or name == "hour" and kind not in _TIMES:
        raise Unsupported(f"{name} of {kind}")
    if kind == "json" and name != "identity":
        raise Unsupported("json partitions by identity only")


def murmur3(data: bytes) -> int:
    """32-bit Murmur3, x86 variant, seed 0."""
    h = 0
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * _C1 & M32
        k = (k << 15 | k >> 17) & M32
        h ^= k * _C2 & M32
        h = ((h << 13 | h >> 19) & M32) * 5 + 0xE6546B64 & M32
    if tail := data[whole:]:
        k = int.from_bytes(tail, "little") * _C1 & M32
        h ^= ((k << 15 | k >> 17) & M32) * _C2 & M32
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> shift
        h = h * factor & M32
    return h ^ h >> 16


def murmur3_longs(x: np.ndarray) -> np.ndarray:
    """Murmur3 of each number's eight little-endian bytes; a batch at a time.

    As Spark columns the same takes an expression tree that doubles with every
    step, which costs seconds to compile; in numpy it takes nanoseconds a row.
    """
    bits = x.astype(np.int64).view(np.uint64)
    turned = lambda v, n: v << np.uint32(n) | v >> np.uint32(32 - n)
    h = np.zeros(len(x), np.uint32)
    for word in (bits.astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)):
        h ^= turned(word * np.uint32(_C1), 15) * np.uint32(_C2)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


@F.pandas_udf(T.LongType())
def long_hash(x: pd.Series) -> pd.Series:
    """Murmur3 of a bigint's eight little-endian bytes, from 0 to 2**32 - 1."""
    there = x.notna()
    out = pd.Series(pd.array([None] * len(x), "Int64"), index=x.index)
    out[there] = murmur3_longs(x[there].to_numpy(np.int64)).astype(np.int64)
    return out


def murmur3_bytes(values: list[bytes]) -> np.ndarray:
    """Murmur3 of byte strings, all of one length at a time."""
    turned = lambda v, n: v << np.uint32(n) | v >> np.uint32(32 - n)
    lengths = np.array([len(v) for v in values], np.int64)
    out = np.zeros(len(values), np.uint32)
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        padded = np.zeros((len(where), -(-n // 4) * 4), np.uint8)
        padded[:, :n] = np.frombuffer(b"".join(values[i] for i in where.tolist()), np.uint8).reshape(len(where), n)
        words = padded.view("<u4").astype(np.uint32)
        h = np.zeros(len(where), np.uint32)
        for k in range(words.shape[1]):
            h ^= turned(words[:, k] * np.uint32(_C1), 15) * np.uint32(_C2)
            if k < n // 4:  # what is left of a word is only mixed in
                h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(n)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[where] = h ^ h >> np.uint32(16)
    return out


@F.pandas_udf(T.LongType())
def _bytes_hash(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series(pd.array([None] * len(data), "Int64"), index=data.index)
    out[there] = murmur3_bytes([bytes(b) for b in data[there]]).astype(np.int64)
    return out


def _as_long(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "timestamptz":
        return F.unix_micros(c)
    if kind in _TIMES:
        return micros(c)
    return c.cast("long")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    days = F.unix_date(c.cast("date")).cast("long")
    seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long")
    return days * 86_400_000_000 + seconds * 1_000_000 + F.rint(F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def apply(transform: str, kind: str, c: Column, scale: int = 0) -> Column:
    """The transform's value; null stays null."""
    name, n = parse(transform)
    if name == "identity":
        return c
    if name == "bucket":
        if kind in _EIGHT_BYTES:
            hashed = long_hash(_as_long(c, kind))
        elif kind == "string":
            hashed = _bytes_hash(c.cast("binary"))
        elif kind == "uuid":
            hashed = _bytes_hash(F.unhex(F.replace(c, F.lit("-"), F.lit(""))))
        elif kind == "binary":
            hashed = _bytes_hash(c)
        else:
            hashed = _bytes_hash(_decimal_bytes(c.cast("string")))
        return F.pmod(hashed.bitwiseAND(0x7FFFFFFF), F.lit(n)).cast("int")
    if name == "truncate":
        if kind in ("string", "json"):
            return F.substring(c, 1, n)
        if kind == "binary":
            return F.substring(c, 1, n)
        if kind == "decimal":
            return c - F.pmod(c, (F.lit(Decimal(n).scaleb(-scale))))
        return (c - F.pmod(c, F.lit(n))).cast("long")
    if name == "year":
        return F.year(c) - 1970
    if name == "month":
        return (F.year(c) - 1970) * 12 + F.month(c) - 1
    if name == "day":
        return F.unix_date(c.cast("date"))
    return (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)).cast("int")


@F.pandas_udf(T.BinaryType())
def _decimal_bytes(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        d = Decimal(t)
        return bounds.encode("decimal", d, -d.as_tuple().exponent)

    return text.map(one)


def value(transform: str, kind: str, v: Any, scale: int = 0) -> Any:
    """The same for one Python value, as pruning needs it; dates and times as `bounds.decode` gives them."""
    name, n = parse(transform)
    if v is None or name == "identity":
        return v
    if name == "bucket":
        if kind in _EIGHT_BYTES:
            data = int(v).to_bytes(8, "little", signed=True)
        else:
            data = bounds.encode(kind, v, scale)
        return (murmur3(data) & 0x7FFFFFFF) % n
    if name == "truncate":
        if kind in ("string", "json", "binary"):
            return v[:n]
        step = Decimal(n).scaleb(-scale) if kind == "decimal" else n
        return v - (v % step + step) % step
    days = v if kind == "date" else v // 86_400_000_000
    date = dt.date(1970, 1, 1) + dt.timedelta(days)
    return {"year": date.year - 1970, "month": (date.year - 1970) * 12 + date.month - 1, "day": days, "hour": v // 3_600_000_000}[name]


def wire(kind: str, c: Column) -> Column:
    """A value as its partition string: decimal numbers, ISO dates, microseconds in six digits or not at all."""
    if kind == "boolean":
        return F.when(c, "true").when(~c, "false")
    if kind in _TIMES:
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        rest = F.pmod(F.rint(F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"), F.lit(1_000_000))
        text = F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
        return F.concat(text, F.lit("+00:00")) if kind == "timestamptz" else text
    if kind == "binary":
        return F.base64(c)
    if kind in ("float", "double"):
        return _repr(c.cast("double"))
    return c.cast("string")


@F.pandas_udf(T.StringType())
def _repr(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else repr(float(v)))


def wire_value(kind: str, v: Any) -> str | None:
    """The partition string of one Python value, dates and times as `bounds.decode` gives them."""
    if v is None:
        return None
    if kind == "boolean":
        return "true" if v else "false"
    if kind == "date":
        return (dt.date(1970, 1, 1) + dt.timedelta(v)).isoformat()
    if kind in _TIMES:
        text = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v)).isoformat()
        return text + "+00:00" if kind == "timestamptz" else text
    if kind == "binary":
        return base64.b64encode(v).decode()
    return repr(v) if isinstance(v, float) else str(v)


def unwire(kind: str, text: str | None) -> Any:
    """The value of a partition string."""
    if text is None:
        return None
    if kind == "boolean":
        return text == "true"
    if kind == "date":
        return (dt.date.fromisoformat(text) - dt.date(1970, 1, 1)).days
    if kind in _TIMES:
        return bounds._micros(dt.datetime.fromisoformat(text))
    if kind == "binary":
        return base64.b64decode(text)
    if kind in ("float", "double"):
        return float(text)
    if kind in ("decimal", "uint64"):
        return Decimal(text)
    return text if kind in ("string", "json", "uuid") else int(text)


def result_kind(transform: str, kind: str) -> str:
    return kind if parse(transform)[0] in ("identity", "truncate") else "int"


def display(transform: str, kind: str, text: str | None) -> str | None:
    """A stored partition string for people; what cannot be read stays as it is."""
    name, n = parse(transform)
    if text is None or name == "identity":
        return text
    try:
        v = int(text)
        if abs(v) > 2**53:
            return text
        if name == "bucket":
            return f"bucket {v}/{n}"
        if name == "year":
            return f"{1970 + v:04d}"
        if name == "month":
            return f"{1970 + v // 12:04d}-{v % 12 + 1:02d}"
        start = dt.datetime(1970, 1, 1) + (dt.timedelta(v) if name == "day" else dt.timedelta(hours=v))
        return start.date().isoformat() if name == "day" else start.strftime("%Y-%m-%dT%H")
    except (ValueError, OverflowError):
        return text
