"""Strict coercion of JSON values to column types.

A value that does not fit exactly is refused with a reason, never bent: no
rounding, no numbers from text (but for decimals), no text from numbers.
"""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import math
import uuid
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import types as ty
from ..errors import CoercionError
from .variant import strict_json

FLOAT_MAX = 3.4028234663852886e38
_EPOCH = dt.datetime(1970, 1, 1)
_UNITS = {"timestamp_s": 1_000_000, "timestamp_ms": 1000, "timestamp": 1, "timestamptz": 1}
_FIRST, _LAST = dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)


def _refuse(kind: str, why: str) -> CoercionError:
    return CoercionError(f"{kind}: {why}")


def _integer(kind: str, v: Any) -> int:
    if isinstance(v, bool) or not isinstance(v, int):
        raise _refuse(kind, "not an integer")
    low, high = ty.RANGES[kind]
    if not low <= v <= high:
        raise _refuse(kind, "out of range")
    return v


def _number(kind: str, v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise _refuse(kind, "not a number")
    try:
        v = float(v)
    except OverflowError:
        raise _refuse(kind, "out of range") from None
    if not math.isfinite(v) or kind == "float" and abs(v) > FLOAT_MAX:
        raise _refuse(kind, "out of range")
    return v


def _text(kind: str, v: Any) -> str:
    if not isinstance(v, str):
        raise _refuse(kind, "not a text")
    try:
        v.encode()
    except UnicodeEncodeError:
        raise _refuse(kind, "not valid Unicode") from None
    return v


def _decimal(field: ty.Field, v: Any) -> Decimal:
    if isinstance(v, bool) or not isinstance(v, (int, str)):
        raise _refuse("decimal", "not an integer or a decimal text")
    try:
        d = Decimal(v)
    except InvalidOperation:
        raise _refuse("decimal", "not a decimal text") from None
    if not d.is_finite():
        raise _refuse("decimal", "not finite")
    scaled = d.scaleb(field["scale"])
    if scaled != scaled.to_integral_value() or abs(int(scaled)) >= 10 ** field["precision"]:
        raise _refuse("decimal", "does not fit exactly")
    return d


def clamp(moment: dt.datetime) -> dt.datetime:
    return min(max(moment, _FIRST), _LAST)


def _timestamp(kind: str, v: Any) -> dt.datetime:
    if isinstance(v, bool):
        raise _refuse(kind, "not a time")
    if isinstance(v, int):
        try:
            return clamp(_EPOCH + dt.timedelta(microseconds=v * _UNITS[kind]))
        except OverflowError:
            return _LAST if v > 0 else _FIRST
    text = _text(kind, v)
    try:
        moment = dt.datetime.fromisoformat(text)
    except ValueError:
        raise _refuse(kind, "not an ISO time") from None
    if moment.tzinfo is not None:
        if kind != "timestamptz":
            raise _refuse(kind, "has an offset")
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if moment.microsecond % _UNITS[kind]:
        raise _refuse(kind, "finer than its unit")
    return moment


def coerce(field: ty.Field, v: Any) -> Any:
    """The column's value of a JSON value; raises `CoercionError` with a reason."""
    kind, children = field["type"], field.get("children") or []
    if v is None:
        if not field.get("nullable", True):
            raise _refuse(field["name"], "null in a column that is not nullable")
        return None
    if kind == "boolean":
        if not isinstance(v, bool):
            raise _refuse(kind, "not true or false")
        return v
    if kind == "uint64":
        return Decimal(_integer(kind, v))
    if kind in ty.RANGES:
        return _integer(kind, v)
    if kind in ("float", "double"):
        return _number(kind, v)
    if kind == "string":
        return _text(kind, v)
    if kind == "binary":
        try:
            return base64.b64decode(_text(kind, v), validate=True)
        except (binascii.Error, ValueError):
            raise _refuse(kind, "not base64") from None
    if kind == "uuid":
        try:
            return str(uuid.UUID(_text(kind, v)))
        except ValueError:
            raise _refuse(kind, "not a UUID") from None
    if kind == "decimal":
        return _decimal(field, v)
    if kind == "date":
        if isinstance(v, int) and not isinstance(v, bool):
            try:
                return dt.date(1970, 1, 1) + dt.timedelta(v)
            except OverflowError:
                raise _refuse(kind, "out of range") from None
        try:
            return dt.date.fromisoformat(_text(kind, v))
        except ValueError:
            raise _refuse(kind, "not an ISO date") from None
    if kind == "time":
        if isinstance(v, int) and not isinstance(v, bool):
            if not 0 <= v < 86_400_000_000:
                raise _refuse(kind, "out of range")
            return v
        try:
            t = dt.time.fromisoformat(_text(kind, v))
        except ValueError:
            raise _refuse(kind, "not an ISO time of day") from None
        return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond
    if kind == "timestamp_ns":
        if isinstance(v, int):
            return _integer("long", v)
        return int((_timestamp("timestamp", v) - _EPOCH) / dt.timedelta(microseconds=1)) * 1000
    if kind in _UNITS:
        return _timestamp(kind, v)
    if kind == "json":
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    if kind == "variant":
        raise _refuse(kind, "variants are made from text, see to_variant")
    if kind == "struct":
        if not isinstance(v, dict):
            raise _refuse(kind, "not an object")
        return tuple(coerce(c, v.get(c["name"])) for c in children)
    if kind == "list":
        if not isinstance(v, list):
            raise _refuse(kind, "not an array")
        return [coerce(children[0], x) for x in v]
    if not isinstance(v, dict):
        raise _refuse("map", "not an object")
    out: dict[Any, Any] = {}
    for k, x in v.items():
        key = _key(children[0], k)
        if key in out:
            raise _refuse("map", "two keys are the same")
        out[key] = coerce(children[1], x)
    return out


def _key(field: ty.Field, text: str) -> Any:
    """A map's key: its text where the type takes text, else the JSON value that the text spells."""
    try:
        return coerce(field, text)
    except CoercionError:
        try:
            return coerce(field, strict_json(text))
        except ValueError:
            raise _refuse("map", f"key is not a {field['type']}") from None


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed inside: a dropped record has none of its values."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    return kind


def coercer(fields: list[ty.Field]):
    """A UDF: JSON object text -> struct of the columns and ``drop_reason`` (null where the record is whole).

    Unknown keys are ignored, absent ones are null.
    """
    schema = T.StructType([T.StructField(f["name"], _nullable(ty.spark_type(f)), True) for f in fields] + [T.StructField("drop_reason", T.StringType())])

    kind = to_arrow_type(schema)

    def one(text: str | None) -> dict[str, Any]:
        try:
            if text is None:
                raise CoercionError("record: no value")
            try:
                v = strict_json(text)
            except (ValueError, RecursionError):
                raise CoercionError("record: not JSON") from None
            if not isinstance(v, dict):
                raise CoercionError("record: not an object")
            return {f["name"]: _plain(f, coerce(f, v.get(f["name"]))) for f in fields}
        except CoercionError as e:
            return {"drop_reason": e.reason}

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(map(one, texts.to_pylist())), kind)

    return run


def _plain(field: ty.Field, v: Any) -> Any:
    """A value as Arrow takes it: structs by name, maps as pairs."""
    children = field.get("children") or []
    if v is None or not children:
        return v
    if field["type"] == "struct":
        return {c["name"]: _plain(c, x) for c, x in zip(children, v, strict=True)}
    if field["type"] == "list":
        return [_plain(children[0], x) for x in v]
    return [(_plain(children[0], k), _plain(children[1], x)) for k, x in v.items()]


def coerce_json(text: Column, fields: list[ty.Field]) -> Column:
    return coercer(fields)(text)


