"""The type vocabulary of tables and its Spark types.

A column is a plain dict: id, name, type, nullable, and as needed precision,
scale, children, comment.  Ids are given depth-first, parent before children,
and never change; files are read by them.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import types as T

from .errors import Invalid, Unsupported

Field = dict[str, Any]

#: All type names.
SCALARS = {
    "boolean": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "timestamp_s": T.TimestampNTZType(),
    "timestamp_ms": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp_ns": T.LongType(),
    "timestamptz": T.TimestampType(),
    "string": T.StringType(),
    "json": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
    "variant": T.VariantType(),
}
CONTAINERS = ("list", "struct", "map")
REFUSED = {
    "interval": "no fixed length and no order",
    "int128": "wider than any physical integer; use decimal(38, 0)",
    "uint128": "wider than any physical integer; use decimal(38, 0)",
    "timetz": "a time of day with an offset has no physical type",
    "geometry": "no physical type",
}
#: What a column may be promoted to.
PROMOTIONS = {
    "int8": ("int16", "int", "long"),
    "int16": ("int", "long"),
    "int": ("long",),
    "uint8": ("uint16", "uint32"),
    "uint16": ("uint32",),
    "float": ("double",),
}
RANGES = {"int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,127}")
RESERVED_PREFIX = "_tide"
ROW_ID = "_tide_row_id"
ROW_ID_FIELD = 2147483646
MAX_DEPTH, MAX_NODES = 8, 10_000
FIELD_ID = "parquet.field.id"


def check_name(name: str) -> str:
    if not IDENTIFIER.fullmatch(name or ""):
        raise Invalid(f"{name!r} is not an identifier")
    return name


def spark_type(field: Field) -> T.DataType:
    kind, children = field["type"], field.get("children") or []
    if kind == "decimal":
        return T.DecimalType(field["precision"], field["scale"])
    if kind == "list":
        return T.ArrayType(spark_type(children[0]), children[0].get("nullable", True))
    if kind == "map":
        return T.MapType(spark_type(children[0]), spark_type(children[1]), children[1].get("nullable", True))
    if kind == "struct":
        return struct_type(children)
    return SCALARS[kind]


def struct_type(fields: list[Field], files: bool = True) -> T.StructType:
    """The Spark schema; with `files`, every column nullable and carrying its id, as files are read and written."""
    return T.StructType([T.StructField(f["name"], spark_type(f), True if files else f.get("nullable", True), {FIELD_ID: f["id"]} if files else {}) for f in fields])


def from_spark(kind: T.DataType) -> Field:
    """Type part of a column from a Spark type."""
    exact = {T.BooleanType: "boolean", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.StringType: "string", T.BinaryType: "binary", T.VariantType: "variant"}
    if type(kind) in exact:
        return {"type": exact[type(kind)]}
    if isinstance(kind, T.DecimalType):
        return {"type": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.ArrayType):
        return {"type": "list", "children": [{"name": "element", "nullable": kind.containsNull, **from_spark(kind.elementType)}]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "children": [{"name": "key", "nullable": False, **from_spark(kind.keyType)}, {"name": "value", "nullable": kind.valueContainsNull, **from_spark(kind.valueType)}]}
    if isinstance(kind, T.StructType):
        return {"type": "struct", "children": fields_from_spark(kind)}
    raise Unsupported(f"no column type for {kind.simpleString()}")


def fields_from_spark(schema: T.StructType, keep_not_null: bool = False) -> list[Field]:
    return [{"name": f.name, "nullable": f.nullable or not keep_not_null, **from_spark(f.dataType)} for f in schema.fields]


def parse_type(text: str) -> Field:
    """Type part of a column from text such as ``decimal(12,3)`` or a Spark DDL type."""
    text = text.strip()
    if text in SCALARS:
        return {"type": text}
    if text in REFUSED:
        raise Unsupported(f"{text}: {REFUSED[text]}")
    if m := re.fullmatch(r"decimal\((\d+)\s*,\s*(\d+)\)", text):
        return {"type": "decimal", "precision": int(m[1]), "scale": int(m[2])}
    return from_spark(T.DataType.fromDDL(text))


def assign_ids(fields: list[Field], next_id: int) -> tuple[list[Field], int]:
    """Copies with ids, depth-first, parent before children."""
    out = []
    for f in fields:
        own, next_id = next_id, next_id + 1
        children, next_id = assign_ids(f.get("children") or [], next_id)
        out.append({**f, "id": own, "nullable": f.get("nullable", True), "children": children})
    return out, next_id


def check_fields(fields: list[Field], depth: int = 1, top: bool = True) -> int:
    """Structural rules; returns the number of nodes."""
    if depth > MAX_DEPTH:
        raise Invalid(f"nested deeper than {MAX_DEPTH}")
    seen: set[str] = set()
    total = 0
    for f in fields:
        kind, children = f["type"], f.get("children") or []
        check_name(f["name"])
        if top and f["name"].lower().startswith(RESERVED_PREFIX):
            raise Invalid(f"{f['name']!r}: names that start with {RESERVED_PREFIX} are reserved")
        if f["name"].lower() in seen:
            raise Invalid(f"column {f['name']!r} is there twice")
        seen.add(f["name"].lower())
        if kind in REFUSED:
            raise Unsupported(f"{kind}: {REFUSED[kind]}")
        if kind not in SCALARS and kind not in CONTAINERS and kind != "decimal":
            raise Unsupported(f"unknown type {kind!r}")
        if kind == "decimal" and not 0 <= f["scale"] <= f["precision"] <= 38:
            raise Invalid("decimal needs 0 <= scale <= precision <= 38")
        names = [c["name"] for c in children]
        if kind == "list" and names != ["element"] or kind == "map" and names != ["key", "value"] or kind == "struct" and not names:
            raise Invalid(f"{kind} has wrong children {names}")
        if kind == "map" and children[0].get("nullable", True):
            raise Invalid("a map's key is required")
        total += 1 + (check_fields(children, depth + 1, False) if children else 0)
    if total > MAX_NODES:
        raise Invalid(f"more than {MAX_NODES} columns")
    return total


def find(fields: list[Field], path: str) -> Field:
    """The column at a dotted path; case-insensitive, ambiguity is an error."""
    head, _, rest = path.partition(".")
    exact = [f for f in fields if f["name"] == head]
    loose = exact or [f for f in fields if f["name"].lower() == head.lower()]
    if len(loose) != 1:
        raise Invalid(f"column {path!r} is {'ambiguous' if loose else 'not there'}")
    return find(loose[0].get("children") or [], rest) if rest else loose[0]


def leaves(fields: list[Field], path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Field]]:
    out = []
    for f in fields:
        own = (*path, f["name"])
        out += leaves(f["children"], own) if f.get("children") else [(own, f)]
    return out
