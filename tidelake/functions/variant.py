"""Variants from JSON text, with stricter rules than the built-in parser."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid

#: Fixed limits of shredding declarations and of JSON values.
SHRED_DEPTH, SHRED_FIELDS, SHRED_PATH = 16, 1000, 1024
JSON_DEPTH, JSON_DIGITS = 128, 38


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is there twice")
    return out


def _no_constant(text: str) -> Any:
    raise ValueError(f"{text} is not JSON")


def _float(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("out of range")
    return value


def _int(text: str) -> int:
    if len(text.lstrip("-")) > JSON_DIGITS:
        raise ValueError("too many digits")
    return int(text)


def _depth(value: Any, level: int = 1) -> None:
    if level > JSON_DEPTH + 1:
        raise ValueError("nested too deep")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(x, level + 1)


def strict_json(text: str) -> Any:
    """The value of a JSON text; repeated keys, NaN, infinities, lone surrogates, deep nesting and long integers are errors."""
    value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant, parse_float=_float, parse_int=_int)
    _depth(value)
    if re.search(r"\\u[dD][89a-fA-F]", text):
        json.dumps(value, ensure_ascii=False).encode()
    return value


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        # Numbers that are not integers are doubles: the exponent form keeps the parser from making decimals.
        return _dump(strict_json(text))
    except (ValueError, RecursionError):
        return None


def _dump(value: Any) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    if isinstance(value, float):
        text = repr(value)
        return text if "e" in text else f"{text}e0"
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _checked(text: pd.Series) -> pd.Series:
    return text.map(_canonical)


def to_variant(text: Column) -> Column:
    """A variant, or null where the text is not strict JSON."""
    return F.try_parse_json(_checked(text))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Compact JSON with keys in their own order, or null where the text is not strict JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(strict_json(t), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def check_shredding(declaration: dict[str, str]) -> None:
    """Paths (dotted) with the type that each is stored as."""
    if len(declaration) > SHRED_FIELDS:
        raise Invalid(f"more than {SHRED_FIELDS} shredded fields")
    for path, kind in declaration.items():
        parts = path.split(".")
        if not all(parts) or len(parts) > SHRED_DEPTH or len(path.encode()) > SHRED_PATH:
            raise Invalid(f"shredded path {path!r}")
        if any(path != other and other.startswith(path + ".") for other in declaration):
            raise Invalid(f"{path!r} is a value and an object")
        if kind not in ("boolean", "int8", "int16", "int", "long", "float", "double", "date", "timestamp", "timestamptz", "string", "binary", "uuid") and not re.fullmatch(r"decimal\(\d+,\s*\d+\)", kind):
            raise Invalid(f"{kind!r} cannot be shredded")


def get(v: Column, path: str, kind: str) -> Column:
    """A path of a variant as a Spark type, null where it is absent or of another type."""
    return F.try_variant_get(v, path, kind)


def decimal_scale(text: str) -> int:
    return -Decimal(text).as_tuple().exponent
