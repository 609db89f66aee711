import datetime as dt
import math
import struct
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake import types as ty
from tidelake.errors import CoercionError, CorruptDeletionVector, Invalid, Unsupported
from tidelake.functions import bounds
from tidelake.functions.coerce import coerce
from tidelake.functions.variant import check_shredding, strict_json
from tidelake.sources import dv


def test_murmur_vectors(spark):
    from tidelake.functions import transforms as tr

    assert tr.murmur3((34).to_bytes(8, "little")) == 2017239379
    assert tr.murmur3(b"iceberg") == 1210000089
    x = np.array([0, 1, -1, 34, 2**63 - 1, -(2**63)], np.int64)
    texts = [b"", b"a", b"ab", b"abc", b"abcd", b"iceberg", "é𝒳".encode() * 9, b"iceberg", bytes(range(250, 256))]
    assert tr.murmur3_bytes(texts).tolist() == [tr.murmur3(b) for b in texts] and len(tr.murmur3_bytes([])) == 0
    assert tr.murmur3_longs(x).tolist() == [tr.murmur3(int(v).to_bytes(8, "little", signed=True)) for v in x]


def test_transform_columns_equal_values(spark):
    from tidelake.functions import transforms as tr

    moments = [dt.datetime(1969, 12, 31, 23, 59, 59, 900000), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 13, 5, 7, 250), dt.datetime(1900, 3, 1)]
    df = spark.createDataFrame([(m, i * 7 - 9, "héllo" + "x" * i, Decimal(i) - Decimal("1.25")) for i, m in enumerate(moments)], "ts timestamp_ntz, n long, s string, d decimal(9,2)")
    for name in ("year", "month", "day", "hour", "bucket[16]"):
        for row in df.select("ts", tr.apply(name, "timestamp", F.col("ts")).alias("v")).collect():
            assert row.v == tr.value(name, "timestamp", bounds._micros(row.ts)), (name, row)
    for name, kind, c in (("bucket[7]", "long", "n"), ("truncate[5]", "long", "n"), ("bucket[7]", "string", "s"), ("truncate[3]", "string", "s"), ("bucket[9]", "decimal", "d"), ("truncate[50]", "decimal", "d")):
        for row in df.select(c, tr.apply(name, kind, F.col(c), 2).alias("v")).collect():
            assert row.v == tr.value(name, kind, row[0], 2), (name, row)


def test_wire_strings(spark):
    from tidelake.functions import transforms as tr

    row = spark.sql("SELECT timestamp_ntz '2024-01-02 03:04:05.9' a, timestamp_ntz '2024-01-02 03:04:05' b, true c, date '1969-12-31' d, 1.5D e, X'00ff' f, cast(null as string) g").head()
    for kind, v, text in (("timestamp", "a", "2024-01-02T03:04:05.900000"), ("timestamp", "b", "2024-01-02T03:04:05"), ("boolean", "c", "true"), ("date", "d", "1969-12-31"), ("double", "e", "1.5"), ("binary", "f", "AP8="), ("string", "g", None)):
        df = spark.sql("SELECT timestamp_ntz '2024-01-02 03:04:05.9' a, timestamp_ntz '2024-01-02 03:04:05' b, true c, date '1969-12-31' d, 1.5D e, X'00ff' f, cast(null as string) g")
        assert df.select(tr.wire(kind, F.col(v))).head()[0] == text
        assert tr.unwire(kind, text) == (bounds._micros(row[v]) if kind == "timestamp" else (row[v] - dt.date(1970, 1, 1)).days if kind == "date" else bytes(row[v]) if kind == "binary" else row[v])


def test_transform_gates_and_display(spark):
    from tidelake.functions import transforms as tr

    for name, kind in (("bucket[4]", "double"), ("truncate[4]", "long"), ("hour", "date"), ("day", "string"), ("identity", "variant"), ("bucket[4]", "uint32")):
        with pytest.raises(Unsupported):
            tr.check(name, kind)
    for bad in ("bucket", "bucket[0]", "year[3]", "week"):
        with pytest.raises(Invalid):
            tr.parse(bad)
    assert [tr.display(t, "timestamp", v) for t, v in (("year", "-1"), ("month", "649"), ("day", "0"), ("hour", "25"), ("bucket[8]", "3"), ("day", "x"))] == ["1969", "2024-02", "1970-01-01", "1970-01-02T01", "bucket 3/8", "x"]


@given(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(), st.decimals(-(10**20), 10**20, places=3))
def test_bounds_round_trip(n, x, s, d):
    assert bounds.decode("long", bounds.encode("long", n)) == n
    assert bounds.decode("double", bounds.encode("double", x)) == x
    assert bounds.decode("decimal", bounds.encode("decimal", d, 3), 3) == d
    try:
        assert bounds.decode("string", bounds.encode("string", s)) == s
    except UnicodeEncodeError:
        pass


@given(st.floats(allow_nan=False), st.floats(allow_nan=False))
def test_float_order_is_total(a, b):
    ka, kb = bounds.order_key("double", a), bounds.order_key("double", b)
    assert (ka < kb) == (a < b or a == b == 0 and math.copysign(1, a) < math.copysign(1, b))


def test_bounds_vectors():
    assert bounds.encode("int", -2) == struct.pack("<i", -2)
    assert bounds.encode("decimal", Decimal("1.28"), 2) == b"\x00\x80"
    assert bounds.encode("boolean", True) == b"\x01"
    assert bounds.decode("long", struct.pack("<i", 7)) == 7
    assert math.copysign(1, bounds.normalize("double", 0.0, False)) == -1
    with pytest.raises(Invalid):
        bounds.decode("int", b"\x00")


def test_sanity():
    low, high = bounds.encode("int", 5).hex(), bounds.encode("int", 3).hex()
    assert bounds.sane("int", {"values": 3, "nulls": 9, "nans": 2, "lower": low, "upper": low}) == {"values": 3, "nulls": 3, "nans": 0, "lower": None, "upper": None}
    out = bounds.sane("int", {"values": 3, "nulls": 0, "lower": low, "upper": high})
    assert out["lower"] is out["upper"] is None
    assert bounds.sane("int", {"values": 3, "nulls": 0, "lower": "00", "upper": low})["upper"] == low


@given(st.lists(st.integers(0, 2**34), max_size=300), st.integers(0, 2**33), st.integers(0, 9000))
def test_vectors_round_trip(positions, start, run):
    values = np.unique(np.array([*positions, *range(start, start + run)], np.int64))
    blob = dv.encode(values)
    assert (dv.decode(blob, len(values)) == values).all()
    data, at = dv.puffin(blob, len(values), "f.parquet")
    assert dv.read_puffin(data) == blob and data[at : at + len(blob)] == blob


def test_malformed_vectors():
    blob = dv.encode(np.array([1, 5, 70000]))
    for bad in (b"", blob[:-1], blob + b"x", blob[:4] + b"XXXX" + blob[8:], blob[:-1] + bytes([blob[-1] ^ 1]), blob[:14] + b"\xff" + blob[15:]):
        with pytest.raises(CorruptDeletionVector):
            dv.decode(bad)
    with pytest.raises(CorruptDeletionVector):
        dv.decode(blob, 4)
    with pytest.raises(CorruptDeletionVector):
        dv.read_puffin(b"PFA1xxxxPFA1")


def test_run_containers():
    # one container with the runs 3..6 and 100..100
    body = struct.pack("<I", 12347) + bytes([1]) + struct.pack("<HH", 0, 4) + struct.pack("<HHHHH", 2, 3, 3, 100, 0)
    body = dv.MAGIC + struct.pack("<QI", 1, 0) + body
    import zlib

    blob = struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))
    assert dv.decode(blob).tolist() == [3, 4, 5, 6, 100]


COERCED = [
    ("boolean", True, True), ("boolean", 1, None), ("int8", 127, 127), ("int8", 128, None), ("int", True, None), ("int", 1.0, None), ("long", "1", None), ("uint64", 2**64 - 1, Decimal(2**64 - 1)),
    ("double", 1, 1.0), ("double", 10**400, None), ("float", 1e39, None), ("string", "é", "é"), ("string", "\ud800", None), ("string", 3, None), ("binary", "AP8=", b"\x00\xff"), ("binary", "A", None),
    ("uuid", "6F9619FF-8B86-D011-B42D-00CF4FC964FF", "6f9619ff-8b86-d011-b42d-00cf4fc964ff"), ("uuid", "x", None), ("date", "2024-02-30", None), ("date", 1, dt.date(1970, 1, 2)), ("time", "00:00:01", 1_000_000), ("time", -1, None),
    ("timestamp", "2024-01-01T00:00:00+01:00", None), ("timestamptz", "2024-01-01T00:00:00+01:00", dt.datetime(2023, 12, 31, 23)), ("timestamp_s", "2024-01-01T00:00:00.5", None), ("timestamp", 10**19, dt.datetime(9999, 12, 31, 23, 59, 59, 999999)), ("json", {"b": 1, "a": [1.5]}, '{"b":1,"a":[1.5]}'),
]


@pytest.mark.parametrize("kind,value,expected", COERCED)
def test_coercion(kind, value, expected):
    field = {"name": "c", "type": kind, "nullable": True}
    if expected is None:
        with pytest.raises(CoercionError):
            coerce(field, value)
    else:
        assert coerce(field, value) == expected


def test_nested_coercion():
    (field,), _ = ty.assign_ids([{"name": "m", "type": "map", "children": [{"name": "key", "type": "int", "nullable": False}, {"name": "value", "type": "list", "children": [{"name": "element", "type": "decimal", "precision": 4, "scale": 1}]}]}], 1)
    assert coerce(field, {"1": [1, "2.5", None]}) == {1: [Decimal(1), Decimal("2.5"), None]}
    for bad in ({"1": [0.5]}, {"1": ["2.55"]}, {"x": []}, [1]):
        with pytest.raises(CoercionError):
            coerce(field, bad)
    required = {"name": "s", "type": "struct", "children": [{"name": "a", "type": "int", "nullable": False}]}
    assert coerce(required, {"a": 1, "other": 2}) == (1,)
    with pytest.raises(CoercionError):
        coerce(required, {})


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "NaN", "1e400", "1" * 39, '"\\ud800"', "[" * 130 + "]" * 130, "", "{"])
def test_strict_json_refuses(text):
    with pytest.raises(ValueError):
        strict_json(text)


def test_shredding_rules():
    check_shredding({"a.b": "int", "a.c": "decimal(5,2)"})
    for bad in ({"a": "int", "a.b": "int"}, {"a..b": "int"}, {"a": "list"}, {".".join("x" * 17): "int"}):
        with pytest.raises(Invalid):
            check_shredding(bad)


def test_variant_from_json(spark):
    from tidelake.functions.variant import canonical_json, to_variant

    rows = [("{\"b\": 1.0, \"a\": [true, null]}",), ("{\"a\":1,\"a\":2}",), ("1e400",), (None,), ("12345678901234567890",)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(F.to_json(to_variant(F.col("t"))).alias("v"), F.schema_of_variant(to_variant(F.col("t"))).alias("k"), canonical_json("t").alias("c")).collect()
    assert [r.v is None for r in out] == [False, True, True, True, False]
    assert out[4].k == "DECIMAL(20,0)" and out[0].c == '{"b":1.0,"a":[true,null]}' and "DOUBLE" in out[0].k


def test_types():
    fields, last = ty.assign_ids([{"name": "a", **ty.parse_type("struct<b:int,c:array<string>>")}, {"name": "d", **ty.parse_type("decimal(5,2)")}], 1)
    assert [f["id"] for f in (fields[0], *fields[0]["children"], fields[0]["children"][1]["children"][0], fields[1])] == [1, 2, 3, 4, 5] and last == 6
    assert ty.check_fields(fields) == 5
    with pytest.raises(Unsupported):
        ty.parse_type("int128")
    for bad in ([{"name": "_tide_x", "type": "int"}], [{"name": "a", "type": "int"}, {"name": "A", "type": "int"}], [{"name": "1a", "type": "int"}], [{"name": "m", "type": "map", "children": []}]):
        with pytest.raises(Invalid):
            ty.check_fields(bad)
