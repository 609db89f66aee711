"""Deletion vectors: sets of row positions in the public Puffin ``deletion-vector-v1`` format.

A blob is a big-endian length, a magic number, a portable 64-bit Roaring bitmap
and a CRC-32 over magic and bitmap.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

from ..errors import CorruptDeletionVector

#: Fixed values of the formats.
MAGIC = bytes.fromhex("d1d33964")
PUFFIN = b"PFA1"
_WITH_RUNS, _NO_RUNS = 12347, 12346


def _container(low: np.ndarray) -> bytes:
    if len(low) <= 4096:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _bitmap32(values: np.ndarray) -> bytes:
    high = (values >> np.uint64(16)).astype(np.uint16)
    keys, starts = np.unique(high, return_index=True)
    parts = np.split((values & np.uint64(0xFFFF)).astype(np.uint16), starts[1:])
    bodies = [_container(p) for p in parts]
    head = struct.pack("<II", _NO_RUNS, len(keys)) + b"".join(struct.pack("<HH", int(k), len(p) - 1) for k, p in zip(keys, parts, strict=True))
    at, offsets = len(head) + 4 * len(keys), []
    for b in bodies:
        offsets.append(struct.pack("<I", at))
        at += len(b)
    return head + b"".join(offsets) + b"".join(bodies)


def encode(positions: np.ndarray) -> bytes:
    """The blob of a set of positions."""
    values = np.unique(np.asarray(positions, np.uint64))
    keys, starts = np.unique(values >> np.uint64(32), return_index=True)
    body = struct.pack("<Q", len(keys))
    for key, part in zip(keys, np.split(values, starts[1:]) if len(values) else [], strict=True):
        body += struct.pack("<I", int(key)) + _bitmap32(part & np.uint64(0xFFFFFFFF))
    body = MAGIC + body
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def _read32(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    start = at
    (cookie,) = struct.unpack_from("<I", data, at)
    runs = None
    if cookie & 0xFFFF == _WITH_RUNS:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data[at + 4 : at + 4 + (n + 7) // 8], np.uint8), bitorder="little")
        at += 4 + (n + 7) // 8
    elif cookie == _NO_RUNS:
        (n,) = struct.unpack_from("<I", data, at + 4)
        at += 8
    else:
        raise CorruptDeletionVector(f"unknown bitmap cookie {cookie}")
    heads = [struct.unpack_from("<HH", data, at + 4 * i) for i in range(n)]
    at += 4 * n
    if runs is None or n >= 4:
        at += 4 * n  # offsets
    out = []
    for i, (key, less_one) in enumerate(heads):
        if runs is not None and runs[i]:
            (count,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data[at + 2 : at + 2 + 4 * count], "<u2").reshape(-1, 2).astype(np.int64)
            at += 2 + 4 * count
            low = np.concatenate([np.arange(a, a + length + 1) for a, length in pairs]) if count else np.zeros(0, np.int64)
        elif less_one + 1 <= 4096:
            low = np.frombuffer(data[at : at + 2 * (less_one + 1)], "<u2").astype(np.int64)
            at += 2 * (less_one + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + 8192], np.uint8), bitorder="little"))
            at += 8192
        if len(low) != less_one + 1:
            raise CorruptDeletionVector("a container's cardinality is wrong")
        out.append(low.astype(np.uint64) | np.uint64(key << 16))
    if at > len(data) or at <= start:
        raise CorruptDeletionVector("the bitmap is cut short")
    return np.concatenate(out) if out else np.zeros(0, np.uint64), at


def decode(blob: bytes, cardinality: int | None = None) -> np.ndarray:
    """Positions of a blob, ascending; anything malformed is a typed error."""
    try:
        (length,) = struct.unpack_from(">I", blob, 0)
        if len(blob) != length + 8:
            raise CorruptDeletionVector("length does not match")
        body = memoryview(blob)[4 : 4 + length]
        if bytes(body[:4]) != MAGIC:
            raise CorruptDeletionVector("bad magic")
        if struct.unpack_from(">I", blob, 4 + length)[0] != zlib.crc32(body):
            raise CorruptDeletionVector("bad checksum")
        (n,) = struct.unpack_from("<Q", body, 4)
        at, parts = 12, []
        for _ in range(n):
            (key,) = struct.unpack_from("<I", body, at)
            part, at = _read32(body, at + 4)
            parts.append(part | np.uint64(key << 32))
        if at != length:
            raise CorruptDeletionVector("bytes are left over")
    except (struct.error, ValueError, IndexError) as e:
        raise CorruptDeletionVector(str(e)) from e
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if cardinality is not None and len(values) != cardinality:
        raise CorruptDeletionVector(f"{len(values)} positions, registered are {cardinality}")
    return values.astype(np.int64)


def puffin(blob: bytes, cardinality: int, data_file: str) -> tuple[bytes, int]:
    """A Puffin file with one blob, and the blob's offset."""
    at = len(PUFFIN)
    footer = json.dumps({"blobs": [{"type": "deletion-vector-v1", "fields": [], "snapshot-id": -1, "sequence-number": -1, "offset": at, "length": len(blob), "properties": {"referenced-data-file": data_file, "cardinality": str(cardinality)}}], "properties": {}}).encode()
    return PUFFIN + blob + PUFFIN + footer + struct.pack("<I", len(footer)) + bytes(4) + PUFFIN, at


def read_puffin(data: bytes) -> bytes:
    """The only blob of a Puffin file, found through its footer."""
    if len(data) < 16 or data[:4] != PUFFIN or data[-4:] != PUFFIN:
        raise CorruptDeletionVector("not a Puffin file")
    (size,) = struct.unpack("<I", data[-12:-8])
    try:
        blobs = json.loads(data[-12 - size : -12])["blobs"]
        (blob,) = (b for b in blobs if b["type"] == "deletion-vector-v1")
        return data[blob["offset"] : blob["offset"] + blob["length"]]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptDeletionVector(f"bad footer: {e}") from e
