"""The binary forms of histograms, as grouped Arrow functions: a name's slots to bytes, and bytes to slots.

Whole numbers: 3,648 counts in slot order are items: a run of empty slots, or a count as the zigzag of its
difference from the count before. Up to 64 items follow a little-endian word whose bits, lowest first, tell
runs (1) from counts (0). Floats: bit sets of the 5-bit digits of the slot, level by level, then counts.
A number of k bytes begins with k - 1 one bits and a zero, lowest first, and holds 7 k bits above; the ninth byte of a
float count follows 0xFF with all 64 bits.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

SLOTS = 57 * 64


class CodecError(ValueError):
    pass


def put(x: int, most: int) -> bytes:
    """A number in as few bytes as hold it; `most`: the longest form that has a prefix."""
    k = max(1, -(-x.bit_length() // 7))
    if k > most:
        if most < 8:
            raise CodecError("count too large")
        return b"\xff" + struct.pack("<Q", x)
    return (x << k | (1 << (k - 1)) - 1).to_bytes(k, "little")


def take(data: bytes, at: int, most: int) -> tuple[int, int]:
    """(number, where it ends)."""
    if at >= len(data):
        raise CodecError("invalid varint data")
    ones = (~data[at] & data[at] + 1).bit_length() - 1
    k = ones + 1
    if k > most:
        if most < 8 or k < 9:
            raise CodecError("invalid varint data")
        if at + 9 > len(data):
            raise CodecError("invalid varint data")
        return struct.unpack_from("<Q", data, at + 1)[0], at + 9
    if at + k > len(data):
        raise CodecError("invalid varint data")
    return int.from_bytes(data[at : at + k], "little") >> k, at + k


def encode_int(counts: dict[int, int]) -> bytes:
    """counts: by bucket * 64 + entry; each below 2^32."""
    items: list[tuple[bool, int]] = []
    at, before = 0, 0
    for slot in sorted(s for s, n in counts.items() if n):
        if not 0 <= counts[slot] < 1 << 32:
            raise CodecError("count too large")
        if slot > at:
            items.append((True, slot - at))
        diff = (counts[slot] - before + (1 << 31)) % (1 << 32) - (1 << 31)  # modulo 2^32, as a signed number
        items.append((False, (diff << 1 ^ diff >> 31) % (1 << 32)))
        at, before = slot + 1, counts[slot]
    if at < SLOTS:
        items.append((True, SLOTS - at))
    out = bytearray()
    for a in range(0, len(items), 64):
        part = items[a : a + 64]
        out += struct.pack("<Q", sum(1 << i for i, (skip, _) in enumerate(part) if skip))
        for _, x in part:
            out += put(x, 5)
    return bytes(out)


def decode_int(data: bytes) -> dict[int, int]:
    counts: dict[int, int] = {}
    at = slot = before = 0
    while at < len(data):
        if at + 8 > len(data):
            raise CodecError("invalid encoded data")
        word = struct.unpack_from("<Q", data, at)[0]
        at += 8
        for i in range(64):
            if at == len(data) or slot == SLOTS:
                break
            x, at = take(data, at, 5)
            if word >> i & 1:
                slot += x
                if slot > SLOTS:
                    raise CodecError("overflow number of buckets")
            else:
                before = (before + (x >> 1 ^ -(x & 1))) % (1 << 32)
                counts[slot] = before
                slot += 1
        if slot == SLOTS:
            break
    if slot != SLOTS or at != len(data):
        raise CodecError("invalid encoded data")
    return {s: n for s, n in counts.items() if n}


def encode_float(counts: dict[int, int]) -> bytes:
    held = sorted(s for s, n in counts.items() if n)
    out = bytearray(struct.pack("<I", sum(1 << i for i in {s >> 10 for s in held})))
    for i in sorted({s >> 10 for s in held}):
        own = [s for s in held if s >> 10 == i]
        out += struct.pack("<I", sum(1 << j for j in {s >> 5 & 31 for s in own}))
        for j in sorted({s >> 5 & 31 for s in own}):
            leaf = [s for s in own if s >> 5 & 31 == j]
            out += struct.pack("<I", sum(1 << (s & 31) for s in leaf))
            for s in leaf:
                out += put(counts[s], 8)
    return bytes(out)


def decode_float(data: bytes) -> dict[int, int]:
    counts: dict[int, int] = {}
    at = 0

    def digits() -> list[int]:
        nonlocal at
        if at + 4 > len(data):
            raise CodecError("buffer too short")
        word = struct.unpack_from("<I", data, at)[0]
        at += 4
        return [b for b in range(32) if word >> b & 1]

    for i in digits():
        for j in digits():
            for k in digits():
                counts[i << 10 | j << 5 | k], at = take(data, at, 8)
    return counts


def serialize(hist: DataFrame, name: str = "name") -> DataFrame:
    """(name, data): each name's histogram as bytes. A name has 32,768 slots at most."""
    is_float = "slot" in hist.columns

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        slots = table.column("slot").to_pylist() if is_float else [b * 64 + e for b, e in zip(table.column("bucket").to_pylist(), table.column("entry").to_pylist(), strict=True)]
        data = (encode_float if is_float else encode_int)(dict(zip(slots, n, strict=True)))
        return pa.table({"name": table.column(name)[:1], "data": pa.array([data], pa.binary())})

    return hist.groupBy(name).applyInArrow(run, f"name {hist.schema[name].dataType.simpleString()}, data binary")


def load(blobs: DataFrame, is_float: bool = False) -> DataFrame:
    """(name, bucket, entry, n) or (name, slot, n), and error: why a name's bytes are no histogram, in a row of its own."""
    kind = blobs.schema["name"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    rows += [(name, s, n, None) for s, n in sorted((decode_float if is_float else decode_int)(data or b"").items())]
                except CodecError as e:
                    rows.append((name, None, None, str(e)))
            names, slots, counts, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
            slot = [pa.array(slots, pa.int32())] if is_float else [pa.array([None if s is None else s // 64 for s in slots], pa.int32()), pa.array([None if s is None else s % 64 for s in slots], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column("name").type), *slot, pa.array(counts, pa.int64()), pa.array(errors, pa.string())], names=["name", *(["slot"] if is_float else ["bucket", "entry"]), "n", "error"])

    return blobs.select("name", "data").mapInArrow(run, f"name {kind}, {'slot int' if is_float else 'bucket int, entry int'}, n long, error string")
