"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has BINS slots. Each shard stands on it at VIRTUAL places; a text's hash gives its slot, and its
shard is the first one clockwise that is not full: a shard takes (1 + SLACK) times the mean. What is placed is a
unit: all texts of a slot, but a text with more than 1/PARTS of all bytes or rows is a unit of its own. Equal texts
are in one unit, so they stay together; only a text that alone exceeds the mean of a shard is parted, by doc_id.
A unit of many rows is numbered in parts, by doc_id too. There are at most BINS + 5 * PARTS units and parts,
whatever the input, so the bytes and rows of each, which are all that reaches the driver, are bounded. The driver
places them, heaviest first, and the numbering of rows is a window over one part, never over a shard.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import save

BINS = 1 << 14
#: A text of more than this part of all bytes, or of all rows, is placed on its own.
PARTS = 1 << 11
VIRTUAL = 256
SLACK = 0.0005
SHARDS = 24
#: Units of up to this many rows are numbered in one part.
LEAST_ROWS = 100_000


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise. A shard's places don't depend on the others."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % BINS, s) for s in range(shards) for v in range(virtual)]
    return sorted(at)


def place(loads: list[tuple[int, int, int]], shards: int, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """(slot, part) -> shard, for loads (slot, part, bytes): heaviest first, clockwise past full shards.

    Where no shard has room, the emptiest takes it.
    """
    nodes = ring(shards)
    slots = [s for s, _ in nodes]
    most = (1 + slack) * sum(x[2] for x in loads) / shards
    held = [0] * shards
    out = {}
    for slot, part, load in sorted(loads, key=lambda x: (-x[2], x[0], x[1])):
        at = bisect_left(slots, slot)
        shard = min(range(shards), key=lambda s: (held[s], s))
        tried: set[int] = set()
        for k in range(len(nodes)):
            s = nodes[(at + k) % len(nodes)][1]
            if s not in tried:
                if held[s] + load <= most:
                    shard = s
                    break
                tried.add(s)
                if len(tried) == shards:
                    break
        out[slot, part] = shard
        held[shard] += load
    return out


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard, a row for each row of docs.

    law is `bytes`: the shards' sizes are near equal, as far as rows and groups of equal texts allow. size: bytes of the text in UTF-8, null none, plus 8.
    text_crc32: of the text's UTF-8 bytes, null for null. slot: the row's number in its shard, without
    gaps from 0; rows that are equal in doc_id and text take their numbers in any order. grown_shard is null.
    Equal texts are in one shard, unless together they exceed the mean of a shard; then rows with one doc_id stay together.
    Null doc_ids and texts are values like others. An empty table gives an empty result. Columns of docs
    with these names are replaced.
    """
    spark = docs.sparkSession
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*added)
    docs = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", size_of(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    docs = docs.withColumn("_bin", F.pmod(F.xxhash64("text"), F.lit(BINS)).cast("int")).withColumn("_text", F.xxhash64("text", F.lit(9)))
    narrow = save(docs.select("doc_id", "size", "_bin", "_text"), "ring-rows")
    sums = (F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bins = narrow.groupBy("_bin").agg(*sums).collect()  # BINS rows at most
    all_bytes, all_rows = sum(r["bytes"] for r in bins), sum(r["rows"] for r in bins)
    own_bytes, own_rows, mean = max(1, all_bytes // PARTS), max(LEAST_ROWS, all_rows // PARTS), all_bytes // shards

    full = _table(spark, [[r["_bin"]] for r in bins if r["bytes"] > own_bytes or r["rows"] > own_rows], ("_bin",))
    texts = narrow.join(F.broadcast(full), "_bin").groupBy("_bin", "_text").agg(*sums)
    texts = texts.where((F.col("bytes") > own_bytes) | (F.col("rows") > own_rows)).collect()  # 2 * PARTS rows at most
    whole = {r["_bin"]: [r["bytes"], r["rows"]] for r in bins}
    units = []
    for r in texts:  # a unit's parts: for its rows, and where the text alone exceeds a shard, for its bytes
        whole[r["_bin"]][0] -= r["bytes"]
        whole[r["_bin"]][1] -= r["rows"]
        apart = r["bytes"] > mean
        units.append([r["_bin"], r["_text"], int(apart), max(-(-r["rows"] // own_rows), -(-r["bytes"] // own_bytes) if apart and r["rows"] > 1 else 1)])
    rest = [[b, -(-rows // own_rows)] for b, (_, rows) in whole.items() if rows > own_rows]
    in_units, in_parts = _table(spark, units, ("_bin", "_text", "_apart", "_own")), _table(spark, rest, ("_bin", "_rest"))

    def parted(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(in_units), ["_bin", "_text"], "left").join(F.broadcast(in_parts), "_bin", "left")
        unit = F.when(F.col("_own").isNotNull(), F.col("_text"))  # null: the rest of the slot
        part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.coalesce("_own", "_rest", F.lit(1))).cast("int")
        return df.withColumn("_unit", unit).withColumn("_part", part).withColumn("_apart", F.coalesce("_apart", F.lit(0))).drop("_own", "_rest", "_text", "text")

    loads = parted(narrow).groupBy("_bin", "_unit", "_apart", "_part").agg(*sums).collect()  # BINS + 5 * PARTS rows at most
    placed: dict[tuple, int] = {}
    unit_of = lambda r: (r["_bin"], (r["_unit"], r["_part"] if r["_apart"] else -1))
    for r in loads:
        placed[unit_of(r)] = placed.get(unit_of(r), 0) + r["bytes"]
    number = {k: i for i, k in enumerate(sorted(placed, key=lambda k: (k[0], k[1][0] is not None, k[1][0] or 0, k[1][1])))}
    home = place([(b, number[b, u], load) for (b, u), load in placed.items()], shards)
    next_slot, rows = [0] * shards, []
    for r in sorted(loads, key=lambda r: (number[unit_of(r)], r["_part"])):
        s = home[r["_bin"], number[unit_of(r)]]
        rows.append([r["_bin"], r["_unit"], r["_part"], s, next_slot[s]])
        next_slot[s] += r["rows"]
    places = _table(spark, rows, ("_bin", "_u", "_p", "shard", "_from"))
    out = parted(docs).join(F.broadcast(places.withColumnRenamed("_bin", "_b")), (F.col("_bin") == F.col("_b")) & F.col("_unit").eqNullSafe(F.col("_u")) & (F.col("_part") == F.col("_p")))
    number = F.row_number().over(W.partitionBy("_bin", "_unit", "_part").orderBy("doc_id", "text_crc32"))
    out = out.withColumn("law", F.lit("bytes")).withColumn("shard", F.col("shard").cast("int")).withColumn("slot", F.col("_from") + number - 1).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("_row.*", *added)


def _table(spark, rows: list[list[int | None]], names: tuple[str, ...]) -> DataFrame:
    """A small table of whole numbers, made in the JVM."""
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<array<long>>")).alias("x"))
    return one.select(*(F.col("x")[i].alias(n) for i, n in enumerate(names)))
