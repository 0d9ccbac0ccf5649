"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source's words give its target: its share of the wanted total by weight, stopped at `most` times
   its size, the excess shared again by weight among the sources that are not stopped.
2. A source is cut by keyed hash into blocks of about BLOCK_ROWS documents, however large it is. Its target
   is an exact quota of block draws: every block in each full pass, then in the last pass the blocks up to
   a cut; of the block at the cut, documents are taken (or, if more than half is due, left out) in hash
   order as long as they fit, and one more, and then one less, if that comes nearer. Rows that are equal are numbered first, so they fall into blocks of their own.
3. The quotas of all sources are partitioned among the output shards by a binary tree: each node draws the
   left half's counts from the multivariate hypergeometric distribution, so every draw lands in exactly
   one shard and every shard gets as many. Blocks grow with the input, so that all counts stay below what is drawn exactly.
4. A source's draws are permuted and dealt to shards as disjoint intervals of the tree's quotas: a document's draws,
   each with its shard and its place there, are what the mix takes of it. `mixed` writes the shards out, each shuffled
   by a keyed hash. All choices follow from the seed, so reruns agree.

Only tables with a row for each source reach the driver or are broadcast: MAX_SOURCES bounds them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .scratch import drop, save

#: Documents of a block, about; more where there would be over MOST_DRAWS block draws.
BLOCK_ROWS = 256
MOST_DRAWS = 500_000_000
#: Blocks whose words are summed together on the way to the cut.
SPAN = 1024
#: Sources a mix can have: their statistics go through the driver.
MAX_SOURCES = 20_000
#: Output shards.
SHARDS = 16
#: Rows of a part of a shard that is sorted in one task, about; rows of one key that are numbered in one.
PART_ROWS = 100_000
#: Keys up to this count are broadcast.
SMALL = 1_000_000
_BITS = 62
_H = (1 << _BITS) - 1
_ADDED = ("size", "source_size", "target", "copies", "taken", "draws")


def words(text: Column) -> Column:
    """The number of runs of other bytes than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """What each source is to give: shares of all sizes by weight, none above `most` times its size."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > most * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total if total else 0.0
            break
        for i in sorted(over):
            out[i] = most * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): each source's quota of draws, parted among the shards by the splitting tree."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(quotas.sum())
    room = np.diff(np.arange(shards + 1, dtype=np.int64) * total // shards)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def part(a: int, b: int, held: np.ndarray) -> None:
        if b - a == 1:
            out[a] = held
            return
        m = (a + b) // 2
        take = int(room[a:m].sum())
        left = np.zeros_like(held)
        rest, need = int(held.sum()), take
        for i in np.flatnonzero(held):  # the marginal method: a chain of hypergeometric draws
            rest -= int(held[i])
            left[i] = rng.hypergeometric(int(held[i]), rest, need)
            need -= int(left[i])
            if not need:
                break
        part(a, m, left)
        part(m, b, held - left)

    if len(quotas):
        part(0, shards, quotas.astype(np.int64))
    return out


#: Columns of the table by source; each step knows more of them.
_SOURCES = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "blocks": pa.int64(), "full": pa.int32(), "rest": pa.float64(), "cut": pa.int64(), "due": pa.float64(), "taken_keys": pa.list_(pa.int64()), "quota": pa.int64(), "step": pa.int64(), "bounds": pa.list_(pa.int64())}


def _sources(spark: SparkSession, rows: list[tuple], columns: int) -> DataFrame:
    """The first columns of _SOURCES, read by the JVM: a table of Python rows would leave Python workers in each executor."""
    kinds = list(_SOURCES.items())[:columns]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)}))


def _order(seed: int, *cols: Column | str) -> Column:
    """A keyed hash of the columns in [0, 2^62)."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(_H))


def _numbered(docs: DataFrame, narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (_key, ...) and narrow (_key, source, size) with _copy: the number of a row among those of its key, from 0.

    Rows of one key are equal in all that matters here. A key with very many is numbered in parts.
    """
    repeats = save(narrow.groupBy("_key", "source", "size").agg(F.count("*").alias("_rows")).where("_rows > 1"), "mix-repeats")
    count = repeats.count()
    if not count:
        return docs.withColumn("_copy", F.lit(0).cast("long")), narrow.withColumn("_copy", F.lit(0).cast("long"))
    keys = repeats.groupBy("_key").agg(F.sum("_rows").alias("_rows"))
    keys = F.broadcast(keys) if count <= SMALL else keys
    starts = repeats.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(PART_ROWS).cast("long")))).repartition("_key", "_start")
    every = starts.withColumn("_copy", F.explode(F.sequence("_start", F.least(F.col("_start") + PART_ROWS, "_rows") - 1))).select(*narrow.columns, "_copy")
    parts = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_rows") / PART_ROWS).cast("long"))
    many = save(docs.join(keys, "_key").withColumn("_part", parts).drop("_rows"), "mix-repeated")
    sizes = many.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("_key").orderBy("_part")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy("_key", "_part").orderBy("_before")) - 1
    many = many.join(before, ["_key", "_part"]).withColumn("_copy", (F.col("_before") + at).cast("long")).select(*docs.columns, "_copy")
    keys = F.broadcast(repeats.select("_key")) if count <= SMALL else repeats.select("_key")
    alone = F.lit(0).cast("long").alias("_copy")
    return docs.join(keys, "_key", "left_anti").select(*docs.columns, alone).unionByName(many), narrow.join(keys, "_key", "left_anti").select(*narrow.columns, alone).unionByName(every)


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, shards: int = SHARDS, seed: int = 17, weight_of: dict | None = None) -> DataFrame:
    """docs with size, source_size, target, copies, taken and draws (array of shard and order in it), a row for each row of docs.

    Sources take the weights in turn, by code point with null last; weight_of gives some of them others.
    draws: a place for each time that the mix holds the document, 0 to `most`; copies: how many; taken: copies * size.
    A null text has size 0 and may be drawn like any other. Rows that are equal in doc_id, source and text are drawn each on
    its own. A source of size 0, or no rows at all, gives target 0. Columns of docs with these names are replaced.
    """
    return _planned(docs.drop(*_ADDED), weights, most, shards, seed, weight_of)[0].select("_row.*", *_ADDED)


def _planned(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, shards: int = SHARDS, seed: int = 17, weight_of: dict | None = None) -> tuple[DataFrame, int]:
    """docs as a struct _row, with plan's columns; and the number of draws at most."""
    spark = docs.sparkSession
    docs = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "source", "text").alias("_key"), "source", words(F.col("text")).alias("size"))
    sizes = save(docs.select("_key", "source", "size"), "mix-sizes")
    stats = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    docs, narrow = _numbered(docs, sizes)
    stats = sorted(stats, key=lambda r: (r.source is None, r.source or ""))
    given = weight_of or {}
    share = [given.get(r.source, weights[i % len(weights)]) for i, r in enumerate(stats)]
    wanted = targets([r["size"] for r in stats], share, most)
    full = [min(most, int(t // r["size"])) if r["size"] else 0 for t, r in zip(wanted, stats, strict=True)]
    all_rows = sum(r.rows for r in stats)
    block_rows = max(BLOCK_ROWS, -(-all_rows * most // MOST_DRAWS))
    rows = [(r.source, r["size"], float(t), max(1, -(-r.rows // block_rows)), f, float(t - f * r["size"]) if f < most else 0.0) for r, t, f in zip(stats, wanted, full, strict=True)]
    by_source = _sources(spark, rows, 6)

    def placed(df: DataFrame, sources: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return df.withColumn("block", F.pmod(_order(seed, "_key", "_copy"), "blocks")).withColumn("key", _order(seed + 1, "_key", "_copy"))

    # the cut: first among spans of blocks, then among the blocks of one span, then in a block
    block = save(placed(narrow, by_source).where("rest > 0").groupBy("source", "rest", "block").agg(F.sum("size").alias("size")), "mix-blocks")
    span = block.groupBy("source", "rest", F.expr(f"block div {SPAN}").alias("span")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("span"))
    cut_span = span.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min("span").alias("span"), F.min_by(F.col("upto") - F.col("size"), "span").alias("before"))
    same = F.col("source").eqNullSafe(F.col("s"))
    inner = block.join(F.broadcast(cut_span.withColumnRenamed("source", "s")), same & (F.expr(f"block div {SPAN}") == F.col("span")))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("block"))
    cuts = inner.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min("block").alias("cut"), F.min_by(F.col("rest") - F.col("upto") + F.col("size"), "block").alias("due"))
    cuts = {r.source: (r.cut, float(r.due)) for r in cuts.collect()}  # a row for each source

    rows = [(*r, *cuts.get(r[0], (-1, 0.0))) for r in rows]
    by_source = _sources(spark, rows, 8)
    edge = placed(narrow, by_source).where("block = cut and size > 0")
    edge = edge.groupBy("source", "due", "key").agg(F.sum("size").alias("size")).groupBy("source", "due").agg(F.sort_array(F.collect_list(F.struct("key", "size"))).alias("block"))
    edge = edge.withColumn("held", F.aggregate("block", F.lit(0).cast("long"), lambda n, x: n + x["size"]))
    edge = edge.withColumn("but", F.col("due") > F.col("held") / 2)  # then it is chosen what to leave out
    none = F.struct(F.when(F.col("but"), F.col("held") - F.col("due")).otherwise(F.col("due")).alias("left"), F.array().cast("array<long>").alias("keys"))

    def fit(state: Column, x: Column) -> Column:
        room = x["size"] <= state["left"]
        return F.struct(F.when(room, state["left"] - x["size"]).otherwise(state["left"]).alias("left"), F.when(room, F.concat(state["keys"], F.array(x["key"]))).otherwise(state["keys"]).alias("keys"))

    edge = edge.withColumn("fit", F.aggregate("block", none, fit))
    left = F.col("fit.left")  # one more document, if that comes nearer, and then one less

    def nearest(held: Callable[[Column], Column], to: Column) -> Column:
        some = F.filter("block", lambda x: held(F.array_contains("fit.keys", x["key"])) & (x["size"] < 2 * to))
        return F.array_min(F.transform(some, lambda x: F.struct(F.abs(x["size"] - to).alias("off"), x["key"].alias("key"), x["size"].alias("size"))))

    edge = edge.withColumn("more", nearest(lambda x: ~x, left))
    edge = edge.withColumn("less", nearest(lambda x: x, F.col("more.size") - left))
    keys = F.when(F.col("more").isNotNull(), F.concat("fit.keys", F.array("more.key"))).otherwise(F.col("fit.keys"))
    keys = F.when(F.col("less").isNotNull(), F.array_remove(keys, F.col("less.key"))).otherwise(keys)
    edge = edge.withColumn("keys", keys).select("source", F.when(F.col("but"), F.array_except(F.transform("block", lambda x: x["key"]), "keys")).otherwise(F.col("keys")).alias("keys"))
    ends = {r.source: r["keys"] for r in edge.collect()}  # about a block for each source at most
    drop(block)

    quotas = np.array([r[4] * r[3] + (r[6] + 1 if r[6] >= 0 else 0) for r in rows], dtype=np.int64)
    parts = split(quotas, shards, seed)
    step = [_coprime(int(q), seed + i) for i, q in enumerate(quotas)]
    rows = [(*r, ends.get(r[0], []), int(q), s, np.cumsum(parts[:, i]).tolist()) for i, (r, q, s) in enumerate(zip(rows, quotas, step, strict=True))]
    by_source = _sources(spark, rows, 12)

    out = placed(docs, by_source)
    partial = (F.col("block") < F.col("cut")) | ((F.col("block") == F.col("cut")) & F.array_contains("taken_keys", F.col("key")))
    passes = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda p: (p < F.col("full")) | ((p == F.col("full")) & partial))

    def drawn(p: Column) -> Column:
        moved = F.pmod((p * F.col("blocks") + F.col("block")) * F.col("step"), "quota")
        shard = F.size(F.filter("bounds", lambda b: b <= moved))
        return F.struct(shard.alias("shard"), _order(seed + 2, "_key", "_copy", p).alias("order"))

    # a draw lies in one of the intervals that the tree has given to the shards
    out = out.withColumn("draws", F.filter(F.transform(passes, drawn), lambda d: d["shard"] < shards))
    out = out.withColumn("copies", F.size("draws")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select("_row", *_ADDED), all_rows * most


def _coprime(n: int, seed: int) -> int:
    """A step that visits every draw of n once. Below 2^31 / n it can't overflow."""
    x = 1 + (seed * 2_654_435_761) % max(1, min(n, 1 << 20))
    while math.gcd(x, max(1, n)) != 1:
        x += 1
    return x


def _dealt(docs: DataFrame, **options) -> DataFrame:
    """(_row, shard) for each copy of each document drawn, each shard in the order of its draws."""
    planned, most = _planned(docs, **options)
    draws = planned.select("_row", F.explode("draws").alias("d")).select("_row", "d.*")
    # a shard is as many ranges of its order as its rows ask for, so none has to fit in a task
    parts = max(1, -(-most // (options.get("shards", SHARDS) * PART_ROWS)))
    part = F.floor(F.col("order") / F.lit(float(1 << _BITS)) * parts)
    return draws.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "order").select("_row", "shard")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row for each copy of each document drawn, with docs' columns (but one named shard) and the shard, in its order within the shard."""
    return _dealt(docs.drop("shard"), **options).select("_row.*", "shard")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix holds it, dealt by shard, with all columns as they are."""
    return _dealt(docs, **options).select("_row.*")
