"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct n-word shingles, by 64-bit hash. Two sets link when
`den * |A and B| >= num * |A or B|`. The join is exact for the hashes, and runs in these steps.

1. Equal sets are one class. Only classes are joined, so thousands of copies cost as much as one.
2. Tiles. Linked sets differ in few elements: with `a` the smaller size, in at most
   `H = floor(a * (den - num) / num)`. A band of sizes deals the elements into bins by hash. Each
   differing element changes one bin, so if the smaller set has more than H bins with elements, at
   least one of them is the same in both. A tile is (band, bin, sum of the bin's elements). A set goes
   to the bands that hold sizes of smaller partners too. A band has the first of some numbers of bins at which
   every set in it has more than H bins with elements, or else a bin for each element, so none is missed.
3. In each tile the smallest set is the hub; a set's first candidate is the hub it shares most tiles with. A pair's bitmaps
   (1,024 parity bits) bound the overlap from above: the bits that differ are at most the elements that
   differ. The pairs that are left are counted exactly, by intersecting the sorted arrays.
4. Links are contracted to components. Of tiles that still hold more than one component, the other hubs
   and, block by block, each component's pair whose bitmaps differ least come next, twice; and if that
   leaves several, all pairs across components whose bitmaps allow a link. Members of one component are
   never compared again, and new links are contracted as links between components.

No step holds a tile in memory: tiles are sorted streams, joins and sums. The sort that finds the hubs runs over all
rows of a tile in one task (24 bytes a row, spilled where they are many).
Words and sets are compared by 64-bit hashes, classes by 128 bits: two shingles that differ count as equal with a
probability of 2^-64 for each pair of shingles in two sets that are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .components import components
from .scratch import bounded, drop, save
from .tokens import LOWER, NOT_SPACE, U64, Words, chunks, mix, signed

#: Ratio between the ends of a band of sizes.
BAND = 1.5
#: Bins of a band, as multiples of the differing elements that its largest sets allow; the last has a bin for each element.
ROOM = (1.15, 1.5, 2.0, 3.0, 5.0, math.inf)
_SALT = 0x2545F4914F6CDD1D
#: 64-bit words of a bitmap; of a wide one, which has a bit for each element or more, at most. Larger sets only weigh on exact counts.
BITMAP = 16
WIDE = 2048
#: Members of a tile that are compared with as many others in one task, where a tile holds several components.
BLOCK = 512
#: Ids up to this count are broadcast (32 MB); more are joined by a shuffle.
SMALL = 4_000_000


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """(rows, elements, where each row's begin): each row's elements ascend and are distinct."""
    for rows, data, offsets in chunks(batches):
        found, begin = Words(LOWER[data], offsets, NOT_SPACE).shingles(n)
        parts, counts = [], np.zeros(rows.num_rows, dtype=np.int64)
        for r in range(rows.num_rows):
            x = found[begin[r] : begin[r + 1]]
            x.sort()
            x = x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
            parts.append(x)
            counts[r] = len(x)
        yield rows, np.concatenate(parts) if parts else found[:0], np.concatenate(([0], np.cumsum(counts)))


def _segments(x: np.ndarray, begin: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """fold over each row's elements; 0 for a row without any."""
    out, has = np.zeros(len(begin) - 1, dtype=U64), begin[:-1] < begin[1:]
    if has.any():
        out[has] = fold.reduceat(x, begin[:-1][has])
    return out


def _keys(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words that identify each row's set."""
    size = (begin[1:] - begin[:-1]).astype(U64)
    return mix(_segments(mix(x), begin, np.add) + size), _segments(mix(x ^ U64(0x5851F42D4C957F2D)), begin, np.bitwise_xor)


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def bins_of(band: int, level: int, num: int, den: int) -> int:
    """The number of bins of a band; 0: a bin for each element."""
    most = int(BAND ** (band + 1)) + 1
    return 0 if math.isinf(ROOM[level]) else int(ROOM[level] * (most * (den - num) // num + 1)) + 2


def _binned(x: np.ndarray, band: int, bins: int) -> np.ndarray:
    if not bins:
        return mix(x ^ U64(band))
    return mix(x + U64(_SALT)) % U64(bins)


def _levels(x: np.ndarray, num: int, den: int) -> int:
    """The levels whose bins suffice for a set, as the smaller of two: a bit for each level but the last, which always does."""
    differ, every = len(x) * (den - num) // num, (1 << (len(ROOM) - 1)) - 1
    if not differ:
        return every  # only equal sets link
    band, out, h = band_of(len(x)), 0, mix(x + U64(_SALT))
    for level in range(len(ROOM) - 1):
        bins = bins_of(band, level, num, den)
        if np.count_nonzero(np.bincount((h % U64(bins)).astype(np.int64), minlength=bins)) > differ:
            out |= 1 << level
    return out


def level_of(passed: int) -> int:
    """The first level at which all sets of a band pass, given the bits that they share."""
    return next((k for k in range(len(ROOM) - 1) if passed >> k & 1), len(ROOM) - 1)


def _tiles(x: np.ndarray, num: int, den: int, levels: dict[int, int]) -> np.ndarray:
    """The tiles of a set, as 64-bit words."""
    if len(x) * (den - num) // num == 0:
        return x[:0]
    low = max(1, -(-len(x) * num // den))
    out = []
    for band in range(band_of(low), band_of(len(x)) + 1):
        if int(BAND ** (band + 1) + 1) * (den - num) // num == 0 or band not in levels:
            continue
        own = _binned(x, band, bins := bins_of(band, levels[band], num, den))
        if not bins:
            out.append(own)
            continue
        sums = np.zeros(bins, dtype=U64)
        np.add.at(sums, own.astype(np.int64), mix(x))
        at = np.flatnonzero(np.bincount(own.astype(np.int64), minlength=bins))
        out.append(mix(sums[at] + mix(U64(band << 32) + at.astype(U64))))
    return np.concatenate(out) if out else x[:0]


def _sized(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _few(ids: DataFrame) -> DataFrame:
    """ids (or other narrow columns of longs), to be broadcast if they are no more than SMALL."""
    return F.broadcast(ids) if ids.count() * len(ids.columns) <= SMALL else ids


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """root (node, root) with more links (a, b), which are contracted to links between its components first."""
    few = _few(root)
    named = links
    for c in ("a", "b"):
        named = named.join(few.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    more = save(components(named.where("a <> b")), "jaccard-roots")
    old = root.join(_few(more.toDF("root", "to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return old.union(more.join(root.select("node"), "node", "left_anti").select("node", "root"))


def _folded(bits: str, other: str) -> Column:
    """A wide bitmap, its halves added if the other has half as many words."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))


def _linked(pairs: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link: wide bitmaps first, then exact counts for those they leave."""
    bits = sets.select("cls", "n", "wide")
    left = pairs.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b")
    words = F.zip_with(_folded("bits_a", "bits_b"), _folded("bits_b", "bits_a"), lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0)))
    differ = F.aggregate(words, F.lit(0), lambda s, x: s + x)
    twice = F.col("na") + F.col("nb") - differ  # at most twice the overlap
    left = left.where(twice * (num + den) >= (F.col("na") + F.col("nb")) * (2 * num)).select("a", "b")
    left = save(left, "jaccard-left")
    named = left.select(F.col("a").alias("cls")).union(left.select("b")).distinct()
    full = elements(named)  # arrays of other sets are neither kept nor moved
    both = left.join(full.toDF("a", "xs"), "a").join(full.toDF("b", "ys"), "b").select("a", "b", "xs", "ys")

    def verify(batches):
        for batch in batches:
            links = [_common(x.values, y.values) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array([k * den >= (x + y - k) * num for k, x, y in links], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(verify, "a long, b long")


def _common(x: pa.Array, y: pa.Array) -> tuple[int, int, int]:
    """The elements that two ascending arrays of distinct elements share, and the sizes of both."""
    x, y = x.to_numpy().view(U64), y.to_numpy().view(U64)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x)), len(x), len(y)


def _mixed(members: DataFrame, root: DataFrame) -> DataFrame:
    """(tile, cls, n, hub, hub_n, root, held) of the tiles that hold more than one component; held: their members."""
    members = members.select("tile", "cls", "n", "hub", "hub_n").join(_few(root).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = members.groupBy("tile").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("held")).where("r0 <> r1")
    return save(members.join(mixed.select("tile", "held"), "tile"), "jaccard-mixed")


def _across(members: DataFrame, num: int, den: int, likeliest: bool) -> DataFrame:
    """(a, b) in members (tile, cls, n, root, held, bits): the pairs across components of a tile whose bitmaps allow a link.

    likeliest: of each component in a block only the pair whose bitmaps differ least, so no more pairs than members.
    A tile is cut by hash into blocks of about BLOCK members, and each pair of blocks is compared on its own.
    """
    own, blocks = F.pmod(F.xxhash64("cls", F.lit(7)), "blocks").cast("int"), F.ceil(F.col("held") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "n", "root", "bits")

    def compare(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if held and key != tuple(keys[a]):
                    yield from _block(held, num, den, likeliest)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _block(held, num, den, likeliest)

    return rows.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi").mapInArrow(compare, "a long, b long")


def _block(parts: list[pa.RecordBatch], num: int, den: int, likeliest: bool) -> Iterator[pa.RecordBatch]:
    block = pa.Table.from_batches(parts)
    lo, own, cls, n, root = (block.column(c).to_numpy() for c in ("lo", "own", "cls", "n", "root"))
    bits = block.column("bits").combine_chunks().flatten().to_numpy().view(U64).reshape(len(cls), -1)
    one = np.flatnonzero(own == lo)
    two = np.flatnonzero(own != lo) if len(one) < len(own) else one
    least, partner = np.full(len(cls), np.iinfo(np.int64).max), np.zeros(len(cls), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in one.tolist():
        j = two[two > i] if two is one else two
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * den >= np.maximum(n[j], n[i]) * num)]
        if len(j):
            both = n[i] + n[j]
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            may = (both - differ) * (num + den) >= both * num * 2
            j, differ = j[may], differ[may]
            if likeliest and len(j):
                closer = differ < least[j]
                least[j[closer]], partner[j[closer]] = differ[closer], i
                if differ.min() < least[i]:
                    least[i], partner[i] = differ.min(), j[differ.argmin()]
            elif len(j):
                found.append((np.full(len(j), i), j))
    if likeliest:
        order = np.lexsort((least, root))
        i = order[np.concatenate(([True], root[order][1:] != root[order][:-1]))]
        i = i[least[i] < np.iinfo(np.int64).max]
        found = [(i, partner[i])] if len(i) else []
    for i, j in found:
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], names=["a", "b"])


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Words are runs of other bytes than ASCII white space, after A-Z are lower-cased; a text of fewer
    than n words has its whole word sequence as one shingle. component_id is the smallest id that links
    reach, its own included. Null or blank texts have no shingles and link with nothing. A row whose id
    is null keeps null as its component_id unless an equal or linked text has an id. Rows that repeat an
    id are rows of their own with equal results if their texts are equal. Other columns are ignored,
    whatever they are called. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def identify(batches):
        for rows, x, begin in _sets(batches, n):
            one, two = _keys(x, begin)
            size = begin[1:] - begin[:-1]
            level = [_levels(x[a:b], num, den) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            band = [band_of(s) if s else 0 for s in size.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), signed(one), signed(two), pa.array(band, pa.int32()), pa.array(level, pa.int32())], names=["doc_id", "n", "cls", "more", "band", "level"])

    ids = save(docs.mapInArrow(identify, f"doc_id {id_type}, n long, cls long, more long, band int, level int"), "jaccard-ids")
    levels = {r.band: level_of(r.passed) for r in ids.where("n > 0").groupBy("band").agg(F.bit_and("level").alias("passed")).collect()}  # a row for each band: the logarithm of the longest text

    def post(batches):
        for rows, x, begin in _sets(batches, n):
            keys, _ = _keys(x, begin)
            _, first = np.unique(keys, return_index=True)  # copies that meet here post once
            tiles = [(_tiles(x[begin[r] : begin[r + 1]], num, den, levels), r) for r in sorted(first.tolist())]
            lens, at = [len(t) for t, _ in tiles], [r for _, r in tiles]
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([t for t, _ in tiles])), signed(np.repeat(keys[at], lens)), pa.array(np.repeat((begin[1:] - begin[:-1])[at], lens))], names=["tile", "cls", "n"])

    postings = docs.mapInArrow(post, "tile long, cls long, n long")
    hub = F.first(F.struct("cls", "n")).over(W.partitionBy("tile").orderBy("n", "cls").rowsBetween(W.unboundedPreceding, W.currentRow))
    tiles = postings.withColumn("hub", hub).where("cls <> hub.cls").select("tile", "cls", "n", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n")).distinct()
    tiles = save(tiles, "jaccard-tiles")
    spark.sparkContext._jvm.System.gc()  # so the files of the largest shuffle go

    # each set is tried first with the hub that it shares most tiles with
    near = tiles.where(_sized(F.col("n"), F.col("hub_n"), num, den)).groupBy("cls", "hub").agg(F.count("*").alias("tiles"))
    near = near.groupBy("cls").agg(F.max_by("hub", F.struct("tiles", "hub")).alias("hub"))
    tried = save(near.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct(), "jaccard-pairs")
    wanted = tiles.select("cls").union(tiles.select("hub")).distinct()
    reps = save(ids.where("n > 0").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "jaccard-wanted")

    def signatures(batches):
        for rows, x, begin in _sets(batches, n):
            keys, _ = _keys(x, begin)
            size = begin[1:] - begin[:-1]
            words = np.array([max(BITMAP, min(WIDE, 1 << (max(0, k - 1) // 64).bit_length())) for k in size.tolist()], dtype=np.int64)
            at = np.concatenate(([0], np.cumsum(words)))
            row = np.repeat(np.arange(rows.num_rows), size)
            h = mix(x ^ U64(0x632BE59BD9B4E019))
            wide, bits = np.zeros(at[-1], dtype=U64), np.zeros(rows.num_rows * BITMAP, dtype=U64)
            np.bitwise_xor.at(wide, at[row] + ((h >> U64(6)).astype(np.int64) & (words[row] - 1)), U64(1) << (h & U64(63)))
            row = np.repeat(np.arange(rows.num_rows), words)
            np.bitwise_xor.at(bits, row * BITMAP + (np.arange(len(wide)) - at[row]) % BITMAP, wide)
            lists = [pa.ListArray.from_arrays(pa.array(k.astype(np.int32)), signed(v)) for k, v in ((np.arange(rows.num_rows + 1) * BITMAP, bits), (at, wide))]
            yield pa.RecordBatch.from_arrays([signed(keys), pa.array(size), *lists], names=["cls", "n", "bits", "wide"])

    def arrays(batches):
        for _, x, begin in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([signed(_keys(x, begin)[0]), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), signed(x))], names=["cls", "elements"])

    def of(classes: DataFrame) -> DataFrame:
        """The rows that stand for the classes."""
        some = _few(reps.join(classes, "cls", "left_semi").select(F.col("doc_id").alias("id")).distinct())
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    sets = save(of(reps.select("cls")).mapInArrow(signatures, "cls long, n long, bits array<long>, wide array<long>").join(_few(reps.select("cls")), "cls", "left_semi"), "jaccard-sets")
    repeats = sets.count() > reps.count()  # only where a doc_id repeats
    if repeats:
        every, sets = sets, save(sets.dropDuplicates(["cls"]), "jaccard-sets")
        drop(every)

    def elements(classes: DataFrame) -> DataFrame:
        found = of(classes).mapInArrow(arrays, "cls long, elements array<long>").join(_few(classes), "cls", "left_semi")
        return found.dropDuplicates(["cls"]) if repeats else found

    links = save(_linked(tried, sets, elements, num, den), "jaccard-links")
    root = save(components(links), "jaccard-roots")

    # tiles that still hold more than one component: other hubs and the likeliest pairs first, then every pair that may link
    members = tiles.select("tile", "cls", "n", "hub", "hub_n").union(tiles.select("tile", "hub", "hub_n", "hub", "hub_n").distinct())
    for last in (False, False, True):
        were, members = members, _mixed(members, root)
        drop(were)
        bits = sets.select("cls", F.col("n").alias("size"), "bits")
        pairs = _across(members.where("held > 2").join(bits, "cls"), num, den, likeliest=not last)
        if not last:
            others = members.where("hub <> cls").join(_few(root).select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").where("root <> coalesce(hub_root, hub)")
            pairs = pairs.union(others.where(_sized(F.col("n"), F.col("hub_n"), num, den)).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")))
        pairs = save(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            links = save(_linked(pairs, sets, elements, num, den), "jaccard-links")
            root = save(_merged(root, links), "jaccard-roots")
            tried = tried.union(pairs)
    for x in (members, tiles, sets, reps):
        drop(x)

    # classes with more than one row or a link; all other rows are their own component
    classes = ids.where("n > 0").groupBy("cls", "more", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = classes.join(root.withColumnRenamed("node", "cls"), "cls", "left").where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "cls"))
    classes = save(classes, "jaccard-classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(named, "root").select("cls", "more", "n", "component_id")
    return ids.join(named, ["cls", "more", "n"], "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the near duplicates: of each component the row with its smallest doc_id stays, with all its columns.

    Rows whose doc_id is null stay; so does every row that repeats the kept row's doc_id.
    """
    found = near_duplicates(docs, n, num, den)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    gone = save(gone, "jaccard-gone")
    return docs.join(_few(gone), "doc_id", "left_anti")
