"""Approximate nearest neighbours with a permutation index.

A vector is represented by its LENGTH nearest of PIVOTS pivots, in order. The index is a table in the shared folder; each
of its segments holds some vectors of one length and their inverted files, one for each pivot, which say for each vector how far
before the end of its order the pivot stands, or 0. A query visits the files of its own nearest pivots and sums up
the footrule distance of the two orders, where a pivot that one of them lacks counts as place LENGTH; the nearest
by footrule are reranked by the exact measure. Equal vectors of a segment are indexed and reranked once, and stand for
all their ids afterwards.

The pivots are a bounded sample of the vectors of each length, and every vector is indexed; vectors of lengths beyond the
MAX_LENGTHS most frequent ones have no pivots and are all compared exactly. A task holds one segment and one block of
queries; queries are taken in blocks of QUERY_BYTES, one after the other, whatever their number. Each segment
returns its own best for each query, and a window over a query keeps the best of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import bounded, save

#: Pivots of a length, the bounded sample the index is fitted on.
PIVOTS = 256
#: Places of a vector's order that are kept, 255 at most.
LENGTH = 128
#: Lengths of vectors that have pivots.
MAX_LENGTHS = 16
#: The part of a segment that is reranked, and the least number.
RERANK = 0.12
LEAST_RERANK = 200
#: Bytes of queries that go to a task at once.
QUERY_BYTES = 8 << 20
#: Vectors of a segment, and queries that are scored against it at once.
SEGMENT = 4096
STEP = 64

#: Queries by length: their ids, and the vectors.
Queries = dict[int, tuple[np.ndarray, np.ndarray]]


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, matrix) of each length: the rows that take part, in double precision: not null, not zero, all components finite."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lens = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(lens[lens > 0]).tolist():
        which = np.flatnonzero(lens == width)
        x = vectors.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield which[ok], x[ok]


def order(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    length = min(length, near.shape[1])
    part = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1)


def inverted(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The inverted files of some vectors: a row for each pivot, with each vector's places from the pivot to the end of its order, or 0."""
    orders = order(vectors, pivots, length)
    files = np.zeros((len(pivots), len(vectors)), dtype=np.uint8)
    files[orders, np.arange(len(vectors))[:, None]] = orders.shape[1] - np.arange(orders.shape[1], dtype=np.uint8)
    return files


def shared_places(files: np.ndarray, query: np.ndarray) -> np.ndarray:
    """For each vector, half of what its order saves in footrule distance to a query's order against sharing no pivot.

    A shared pivot at places p and q costs |p - q|; one that a side lacks costs length - p. So a shared one
    saves (length - p) + (length - q) - |p - q|, which is twice the smaller of length - p and length - q.
    """
    own = (len(query) - np.arange(len(query))).astype(np.uint8)
    return np.add.reduce(np.minimum(files[query], own[:, None]), axis=0, dtype=np.uint16)


def fit(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """The pivots of each length: the distinct vectors with the smallest hashes of their ids."""
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(MAX_LENGTHS).collect()
    hashed = vectors.withColumn("n", F.size("embedding")).where(F.col("n").isin([r.n for r in lengths])).withColumn("h", F.xxhash64("embedding"))
    first = hashed.groupBy("n", "h").agg(F.min(F.struct(F.xxhash64("vec_id", F.lit(3)).alias("o"), "vec_id")).alias("one"))
    first = first.withColumn("k", F.row_number().over(W.partitionBy("n").orderBy("one.o"))).where(F.col("k") <= 2 * pivots).select("n", "h", "one.o", "one.vec_id")
    some = hashed.join(F.broadcast(first), ["n", "h", "vec_id"]).orderBy("o").select("embedding").toArrow()
    return {x.shape[1]: x[np.sort(_distinct(x)[0])][:pivots] for _, x in _matrices(some.column("embedding").combine_chunks())}


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a row of each distinct vector, and the vector of each row."""
    x = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).reshape(-1), return_index=True, return_inverse=True)[1:]


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], length: int = LENGTH) -> DataFrame:
    """Segments of the index of (vec_id long, embedding): vectors of one length, the ids of each, and the inverted files; none without pivots."""
    bounded(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def segment(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first, which = _distinct(v)
        v, by = v[first], np.lexsort((ids, which))
        width = v.shape[1]
        files = inverted(v, shared.value[width], length).tobytes() if width in shared.value else None
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([ids[by].tobytes()], pa.binary()), pa.array([np.cumsum(np.bincount(which)).tobytes()], pa.binary()), pa.array([files], pa.binary())], names=["width", "vectors", "ids", "ends", "files"])

    def index(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(a, SEGMENT)
                own = part.column(0).to_numpy()
                for which, x in _matrices(part.column(1)):
                    held.setdefault(x.shape[1], []).append((own[which], x))
                    size += x.size
                for width in [w for w, p in held.items() if sum(len(i) for i, _ in p) >= SEGMENT]:
                    size -= sum(x.size for _, x in held[width])
                    yield segment(held.pop(width))
                if size > SEGMENT * 1024:  # many lengths: what there is of each
                    yield from (segment(p) for p in held.values())
                    held, size = {}, 0
        yield from (segment(p) for p in held.values())

    return vectors.mapInArrow(index, "width int, vectors binary, ids binary, ends binary, files binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, length: int = LENGTH, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product in double precision.

    vectors and queries have vec_id and embedding. A query's own id is no candidate. Nearest first, ties to
    the smaller vec_id; fewer than k only if there are fewer candidates. Vectors that are null, zero, or hold
    null or non-finite components take no part on either side, nor do null ids, nor vectors of another length than the query.
    Rows that repeat an id count as rows. Other columns are ignored. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    vectors, queries = (d.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for d in (vectors, queries))
    index = save(build_index(vectors, fitted := fit(vectors, pivots), length), "ann-index")
    out, last = None, None
    for block in _blocks(queries):
        if last is not None:  # one block is with the tasks at a time
            found = save(_search_block(index, last, fitted, k, length, rerank), "ann-found")
            out = found if out is None else out.union(found)
        last = block
    if last is not None:
        found = _search_block(index, last, fitted, k, length, rerank)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _blocks(queries: DataFrame) -> Iterator[Queries]:
    """The queries that take part, QUERY_BYTES of vectors at a time."""
    rows: list = []
    size = 0

    def ready() -> Queries:
        ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        return {x.shape[1]: (ids[which], x) for which, x in _matrices(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))}

    for r in queries.toLocalIterator(prefetchPartitions=False):
        rows.append(r)
        size += 8 * len(r.embedding)
        if size >= QUERY_BYTES:
            yield ready()
            rows, size = [], 0
    if rows:
        yield ready()


def _search_block(index: DataFrame, queries: Queries, pivots: dict[int, np.ndarray], k: int, length: int, rerank: float) -> DataFrame:
    """The k nearest found of each query."""
    orders = {w: order(x, pivots[w], length) for w, (_, x) in queries.items() if w in pivots}
    shared = index.sparkSession.sparkContext.broadcast((queries, orders))

    def scan(batches: Iterator[pa.RecordBatch]):
        queries, orders = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                width, v, own, ends, files = (batch.column(i)[r].as_py() for i in range(5))
                if width not in queries:
                    continue
                ids, x = queries[width]
                v, own, ends = np.frombuffer(v).reshape(-1, width), np.frombuffer(own, np.int64), np.frombuffer(ends, np.int64)
                keep = max(LEAST_RERANK, k + 1, int(rerank * len(v)))
                files = np.frombuffer(files, np.uint8).reshape(-1, len(v)) if files and keep < len(v) else None
                for q in range(0, len(ids), STEP):
                    found = [_best(files, orders[width][i] if files is not None else None, v, own, ends, x[i], ids[i], k, keep) for i in range(q, min(q + STEP, len(ids)))]
                    n = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q : q + STEP], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    found = index.mapInArrow(scan, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(files: np.ndarray | None, query_order: np.ndarray | None, v: np.ndarray, own: np.ndarray, ends: np.ndarray, query: np.ndarray, query_id: int, k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best; v: distinct vectors, own: the ids of each in turn, ascending, up to its end."""
    some = np.arange(len(v))
    if files is not None:
        near = shared_places(files, query_order)
        some = np.flatnonzero(near >= np.partition(near, len(v) - keep)[len(v) - keep])  # with all that tie at the cut
    score = np.einsum("ij,j->i", v[some], query)
    if len(some) > 4 * k:  # the k best by score, and more only if they tie or the query itself is one
        top = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
        some, score = some[top], score[top]
    ids, scores, held, last = [own[:0]], [score[:0]], 0, None
    for i in np.argsort(-score, kind="stable"):
        if held >= k and score[i] != last:
            break
        g = some[i]
        its = own[ends[g - 1] if g else 0 : ends[g]]
        its = its[its != query_id][:k]
        ids.append(its)
        scores.append(np.repeat(score[i], len(its)))
        held, last = held + len(its), score[i]
    found, score = np.concatenate(ids), np.concatenate(scores)
    top = np.lexsort((found, -score))[:k]
    return found[top].astype(np.int64), score[top]
