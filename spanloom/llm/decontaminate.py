"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: each segment holds some documents, the benchmark terms that occur in them in
order, and for each term the places of its postings in the segment's word axis. It is stored as a table in the shared
folder, so searching needs no text and no shuffle. Which terms are the benchmark's is told by a bitmap of fixed
size; a term that it takes for one only adds postings. A search takes each benchmark window from its rarest term in
the whole index, looks up only the windows whose rarest term is in the segment, and intersects the offset-adjusted
lists of its other terms from rare to frequent; what is left are exact phrase matches. With slop, a term may lie
that many words off its place (proximity matches).

The benchmark is searched in slices of at most SLICE_BYTES of text (or one item), one slice after the other, so what
goes to a task is bounded however long the benchmark is. Terms are compared by 64-bit hashes: a window is found where
it isn't with a probability of about 2^-64 for each pair of different words that are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import bounded, save
from .tokens import ALNUM, LOWER, Words, chunks, text_bytes

#: Bytes of benchmark text whose windows are searched at once.
SLICE_BYTES = 1 << 20
#: Bits of the bitmap of the benchmark's terms (4 MB).
TERM_BITS = 1 << 25
#: Candidate places that are checked at once.
PLACES = 1 << 18
#: Contaminated texts up to this count are broadcast (their hashes: 64 MB); more are joined by a shuffle.
SMALL = 1_000_000
#: Words of a window.
WINDOW = 8
_SEGMENT = "segment long, docs array<{id}>, begin array<long>, terms array<long>, counts array<int>, positions array<int>"

Items = list[tuple[str, "str | None"]]


class Windows:
    """The distinct windows of some items: their terms, the items that hold each."""

    def __init__(self, items: Items, width: int):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        words = Words(LOWER[data], offsets, ALNUM)
        found, row = words.hash.view(np.int64), words.row
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        ids = np.array([number[i] for i, _ in items], dtype=np.int64)
        at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(found) >= width else np.zeros(0, np.int64)
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        cells = np.zeros((len(at) + len(short), width + 1), dtype=np.int64)  # the terms, and how many
        cells[: len(at), :width] = found[at[:, None] + np.arange(width)]
        cells[: len(at), width] = width
        for k, r in enumerate(short, len(at)):
            n = words.counts[r]
            cells[k, :n], cells[k, width] = found[words.begin[r] : words.begin[r + 1]], n
        cells, which = np.unique(cells, axis=0, return_inverse=True)
        held = np.unique(which.reshape(-1) * max(1, len(self.items)) + ids[np.concatenate((row[at], short))]) if len(cells) else np.zeros(0, np.int64)
        self.terms, self.lens = cells[:, :width], cells[:, width]
        self.held_by = held % max(1, len(self.items))
        self.held_from = np.searchsorted(held // max(1, len(self.items)), np.arange(len(cells) + 1))
        self.offsets = np.broadcast_to(np.arange(width), self.terms.shape)

    def rank(self, terms: np.ndarray, counts: np.ndarray) -> Windows:
        """Orders each window's terms from rare to frequent, by the postings of terms (ascending) in the whole index."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        n = np.where(terms[at] == self.terms, counts[at], 0) if len(terms) else np.zeros(self.terms.shape, np.int64)
        n = np.where(np.arange(self.terms.shape[1]) < self.lens[:, None], n, np.iinfo(np.int64).max)
        order = np.argsort(n, axis=1, kind="stable")
        live = np.flatnonzero(n.min(axis=1, initial=np.iinfo(np.int64).max) > 0)  # others occur nowhere
        lead = np.take_along_axis(self.terms, order[:, :1], axis=1)[live, 0]
        by = np.argsort(lead, kind="stable")
        self.leads, first = np.unique(lead[by], return_index=True)
        self.led, self.led_from = live[by], np.concatenate((first, [len(by)]))
        self.terms, self.offsets = np.take_along_axis(self.terms, order, axis=1), order.astype(np.int32)
        return self


def term_bits(bits: np.ndarray, terms: np.ndarray) -> None:
    """Adds terms to the bitmap."""
    place = (terms & (TERM_BITS - 1)).astype(np.int64)
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))


def build_index(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Segments of the index of (doc_id, text), for each run of documents: the postings of the terms in the bitmap."""
    bounded(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def index(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 40
        for rows, data, offsets in chunks(batches):
            words = Words(LOWER[data], offsets, ALNUM)
            found = words.hash.view(np.int64)
            place = (found & (TERM_BITS - 1)).astype(np.int64)
            hit = np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            hit = hit[np.argsort(found[hit], kind="stable")]
            terms, counts = np.unique(found[hit], return_counts=True)
            lists = [(rows.column(0).to_pylist(), rows.column(0).type), (words.begin, pa.int64()), (terms, pa.int64()), (counts.astype(np.int32), pa.int32()), (hit.astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([segment]), *(pa.array([x], pa.list_(t)) for x, t in lists)], names=["segment", "docs", "begin", "terms", "counts", "positions"])
            segment += 1

    return docs.select("doc_id", "text").mapInArrow(index, _SEGMENT.format(id=id_type))


class Segment:
    """A segment's postings."""

    def __init__(self, begin: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.begin, self.terms, self.counts, self.positions = begin, terms, counts.astype(np.int64), positions.astype(np.int64)
        self.size = int(begin[-1])
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.lists = np.repeat(np.arange(len(terms)), self.counts) * (self.size + 1) + self.positions  # ascending: by term, then by place

    def match(self, w: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of the places where a window's terms stand in one document, each within slop words of its place."""
        if not len(self.terms) or not len(w.leads):
            return
        if len(w.leads) < len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, w.leads), len(self.terms) - 1)
            lead = np.flatnonzero(self.terms[at] == w.leads)
            term = at[lead]
        else:
            at = np.minimum(np.searchsorted(w.leads, self.terms), len(w.leads) - 1)
            term = np.flatnonzero(w.leads[at] == self.terms)
            lead = at[term]
        windows, places = w.led_from[lead + 1] - w.led_from[lead], self.counts[term]
        upto = np.concatenate(([0], np.cumsum(windows * places)))
        for a in range(0, int(upto[-1]), PLACES):
            c = np.arange(a, min(a + PLACES, int(upto[-1])))
            k = np.searchsorted(upto, c, "right") - 1
            c -= upto[k]
            yield self._agree(w, w.led[w.led_from[lead[k]] + c // places[k]], self.positions[self.first[term[k]] + c % places[k]], slop)

    def _agree(self, w: Windows, which: np.ndarray, place: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        start = place - w.offsets[which, 0]
        doc = np.searchsorted(self.begin, place, "right") - 1
        for k in range(1, w.terms.shape[1]):
            if not len(which):
                break
            wanted, offset, over = w.terms[which, k], w.offsets[which, k], k >= w.lens[which]
            low = np.maximum(start + offset - slop, self.begin[doc])
            high = np.minimum(start + offset + slop, self.begin[doc + 1] - 1)
            term = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
            at = np.searchsorted(self.lists, term * (self.size + 1) + low)
            there = (self.terms[term] == wanted) & (low <= high) & (at < len(self.lists))
            there &= self.lists[np.minimum(at, len(self.lists) - 1)] <= term * (self.size + 1) + high
            keep = there | over
            which, start, doc = which[keep], start[keep], doc[keep]
        return which, start


def _found(w: Windows, segment: Segment, docs: int, slop: int) -> tuple[list[list[int]], list[list[str]], list[list[str]]]:
    """For each document of a segment: spans of hit words, ids of items with exact occurrences, and with proximity matches."""
    begin = segment.begin
    hit = np.zeros(segment.size + 1, dtype=np.int32)
    exact: list[np.ndarray] = []
    near: list[np.ndarray] = []
    for which, start in segment.match(w, 0):
        np.add.at(hit, start, 1)
        np.add.at(hit, start + w.lens[which], -1)
        exact.append(np.unique((np.searchsorted(begin, start, "right") - 1) * len(w.lens) + which))
    for which, start in segment.match(w, slop) if slop else ():
        lead = np.clip(start, 0, max(0, segment.size - 1))
        near.append(np.unique((np.searchsorted(begin, lead, "right") - 1) * len(w.lens) + which))
    on = np.cumsum(hit[:-1]) > 0
    edge = on.copy()
    edge[1:] ^= on[:-1]
    starts = begin[:-1][begin[:-1] < begin[1:]]
    edge[starts] = on[starts]
    spans: list[list[int]] = [[] for _ in range(docs)]
    if on.any():  # a span ends where hits end, or its document
        ends = np.concatenate((begin[1:], np.flatnonzero(edge & ~on)))
        ends.sort()
        for a in np.flatnonzero(edge & on).tolist():
            d = int(np.searchsorted(begin, a, "right")) - 1
            b = int(ends[np.searchsorted(ends, a, "right")])
            spans[d] += [a - int(begin[d]), b - int(begin[d])]
    found = _items(w, exact, docs)
    return spans, found, _items(w, near, docs) if slop else found


def _items(w: Windows, pairs: list[np.ndarray], docs: int) -> list[list[str]]:
    """The ids of the items that hold the windows of each document, from numbers document * windows + window."""
    out: list[list[str]] = [[] for _ in range(docs)]
    if pairs:
        both = np.unique(np.concatenate(pairs))
        doc, which = both // len(w.lens), both % len(w.lens)
        n = w.held_from[which + 1] - w.held_from[which]
        item = w.held_by[np.repeat(w.held_from[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for x in np.unique(np.repeat(doc, n) * len(w.items) + item).tolist():
            out[x // len(w.items)].append(w.items[x % len(w.items)])
    return out


def search(index: DataFrame, windows: Windows, slop: int = 0, all_rows: bool = True) -> DataFrame:
    """(segment, place, doc_id, n_words, spans, items, near) of the index's documents, or of those that have any: spans of hit words as [from, to, ...], ids of items with exact occurrences of a window, ids of items with proximity matches."""
    spark = index.sparkSession
    bounded(spark)
    id_type = index.schema["docs"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in range(batch.num_rows):
                docs, begin, terms, counts, positions = (batch.column(i)[r].values for i in range(1, 6))
                begin = begin.to_numpy()
                spans, items, near = _found(shared.value, Segment(begin, terms.to_numpy(), counts.to_numpy(), positions.to_numpy()), len(docs), slop)
                some = [d for d in range(len(docs)) if all_rows or items[d] or near[d]]
                pick = lambda x: [x[d] for d in some]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), docs.take(pa.array(some, pa.int64())), pa.array(np.diff(begin)[some], pa.int64()), pa.array(pick(spans), pa.list_(pa.int64())), pa.array(pick(items), pa.list_(pa.string())), pa.array(pick(near), pa.list_(pa.string()))],
                    names=["segment", "place", "doc_id", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(scan, f"segment long, place int, doc_id {id_type}, n_words long, spans array<long>, items array<string>, near array<string>")


def _slices(items: DataFrame) -> Iterator[Items]:
    """The items (i, text), SLICE_BYTES of text at a time, at least one slice."""
    part: Items = []
    size, any_ = 0, False
    for r in items.toLocalIterator():
        own = len((r.text or "").encode())
        if part and size + own > SLICE_BYTES:
            yield part
            part, size, any_ = [], 0, True
        part.append((r.i, r.text))
        size += own
    if part or not any_:
        yield part


def _ranked(part: Items, width: int, frequency: DataFrame) -> Windows:
    windows = Windows(part, width)
    terms = frequency.sparkSession.createDataFrame(pa.table({"term": np.unique(windows.terms)}))
    rows = frequency.join(F.broadcast(terms), "term").toArrow()  # the terms of one slice at most
    own, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    return windows.rank(own[np.argsort(own)], n[np.argsort(own)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least: int = 2, slop: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items, spans.

    Words are runs of ASCII letters, digits and non-ASCII characters after A-Z are lower-cased. A window
    is `width` consecutive words of an item; an item of fewer words, but not none, is one window. n_hit
    counts the document's words inside any occurrence of a window, spans gives them as [from, to, from,
    to, ...]. n_items counts the items with an occurring window; items_sha256 is the hash of their ids,
    sorted as strings and joined by commas (of the empty string if there are none). contaminated: at least
    `least` items. near_items: items whose window has each term within `slop` words of its place.

    Null texts have no words, null item ids are the id "null". An item id that repeats counts once. Rows
    that repeat a doc_id stay rows of their own. An empty table on either side gives no hits or no rows.
    Other columns are ignored, whatever they are called.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    bits = np.zeros(TERM_BITS >> 3, dtype=np.uint8)
    slices: list[Items] = []
    several = False
    for part in _slices(items):
        term_bits(bits, Windows(part, width).terms)
        several, slices = several or bool(slices), slices or [part]  # a second slice is read again when its turn comes
    index = save(build_index(docs.select("doc_id", "text"), bits), "postings")
    frequency = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    if several:
        frequency = save(frequency, "postings-terms")
        parts = [save(search(index, _ranked(part, width, frequency), slop, False), "postings-found") for part in _slices(items)]
        out = _joined(index, parts)
    else:
        out = search(index, _ranked(slices[0], width, frequency), slop)
    own = F.array_sort(F.array_distinct("items"))
    hit = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("items_sha256"), (F.size(own) >= least).alias("contaminated"), own.alias("items"), F.array_sort(F.array_distinct("near")).alias("near_items"), "spans")


def _joined(index: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """What the slices found, by document."""
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")]  # a document's own hits
    found = found.groupBy("segment", "place").agg(*lists)

    def union(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.set_column(2, "spans", pa.array([_union(x) for x in b.column(2).to_pylist()], pa.list_(pa.int64())))

    found = found.mapInArrow(union, found.schema)
    every = index.select("segment", F.posexplode("docs").alias("place", "doc_id"), "begin")
    every = every.select("segment", "place", "doc_id", (F.col("begin")[F.col("place") + 1] - F.col("begin")[F.col("place")]).alias("n_words"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return every.join(found, ["segment", "place"], "left").select("segment", "place", "doc_id", "n_words", empty("spans", "long"), empty("items", "string"), empty("near", "string"))


def _union(spans: list[int]) -> list[int]:
    """Spans [from, to, ...] in any order as ascending ones that don't touch."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows, with all their columns, whatever they are called. Rows with equal texts share their fate, whatever their doc_id; null texts stay."""
    rows = docs.select(_text_key(F.col("text")).alias("doc_id"), "text")
    found = decontaminate(rows, benchmark).where("contaminated").select(F.col("doc_id").alias("_text_key")).distinct()
    found = save(found, "contaminated")
    found = F.broadcast(found) if found.count() <= SMALL else found
    return docs.join(found, _text_key(docs["text"]) == found["_text_key"], "left_anti")
