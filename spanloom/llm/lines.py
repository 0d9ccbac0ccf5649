"""Line dedup with a log-template tree of fixed depth.

A line's words become tokens; those that hold a digit are variable fields from the start. The tree's levels are
the token count, then the leading tokens; lines that reach one leaf are compared position by position with the
leaf's templates, and the template that agrees in at least SIMILAR of the tokens takes the line, its other
positions becoming variable. Templates whose lines occur in at least `least` documents are recurring, and
their lines are dropped. Tokens, lines and leaves are 64-bit hashes: two lines that differ count as one with a
probability of 2^-64 for each pair.

Only distinct lines go through the tree, and only where a leaf holds several: a bitmap of fixed size tells tasks which
leaves those may be, so texts are read where they are and never moved. A leaf's key is the same at every size. A leaf of
more than LEAF distinct lines is dealt by hash into blocks of about LEAF, each block grows templates of its own, and
the templates of a leaf's blocks are then grown into one another as lines are into templates. So a task holds a block,
or the templates of a leaf; those are few where many lines share a template, and one task where they don't.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import bounded, drop, save
from .tokens import NOT_SPACE, U64, Words, _STEP, chunks, mix, signed

#: Leading tokens of the tree's leaves.
DEPTH = 3
#: Distinct lines of a leaf that are grown in one task; a fuller leaf is grown in blocks, whose templates are merged.
LEAF = 2000
SIMILAR = 0.6
#: Lines of fewer tokens are counted as they are, with their digits, and go through no tree.
LEAST_TOKENS = 3
#: Lines of fewer tokens and fewer bytes than this, white space aside, are never dropped.
LEAST_BYTES = 6
#: Recurring lines up to this count are broadcast (32 MB); more are joined to their rows by a shuffle. A quarter of it for templates.
SMALL = 4_000_000
#: Bits of the bitmap of leaves that hold several lines (4 MB).
LEAF_BITS = 1 << 25
FIELD = "<*>"
_FIELD = U64(0x6A09E667F3BCC909)


@dataclass
class Lines:
    """The lines of some rows that have enough tokens or bytes."""

    row: np.ndarray
    #: The line's number in its row.
    line: np.ndarray
    #: Whether it goes through the tree, its leaf, and the hash of all of its tokens.
    many: np.ndarray
    leaf: np.ndarray
    whole: np.ndarray
    #: The tokens of all lines, and where each line's begin and end.
    tokens: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Lines:
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(breaks, offsets[:-1])  # a line begins with its newline, also where that is its row's first byte
        starts = starts[starts < len(data)]
        words = Words(data, np.append(starts, len(data)), NOT_SPACE)
        many = words.counts >= LEAST_TOKENS
        digits = np.flatnonzero((data >= 48) & (data <= 57))
        held = np.searchsorted(digits, np.append(words.start, len(data)))
        tokens = np.where((held[1:] > held[:-1]) & many[words.row], _FIELD, words.hash)
        place = np.arange(len(tokens)) - words.begin[words.row]
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(tokens * _STEP[place % 64] + mix(place.astype(U64)), dtype=U64)))
        size = np.add.reduceat(NOT_SPACE[data], starts, dtype=np.int64) if len(starts) else starts
        keep = np.flatnonzero(many | (size >= LEAST_BYTES))
        row = np.searchsorted(offsets, starts, "right") - 1
        line = np.searchsorted(breaks, starts, "right") - np.searchsorted(breaks, offsets[row], "left")
        n, at = words.counts[keep], words.begin[keep]
        leaf, whole = (mix(sums[at + np.minimum(n, d)] - sums[at] + n.astype(U64)) for d in (DEPTH, 1 << 40))
        return cls(row[keep], line[keep], many[keep], leaf, whole, tokens, at, at + n)

    def pick(self, which: np.ndarray) -> pa.ListArray:
        """The tokens of some lines."""
        n = (self.end - self.begin)[which]
        at = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(self.begin[which] - at[:-1], n) + np.arange(at[-1])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), signed(self.tokens[flat]))


def _grown(lines: np.ndarray, field: int) -> tuple[np.ndarray, np.ndarray]:
    """The template's number of each line, and the templates; lines: a row of tokens for each, taken in their order."""
    made = np.zeros((16, lines.shape[1]), dtype=lines.dtype)
    size, owner = 0, np.zeros(len(lines), dtype=np.int64)
    for i, own in enumerate(lines):
        same = np.count_nonzero(made[:size] == own, axis=1)
        at = int(same.argmax()) if size else -1
        if at < 0 or same[at] < SIMILAR * len(own):
            if size == len(made):
                made = np.concatenate((made, np.zeros_like(made)))
            made[size] = own
            at, size = size, size + 1
        else:
            made[at][made[at] != own] = field
        owner[i] = at
    return owner, made[:size]


def templates(lines: list[tuple[Hashable, list[str]]]) -> list[tuple[Hashable, int, str]]:
    """(line, template's number, template) for a leaf's distinct lines (line, tokens), taken in their order."""
    number = {FIELD: 0}
    cells = np.array([[number.setdefault(t, len(number)) for t in tokens] for _, tokens in lines], dtype=np.int64).reshape(len(lines), -1)
    owner, made = _grown(cells, 0)
    word = list(number)
    text = [" ".join(word[i] for i in t) for t in made.tolist()]
    return [(line, k, text[k]) for (line, _), k in zip(lines, owner.tolist(), strict=True)]


def _tokens(table: pa.Table) -> np.ndarray:
    flat = table.column("tokens").combine_chunks()
    return flat.flatten().to_numpy().reshape(table.num_rows, -1)


def _even(table: pa.Table) -> pa.Table:
    """The rows with as many tokens as the first: all of them, as leaves are kept by the number of tokens."""
    n = pa.compute.list_value_length(table.column("tokens"))
    return table.filter(pa.compute.equal(n, n[0]))


def _grow(table: pa.Table) -> pa.Table:
    """Templates of a block of a leaf: each line's, and for the lines that begin one its tokens if there are other blocks."""
    table = _even(table.sort_by([("docs", "descending"), ("whole", "ascending")]))
    owner, made = _grown(_tokens(table), int(_FIELD.view(np.int64)))
    docs = np.bincount(owner, table.column("docs").to_numpy())
    _, first = np.unique(owner, return_index=True)
    tokens = [None] * table.num_rows
    if table.column("blocks")[0].as_py() > 1:
        for k, i in enumerate(first.tolist()):
            tokens[i] = made[k].tolist()
    base = table.column("block")[0].as_py() << 32
    return pa.table({"leaf": table.column("leaf"), "whole": table.column("whole"), "template": pa.array(base + owner), "docs": pa.array(docs[owner].astype(np.int64)), "tokens": pa.array(tokens, pa.list_(pa.int64()))})


def _merge(table: pa.Table) -> pa.Table:
    """The number, in the leaf, of each block's templates."""
    table = _even(table.sort_by([("docs", "descending"), ("template", "ascending")]))
    owner, _ = _grown(_tokens(table), int(_FIELD.view(np.int64)))
    return pa.table({"leaf": table.column("leaf"), "template": table.column("template"), "to": pa.array(owner)})


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are in held, which is sorted: the cost grows with x, and with the logarithm of held only."""
    at = np.searchsorted(held, x)
    out = at < len(held)
    out[out] = held[at[out]] == x[out]
    return out


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def recurring(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lines, found): lines (doc, row, whole) of docs (doc, row, text), and (whole) of those whose template occurs in at least `least` documents. doc tells documents apart, row rows."""
    spark = docs.sparkSession
    bounded(spark)
    docs = docs.where("text is not null").select("doc", "row", "text")

    def number(batches: Iterator[pa.RecordBatch]):
        for rows, data, offsets in chunks(batches):
            x = Lines.of(data, offsets)
            _, once = np.unique(mix(x.whole ^ mix(x.row.astype(U64))), return_index=True)
            at = pa.array(x.row[once])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), signed(x.whole[once]), pa.array(x.leaf[once].view(np.int64), mask=~x.many[once])], names=["doc", "row", "whole", "leaf"])

    lines = save(docs.mapInArrow(number, "doc long, row long, whole long, leaf long"), "lines")
    # a document counts once for a line, and what is distinct is counted before it is grouped further
    held = lines.select("whole", "leaf", "doc").distinct()
    distinct = save(held.groupBy("whole", "leaf").agg(F.count("*").alias("docs")), "lines-distinct")
    full = save(distinct.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"), "lines-full")
    blocks = F.ceil(F.col("size") / F.lit(LEAF)).cast("long")
    shared = distinct.join(_few(full, SMALL // 4), "leaf").select("leaf", "whole", "docs", blocks.alias("blocks"), F.pmod(F.xxhash64("whole", F.lit(5)), blocks).alias("block"))

    bit = F.pmod("leaf", F.lit(LEAF_BITS))
    word = full.groupBy((F.floor(bit / 64)).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    bits = np.zeros(LEAF_BITS // 64, dtype=np.int64)
    found = word.toArrow()  # at most LEAF_BITS / 64 rows
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    known = spark.sparkContext.broadcast(bits)

    def fetch(batches: Iterator[pa.RecordBatch]):
        for _, data, offsets in chunks(batches):
            x = Lines.of(data, offsets)
            at = x.leaf & U64(LEAF_BITS - 1)
            some = np.flatnonzero(x.many & ((known.value[(at >> U64(6)).astype(np.int64)].view(U64) >> (at & U64(63))) & U64(1)).astype(bool))
            some = some[np.unique(x.whole[some], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([signed(x.whole[some]), x.pick(some)], names=["whole", "tokens"])

    tokens = docs.select("text").mapInArrow(fetch, "whole long, tokens array<long>").groupBy("whole").agg(F.first("tokens").alias("tokens"))
    grown = shared.join(tokens, "whole").groupBy("leaf", "block").applyInArrow(_grow, "leaf long, whole long, template long, docs long, tokens array<long>")
    grown = save(grown, "lines-templates")
    merged = save(grown.where("tokens is not null").select("leaf", "template", "docs", "tokens").groupBy("leaf").applyInArrow(_merge, "leaf long, template long, to long"), "lines-merged")
    grown = grown.select("leaf", "whole", "template")
    if not merged.isEmpty():
        grown = grown.join(_few(merged, SMALL // 4), ["leaf", "template"], "left").select("leaf", "whole", F.coalesce("to", "template").alias("template"))
    several = grown.groupBy("leaf", "template").agg(F.count("*").alias("k")).where("k > 1").select("leaf", "template")
    members = save(grown.join(several, ["leaf", "template"]), "lines-members")
    # documents of a template: each counts once, also with several of its lines
    wide = lines.select("doc", "whole").join(_few(members, SMALL // 4), "whole").select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    found = distinct.where(F.col("docs") >= least).select("whole").union(members.join(wide, ["leaf", "template"]).select("whole")).distinct()
    found = save(found, "lines-recurring")
    for x in (distinct, full, merged, members):
        drop(x)
    return lines, found


def drop_recurring(docs: DataFrame, least: int = 3) -> DataFrame:
    """docs with text without its recurring lines, and n_lines and n_dropped; a row for each row of docs.

    A line ends at a newline; lines of fewer than LEAST_TOKENS tokens go only where they recur exactly, and stay if
    they have fewer than LEAST_BYTES bytes too; the newlines between lines that stay are kept. A null text stays null
    with 0 lines; a text of recurring lines only becomes empty. Rows that repeat a doc_id are one document for
    counting; each loses the lines of its own. Null doc_ids are one id. Columns of docs named n_lines or n_dropped are
    replaced, all others stay as they are, whatever they are called.
    """
    docs = docs.drop("n_lines", "n_dropped")
    bounded(docs.sparkSession)
    row = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(7))
    lines, found = recurring(docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("doc"), row.alias("row"), "text"), least)
    added = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    if found.count() <= SMALL:
        gone = docs.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column(0).to_numpy()))
        text = docs.columns.index("text")

        def cut(batches: Iterator[pa.RecordBatch]):
            for rows, data, offsets in chunks(batches):
                yield _cut(rows, text, Lines.of(data, offsets), lambda x: _among(x.whole.view(np.int64), gone.value), list(rows.columns))

        return docs.mapInArrow(cut, StructType([*docs.schema.fields, *added]))

    # more than a broadcast holds: each row gets the lines that it loses
    lost = lines.join(found, "whole", "left_semi").groupBy("row").agg(F.collect_set("whole").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("held"), "text", row.alias("row")).join(save(lost, "lines-lost"), "row", "left").select("held", "text", "gone")
    names = docs.columns

    def cut_each(batches: Iterator[pa.RecordBatch]):
        for rows, data, offsets in chunks(batches):
            own = [() if g is None else g for g in rows.column(2).to_pylist()]
            keys = {(r, w) for r, gone in enumerate(own) for w in gone}
            pick = lambda x: np.array([k in keys for k in zip(x.row.tolist(), x.whole.view(np.int64).tolist(), strict=True)], dtype=bool)  # noqa: E731, B023
            held = rows.column(0)
            yield _cut(rows, names.index("text"), Lines.of(data, offsets), pick, [held.field(i) for i in range(len(names))], names)

    return rows.mapInArrow(cut_each, StructType([*docs.schema.fields, *added]))


def _cut(rows: pa.RecordBatch, text: int, lines: Lines, recur, columns: list[pa.Array], names: list[str] | None = None) -> pa.RecordBatch:
    """The columns, the one at `text` without the lines that recur, and how many lines there were and are dropped."""
    hit = np.flatnonzero(recur(lines))
    dropped = np.bincount(lines.row[hit], minlength=rows.num_rows)
    at = np.concatenate(([0], np.cumsum(dropped)))
    texts = columns[text]
    counts = pa.compute.fill_null(pa.compute.add(pa.compute.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
    if len(hit):
        out = texts.to_pylist()
        for r in np.flatnonzero(dropped).tolist():
            gone = set(lines.line[hit[at[r] : at[r + 1]]].tolist())
            out[r] = "\n".join(x for i, x in enumerate(out[r].split("\n")) if i not in gone)
        columns[text] = pa.array(out, texts.type)
    return pa.RecordBatch.from_arrays([*columns, counts, pa.array(dropped, pa.int64())], names=[*(names or rows.schema.names), "n_lines", "n_dropped"])
