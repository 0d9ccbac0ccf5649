"""Language ID with language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that are typical of it. The filters are bit-sliced: a slot
holds a word with a bit for each language, so one AND over an n-gram's slots gives the set of languages
that contain it. A text's n-grams are looked up, the languages' bits are counted, each count is corrected
for its filter's rate of false positives, and the largest share decides.

An n-gram is as many bytes as LENGTHS says of a lower-cased word between two spaces; a word is a run of letters. So the
shortest words have n-grams too, and a long text is read in pieces of whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import tokens
from .scratch import bounded, drop, save
from .tokens import LOWER, U64, chunks, mix

#: Bytes of an n-gram, the spaces around its word included.
LENGTHS = (3, 4, 5)
#: Documents of each language that the filters are learned from, about: the documented bound of the sample.
SAMPLE_DOCS = 1500
#: N-grams of a language's filter at most, its most frequent ones.
NGRAMS = 60_000
#: Slots of the bit-sliced filters, a power of two, and hash functions.
SLOTS = 1 << 21
HASHES = 2
#: An n-gram is typical of a language if its rate there is at least this part of its highest rate.
TYPICAL = 0.25
#: N-grams seen less often in the sample are noise.
LEAST = 3
#: Languages are the bits of one word.
MAX_LANGUAGES = 64
#: N-grams that are counted together in a worker.
HELD = 1 << 20
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Filters:
    """Bit-sliced Bloom filters of the languages."""

    langs: list[str]
    slots: np.ndarray
    #: Each filter's rate of false positives: its filled part to the power of the hashes.
    fill: np.ndarray
    #: The most frequent language, for texts without evidence.
    usual: int = 0

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], usual: str | None) -> Filters:
        langs = sorted(grams)
        if len(langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        slots = np.zeros(SLOTS, dtype=U64)
        for bit, lang in enumerate(langs):
            for at in places(grams[lang]):
                slots[at] |= U64(1) << U64(bit)
        fill = np.array([np.count_nonzero(slots & (U64(1) << U64(b))) / SLOTS for b in range(len(langs))]) ** HASHES
        return cls(langs, slots, fill, langs.index(usual) if usual is not None else 0)

    def hits(self, grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): how many of each row's n-grams each language's filter holds."""
        a, b = places(grams)
        mask = self.slots[a] & self.slots[b]
        return np.stack([np.bincount(row, (mask >> U64(k)) & U64(1), rows) for k in range(len(self.langs))], axis=1)


def places(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams)
    return [((h >> U64(k * 24)) & U64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of some rows as whole numbers, and the row of each, piece by piece."""
    a = 0
    while a < len(data):
        b = tokens.word_end(data, a + tokens.CHUNK_BYTES, _LETTER)
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]
        cuts = np.concatenate(([a], inner, [b]))
        yield from _piece(data[a:b], cuts - a, np.searchsorted(offsets, cuts[:-1], "right") - 1)
        a = b


def _piece(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = np.repeat(np.arange(len(rows)), np.diff(offsets))
    flat = np.full(len(data) + 2 * len(rows), 32, dtype=np.uint8)  # a space before and after each row
    flat[np.arange(len(data)) + 2 * own + 1] = np.where(_LETTER[data], LOWER[data], 32)
    row = np.repeat(rows, np.diff(offsets) + 2).astype(np.int32)
    letter = flat != 32
    keep = letter.copy()  # of a run of spaces only the first, and the first of each row
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    flat, row, letter = flat[keep], row[keep], letter[keep]
    gram, held = flat.astype(U64), np.ones(len(flat), dtype=bool)
    for n in range(2, max(LENGTHS) + 1):
        if len(flat) < n:
            return
        gram = gram[:-1] | (flat[n - 1 :].astype(U64) << U64(8 * (n - 1)))
        held = held[:-1] & letter[n - 2 : -1] if n > 2 else held[:-1]
        if n in LENGTHS:
            at = np.flatnonzero(held & (row[: len(gram)] == row[n - 1 :]))
            yield gram[at] | U64(n << 56), row[at]


def train_part(doc_id: Column) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def learn(docs: DataFrame) -> Filters:
    """Filters of the languages of the rows of docs (doc_id, text, lang) that may be learned from, from about SAMPLE_DOCS of each.

    Every language's rows are counted; a row is in the sample if its text's hash is below the part of them
    that is wanted, so the sample is the same at each run.
    """
    bounded(docs.sparkSession)
    rows = docs.where(train_part(F.col("doc_id"))).where("lang is not null and text is not null").select("text", "lang")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return Filters.build({}, None)
    part = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < part[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch, data, offsets in chunks(batches):
            langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist())
            for grams, row in ngrams(data, offsets):
                for lang in np.unique(langs[row]):
                    held.setdefault(str(lang), []).append(grams[langs[row] == lang])
                size += len(grams)
            if size >= HELD:
                yield from _counted(held)
                held, size = {}, 0
        yield from _counted(held)

    sums = save(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("gram").pivot("lang", sorted(counts)).agg(F.sum("n")).na.fill(0), "langid-grams")
    langs = sorted(counts)
    totals = sums.agg(*[F.sum(f"`{x}`").alias(str(i)) for i, x in enumerate(langs)]).first()
    rate = {x: F.col(f"`{x}`") / F.lit(float(totals[i] or 1)) for i, x in enumerate(langs)}
    most = F.greatest(*rate.values()) if len(langs) > 1 else rate[langs[0]]
    grams = {}
    for lang in langs:  # at most NGRAMS of each language reach the driver
        typical = sums.where((F.col(f"`{lang}`") >= LEAST) & (rate[lang] >= most * TYPICAL))
        found = typical.orderBy(F.col(f"`{lang}`").desc(), "gram").limit(NGRAMS).select("gram").toArrow()
        grams[lang] = found.column(0).to_numpy().view(U64)
    drop(sums)
    return Filters.build(grams, min(counts, key=lambda x: (-counts[x], x)))


def _counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _decided(f: Filters, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """lang_pred and score of each row."""
    langs, score = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
    if not f.langs:
        return langs, score
    hits, n = np.zeros((rows.num_rows, len(f.langs))), np.zeros(rows.num_rows)
    for grams, row in ngrams(data, offsets):
        hits += f.hits(grams, row, rows.num_rows)
        n += np.bincount(row, minlength=rows.num_rows)
    true = np.maximum(0, (hits - n[:, None] * f.fill) / (1 - f.fill))
    total = true.sum(axis=1)
    best = np.where(total > 0, true.argmax(axis=1), f.usual)
    score = np.where(total > 0, true[np.arange(rows.num_rows), best] / np.maximum(total, 1e-300), 0.0)
    at = np.flatnonzero(_LETTER[data] & (data < 128))
    has = np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])
    texts = rows.column(rows.schema.get_field_index("text"))
    for r in range(rows.num_rows):
        if has[r] or (offsets[r] < offsets[r + 1] and any(c.isalpha() for c in texts[r].as_py())):
            langs[r] = f.langs[best[r]]
        else:
            score[r] = 0.0
    return langs, np.clip(score, 0, 1)


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (those of keep, or all but lang_pred and score), and these two, for every row.

    lang_pred: the language with the largest corrected count of the text's n-grams; ties go to the first by
    name. score: that count's share of all, 0 to 1. `und` with score 0: a null text or one without letters,
    or nothing to learn from. A text with letters but no n-gram in any filter gets the language that is
    most frequent in training, with score 0. Whole texts count, however long.
    """
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast(filters)
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    docs = docs.select(*dict.fromkeys([*names, "text"]))
    schema = StructType([*(docs.schema[c] for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def decide(batches: Iterator[pa.RecordBatch]):
        for rows, data, offsets in chunks(batches):
            langs, score = _decided(shared.value, rows, data, offsets)
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(decide, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, learned from the rows that are not held out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(rows, learn(docs.select("doc_id", "text", "lang")), ("doc_id", "held_out"))


def keep_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs whose text has a language: not `und`, and the best language's share is at least `least` (0: short but clean texts stay).

    All columns stay as they are, whatever they are called; null texts and texts without letters go.
    """
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast(learn(docs.select("doc_id", "text", "lang")))

    def known(batches: Iterator[pa.RecordBatch]):
        for rows, data, offsets in chunks(batches):
            langs, score = _decided(shared.value, rows, data, offsets)
            yield rows.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
