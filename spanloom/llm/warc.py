"""WARC archives with an index.

`write_archives` writes each task's records to archives of its own in the shared folder, as they come, so no page is moved;
what it returns is the index, saved before anything is read: for each record its archive, offset, length, URL and payload
digest. An archive's name has the attempt of its task, and only the rows of attempts that are committed are in the index, so
what a lost executor leaves is never read. `read_records` takes rows of the index, sorts their byte ranges, coalesces near
ones into single reads, and parses the records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import bounded, drop, new_path, save

#: Bytes of an archive at most, but for its last record.
MOST = 1 << 30
#: Payloads below this size are never revisits.
REVISIT_BYTES = 100
#: Ranges this close are read at once, up to READ bytes.
GAP = 64 << 10
READ = 4 << 20
#: Digests that repeat, up to this count, are broadcast (some 100 MB); more are joined by a shuffle.
SMALL = 1_000_000
#: Rows that repeat a page's id and payload are made in so many at once.
REPEATS = 100_000
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _digested(pages: DataFrame) -> DataFrame:
    """page_id, url, html, with null html as empty, and its size and digest."""
    body = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")  # a header is one line
    return pages.select("page_id", url.alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body.cast("binary"), 256).alias("digest"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _head(rows: DataFrame) -> Column:
    """A record's WARC and HTTP headers, from page_id, url, bytes, digest, kind and refers_to."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("kind") == "revisit"
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("kind"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit(END), http,
    )


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _with_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest, kind and refers_to of every row; html is null for revisits."""
    rows = _digested(pages)
    narrow = save(rows.select("page_id", "digest", "bytes"), "warc-digests")
    equal = narrow.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    first = save(equal.where("n > 1 and least is not null").select("digest", "least"), "warc-first")
    twice = save(narrow.join(_few(first), "digest").where("page_id = least").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("twice")), "warc-twice")
    drop(narrow)
    columns = ("page_id", "url", "html", "bytes", "digest", "kind", "refers_to")

    def marked(rows: DataFrame, response: Column) -> DataFrame:
        kind = F.when(response, "response").otherwise("revisit")
        return rows.select("page_id", "url", F.when(response, F.col("html")).alias("html"), "bytes", "digest", kind.alias("kind"), F.when(~response, F.col("least")).alias("refers_to")).select(*columns)

    rows = rows.join(_few(first), "digest", "left")
    alone = F.col("least").isNull() | F.coalesce(F.col("page_id") == F.col("least"), F.lit(False))
    if twice.isEmpty():
        return marked(rows, alone)
    # rows that repeat the response's id and payload: one of them is the response, and they differ in their URL at most
    rows = rows.join(_few(twice), "digest", "left")
    repeated = F.coalesce(F.col("twice") & (F.col("page_id") == F.col("least")), F.lit(False))
    same = rows.where(repeated)
    lead = same.groupBy("digest").agg(F.min(F.struct("url")).alias("lead"))
    same = same.groupBy("page_id", "url", "digest", "bytes", "least").agg(F.first("html").alias("html"), F.count("*").alias("n")).join(_few(lead), "digest")
    same = same.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    here = F.col("lead.url").eqNullSafe(F.col("url")) & (F.col("start") == 0)
    same = same.withColumn("html", F.when(here, F.col("html"))).repartition("digest", "url", "start")
    same = same.withColumn("i", F.explode(F.sequence("start", F.least(F.col("start") + REPEATS, "n") - 1)))
    return marked(rows.where(~repeated), alone).unionByName(marked(same, here & (F.col("i") == 0)))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives under path, and returns their index: page_id, url, digest, bytes, kind, refers_to, archive, offset, length.

    Of records with equal payloads of at least REVISIT_BYTES bytes the one with the smallest page_id is the
    response, the others revisit it. Null html is an empty payload; a null url gives no Target-URI; a null
    page_id is written as `null`, and such a row is a response unless its payload has one with an id.
    Of rows that repeat a page_id and payload one with the smallest url is the response. Other columns are ignored.
    """
    bounded(pages.sparkSession)
    rows = _with_kinds(pages)
    rows = rows.select("page_id", "url", "digest", "bytes", "kind", "refers_to", F.concat(_head(rows), F.coalesce("html", F.lit(""))).alias("record"))

    def write(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        from pyarrow.fs import FileSystem

        task = TaskContext.get()
        store, root = FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        file, number, at = None, 0, 0
        try:
            for batch in batches:
                names, offsets, lengths = [], [], []
                for record in batch.column(6):
                    if file is None or at >= MOST:
                        if file is not None:
                            file.close()
                        name, at, number = f"{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc", 0, number + 1
                        file = store.open_output_stream(f"{root}/{name}")
                    data = record.as_buffer()
                    file.write(data)
                    file.write(END.encode())
                    names.append(name)
                    offsets.append(at)
                    lengths.append(data.size)
                    at += data.size + len(END)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[*batch.schema.names[:6], "archive", "offset", "length"])
        finally:
            if file is not None:
                file.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("record").schema)
    return save(rows.mapInArrow(write, f"{schema}, archive string, offset long, length long"), "warc-index")


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers by lower-case name, HTTP headers, payload) of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record at this offset")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if len(block) != int(named["content-length"]):
        raise ValueError("a record's length isn't its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, http, payload


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) as reads (begin, end, number of ranges)."""
    out: list[list[int]] = []
    for a, n in ranges:
        if out and a - out[-1][1] <= GAP and a + n - out[-1][0] <= READ:
            out[-1][1:] = [max(out[-1][1], a + n), out[-1][2] + 1]
        else:
            out.append([a, a + n, 1])
    return [tuple(x) for x in out]


def read_records(selected: DataFrame, path: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of the selected rows of the index.

    page_id, type, sizes and digests are those of the records read, not of the index. payload is null for
    revisits; their payload_bytes and payload_digest are of the full payload.
    """
    from pyarrow.fs import FileSystem

    bounded(selected.sparkSession)
    part = F.expr(f"offset div {8 * READ}")
    rows = selected.select("archive", "offset", "length").withColumn("part", part).repartition("archive", "part").sortWithinPartitions("archive", "offset").drop("part")

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            archive, offset, length = (batch.column(i).to_pylist() for i in range(3))
            a = 0
            while a < len(archive):
                b = a
                while b < len(archive) and archive[b] == archive[a]:
                    b += 1
                store, root = FileSystem.from_uri(path)
                with store.open_input_file(f"{root}/{archive[a]}") as file:
                    at = a
                    for begin, end, n in coalesced(list(zip(offset[a:b], length[a:b], strict=True))):
                        data = file.read_at(end - begin, begin)
                        yield _batch([parse(data[offset[i] - begin : offset[i] - begin + length[i]]) for i in range(at, at + n)])
                        at += n
                a = b

    return rows.mapInArrow(read, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def _batch(records: list) -> pa.RecordBatch:
    urn = re.compile("<urn:page:(.*)>")
    out = []
    for named, http, payload in records:
        revisit = named["warc-type"] == "revisit"
        size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
        digest = named["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't have its digest")
        own = urn.match(named["warc-record-id"])[1]
        out.append((None if own == "null" else own, named.get("warc-target-uri"), named["warc-type"], None if revisit else payload, size, digest, urn.match(named["warc-refers-to"])[1] if revisit else None))
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every row of pages, read back from the archives written."""
    path = new_path(pages.sparkSession, "warc")
    index = write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_records(index, path)  # lazily: the archives stay until the driver ends
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
