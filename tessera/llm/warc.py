"""WARC archives: written by Spark's own text writer, read back by boundary-chain verification.

Reading splits each archive into byte ranges.  A task reports, for every place in its range that looks like
a record, where the chain of records that begins there leaves the range.  Pointer jumping from offset 0
then tells where the one true chain enters each range, and a second pass walks from there.  What looks like
a record inside a payload is never entered, as the chain steps over it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, written

#: Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
BLANK = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Bytes in which a record's header is looked for at first.
HEADER = 1 << 16
#: Bytes of a range of an archive, and of all ranges of a task.
BLOCK, TASK = 8 << 20, 128 << 20


def sha1_base32(body: Column) -> Column:
    """Bare upper-case base32 SHA-1; 20 bits, which are five hex and four base32 digits, at a time."""
    hexed = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def with_payload(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, payload binary, digest); a null payload is the empty one."""
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"), sha1_base32(body).alias("digest"))


def first_of_equals(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, first id) of the payloads of at least so many bytes that several rows have; pre-aggregated before the shuffle."""
    long = rows.where(F.octet_length("payload") >= least_bytes)
    return long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").select("digest", "first")


def records(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(value): the text of a record without the blank lines that end it.

    Of rows with equal payloads, those with the smallest id become responses and the others revisits, without
    the payload, that name it.  Rows with a null id revisit the smallest id; without one all are responses.
    Repeated rows make repeated records.  The list of repeated payloads is written first, so that Spark
    joins it by broadcast if its file is below the broadcast threshold and by a shuffle beyond.
    """
    rows = with_payload(pages, key, url, html)
    first = written(first_of_equals(rows, least_bytes), "firsts")
    rows = rows.join(first, (rows.digest == first.digest) & (F.octet_length("payload") >= least_bytes), "left").drop(first.digest)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    nl, size = F.lit("\r\n"), F.octet_length("payload").cast("string")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), nl,
        F.lit("WARC-Record-ID: "), name(F.col("id")), nl,
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, nl), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), nl,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")), nl)).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 50_000, **names: str) -> None:
    """WARC files at ``path``, one or more for each partition; a record ends with two line ends, which serve as the writer's separator."""
    out = records(pages, least_bytes, **names)
    out.write.option("lineSep", BLANK.decode()).option("maxRecordsPerFile", records_per_file).text(path)


class ByteFile:
    """Ranges of a file, local or in any store that Arrow knows."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            self.file = open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(name)

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)


def parse_header(raw: bytes) -> dict[str, str] | None:
    """Fields, names in lower case, of bytes that begin with the magic; None if that is no whole header with a length."""
    end = raw.find(BLANK)
    if end < 0 or not raw.startswith(MAGIC):
        return None
    fields = {"": str(end + 4)}
    for line in raw[len(MAGIC) : end].split(b"\r\n"):
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def header_at(f: ByteFile, data: bytes, base: int, at: int) -> dict[str, str] | None:
    """The header at a place of the file, of which ``data`` begins at ``base``; a long one is read on in doubling steps."""
    n = HEADER
    end = data.find(BLANK, at - base, at - base + n)
    if end >= 0:
        return parse_header(data[at - base : end + 4])
    raw = data[at - base : at - base + n]
    while len(raw) == n and raw.startswith(MAGIC) and BLANK not in raw and all(b":" in x for x in raw[len(MAGIC) :].split(b"\r\n")[:-1]):
        n *= 2
        raw = f.read(at, n)
    return parse_header(raw)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, start, stop) ranges to (path, at, to): each candidate and where its chain leaves the range."""
    for batch in batches:
        for r in batch.to_pylist():
            data = (f := ByteFile(r["path"])).read(r["start"], r["stop"] - r["start"] + HEADER)
            n, at, nexts = r["stop"] - r["start"], data.find(MAGIC), {}
            while 0 <= at < n:
                if head := header_at(f, data, r["start"], r["start"] + at):
                    nexts[at] = at + int(head[""]) + int(head["content-length"]) + 4
                at = data.find(MAGIC, at + 1)
            leaves: dict[int, int] = {}
            for at in sorted(nexts, reverse=True):  # a successor is always further on
                leaves[at] = leaves.get(nexts[at], nexts[at])
            f.file.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"]] * len(leaves), pa.string()), "at": pa.array([r["start"] + a for a in leaves], pa.int64()), "to": pa.array([r["start"] + b for b in leaves.values()], pa.int64())})


_FIELDS = "path string, at long, id long, record_type string, url string, digest string, refers_to long, payload_bytes long, payload binary"


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, stop): from a true record on, all records that begin before stop; a few MB at a time."""
    kinds = [("path", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(kinds)
    for batch in batches:
        for r in batch.to_pylist():
            f, at, rows, held = ByteFile(r["path"]), r["at"], [], 0
            data, base = b"", at
            while at < r["stop"]:
                if at - base + HEADER > len(data) and base + len(data) < r["size"]:
                    data, base = f.read(at, BLOCK), at
                head = header_at(f, data, base, at)
                if head is None:
                    raise ValueError(f"{r['path']}: no record at {at}")
                first, size = at + int(head[""]), int(head["content-length"])
                block = data[first - base : first - base + size]
                if len(block) < size:
                    block = f.read(first, size)
                http, _, body = block.partition(BLANK)
                length = [int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                kind = head.get("warc-type")
                rows.append({
                    "path": r["path"], "at": at, "id": _page(head.get("warc-record-id")), "record_type": kind, "url": head.get("warc-target-uri"),
                    "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page(head.get("warc-refers-to")),
                    "payload_bytes": length[0] if length else len(body), "payload": body if kind == "response" else None,
                })
                held += size
                at = first + size + 4
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            f.file.close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """All records of the archives at ``path``: path, at, id, record_type, url, digest, refers_to, payload_bytes, payload.

    Rounds of pointer jumping: log2 of the ranges of the longest file.  An archive whose chain doesn't end
    exactly at its end is damaged: that is an error, never a silent loss.  No archives: no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    longest, total = files.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    spread = 4 * spark.sparkContext.defaultParallelism  # as many tasks as keep all cores busy, or one for each 128 MB
    tasks = max(1, math.ceil(total / max(block, TASK)), min(spread, math.ceil(total / block)))
    ranges = files.select("path", "size", F.explode(F.expr(f"sequence(0, (size - 1) div {block})")).alias("block"))
    ranges = ranges.select("path", (F.col("block") * block).alias("start"), F.least((F.col("block") + 1) * block, "size").alias("stop"))
    chains = written(ranges.repartition(tasks, "path", "start").mapInArrow(_chains, "path string, at long, to long"), "chains")
    # only where a chain of another range leads to can the true chain enter
    led = chains.select("path", F.col("to").alias("at")).union(files.select("path", F.lit(0).cast("long").alias("at"))).distinct()
    hop = written(chains.join(led, ["path", "at"], "left_semi"), "entries")
    discard(chains)
    on = hop.select("path", "at").where("at = 0")
    for k in range(max(1, math.ceil(math.log2(max(1, longest / block)))) + 1):
        on = written(on.union(on.join(hop, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct(), f"on{k}")
        nxt = hop.withColumnRenamed("to", "mid").join(hop.select("path", F.col("at").alias("mid"), "to"), ["path", "mid"], "left")
        hop = written(nxt.select("path", "at", F.coalesce("to", "mid").alias("to")), f"hop{k}")
    if files.join(on.withColumnRenamed("at", "size"), ["path", "size"], "left_anti").limit(1).count():
        raise ValueError(f"{path}: the records of an archive don't reach its end")
    entries = on.join(files, "path").where("at < size")
    entries = entries.withColumn("stop", F.least((F.col("at") / block).cast("long") * block + block, F.col("size")))
    return entries.repartition(tasks, "path", "at").mapInArrow(_walk, _FIELDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive a table of pages in the shared folder, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those of the full payload: of a response taken anew from what was read, of a revisit
    those that its record states.  See ``records`` for null ids, null and equal payloads and repeated rows;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, least_bytes)
    got = read_archives(spark, path)
    whole = F.col("payload").isNotNull()
    return got.select(
        F.col("id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, sha1_base32(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
