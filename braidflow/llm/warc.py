"""WARC archives: writing, normalising monolithic gzip files, and reading by index.

A whole archive in one gzip stream can't be read from the middle. The normaliser inflates such a stream once, record by
record, writes every record as a gzip member of its own, and beside the archive an index of offsets. On the way it turns
records whose payload another record holds into revisits. Which those are is found on digests alone: each archive's task
notes them as it writes, a partial aggregate by digest keeps the record of the largest page_id, and the others' places go
to their archives' tasks. Pages themselves are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import filesystem, materialise, prepare, put_file, shared_dir

#: Payloads below so many bytes are never revisits. The date is a parameter, so that tasks that run again write the same.
LEAST_BYTES, DATE, LEVEL = 1000, "2024-01-01T00:00:00Z", 3
#: Records of one payload from which their places are found without dealing them by digest, and such payloads at most.
MANY, MOST_MANY = 10_000, 500_000
CHUNK = 1 << 18
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
META = "archive int, seq long, page_id long, payload_bytes long, payload_digest string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive int"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(archive: int, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'archive {archive} record {seq}')}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def response(archive: int, seq: int, page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(archive, seq)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers += [("WARC-Payload-Digest", base32(digest)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + payload)


def revisit(headers: dict[str, str], block: bytes, refers: tuple[int, int, int | None]) -> bytes:
    """The record as a revisit: its HTTP headers without the payload, and where the payload is."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kept = {k: v for k, v in headers.items() if k != "Content-Length"} | {"WARC-Type": "revisit"}
    kept |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*refers[:2]), "X-Payload-Bytes": str(len(payload))}
    if refers[2] is not None:
        kept["X-Refers-To-Page-Id"] = str(refers[2])
    return record(list(kept.items()), http + b"\r\n\r\n")


def parse(read: Callable[[], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an inflated stream, of which read() gives the next bytes and at last none."""
    held = bytearray()
    ended = False

    def until(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            part = read()
            ended = not part
            held.extend(part)
        return len(held) >= n

    while until(1):
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not until(len(held) + 1):
                raise ValueError("a record's header is cut off")
            at = held.find(b"\r\n\r\n")
        lines = bytes(held[:at]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = at + 4 + int(headers["Content-Length"])
        if not until(end + 4):
            raise ValueError("a record's block is cut off")
        block = bytes(held[at + 4 : end])
        del held[: end + 4]
        yield headers, block


def inflate(stream) -> Callable[[], bytes]:
    """Reads a gzip stream of one or more members bit by bit."""
    state = {"z": zlib.decompressobj(31), "rest": b"", "fed": False}

    def read() -> bytes:
        while True:
            data = state["rest"] or stream.read(CHUNK)
            state["rest"] = b""
            if not data:
                if state["fed"] and not state["z"].eof:
                    raise ValueError("the gzip stream is cut off")
                return b""
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            out = state["z"].decompress(data, CHUNK * 4)
            state["fed"] = True
            state["rest"] = state["z"].unused_data if state["z"].eof else state["z"].unconsumed_tail
            if out:
                return out

    return read


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(source: str, target: str, revisits: dict[int, tuple[int, int, int | None]]) -> int:
    """Rewrite a monolithic archive with a member a record, and an index beside it; revisits: what records, by their place,
    refer to. Gives the number of records. The index comes last: an archive that has one is whole."""
    index: list[str] = []

    def write(out) -> None:
        system, path = filesystem(source)
        at = 0
        with system.open_input_stream(path, compression=None) as stream:
            for seq, (headers, block) in enumerate(parse(inflate(stream))):
                rows = list(headers.items())
                data = revisit(headers, block, revisits[seq]) if seq in revisits else record([x for x in rows if x[0] != "Content-Length"], block)
                packed = member(data)
                out.write(packed)
                index.append(json.dumps({"offset": at, "length": len(packed), "type": "revisit" if seq in revisits else headers["WARC-Type"], "id": headers["WARC-Record-ID"], "uri": headers.get("WARC-Target-URI"), "digest": headers.get("WARC-Payload-Digest")}))
                at += len(packed)

    put_file(target, write)
    put_file(target + ".idx", lambda s: s.write("".join(x + "\n" for x in index).encode()))
    return len(index)


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record of an index entry, from its own member alone."""
    file.seek(offset)
    data = zlib.decompress(file.read(length), 31)
    parts = [data]
    return next(parse(lambda: parts.pop() if parts else b""))


def archive_uri(folder: str, number: int) -> str:
    return f"{folder}/archive-{number:06d}.warc.gz"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """An archive, one gzip stream, for each partition of (page_id, url, html); gives each record's place, size and digest.

    A null html has an empty payload, a null url no target, a null page_id no page number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        rows: list[tuple] = []
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def write(out) -> None:
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for b in (x for part in ([first], batches) for x in part):
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode("utf-8")
                    digest = hashlib.sha1(payload).hexdigest()
                    out.write(z.compress(response(number, len(rows), page_id, url, payload, digest)))
                    rows.append((number, len(rows), page_id, len(payload), digest))
            out.write(z.flush())

        put_file(archive_uri(folder, number), write)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["archive", "seq", "page_id", "payload_bytes", "payload_digest"]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(rows.mapInArrow(run, META), "warc-records")


def revisits_of(meta: DataFrame, least_bytes: int) -> DataFrame:
    """(archive, seq, to_archive, to_seq, refers_to) of records whose payload, of least_bytes or more, a record of a larger
    page_id has; of records that share that page_id too the last one written is kept."""
    place = F.struct("page_id", "archive", "seq")
    rows = meta.filter(F.col("payload_bytes") >= least_bytes).withColumnRenamed("payload_digest", "d")
    groups = rows.groupBy("d").agg(F.max(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("d", "digest")
    groups = materialise(groups, "warc-groups")
    same = F.col("d") == F.col("digest")
    # Of payloads with many records there are few: one in MANY records at most.
    many = groups.filter(F.col("n") >= MANY)
    if 0 < many.count() <= MOST_MANY:
        few = rows.join(F.broadcast(many), same, "left_anti").join(groups.filter(F.col("n") < MANY), same)
        found = rows.join(F.broadcast(many), same).unionByName(few)
    else:
        found = rows.join(groups, same)
    found = found.filter((F.col("archive") != F.col("kept.archive")) | (F.col("seq") != F.col("kept.seq")))
    return found.select("archive", "seq", F.col("kept.archive").alias("to_archive"), F.col("kept.seq").alias("to_seq"), F.col("kept.page_id").alias("refers_to"))


def normalise_all(spark: SparkSession, source: str, target: str, meta: DataFrame, revisits: DataFrame) -> DataFrame:
    """Normalise each archive in a task of its own, which gets the revisits of that archive alone."""

    def run(archives: pd.DataFrame, found: pd.DataFrame, source: str, target: str) -> pd.DataFrame:
        out = []
        rows = {int(r.seq): (int(r.to_archive), int(r.to_seq), None if pd.isna(r.refers_to) else int(r.refers_to)) for r in found.itertuples()}
        for number in archives["number"]:
            out.append((number, normalise(archive_uri(source, number), archive_uri(target, number), rows)))
        return pd.DataFrame(out, columns=["archive", "records"]).astype({"archive": "int32", "records": "int64"})

    archives = materialise(meta.select(F.col("archive").alias("number")).distinct(), "warc-numbers")
    # Dealt by count: their rows are few, but each stands for an archive to inflate.
    parts = max(1, 2 * archives.count())
    # Page numbers would lose digits as floating point: they travel as text.
    revisits = revisits.withColumn("refers_to", F.col("refers_to").cast("string"))
    done = archives.repartition(parts, "number").groupBy("number").cogroup(revisits.repartition(parts, "archive").groupBy("archive")).applyInPandas(partial(run, source=source, target=target), "archive int, records long")
    return materialise(done, "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, read through their indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()]
        for batch in batches:
            for number in batch.column("archive").to_pylist():
                system, path = filesystem(archive_uri(folder, number))
                with system.open_input_stream(path + ".idx") as s:
                    index = [json.loads(x) for x in s.read().splitlines()]
                rows: list[tuple] = []
                with system.open_input_file(path) as file:
                    for entry in index:
                        headers, block = read_record(file, entry["offset"], entry["length"])
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        kind = headers["WARC-Type"]
                        if kind == "revisit":
                            size = int(headers["X-Payload-Bytes"])
                            digest = base64.b32decode(headers["WARC-Payload-Digest"].split(":")[1]).hex()
                        else:
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if base32(digest) != headers["WARC-Payload-Digest"]:
                                raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                        rows.append((int(page) if page is not None else None, size, digest, kind, int(refers) if refers is not None else None, headers.get("WARC-Target-URI"), number))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").mapInArrow(run, ROWS)


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages as WARC, normalise the archives and read them back: page_id, payload_bytes, payload_digest, record_type
    (response or revisit) and refers_to.

    Rows that repeat a page_id are records of their own; of equal payloads they count as a smaller page_id, in order of
    writing. A null page_id is smaller than all others, and a revisit to it has a null refers_to. An empty table gives no
    archive and no rows. Columns other than page_id, url and html are ignored.
    """
    spark = prepare(pages.sparkSession)
    raw, done = shared_dir(spark, "warc-monolithic"), shared_dir(spark, "warc")
    meta = write_monolithic(pages, raw)
    archives = normalise_all(spark, raw, done, meta, revisits_of(meta, least_bytes))
    system, path = filesystem(raw)
    if archives.limit(1).count():
        system.delete_dir(path)  # no task needs it once all archives are normalised
    parts = max(1, archives.count())
    return read_archives(archives.repartition(parts, "archive"), done).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
"""
