"""Deterministic sharded WARC writer and its reader.

Records are cut into shards of ascending ids (`shard_bounds`), one shuffle brings
each shard's records together in id order, and the writer streams them into
``.warc.gz`` files, one gzip member per record. A file is closed when its compressed
size reaches ``roll_bytes``. Headers and digests are made anew from the payload.
Files are written under temporary names, renamed, and become part of the archive
only through the manifest that Spark commits at the end; the reader opens only what
the manifest lists. The same rows give the same files, byte for byte.

Copies: of equal payloads of at least ``min_revisit`` bytes, the record with the
smallest id is the response and the others are revisits. The pairs (copy, response)
are found on (id, digest) rows alone and travel in the same shuffle as the payloads,
sorted right before the record they belong to, so payloads are shuffled once.

Edge cases: null html is an empty payload; a null or blank URL becomes ``urn:page:ID``;
line breaks in URLs are percent-encoded; null ids sort last; rows that repeat an id
and a payload give one response and revisits to it; an empty table gives an empty
archive; one payload must fit in a task's memory, a group of copies need not.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import commit_bytes, file_system, shard_bounds, shard_column, shared_path, small_batches, store

MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary, file string")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _labelled(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}')}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    url = (url or "").strip().replace("\r", "%0D").replace("\n", "%0A")
    return url or f"urn:page:{page_id}"


def record(page_id, url, payload: bytes, refers_to=None, refers_url=None, revisit=False,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC record; revisits carry the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target_uri(url, page_id)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {_labelled(payload)}", f"WARC-Block-Digest: {_labelled(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}",
                 f"WARC-Refers-To-Target-URI: {target_uri(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}",
                 f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member with a zero time stamp: equal input, equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def copy_links(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of every page whose payload has copies."""
    slim = store(pages.where(F.col("n") >= min_revisit).select("page_id", "url", "digest"), "warc-digests")
    first = (slim.groupBy("digest")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("f"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url")))
    # a row per page that has copies; a hot digest's rows are slim and AQE splits them
    return slim.join(first, "digest").select("page_id", "digest", "refers_to", "refers_url").distinct()


def _writer(root: str, roll_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = file_system(root)
        shard = buffer = link = written = None
        seq = count = 0
        done: list[tuple] = []

        def close():
            nonlocal buffer, seq, count
            if buffer:
                name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                commit_bytes(filesystem, f"{base}/_tmp", f"{base}/{name}", bytes(buffer))
                done.append((shard, name, count, len(buffer), hashlib.sha256(buffer).hexdigest()))
                seq += 1
            buffer, count = bytearray(), 0

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if shard is not None:
                        close()
                    shard, seq, link, written = r["shard"], 0, None, None
                    buffer, count = bytearray(), 0
                if r["kind"] == 0:
                    link, written = r, None
                    continue
                payload = (r["html"] or "").encode("utf-8", "replace")
                key = (r["page_id"], r["digest"])
                linked = link is not None and (link["page_id"], link["digest"]) == key
                revisit = linked and (link["refers_to"] != r["page_id"] or written == key)
                if linked:
                    written = key
                data = record(r["page_id"], r["url"], payload, link["refers_to"] if revisit else None,
                              link["refers_url"] if revisit else None, revisit, date)
                buffer += gzip_member(data, level)
                count += 1
                if len(buffer) >= roll_bytes:
                    close()
        if shard is not None:
            close()
        names = ["shard", "file", "records", "bytes", "sha256"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
    return run


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = 100, shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, level: int = 6,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the pages below ``root`` and return the committed manifest."""
    spark = pages.sparkSession
    small_batches(spark, 200)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("n"),
                        F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"))
    bounds = shard_bounds(rows.select("page_id", "n"), "page_id", F.col("n") + 512, shard_bytes)
    links = store(copy_links(rows, min_revisit), "warc-links")
    none = F.lit(None)
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html",
                       none.cast("long").alias("refers_to"), none.cast("string").alias("refers_url")).unionByName(
        links.select("page_id", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"),
                     none.cast("string").alias("html"), "refers_to", "refers_url"))
    both = both.withColumn("shard", shard_column(F.col("page_id"), bounds))
    filesystem, base = file_system(root)
    filesystem.create_dir(f"{base}/_tmp", recursive=True)
    order = ["shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url"]
    manifest = (both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(*order)
                .mapInArrow(_writer(root, roll_bytes, level, date), MANIFEST))
    manifest.write.parquet(f"{root}/manifest")
    filesystem.delete_dir(f"{base}/_tmp")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, out, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or stream.read(chunk)
        left = b""
        if not data:
            return
        out.append(z.decompress(data))
        if z.eof:
            left = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse_record(data: bytes) -> dict:
    """A record's fields; raises when a digest does not match what is stored."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if _labelled(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if _labelled(payload) != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"],
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][7:]).hex(),
            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-Id", "")), "payload": payload}


def _reader(root: str, payloads: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = file_system(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for member in _members(f):
                        r = parse_record(member) | {"file": name}
                        if not payloads:
                            r["payload"] = None
                        size += len(r["payload"] or b"") + 300
                        rows.append(r)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, types)], names)
    return run


def read_archive(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """Every record of the files that the manifest lists, digests verified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    files = max(1, manifest.count())
    return manifest.select("file").repartition(files, "file").mapInArrow(_reader(root, payloads), RECORDS)


def archive(pages: DataFrame, **options) -> tuple[str, DataFrame]:
    """Write ``pages`` to a fresh folder in the shared folder; (root, manifest)."""
    root = shared_path(pages.sparkSession, "warc")
    return root, write_archive(pages, root, **options)
