"""WARC archives without repeated payloads.

Headers alone (id, digest, length) are shuffled by payload digest. Of the records with one payload the smallest id
keeps it; each other record is joined to that original and rewritten as a revisit: fresh headers, no payload. Archives
are Parquet tables of gzip members in the shared folder; the members of an archive, joined in order, are a .warc.gz file.

Defined cases: a null payload is an empty one; repeated rows of an id with one payload are all responses if the id
is the smallest, else all revisits; records without an id refer to the smallest id and are never referred to (all
responses, if no record of that payload has an id); a null url gives no target header; an empty table gives no records;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.arrow import STEP_BYTES, parts
from tallywire.llm.shared import shared_folder, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits, eight digits at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """Adds refers_to to headers (page_id, digest, payload_bytes): the original's id for revisits, else null.

    The smallest id of each digest is found with partial aggregates, so that a digest on a third of all rows reaches
    the shuffle as a row for each task; digests of a single record do not enter the join.
    """
    originals = (
        headers.filter(F.col("payload_bytes") >= min_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("records"))
        .filter((F.col("records") > 1) & F.col("original").isNotNull())
        .select(F.col("digest").alias("original_digest"), "original")
    )
    matches = (F.col("digest") == F.col("original_digest")) & ~F.col("page_id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= min_payload)
    return headers.join(originals, matches, "left").select("page_id", "digest", "payload_bytes", F.col("original").alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {RECORD_DATE}",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"WARC-Block-Digest: sha1:{block_digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block; a wrong length or block digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if lines[0] != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    if fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("block digest differs")
    return fields, block


def _one_line(url: str | None) -> str | None:
    return url if url is None else "".join("%0D" if c == "\r" else "%0A" if c == "\n" else c for c in url)


def write_archives(pages: DataFrame, path: str, *, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the pages as deduplicated archives to ``path``: a table (archive, member, content)."""
    # UTF-8 bytes of a text column, a null as none; and its digest, which both passes compute alike
    data = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    decided = resolve(written(rows.select("page_id", "digest", "payload_bytes"), "headers"), min_payload)
    revisits = decided.filter(F.col("refers_to").isNotNull()).select(F.col("page_id").alias("known_id"), F.col("digest").alias("known_digest"), "refers_to").distinct()
    same = rows["page_id"].eqNullSafe(F.col("known_id")) & (rows["digest"] == F.col("known_digest"))
    ready = rows.join(revisits, same, "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "payload_bytes", "refers_to")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, member = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        for batch in batches:
            for part in parts(batch, STEP_BYTES, 2):
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                out = [gzip.compress(record(i, _one_line(u), p, d, n, r), 4, mtime=0) for i, u, p, d, n, r in rows]
                yield pa.RecordBatch.from_pydict({"archive": [archive] * len(out), "member": pa.array(range(member, member + len(out)), pa.int64()), "content": pa.array(out, pa.binary())})
                member += len(out)

    ready.mapInArrow(members, "archive string, member long, content binary").write.option("compression", "none").parquet(path)


def read_archives(spark, path: str) -> DataFrame:
    """Records of archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits)."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    arrow = pa.schema([pa.field(c.split()[0], t) for c, t in zip(schema.split(", "), types, strict=True)])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, STEP_BYTES, 0)):
            rows = []
            for content in part.column(0).to_pylist():
                f, block = parse(gzip.decompress(content))
                kind = f["warc-type"]
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError("payload digest differs")
                number = {k: int(f[k]) if k in f else None for k in ("x-page", "x-refers-to-page")}
                size = len(payload) if payload is not None else int(f["x-payload-length"])
                rows.append((number["x-page"], f.get("warc-target-uri"), kind, digest, size, number["x-refers-to-page"], payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.schema("archive string, member long, content binary").parquet(path).select("content").mapInArrow(records, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")




ORACLE_SQL = """
WITH bare AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hexed FROM bare),
firsts AS (SELECT hexed, min(page_id) AS original FROM digests GROUP BY hexed)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
        ((CAST('0x' || substr(hexed, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM digests JOIN firsts USING (hexed)
"""
