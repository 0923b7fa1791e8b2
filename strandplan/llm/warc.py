"""WARC archives with revisit resolution.

Headers (page id, URL, digest, length) are shuffled by payload digest; the smallest page id of a digest answers
for it and the others become revisit records that name it. Only the revisit list meets the payloads again.
Archives are written by Spark's text sink, which takes raw bytes of any file system, a file for each bounded
pack of records, and read back whole-file with the lengths that the records state.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import bounded_batches, shared_path, written

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: An archive holds so many bytes at most, or one larger record.
ARCHIVE_BYTES = 8 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """``(id, digest, first_id, first_url)`` for each page that revisits another.

    Of pages with equal payloads of ``least`` bytes or more, the smallest id answers; the rest revisit it. Null
    payloads are empty, so never revisits. A null id is never the smallest unless all are null. Repeated rows of
    the answering id are all responses.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    headers = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    headers = written(headers.select("id", "url", "digest"), "warc-headers")
    answers = headers.groupBy("digest").agg(
        F.count("*").alias("pages"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first")
    ).where("pages > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    again = headers.join(answers, "digest").where(~F.col("id").eqNullSafe(F.col("first_id")))
    return again.groupBy("id", "digest").agg(F.first("first_id").alias("first_id"), F.first("first_url").alias("first_url"))


def _record(page_id: int | None, url: str | None, body: bytes, digest: str, revisit: bool, first_id: int | None, first_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record without the two line ends that close it."""
    name = lambda i, d: f"<urn:uuid:{uuid.uuid5(SPACE, f'{i}/{d}')}>"
    plain = lambda s: "".join(c if c.isprintable() else "?" for c in s or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    if not revisit:
        block += body
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {plain(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first_id, digest)}", f"WARC-Refers-To-Target-URI: {plain(first_url)}",
            f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {first_id}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def _packer(date: str, most: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([END.join(kept)], pa.binary())], names=["archive"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, digest, revisit, first_id, first_url = row
                record = _record(page_id, url, (html or "").encode(), digest, revisit, first_id, first_url, date)
                if kept and size + len(record) > most:
                    yield archive()
                    kept, size = [], 0
                kept.append(record)
                size += len(record) + len(END)
        if kept:
            yield archive()

    return pack


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE,
) -> None:
    """Write every page as a response or revisit record below ``path``, in archives of bounded size.

    Null payloads are empty, null URLs empty, null ids left blank. Repeated rows are records each. A payload longer
    than ``archive_bytes`` is an archive of its own. Other columns aren't read; an empty table writes no record.
    """
    bounded_batches(pages.sparkSession)
    again = written(resolve(pages, id_col, url_col, body_col, least), "warc-revisits")
    again = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first_id", "first_url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).join(
        again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    )
    records = rows.select("id", "url", "html", "digest", F.col("_digest").isNotNull().alias("revisit"), "first_id", "first_url")
    packs = records.mapInArrow(_packer(date, archive_bytes), "archive binary")
    # A binary value cast to a string keeps its bytes; the sink closes the last record of each file.
    packs.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a stated length that doesn't end in two line ends raises."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        first, *rest = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in rest)
        start = end + len(END)
        stop = start + int(head["Content-Length"])
        if archive[stop : stop + len(END)] != END:
            raise ValueError(f"record at byte {at} has a wrong length")
        yield head, archive[start:stop]
        at = stop + len(END)


READ_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, "
    "record_id string, refers_to_id string, payload binary"
)


def _reader(with_payload: bool):
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("target_uri", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s) if s else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    kind = head["WARC-Type"]
                    http, _, body = block.partition(END)
                    stated = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(body) != stated or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                    rows.append((
                        number(head["WARC-Page-ID"]), stated, digest, kind, number(head.get("WARC-Refers-To-Page-ID")), head["WARC-Target-URI"],
                        head["WARC-Record-ID"], head.get("WARC-Refers-To"), body if with_payload and kind == "response" else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records below ``path``, a row each; payloads of responses are checked against their digests."""
    # A file is one row of the binary source and at most ARCHIVE_BYTES (or one record), so few go to Python at once.
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), READ_SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives and return what reading them back gives; an empty table writes none."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path, with_payload=False)


def op3_sql() -> str:
    """DuckDB: the same by grouping on digests."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= {LEAST} GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""
