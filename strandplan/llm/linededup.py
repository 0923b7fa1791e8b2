"""Line dedup: hash ranges with a secondary sort by document and position, streamed; bitmaps come back.

Every line becomes a 128-bit key hash with its document and position. The rows are dealt by ranges of
(hash, document), so a line that a third of all documents share is split over many ranges instead of landing
in one task. Each range is read as a stream: the first document of a key keeps its lines, the others lose
theirs. Where a key runs on over a range's border, the rows of the first document after the border are held
back until the border rows of all ranges (two a range) are compared. Only drops leave the streams; they are
packed into one compressed keep bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import bounded_batches, written

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, HELD, BORDER = 0, 1, 2


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc, body, pos, h1, h2) for each line whose key has ``least`` code points or more.

    ``body`` tells rows of one document id with different texts apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text")).select(
        "doc", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    key = lines.select("doc", "body", "pos", ascii_lower(F.btrim("line", F.lit(STRIP))).alias("key"))
    return key.where(F.length("key") >= least).select(
        "doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop of one sorted range; vectorised, one batch in memory.

    A null document counts as the largest. It carries (key, first document) over batches.
    """
    carry = None  # (h1, h2, first document of the key here)
    head = None
    names = ["kind", "doc", "body", "pos", "h1", "h2"]

    def out(kind, doc, body, pos, h1, h2):
        nulls = doc == np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc, mask=nulls), pa.array(body), pa.array(pos), pa.array(h1), pa.array(h2)],
            names=names,
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        body, pos, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        runs_on = carry is not None and (h1[0], h2[0]) == carry[:2]
        starts = np.flatnonzero(new)
        first = doc[starts].copy()
        if runs_on:
            first[0] = carry[2]
        elif carry is None:
            head = (h1[0], h2[0], doc[0])
            yield out(BORDER, *(np.array([x]) for x in (doc[0], 0, np.int32(0), h1[0], h2[0])))
        of = first[np.cumsum(new) - 1]
        lost = doc != of
        if lost.any():
            yield out(DROP, *(x[lost] for x in (doc, body, pos, h1, h2)))
        held = ~lost & (h1 == head[0]) & (h2 == head[1])
        if held.any():
            yield out(HELD, *(x[held] for x in (doc, body, pos, h1, h2)))
        carry = (h1[-1], h2[-1], first[-1])
    if carry is not None and carry[:2] != head[:2]:
        yield out(BORDER, *(np.array([x]) for x in (carry[2], 0, np.int32(0), carry[0], carry[1])))


def _pack(pos: list[int]) -> bytes:
    """Positions to drop, as a compressed bitmap of lines to keep; lines past its end are kept."""
    bits = np.ones((max(pos) // 8 + 1) * 8, np.uint8)
    bits[pos] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def kept_flags(bitmap: bytes) -> np.ndarray:
    """One flag a line up to the last dropped one, and up to seven that pad the last byte (not lines to drop)."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return bits.astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``(id, body, n_dropped, keep)`` for each document that loses a line.

    Keys are lines stripped of ASCII white space and lower-cased in A-Z. A key of ``least`` code points or more
    that two or more ids hold stays in the smallest id alone. A null text is one empty line. A null id counts as
    one document larger than all others. Repeated rows (same id, same text) share one bitmap; rows of one id
    with different texts have one each, told apart by ``body`` = xxhash64(text). Extra columns are not read. A text
    may have any length: it is split once, and its lines travel as numbers. An empty table gives no row.
    """
    bounded_batches(docs.sparkSession)
    # Written, so that finding the ranges and dealing the rows read five numbers a line instead of splitting texts twice.
    keys = written(line_keys(docs, id_col, text_col, least), "line-keys")
    order = ["h1", "h2", F.col("doc").asc_nulls_last()]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order, "body", "pos")
    found = written(
        dealt.select("doc", "body", "pos", "h1", "h2").mapInArrow(_stream, "kind int, doc long, body long, pos int, h1 long, h2 long"),
        "line-drops",
    )
    border = found.where(F.col("kind") == BORDER).groupBy("h1", "h2").agg(
        F.min("doc").alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    late = found.where(F.col("kind") == HELD).join(border, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    drops = found.where(F.col("kind") == DROP).select("doc", "body", "pos").union(late.select("doc", "body", "pos"))
    pack = F.pandas_udf(lambda s: s.map(lambda p: _pack(list(p))), "binary")
    gathered = drops.groupBy("doc", "body").agg(F.collect_set("pos").alias("pos"))
    return gathered.select(
        F.col("doc").alias(id_col), "body", F.size("pos").cast("long").alias("n_dropped"), pack("pos").alias("keep")
    )


#: What ``apply_bitmaps`` adds.
ADDED = ("_n_lines", "_n_dropped", "_kept")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``, the text without its dropped lines.

    A null text is one empty line, and every row stays, repeated ones too. Other columns pass through whatever
    their names; only columns named like the three added ones give way to them.
    """
    # Bitmaps are unpacked before the join, so no text is queued for Python.
    unpack = F.pandas_udf(lambda s: s.map(kept_flags), "array<boolean>")
    marks = bitmaps.select(F.col(id_col).alias("m_doc"), F.col("body").alias("m_body"), F.col("n_dropped").alias("m_dropped"), unpack("keep").alias("m_flags"))
    # The caller's columns travel inside one struct, where their names can't meet others.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("row"))
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    joined = rows.select("row", F.col("row")[id_col].cast("long").alias("doc"), F.xxhash64(body).alias("body")).join(
        marks, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("body") == F.col("m_body")), "left"
    )
    lines = F.split(body, "\n", -1)
    return joined.select(
        "row.*",
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce("m_dropped", F.lit(0)).cast("long").alias("_n_dropped"),
        # A dropped line becomes null, which array_join leaves out; lines past the flags have none and stay.
        F.when(F.col("m_flags").isNull(), body).otherwise(
            F.array_join(F.zip_with(lines, "m_flags", lambda line, keep: F.when(keep.isNull() | keep, line)), "\n")
        ).alias("_kept"),
    )


def op7_sql() -> str:
    """DuckDB: the same by grouping."""
    return r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line,
    translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
    (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT l.*, f.first IS NOT NULL AND l.doc_id <> f.first AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
