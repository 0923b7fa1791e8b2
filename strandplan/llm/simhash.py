"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits. Every bit has a nonzero vector of
RADIUS+1 bits; table v (a nonzero vector) keeps the bits whose vector has an odd inner product with v. The
vectors of any RADIUS differing bits leave some v orthogonal to all of them, so the pair agrees on everything
that table keeps: no pair within the radius is missed, and one table keeps about half the bits.

Equal fingerprints are merged before the tables are filled, so a group of copies is one row. A bucket is read
as a stream; one of more than ``BUCKET`` fingerprints is not gathered but dealt again by the same covering of
the bits that its table leaves free, which halves them each time, until the buckets are small: every pair
still meets. Only a spanning forest of each bucket's links leaves it, and components come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.operators.components import connected_components
from strandplan.plans.session import bounded_batches, scratch, shared_path, written, written_at

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints compared with each other inside one bucket; larger buckets are dealt again.
BUCKET = 4096
LEVELS = 12


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit hashes of word shingles in order; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes set, as an unsigned number; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def _vectors(width: int) -> Iterator[int]:
    """Nonzero vectors in the order of a maximal shift register, over and over.

    Any stretch of them has odd and even inner products with every vector in fair shares, and no five in a row
    are all even, so a table fixes bits as long as five or more are free.
    """
    taps = {3: 0b011, 4: 0b0011, 5: 0b00101, 6: 0b000011}[width]  # x^3+x+1, x^4+x+1, x^5+x^2+1, x^6+x+1
    v = 1
    while True:
        yield v
        v <<= 1
        if v >> width:
            v = v & (1 << width) - 1 ^ taps


@cache
def masks(free: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Which bits of the mask ``free`` each covering table keeps."""
    bits = [i for i in range(64) if free >> i & 1]
    count = (1 << (radius + 1)) - 1
    vector = dict(zip(bits, _vectors(radius + 1), strict=False))
    tables = (sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, count + 1))
    return tuple(sorted(set(tables)))


@cache
def kept_bits(path: tuple[int, ...], radius: int = RADIUS) -> int:
    """All bits fixed after the tables ``path`` were taken one inside the other."""
    fixed = 0
    for table in path:
        fixed |= masks(~fixed & (1 << 64) - 1, radius)[table]
    return fixed


def _path(code: int, level: int) -> tuple[int, ...]:
    return tuple(code >> 5 * k & 31 for k in range(level))


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the fingerprints at most ``radius`` apart."""
    n = len(fps)
    left = np.ones(n, bool)
    links = []
    while left.any():
        ahead = [int(np.argmax(left))]
        left[ahead[0]] = False
        while ahead:
            i = ahead.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
            left[near] = False
            links += [(fps[i], fps[j]) for j in near]
            ahead += near.tolist()
    return np.array(links, np.uint64).reshape(-1, 2)


def _linker(level: int, radius: int, bucket: int):
    """Streams rows (table, key, fp) sorted by (table, key, fp); gives (kind, a, b): a link, or a row to deal again."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that the rows so far end in
        size, now, over = 0, None, False

        def out(kind, a, b):
            a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def forest(fps):
            links = _forest(fps, radius)
            if len(links):
                yield out(0, links[:, 0], links[:, 1])

        def add(table, fps):
            nonlocal held, size, over
            held.append(fps)
            size += len(fps)
            if size > bucket:
                over = True
                again = np.concatenate(held)
                held = []
                yield out(1, np.full(len(again), table, np.uint64), again)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            starts = np.concatenate(([0], np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1))
            ends = np.concatenate((starts[1:], [n]))
            for k in sorted({0, *np.flatnonzero(ends - starts > 1).tolist(), len(starts) - 1}):
                s, e = starts[k], ends[k]
                if k not in (0, len(starts) - 1) and e - s <= bucket:  # a whole bucket
                    yield from forest(fp[s:e])
                    continue
                if (table[s], key[s]) != now:
                    if not over and size > 1:
                        yield from forest(np.concatenate(held))
                    held, size, now, over = [], 0, (table[s], key[s]), False
                yield from add(table[s], fp[s:e])
        if not over and size > 1:
            yield from forest(np.concatenate(held))

    return link


def _dealer(level: int, radius: int):
    """Rows (path, fp) to rows (table, key, fp), one for each table of the covering of the bits that ``path`` leaves free."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for code in np.unique(path):
                fps = fp[path == code]
                fixed = kept_bits(_path(int(code), level), radius)
                for t, mask in enumerate(masks(~fixed & (1 << 64) - 1, radius)):
                    key = fps & np.uint64(fixed | mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), code | t << 5 * level, np.int64)), pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))],
                        names=["tbl", "key", "fp"],
                    )

    return deal


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that join all that are within the radius of each other.

    All tables' links together have the same components as all pairs within the radius have. Tables fix
    bits until at most four are free, so ``bucket`` is 16 or more.
    """
    if bucket < 16:
        raise ValueError("a bucket holds 16 fingerprints or more")
    rows = prints.select(F.lit(0).cast("long").alias("path"), "fp")
    links = None
    for level in range(LEVELS):
        dealt = rows.mapInArrow(_dealer(level, radius), "tbl long, key long, fp long")
        found = written(
            dealt.repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp").mapInArrow(_linker(level, radius, bucket), "kind int, a long, b long"),
            "simhash-links",
        )
        new = found.where("kind = 0").select("a", "b")
        links = new if links is None else links.union(new)
        rows = found.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("fp"))
        if rows.isEmpty():
            return links
    raise RuntimeError("buckets did not shrink")  # can't be: twelve levels leave at most four bits free


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` with the fingerprint's bits as a signed long, a row for each row of ``docs``.

    Null and wordless texts have fingerprint 0. A text may have any length; memory grows with that of one text.
    Rows without an id, repeated rows and an empty table pass as they are; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_prints, "id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(id_col, fp, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint is reachable over links. Null and wordless texts have
    fingerprint 0 and link like any other. A null id takes its component's smallest id, or null if there is none.
    Repeated rows repeat. An empty table gives an empty result.
    """
    prints, path = written(fingerprints(docs, id_col, text_col), "simhash-prints"), shared_path(docs.sparkSession, "simhash-final")
    with scratch(docs.sparkSession):
        distinct = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
        links = near_links(distinct, radius, bucket)
        groups = connected_components(links, "a", "b")
        members = groups.join(distinct, groups["node"] == distinct["fp"]).select("fp", "component", "low")
        lows = members.groupBy("component").agg(F.min("low").alias("component_low"))
        linked = members.join(lows, "component").select("fp", "component_low")
        # Written, so that the last join stands between two exchanges and adaptive execution can split a hot fingerprint.
        final = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id"))
        final, _ = written_at(final, "simhash-final", path)
    return prints.join(final, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_print(fp: str) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
