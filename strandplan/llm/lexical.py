"""Ranked lexical search by windowed bucket scoring.

One pass over the texts keeps, of every document, its length and how often it holds each term that some query asks
for: a forward index of small numbers, written once and sorted by document inside its parts. Global statistics are
sums over it. Then a task reads its part of the index as a stream of windows, each the next ``WINDOW`` documents in
that order (fewer if they hold ``POSTINGS`` postings), turns a window into posting lists by one sort, and scores
every query in it: a query's lists are traversed, their contributions scatter-added into one array of ``WINDOW``
sums that fits a core's cache, and the lists' occupancy bitsets joined; what the bitset names is harvested into the
query's heap and cleared. Only heaps leave a task. No posting list, no frequent word and no query's candidates are
ever gathered: documents are dealt evenly, whatever they hold.

Queries are worked on in blocks of at most ``PAIRS`` pairs of query and term (or one query), which bounds what is
broadcast; each block is a pass of its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.operators.numbering import sums_before
from strandplan.plans.session import bounded_batches, written

TOP = 50
#: Documents a window holds: its sums are 64 KB.
WINDOW = 1 << 13
#: Postings a window may hold before it is closed early.
POSTINGS = 1 << 20
#: Pairs of query and term that are broadcast at a time.
PAIRS = 1 << 17
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Groups that a query's heaps are merged in before they meet.
DEALS = 64
#: Every byte of ASCII but letters and digits ends a term; capital letters become small ones.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of a bounded size (a term is never cut)."""
    folded = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            end = cut if cut > at else folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, term)``: each distinct term of each query, rows of one id being one query; null texts have none."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({t for part in terms(text) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item", "term"])

    bounded_batches(items.sparkSession)
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item long, term binary").distinct()


def _indexer(shared):
    names = ["doc_id", "n", "terms", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = {t: k for k, t in enumerate(known)}
        for batch in batches:
            ids, ns, ends, held, counts = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for part in terms(text.as_py()):
                    n += len(part)
                    found.update(filter(number.__contains__, part))
                if n:
                    ids.append(doc)
                    ns.append(n)
                    held.extend(map(number.__getitem__, found))
                    counts.extend(found.values())
                    ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((held, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=names)

    return run


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, terms, counts)``, written: every document with a term, its length, and its counts of the vocabulary's terms."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = rows.mapInArrow(_indexer(shared), "doc_id long, n long, terms array<int>, counts array<long>")
    return written(kept.sortWithinPartitions(F.col("doc_id").asc_nulls_last()), "search-index")


@dataclass
class Block:
    """What scoring a block of queries needs: weights by term, each query's terms, and the corpus' sizes."""

    weights: np.ndarray
    items: list
    asked: list[np.ndarray]
    docs: int
    length: int
    top: int


class _Heap:
    """The best (score, document) of a query, equal scores to the smaller id; documents without an id come last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def take(self, scores: np.ndarray, docs: list) -> None:
        if len(self.rows) == self.top:
            some = np.flatnonzero(scores >= self.rows[0][0])
        else:
            some = np.arange(len(scores))
        if len(some) > self.top:
            least = np.partition(scores[some], len(some) - self.top)[len(some) - self.top]
            some = some[scores[some] >= least]
        for score, i in zip(scores[some].tolist(), some.tolist(), strict=True):
            row = (score, docs[i] is not None, -(docs[i] or 0), i)
            if len(self.rows) < self.top:
                heapq.heappush(self.rows, row)
            elif row > self.rows[0]:
                heapq.heapreplace(self.rows, row)

    def best(self) -> list[tuple[int, int | None]]:
        return [(score, -minus if some else None) for score, some, minus, _ in sorted(self.rows, reverse=True)]


def _window(block: Block, heaps: dict[int, _Heap], docs: list, n: np.ndarray, slot: np.ndarray, term: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
    """Score all queries in one window of documents; ``sums`` comes and goes zeroed."""
    if 50 * int(n.max()) * block.docs < 1 << 63:
        m = 50 + (50 * n * block.docs) // block.length
    else:
        m = np.array([50 + (50 * x * block.docs) // block.length for x in n.tolist()], np.int64)
    order = np.argsort(term, kind="stable")
    slot, term, count = slot[order], term[order], count[order]
    adds = block.weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[slot]))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    here, starts, ends = term[first], first.tolist(), [*first[1:].tolist(), len(term)]
    place = np.full(len(block.weights), -1, np.int64)
    place[here] = np.arange(len(here))
    bits = np.zeros((len(here), len(sums) // 8), np.uint8)
    mark = np.zeros(len(sums), bool)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        mark[slot[a:b]] = True
        bits[k] = np.packbits(mark)
        mark[slot[a:b]] = False
    for i, asked in enumerate(block.asked):
        lists = place[asked]
        lists = lists[lists >= 0]
        if not len(lists):
            continue
        for k in lists.tolist():
            a, b = starts[k], ends[k]
            sums[slot[a:b]] += adds[a:b]  # a document stands once in a list
        held = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[lists])))
        scores = sums[held]
        sums[held] = 0
        some = scores > 0
        if not some.all():
            held, scores = held[some], scores[some]
        if len(held):
            heap = heaps.setdefault(i, _Heap(block.top))
            if len(heap.rows) < heap.top or scores.max() >= heap.rows[0][0]:
                heap.take(scores, _Picked(docs, held))


class _Picked:
    """Document ids by place among those harvested."""

    def __init__(self, docs: list, held: np.ndarray):
        self.docs, self.held = docs, held

    def __getitem__(self, i: int):
        return self.docs[self.held[i]]


def _scorer(shared, window: int, postings: int):
    names = ["item", "doc_id", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        heaps: dict[int, _Heap] = {}
        sums = np.zeros(-(-window // 8) * 8, np.int64)
        ids, ns, sizes, held, counts, waiting = [], [], [], [], [], 0

        def close() -> None:
            nonlocal waiting
            if held and waiting:
                slot = np.repeat(np.arange(len(ids)), np.concatenate(sizes))
                _window(block, heaps, ids, np.concatenate(ns), slot, np.concatenate(held), np.concatenate(counts), sums)
            for x in (ids, ns, sizes, held, counts):
                x.clear()
            waiting = 0

        for batch in batches:
            offsets = batch.column("terms").offsets.to_numpy()
            docs, n = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
            flat, times = (batch.column(k).values.to_numpy() for k in ("terms", "counts"))
            shift = batch.column("counts").offsets.to_numpy()[0] - offsets[0]
            at = 0
            while at < len(docs):
                # As many rows as the window has room for; one row at least.
                room = min(len(docs), at + window - len(ids))
                room = max(at + 1, min(room, int(np.searchsorted(offsets, offsets[at] + postings - waiting, "right")) - 1))
                a, b = offsets[at], offsets[room]
                ids.extend(docs[at:room])
                ns.append(n[at:room])
                sizes.append(np.diff(offsets[at : room + 1]))
                held.append(flat[a:b])
                counts.append(times[a + shift : b + shift])
                waiting += int(b - a)
                at = room
                if len(ids) >= window or waiting >= postings:
                    close()
        close()
        for i, heap in heaps.items():
            best = heap.best()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.items[i]] * len(best), pa.int64()), pa.array([d for _, d in best], pa.int64()), pa.array([s for s, _ in best], pa.int64())], names=names
            )

    return run


def _merged(heaps: DataFrame, top: int) -> DataFrame:
    """Each query's best of all tasks' heaps: within groups of tasks first, so no query's heaps meet at once."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    dealt = heaps.withColumn("deal", F.spark_partition_id() % DEALS)
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("deal")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    top: int = TOP, window: int = WINDOW, postings: int = POSTINGS, pairs: int = PAIRS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``top`` documents of each query with a score above 0, best first.

    A document is a row: repeated rows are ranked each, rows without an id count in all statistics and come last
    among equal scores. Null, empty and wordless texts are no documents; a query without terms, or whose terms no
    document holds, has no rows. Texts and queries may have any length. Empty tables give an empty result. Other
    columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    asked = written(query_terms(items, item_col, query_col), "search-terms")
    sizes = written(asked.groupBy("item").agg(F.count("*").alias("size")), "search-sizes")
    # A block of queries is what starts in the same range of running pairs.
    dealt = written(sums_before(sizes, "size", F.col("item").asc_nulls_first()).select("item", F.floor(F.col("before") / pairs).alias("block")), "search-blocks")
    blocks = asked.join(dealt, asked["item"].eqNullSafe(dealt["item"])).select(asked["item"], "term", "block")
    blocks = written(blocks, "search-pairs")
    result = None
    for (number,) in blocks.select("block").distinct().sort("block").collect():
        # At most ``pairs`` pairs and those of the last query, whose text is a row like any other.
        rows = blocks.where(F.col("block") == number).select("item", "term").sort("item", "term").collect()
        vocabulary = sorted({bytes(r["term"]) for r in rows})
        at = {t: k for k, t in enumerate(vocabulary)}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item"], []).append(at[bytes(r["term"])])
        index = forward_index(docs, vocabulary, id_col, text_col)
        total, length = index.agg(F.count("*"), F.sum("n")).first()
        held = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the block
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast(Block(weights, list(by_item), [np.array(x) for x in by_item.values()], total, length or 1, top))
        heaps = index.mapInArrow(_scorer(shared, window, postings), "item long, doc_id long, score long")
        best = _merged(heaps, top)
        result = best if result is None else result.unionByName(best)
    if result is None:
        result = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    return result.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def op12_sql() -> str:
    """DuckDB: all pairs of query term and document that holds it, summed and ranked."""
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold}, '{TERM}') AS ts FROM documents),
c AS (SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::HUGEINT AS nn, sum(n)::HUGEINT AS ll FROM c),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM c) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({fold}, '{TERM}')) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g WHERE t IN (SELECT t FROM q) GROUP BY t, nn),
m AS (SELECT r, doc_id, (50 + (50 * n * nn) // ll)::BIGINT AS m FROM c, g),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
