"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded, documented number of labelled rows (``TRAIN_ROWS``, those with the smallest
hashes of their ids, so the choice doesn't depend on partitions) inside one task; per-coordinate rates and L1
leave few weights, which are the only thing broadcast. Scoring is a map over all texts without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm import workers
from strandplan.plans.session import bounded_batches

#: Labelled rows used for fitting at most, whatever the corpus holds, and distinct features of all of them.
#: A text that would pass the second bound is left out whole.
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 24_000_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
SEED = 7


@dataclass(frozen=True)
class FtrlRules:
    """Parameters of the model."""

    bits: int = 20
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    #: Passes over the training rows: ``epochs``, and with few rows as many more as make ``steps`` updates.
    epochs: int = 3
    steps: int = 24_000
    most_epochs: int = 15
    least_texts: int = 3
    stem: int = 4
    skips: tuple = (1, 2)


class Hasher:
    """Words to 64-bit numbers, with a bounded memory of those seen."""

    def __init__(self, stem: int, keep: int = 100_000):
        self.stem, self.keep = stem, keep
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Two rows: the hash of each word, and of its stem (its first letters)."""
        if len(self.seen) > self.keep:
            self.seen.clear()
        seen, pairs = self.seen, []
        for w in WORD.findall((text or "").lower()):
            pair = seen.get(w)
            if pair is None:
                pair = seen[w] = (zlib.crc32(w.encode()), zlib.crc32(w[: self.stem].encode()))
            pairs.append(pair)
        return np.array(pairs, np.uint64).reshape(-1, 2).T


def _scatter(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def features(words: np.ndarray, rules: FtrlRules) -> np.ndarray:
    """Distinct buckets of a text's words, stems, bigrams and skip-grams; 0 is the intercept."""
    whole, stems = words[0], words[1]
    wide = whole * np.uint64(0x100000001B3)
    found = [_scatter(whole, 1, rules.bits), _scatter(stems, 2, rules.bits), _scatter(wide[:-1] ^ whole[1:], 3, rules.bits)]
    for k in rules.skips:
        if len(whole) > k + 1:
            found.append(_scatter(wide[: -k - 1] ^ whole[k + 1 :], 3 + k, rules.bits))
    return np.unique(np.concatenate([np.zeros(1, np.uint64), *found])).astype(np.int32)


#: Before any label is seen, one text in twenty counts as toxic; twenty texts' worth of that is kept.
PRIOR, PRIOR_TEXTS = 0.05, 20


def fit(rows: Iterable[tuple[str | None, int]], rules: FtrlRules, most: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights other than zero, log-odds of the labels at large), after some passes over (text, label).

    Rows are read once; their buckets are kept, ``most`` numbers of four bytes or fewer. A text whose buckets don't
    fit what is left of that takes no part.
    """
    hasher, sets, used, labels = Hasher(rules.stem), [], 0, []
    seen = np.zeros(1 << rules.bits, np.int32)
    for text, label in rows:
        i = features(hasher(text), rules)
        if used + len(i) > most:
            continue
        used += len(i)
        seen[i] += 1
        sets.append(i)
        labels.append(int(label))
    # A bucket of one or two texts can only be learned by heart, so it is left out.
    common = seen >= rules.least_texts
    for k, i in enumerate(sets):
        sets[k] = i[common[i]]
    share = (sum(labels) + PRIOR * PRIOR_TEXTS) / (len(labels) + PRIOR_TEXTS)
    bias = math.log(share / (1 - share))
    z, n = np.zeros(1 << rules.bits), np.zeros(1 << rules.bits)

    def weights(i):
        zi = z[i]
        w = (np.sign(zi) * rules.l1 - zi) / ((rules.beta + np.sqrt(n[i])) / rules.alpha + rules.l2)
        return np.where(np.abs(zi) <= rules.l1, 0.0, w)

    passes = max(rules.epochs, min(rules.most_epochs, -(-rules.steps // max(1, len(labels)))))
    for epoch in range(passes):
        for k in np.random.default_rng(SEED + epoch).permutation(len(labels)).tolist():
            i = sets[k]
            w = weights(i)
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - labels[k]
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rules.alpha * w
            n[i] = ni + g * g
    every = np.flatnonzero(np.abs(z) > rules.l1)
    return every, weights(every), bias


def _fitter(rules: FtrlRules):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn("toxicity")
        rows = ((text.as_py(), label.as_py()) for b in batches for text, label in zip(b.column(0), b.column(1), strict=True))
        buckets, weights, bias = fit(rows, rules)
        workers.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *buckets], pa.int32()), pa.array([bias, *weights], pa.float64())], names=["bucket", "weight"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, rules: FtrlRules | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", rows: int = TRAIN_ROWS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) fitted on at most ``rows`` labelled documents.

    Taken are the ids with the smallest hashes; of several labels of one id the largest counts, null labels and
    labels without a document are left out, and of several texts of one id the first in code-point order is
    read. Without labelled rows there are no weights, and every score is the prior's share.
    """
    rules = rules or FtrlRules()
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.withColumn("order", F.xxhash64(F.lit(SEED), "id"))
    n = known.count()
    # A little more than the share that is wanted, so that only about ``rows`` ids are sorted, at every size.
    share = min(1.0, (1.1 * rows + 200) / max(1, n))
    least = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
    chosen = known.where(F.col("order") <= F.lit(least)).orderBy("order", "id").limit(rows).select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most ``rows`` ids
    sample = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))
    # In the order of the ids' hashes, so that what the bound on features leaves out is chance too.
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(SEED), "id"), "id").select("text", "label")
    model = one.mapInArrow(_fitter(rules), "bucket int, weight double").collect()
    bias = next((r["weight"] for r in model if r["bucket"] < 0), math.log(PRIOR / (1 - PRIOR)))
    model = [r for r in model if r["bucket"] >= 0]
    return np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model], np.float64), bias


def _scorer(shared, rules: FtrlRules):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn("toxicity")
        buckets, weights, bias = shared.value
        table = np.zeros(1 << rules.bits)
        table[buckets] = weights
        hasher = Hasher(rules.stem)
        for batch in batches:
            sums = [bias + table[features(hasher(t.as_py()), rules)].sum() for t in batch.column(batch.num_columns - 1)]
            scores = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], rules: FtrlRules | None = None, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every whole text, a row for each row of ``docs``.

    Null and empty texts get the score of the bias and the intercept; equal texts score alike, of any length. A kept
    column may have any name but ``score``.
    """
    rules = rules or FtrlRules()
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # the weights that L1 left: at most 2**bits
    # The text is the last column, known by its place, and the kept ones travel under numbers.
    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)] + [F.col(text_col).alias("text")]
    schema = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "score double"])
    scored = docs.select(*columns).mapInArrow(_scorer(shared, rules), schema)
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "score")


def in_training(id_):
    """Whether labels may be learned from a row: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 != 2, F.lit(False))
