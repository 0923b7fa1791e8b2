"""License scans by a positional rare-token index.

Licence notices are templates of words. The index lists, for each word, the templates and positions it stands
at. In a file, each template is looked up by those of its words in the file that are rarest over all documents
(highest IDF); an offset at which any of these words would align the template is tried if enough of them agree on
it within a slack, and an alignment counts if all mandatory key phrases of the template stand where it says, within a slack of a few words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import bounded_batches

#: Words of a text after A-Z are lower-cased, on UTF-8 bytes: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall

#: Fixed values of the contract: phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, notice, mandatory key phrases of the notice.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("apache-2", "spdx license identifier apache 2 0", ("license identifier apache 2 0",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote", "prior written permission")),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms", "conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("use copy modify", "with or without fee")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "free software foundation", "version 3")),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license", "2 0")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ("without any express or implied warranty", "authors be held liable")),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
)


@dataclass(frozen=True)
class LicenseRules:
    """Rarest words a template is looked up by, of which ``agree`` must align it; words a key phrase may be off."""

    anchors: int = 3
    agree: int = 2
    slack: int = 3


def words_of(text: str | None) -> list[bytes]:
    """Words in order."""
    return WORD((text or "").encode().lower())


class Index:
    """Templates, their postings by word, and where their key phrases stand."""

    def __init__(self, templates: tuple = TEMPLATES, base: tuple = BASE):
        self.base = [(p.encode().split(), label) for p, label in base]
        self.labels, self.texts, self.keys = [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (label, notice, phrases) in enumerate(templates):
            words = notice.encode().split()
            self.labels.append(label)
            self.texts.append(words)
            self.keys.append([(self._find(words, p.encode().split()), p.encode().split()) for p in phrases])
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        self.vocabulary = frozenset(self.postings) | {w for p, _ in self.base for w in p}

    @staticmethod
    def _find(words: list[bytes], phrase: list[bytes]) -> int:
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                return i
        raise ValueError(f"{phrase} isn't in its notice")


def _near(ordered: list[int], at: int, slack: int) -> bool:
    k = bisect_left(ordered, at - slack)
    return k < len(ordered) and ordered[k] <= at + slack


def scan(words: list[bytes], index: Index, idf: dict[bytes, float], rules: LicenseRules) -> tuple[list[tuple[str, int]], list[tuple[str, int, float]]]:
    """(base places as (label, start), alignments as (label, start, share of the notice's words in place))."""
    at: dict[bytes, list[int]] = defaultdict(list)
    vocabulary = index.vocabulary
    for i, w in enumerate(words):
        if w in vocabulary:
            at[w].append(i)
    base = []
    for phrase, label in index.base:
        rarest = min(phrase, key=lambda w: len(at.get(w, ())))
        k = phrase.index(rarest)
        base += [(label, i - k) for i in at.get(rarest, ()) if i >= k and words[i - k : i - k + len(phrase)] == phrase]
    looked: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for w in sorted(at, key=lambda w: (-idf.get(w, 0.0), w)):
        for t, q in index.postings.get(w, ()):
            if len({a for a, _ in looked[t]} | {w}) <= rules.anchors:
                looked[t].append((w, q))
    found = []
    for t, anchors in looked.items():
        if any(w not in at for _, phrase in index.keys[t] for w in phrase):
            continue
        offsets: dict[bytes, list[int]] = defaultdict(list)
        for w, q in anchors:
            offsets[w] += [p - q for p in at[w]]
        for w in offsets:
            offsets[w].sort()
        need = min(rules.agree, len(offsets))
        begun, best = -math.inf, None  # first offset of the places that are one notice, and the best of them
        for d in sorted({d for ds in offsets.values() for d in ds}):
            if sum(_near(offsets[w], d, rules.slack) for w in offsets) < need:
                continue
            if all(any(words[s : s + len(phrase)] == phrase for s in range(max(0, d + o - rules.slack), d + o + rules.slack + 1)) for o, phrase in index.keys[t]):
                notice = index.texts[t]
                share = sum(0 <= d + q < len(words) and words[d + q] == w for q, w in enumerate(notice)) / len(notice)
                if d > begun + rules.slack:
                    found += [best] if best else []
                    begun, best = d, None
                if best is None or share > best[2]:
                    best = (index.labels[t], max(0, d), share)
        found += [best] if best else []
    return base, sorted(found)


def _counter(templates: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, n = Index(templates).vocabulary, Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                seen.update(vocabulary.intersection(words_of(t.as_py())))
                n += 1
        names = [None, *(w.decode() for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    return run


def word_weights(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES) -> dict[bytes, float]:
    """IDF of each template word over all documents; what reaches the driver is one row a template word."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(F.col(text_col)).mapInArrow(_counter(templates), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in counts if r["word"] is None)
    return {r["word"].encode(): math.log((n + 1) / (r["n"] + 1)) for r in counts if r["word"] is not None}


FOUND = "id long, n_words long, base array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,share:double>>"
_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])
_MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])


def _scanner(idf: dict[bytes, float], rules: LicenseRules, templates: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            n, base, matches = [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                places, alignments = scan(words, index, idf, rules)
                n.append(len(words))
                base.append([{"label": a, "start": s} for a, s in places])
                matches.append([{"label": a, "start": s, "share": x} for a, s, x in alignments])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, pa.list_(_PLACE)), pa.array(matches, pa.list_(_MATCH))], names=["id", "n_words", "base", "matches"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LicenseRules | None = None, templates: tuple = TEMPLATES) -> DataFrame:
    """``(id_col, n_words, base, matches)`` of every whole text, a row for each row of ``docs``.

    ``base`` has all places of the fixed phrases, ``matches`` the verified alignments with the share of the
    notice's words that stand in place; positions count words from 0. A null text is empty: no words, no
    matches. Repeated rows give repeated results. Words of equal IDF rank by their bytes; of alignments within the
    slack of each other the one with the largest share counts, the first if several have it. A long text is read
    whole, in time that grows with its words. Other columns aren't read. An empty table gives an empty result. Two
    scans, no shuffle but the sum of word counts.
    """
    idf = word_weights(docs, text_col, templates)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(idf, rules or LicenseRules(), templates), FOUND).withColumnRenamed("id", id_col)


def digest_licenses(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from what ``find_licenses`` returns; score is the best share, 1 for a base phrase."""
    starts = F.transform("base", lambda x: x["start"])
    label = lambda c: F.transform(c, lambda x: x["label"])
    told = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        told(label("base")).alias("base_labels"), told(F.concat(label("base"), label("matches"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
