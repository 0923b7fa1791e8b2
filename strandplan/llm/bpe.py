"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct pre-tokens of a batch go into one trie. A depth-first walk gives each node, that is each prefix,
the last token of its encoding: the one token that ends the prefix and may follow the last token of what is
left before it. Whether two tokens may stand side by side is decided once a pair, by undoing their merges from
the touching ends inwards and looking for a merge across the border that would have come earlier. An encoding
is then read by stepping back from a word's node; words that share a prefix share its states.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from strandplan.llm import workers
from strandplan.llm.columns import kept_as, named
from strandplan.plans.session import bounded_batches

DEFAULT = "byte_bpe_50k.json"
#: Encoded pre-tokens, and judged pairs of tokens, that a task keeps; beyond that it keeps
#: the words of the texts at hand, so memory doesn't grow.
CACHE, PAIRS = 250_000, 250_000
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files name bytes: printable Latin-1 by itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(0x100 + k): b for k, b in enumerate(rest)}


def shared_lengths(order: list[bytes]) -> list[int]:
    """How many bytes each word of a sorted list shares with the one before it."""
    out: list[int] = []
    for i in range(0, len(order), 1 << 16):
        part = order[max(0, i - 1) : i + (1 << 16)]
        if i == 0:
            out.append(0)
        wide = min(64, max(map(len, part)))
        table = np.array([w[:wide] for w in part], f"S{wide}").view(np.uint8).reshape(-1, wide)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        least = np.minimum(sizes[1:], sizes[:-1])
        same = np.concatenate((table[1:] == table[:-1], np.zeros((len(part) - 1, 1), bool)), axis=1)
        alike = np.minimum(same.argmin(axis=1), least)
        for k in np.flatnonzero((alike == wide) & (least > wide)).tolist():
            a, b = part[k], part[k + 1]
            n = wide
            while n < least[k] and a[n] == b[n]:
                n += 1
            alike[k] = n
        out += alike.tolist()
    return out


class Encoder:
    """A vocabulary with its merges; encodes sets of words and decodes ids."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(s): i for s, i in told["model"]["vocab"].items()}
        self.longest = max(map(len, self.vocab))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.vocab.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.packed = [struct.pack("<I", i) for i in range(size)]
        self.sizes = [len(b) for b in self.bytes]
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * size  # the rank of the merge that makes a token
        self.parts: list[tuple[int, int] | None] = [None] * size
        for r, pair in enumerate(told["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = r
            if self.parts[z] is None:
                self.made[z], self.parts[z] = r, (x, y)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.follows: dict[int, bool] = {}  # by left * size + right
        self.known: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the text of both tokens is encoded as just these two."""
        pair = left * len(self.bytes) + right
        got = self.follows.get(pair)
        if got is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            got = self.follows[pair] = self._undo(left, right)
        return got

    def _undo(self, x: int, y: int) -> bool:
        # x and y: what touches the border at some time; each is consumed later by a merge of rank ends_x, ends_y.
        ends_x = ends_y = NEVER
        while True:
            across = self.rank.get((x, y), NEVER)
            # Of merges of one rank the leftmost is first: inside the left token before, inside the right one after.
            if across < ends_x and across <= ends_y and across < NEVER:
                return False
            if self.made[x] > self.made[y]:
                ends_x, x = self.made[x], self.parts[x][1]
            elif self.parts[y] is not None:
                ends_y, y = self.made[y], self.parts[y][0]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) of each distinct word, through one trie.

        The trie is laid out flat: words in order, each with the depth at which it leaves its predecessor's
        branch. So going through them is the depth-first walk, and only prefixes below that depth are new nodes.
        ``last`` holds the states of the branch: each prefix's last token.
        """
        order = sorted(words)
        vocab, longest, follows, may_follow = self.vocab.get, self.longest, self.follows.get, self.may_follow
        packed, size, every = self.packed, self.sizes, len(self.bytes)
        last: list[int] = [-1]
        for word, shared in zip(order, shared_lengths(order), strict=True):
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for start in range(depth - longest if depth > longest else 0, depth):
                    token = vocab(word[start:depth])
                    if token is not None:
                        if not start:
                            break
                        before = last[start]
                        ok = follows(before * every + token)
                        if may_follow(before, token) if ok is None else ok:
                            break
                last.append(token)
            ids, at = [], len(word)
            while at:
                token = last[at]
                ids.append(packed[token])
                at -= size[token]
            ids.reverse()
            yield word, b"".join(ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        pieces = [self.specials.split(t) if self.specials and self.specials.search(t) else [t] for t in texts]
        cut = [[[p] if k % 2 else self.split(p) for k, p in enumerate(parts)] for parts in pieces]
        if len(self.known) > CACHE:  # what these texts hold is likely to come again
            here = {w for parts in cut for k, words in enumerate(parts) if k % 2 == 0 for w in words}
            self.known = {w: self.known[w] for w in here if w in self.known}
        known = self.known
        new = {w for parts in cut for k, words in enumerate(parts) if k % 2 == 0 for w in words if w not in known}
        if new:
            by_bytes = {w.encode(): w for w in new}
            for word, code in self.encode_words(by_bytes):
                known[by_bytes[word]] = code
        for parts in cut:
            yield b"".join(self.packed[self.special[words[0]]] if k % 2 else b"".join([known[w] for w in words]) for k, words in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 give U+FFFD."""
        names = self.bytes
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec)
    return _made[key]


#: Texts whose words share one trie: as many as hold so many characters, or one longer text.
GROUP = 2 << 20


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


#: What encoding can return, as (Spark type, Arrow type).
OUTPUTS = {
    "n_tokens": (LongType(), pa.int64()), "ids": (ArrayType(IntegerType()), pa.list_(pa.int32())), "decoded": (StringType(), pa.string()),
    "ids_sha256": (StringType(), pa.string()), "decoded_sha256": (StringType(), pa.string()),
}


def _coder(spec, outputs: tuple) -> Callable:
    def told(coder: Encoder, code: bytes) -> tuple:
        back = coder.decode(code) if {"decoded", "decoded_sha256"} & {*outputs} else ""
        every = {
            "n_tokens": lambda: len(code) // 4, "ids": lambda: np.frombuffer(code, "<u4").astype(np.int32), "decoded": lambda: back,
            "ids_sha256": lambda: hashlib.sha256(code).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(back.encode()).hexdigest(),
        }
        return tuple(every[k]() for k in outputs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn("bpe", _made.clear)
        coder = _encoder(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = [told(coder, code) for group in _groups(texts) for code in coder.encode(group)]
            columns = [pa.array([r[k] for r in rows], OUTPUTS[o][1]) for k, o in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *outputs])

    return run


def encode_texts(
    docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple = ("doc_id",), outputs: tuple = ("n_tokens", "ids", "decoded")
) -> DataFrame:
    """``keep`` columns and ``outputs`` (of ``OUTPUTS``): ids, the text they decode to, or digests of them.

    Strings of special tokens in a text become their ids, as the vocabulary file asks. Null texts are empty: no
    ids, an empty text. Rows repeat as given and no other column is read. No shuffle: a task keeps what it has
    encoded, within a bound. The vocabulary file, of fixed size, is read on the driver and broadcast. A kept column
    that has the name of an output comes back as that name with ``_kept``; names may hold any character. Texts may
    have any length; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    with open(path or public_tokenizers.path(DEFAULT), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    # Names with dots don't pass through Arrow operators, so kept columns are numbered on the way.
    schema = StructType([StructField(f"_keep_{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [StructField(o, OUTPUTS[o][0]) for o in outputs])
    rows = docs.select(*[named(c).alias(f"_keep_{k}") for k, c in enumerate(keep)], named(text_col).alias("_encoded"))
    return rows.mapInArrow(_coder(spec, tuple(outputs)), schema).toDF(*[kept_as(c, outputs) for c in keep], *outputs)
