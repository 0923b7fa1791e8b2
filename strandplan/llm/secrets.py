"""Secret scans: exact patterns plus sliding-window Shannon entropy, in DataFrame functions only.

Candidates are maximal runs of token characters. Each belongs to one character class (hexadecimal, lower
alphanumeric, mixed), each class with its own entropy threshold. One pass over a candidate keeps the counts of
the window's characters in a byte string and the sum of ``c*log2(c)`` as a fixed-point integer: a character
that enters or leaves changes one count and one term of the sum, whatever the window's width. An allow-list
suppresses placeholders, plain words, numbers and identifiers of known public form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the base patterns, letters of the key names in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Runs are maximal, so the minimum length can stand in the pattern: a shorter run holds no longer match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Least digits of a candidate.
DIGITS = 2
#: Least entropy in bits of some window, by class.
BITS = {"hex": 3.0, "lower": 3.5, "mixed": 3.75}
ALLOW = (
    "^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*$",
    "^[0-9]+([-_/=+][0-9]+)*[-_/=+]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
    "abcdefghij|ABCDEFGHIJ|0123456789",
)
SCALE = 1 << 20


def term(c: int) -> int:
    """Fixed-point ``c*log2(c)``: sums of it are exact integers, alike in every engine."""
    return round(SCALE * c * math.log2(c)) if c > 1 else 0


def most_sum(bits: float, window: int) -> int:
    """The largest sum of terms at which a window still has ``bits`` of entropy."""
    return math.floor(SCALE * window * (math.log2(window) - bits))


@dataclass(frozen=True)
class SecretRules:
    """Parameters of the entropy method; the base patterns are fixed.

    A candidate needs ``digits`` digits and a letter besides its entropy, as long words of prose and identifiers
    have few. That misses random base-62 keys with fewer: 14 % of those with 20 characters, 8 % with 24, 2.6 %
    with 32, 0.8 % with 40, and every key of letters alone.
    """

    candidate: str = CANDIDATE
    window: int = WINDOW
    digits: int = DIGITS
    bits: dict = field(default_factory=lambda: dict(BITS))
    allow: tuple = ALLOW


#: Hits handled together when offsets are summed, so that the cost stays near linear in a text's hits.
BLOCK = 256


def _offsets(pieces: Column, hits: Column) -> Column:
    """Where each hit starts, given the text's pieces between the hits; two levels of running sums."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n")))
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(hits) / BLOCK).cast("int") - 1),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )
    spans = "array<struct<s:int,e:int>>"

    def grow(state, x):
        s = (state["at"] + x["gap"]).alias("s")
        e = (state["at"] + x["gap"] + x["n"]).alias("at")
        return F.struct(e, F.concat(state["out"], F.array(F.struct(s, e.alias("e")))).alias("out"))

    def run(at, block):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(spans).alias("out")), grow)

    nested = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")),
        lambda state, block: F.struct(
            run(state["at"], block)["at"].alias("at"),
            F.concat(state["out"], F.array(run(state["at"], block)["out"])).alias("out"),
        ),
    )
    return F.flatten(nested["out"])


def _found(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add ``name``: every leftmost non-overlapping match as (s, e, hit), in code points, end exclusive.

    Texts without a match are sorted out by one search before anything is cut or gathered.
    """
    text, none = F.col("_text"), F.array().cast("array<string>")
    any_ = text.rlike(pattern)
    df = df.withColumn("_hits", F.when(any_, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_pieces", F.when(F.size("_hits") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_at", F.when(F.size("_hits") > 0, _offsets(F.col("_pieces"), F.col("_hits"))))
    zipped = F.zip_with("_at", "_hits", lambda at, h: F.struct(at["s"].alias("s"), at["e"].alias("e"), h.alias("hit")))
    empty = F.array().cast("array<struct<s:int,e:int,hit:string>>")
    return df.withColumn(name, F.coalesce(zipped, empty)).drop("_hits", "_pieces", "_at")


def _hot(hit: Column, rules: SecretRules) -> Column:
    """(first, last, least) of a candidate: the code points its windows of high entropy span, and the least sum."""
    w = rules.window
    chars = F.split(hit, "")
    moves = F.transform(
        chars,
        lambda x, i: F.struct(
            F.instr(F.lit(ALPHABET), x).alias("enter"),
            F.when(i >= w, F.instr(F.lit(ALPHABET), F.get(chars, i - w))).otherwise(0).alias("leave"),
            i.alias("i"),
        ),
    )
    up = F.array(*[F.lit(term(c + 1) - term(c)).cast("long") for c in range(w + 1)])
    limit = F.when(
        hit.rlike("^[0-9a-fA-F]+$"), F.lit(most_sum(rules.bits["hex"], w))
    ).when(
        ~hit.rlike("[A-Z]"), F.lit(most_sum(rules.bits["lower"], w))
    ).otherwise(F.lit(most_sum(rules.bits["mixed"], w))).cast("long")

    def count(counts, at):
        return F.ascii(F.substring(counts, at, F.lit(1))) - 48

    def put(counts, at, c):
        return F.overlay(counts, F.char(c + 48), at, F.lit(1))

    def leave(state, m):
        c = count(state["counts"], m["leave"])
        return F.when(
            m["leave"] > 0,
            F.struct(
                put(state["counts"], m["leave"], c - 1).alias("counts"),
                (state["total"] - F.get(up, c - 1)).alias("total"),
                state["first"].alias("first"),
                state["last"].alias("last"),
            ),
        ).otherwise(state)

    def enter(state, m):
        c = count(state["counts"], m["enter"])
        total = state["total"] + F.get(up, c)
        hot = (m["i"] >= w - 1) & (total <= limit)
        return F.struct(
            put(state["counts"], m["enter"], c + 1).alias("counts"),
            total.alias("total"),
            F.when(hot & (state["first"] < 0), m["i"] - (w - 1)).otherwise(state["first"]).alias("first"),
            F.when(hot, m["i"] + 1).otherwise(state["last"]).alias("last"),
        )

    start = F.struct(
        F.lit("0" * len(ALPHABET)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )
    # The leaving character goes first, so a count never passes the window's width.
    return F.aggregate(moves, start, lambda s, m: enter(leave(s, m), m))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules | None = None) -> DataFrame:
    """Every secret of every whole text: ``(id_col, secrets array<struct<s,e,kind,hit>>)``.

    Offsets are code points from 0, end exclusive; ``kind`` is one of ``KINDS``. Spans are ordered by start,
    then by kind. A null or empty text gives an empty array; repeated rows give repeated results; other columns
    of ``docs`` are not looked at, whatever their names. Entropy candidates pass the allow-list and hold
    ``rules.digits`` digits and a letter. No shuffle, no Python.
    """
    rules = rules or SecretRules()
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_entropy", rules.candidate)):
        df = _found(df, name, pattern)
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6))

    def wanted(x):
        keep = F.length(x["hit"]) >= rules.window
        keep = keep & (F.length(F.regexp_replace(x["hit"], "[^0-9]", "")) >= rules.digits) & x["hit"].rlike("[A-Za-z]")
        for pattern in rules.allow:
            keep = keep & ~x["hit"].rlike(pattern)
        return keep

    hot = F.transform(
        F.filter("_entropy", wanted),
        lambda x: F.struct(x["s"].alias("s"), x["hit"].alias("hit"), _hot(x["hit"], rules).alias("hot")),
    )
    df = df.withColumn("_entropy", F.when(F.size("_entropy") > 0, hot))
    df = df.withColumn(
        "_entropy",
        F.transform(
            F.filter("_entropy", lambda x: x["hot"]["first"] >= 0),
            lambda x: F.struct(
                (x["s"] + x["hot"]["first"]).alias("s"),
                (x["s"] + x["hot"]["last"]).alias("e"),
                F.substring(x["hit"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"]).alias("hit"),
            ),
        ),
    )

    def ranked(k, kind):
        return F.transform(
            F.coalesce(F.col(f"_{kind}"), F.array().cast("array<struct<s:int,e:int,hit:string>>")),
            lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["hit"].alias("hit")),
        )

    parts = [ranked(k, kind) for k, kind in enumerate(KINDS)]
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.array_sort(F.concat(*parts)),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(names, x["k"]).alias("kind"), x["hit"].alias("hit")),
    )
    return df.select(F.col("_id").alias(id_col), spans.alias("secrets"))


def digest_secrets(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from what ``find_secrets`` returns."""

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select(
        id_col, n("assign"), n("access"), n("hex"),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), n("entropy"),
    )


def op1_sql() -> str:
    """DuckDB: the same result, each window's entropy counted afresh."""
    w = WINDOW
    terms = " ".join(f"WHEN {c} THEN {term(c)}" for c in range(2, w + 1))
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    allow = " AND ".join(f"NOT regexp_matches(hit, {quoted(p)})" for p in ALLOW)
    parts = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)):
        parts.append(
            f"SELECT doc_id, rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, {quoted(pattern)}) AS hits, "
            f"string_split_regex(t, {quoted(pattern)}) AS pieces FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
h AS (SELECT doc_id, rid, k, kind, hits[i] AS hit,
        (list_sum(list_transform(pieces[1:i], lambda x: length(x))) +
         coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
base AS (SELECT doc_id, rid, k, kind, s, s + length(hit) AS e FROM h
         WHERE k IN (1, 2) OR (k = 0 AND length(regexp_extract(hit, {quoted(ASSIGN)}, 2)) >= 6)),
c AS (SELECT doc_id, rid, s, hit, CASE WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN {most_sum(BITS['hex'], w)}
        WHEN NOT regexp_matches(hit, '[A-Z]') THEN {most_sum(BITS['lower'], w)} ELSE {most_sum(BITS['mixed'], w)} END AS most
      FROM h WHERE k = 3 AND length(regexp_replace(hit, '[^0-9]', '', 'g')) >= {DIGITS} AND regexp_matches(hit, '[A-Za-z]') AND {allow}),
win AS (SELECT *, unnest(range(0, length(hit) - {w} + 1)) AS p FROM c),
ch AS (SELECT doc_id, rid, s, most, p, x, count(*) AS n
       FROM (SELECT *, unnest(string_split(substr(hit, (p + 1)::BIGINT, {w}), '')) AS x FROM win) GROUP BY ALL),
ent AS (SELECT doc_id, rid, s, p, most, sum(CASE n {terms} ELSE 0 END) AS total FROM ch GROUP BY ALL),
hot AS (SELECT doc_id, rid, 3 AS k, 'entropy' AS kind, (s + min(p))::BIGINT AS s1, (s + max(p) + {w})::BIGINT AS e FROM ent WHERE total <= most GROUP BY doc_id, rid, s),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, rid, k, kind, s1, e FROM hot),
g AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS n,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS bs, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS alls
      FROM every GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(alls, '') AS spans, coalesce(n, 0)::BIGINT AS n_entropy
FROM d LEFT JOIN g USING (rid)
"""
