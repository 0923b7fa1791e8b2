"""Mixing sources to target weights: token totals per source, capped shares, repetition rates, seeded copies.

Each document is emitted floor(rate) times, plus once more by a draw that its id's hash under the source's seed
decides. A source takes, of ``SEEDS`` seeds, the one under which its draws come nearest to its target; that
costs one aggregate over ids and sizes, and keeps sources with few or very uneven documents close. So the draws of
a source are conditioned on their sum: under any one seed a document's copy has the fraction as its probability,
but a source is not one unconditioned draw, and a change of its documents can change its seed and with it all its
draws. ``seeds=1`` gives the plain draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.llm.columns import kept_as, named
from strandplan.operators.numbering import dense_ids, sums_before
from strandplan.plans.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights in the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
SEEDS = 16


def words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, size)``: one row a source.

    Sources rank by code point, null last, and take ``weights`` in turn. Targets share the total by weight; a
    target stops at ``most`` times its source's size and its excess is shared again by weight until none is
    above. That fixed point is found at once: sources saturate in the order of size over weight, so with
    running totals in this order the first source that its share doesn't fill gives the level of all later ones.
    An empty source has target and rate 0. Ranks and running totals go by ranges of their order, so sources may be
    as many as web hosts; only sums over all of them, and the one source that gives the level, are single rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_ids(per, F.col("source").asc_nulls_last(), name="_rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int")).cast("long")
    by_fill = ((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    filled = dense_ids(ranked.withColumn("w", weight), *by_fill, name="_i")
    filled = written(sums_before(filled, {"source_size": "_sizes", "w": "_ws"}, "_i"), "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("_all"), F.sum("w").alias("_all_w"))  # one row
    rest, rest_w = (F.col("_all") - most * F.col("_sizes")).alias("rest"), (F.col("_all_w") - F.col("_ws")).alias("rest_w")
    level = filled.crossJoin(F.broadcast(whole)).select("source", "source_size", "w", "_i", rest, rest_w)
    fits = F.col("rest") * F.col("w") <= most * F.col("source_size") * F.col("rest_w")
    first = level.agg(F.min(F.when(fits, F.struct("_i", "rest", "rest_w"))).alias("level"))  # one row
    level = level.crossJoin(F.broadcast(first)).withColumn("open", F.coalesce(F.col("_i") >= F.col("level._i"), F.lit(False)))
    target = F.when(F.col("open"), F.col("w") * F.col("level.rest").cast("double") / F.col("level.rest_w")).otherwise((most * F.col("source_size")).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return level.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def uniform(id_: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a numbered seed and an id: 52 bits of MD5, so reruns and other engines agree."""
    text = F.concat(F.lit(seed + ":"), number.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def copies(id_: Column, rate: Column, number: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with the fraction's probability."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(id_, number, seed) < rate - whole, 1).otherwise(0)).cast("long")


def with_seeds(sized: DataFrame, table: DataFrame, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """``table`` with ``number``: each source's seed, the one whose draws take nearest to the target (ties to the lower)."""
    joined = sized.join(table, F.col("source").eqNullSafe(F.col("_source")))
    sums = [F.sum(F.col("size") * copies(F.col("_id"), F.col("rate"), F.lit(k), seed)).alias(f"t{k}") for k in range(seeds)]
    taken = joined.groupBy("_source", "source_size", "target", "rate").agg(*sums)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(seeds)]))
    return taken.select("_source", "source_size", "target", "rate", best["k"].alias("number"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, keep: tuple = (), seeds: int = SEEDS,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies)`` and ``keep`` columns, a row for each row of ``docs``.

    Rates are at most ``most``, so no row passes ``most`` times its size. Null texts have size 0; null sources are
    one source; repeated rows draw alike. Ids and sizes are written once and read by the sums. The per-source
    table is written too, so its size is known: Catalyst broadcasts it below its threshold and otherwise
    sort-merge joins, where a hot source is split by adaptive execution. A kept column that has the name of a
    result comes back as that name with ``_kept``; names may hold any character. Texts may have any length; an
    empty table gives an empty result.
    """
    rows = docs.select(named(id_col).alias("_id"), named(source_col).alias("source"), words(named(text_col)).alias("size"), *[named(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])
    sized = written(rows.select("_id", "source", "size"), "mix-sizes")
    table = written(source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "_source"), "mix-rates")
    table = written(with_seeds(sized, table, seed, seeds), "mix-seeds")
    joined = (rows if keep else sized).join(table, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", copies(F.col("_id"), F.col("rate"), F.col("number"), seed).alias("copies"),
        *[F.col(f"_keep_{k}").alias(kept_as(c, (id_col, "source", "size", "source_size", "target", "copies"))) for k, c in enumerate(keep)],
    )


def op6_sql() -> str:
    """DuckDB: shares by the same level, found by trying every possible set of filled sources."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS i FROM r),
lv AS (SELECT a.i, (SELECT sum(source_size) FROM o) - {MOST} * coalesce((SELECT sum(b.source_size) FROM o b WHERE b.i < a.i), 0) AS rest,
       (SELECT sum(w) FROM o) - coalesce((SELECT sum(b.w) FROM o b WHERE b.i < a.i), 0) AS rest_w, a.w, a.source_size FROM o a),
f AS (SELECT * FROM lv WHERE rest * w <= {MOST} * source_size * rest_w ORDER BY i LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN f.i IS NULL OR o.i < f.i THEN ({MOST} * o.source_size)::DOUBLE
        ELSE o.w * f.rest::DOUBLE / f.rest_w END AS target FROM o LEFT JOIN f ON true),
q AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {float(MOST)}) ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, k, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || k || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}::DOUBLE < rate - floor(rate)
        THEN 1 ELSE 0 END AS copies FROM q, (SELECT unnest(range(0, {SEEDS})) AS k)),
s AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies)::BIGINT - any_value(target)), k) AS rn FROM c GROUP BY source, k) WHERE rn = 1)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source AND c.k = s.k
"""
