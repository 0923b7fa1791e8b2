"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones. They fall into folds by a hash of the URL, so repeated URLs
stay together: one half gives the block rates of host suffixes and path tokens, the other half (a bounded sample of
it) fits the trees, and a last part is held out to measure them. Suffix statistics are counted over all pages in
``BUCKETS`` hashed buckets, so their table is bounded whatever the number of hosts, and is broadcast to one pass
over the URLs.

Trees grow level by level from histograms: an aggregate sums gradients and curvatures a node, feature and bin, in
fixed point, so sums don't depend on their order. Only histograms, of a size that the rules bound, come to the
driver, which picks the splits; the fitted trees are one SQL expression. Nothing runs in Python workers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import written

#: (verdict, host, path): fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Buckets of the suffix statistics; a bucket is a row of three numbers.
BUCKETS = 1 << 16
#: Folds by hash: statistics, trees, held out.
FOLDS, STATS, FIT = 8, 4, 7
#: One: a gradient in fixed point.
ONE = 1 << 20
#: Pages that a bucket's rate takes from the mean of all.
SMOOTH = 4
KINDS = ("tld", "domain", "host", "segment", "lead", "ending")


@dataclass(frozen=True)
class UrlRules:
    """The fit: labelled rows at most, bins a feature, trees, their depth, step, least curvature of a leaf, and the verdict's threshold."""

    fit_rows: int = 20_000
    bins: int = 16
    trees: int = 12
    depth: int = 3
    rate: float = 0.6
    ridge: float = 1.0
    least: float = 1.0
    threshold: float = 0.5


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): the host with A-Z lower-cased; all empty for null or without ``://``. What follows ``#`` is in none."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(known, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    asked = F.regexp_extract(behind, r"^[^?#]*\?([^#]*)", 1)
    return lower_ascii(host), path, asked


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct ``(rule, verdict)``; null if none does. Of equal lengths the first by text."""
    fits = None
    for verdict, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        mine = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        told = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(mine, told) if fits is None else fits.when(mine, told)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(host: Column, path: Column) -> dict[str, Column]:
    """What statistics are kept of: host suffixes of one label, two and all, the path's first segment, that with the next character, and the path's ending.

    Hosts and paths are kept apart, so what is known of one says something about URLs whose other part is new.
    """
    parts = F.split(path, "/", 4)
    head, then = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    ending = F.regexp_extract(F.substring(path, -16, 16), r"[^/a-zA-Z0-9]([a-zA-Z0-9]*|/)$|/$", 0)
    return {
        "tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "host": host,
        "segment": head, "lead": F.concat_ws("/", head, F.substring(then, 1, 1)), "ending": ending,
    }


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, everything outside printable ASCII being one; linear in its length."""
    n = F.length(text).cast("double")
    counts = F.transform(F.sequence(F.lit(33), F.lit(126)), lambda c: F.length(text) - F.length(F.replace(text, F.char(c), F.lit(""))))
    counts = F.concat(counts, F.array(F.length(F.regexp_replace(text, "[\\x21-\\x7E]", ""))))
    bits = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda a, k: a + k * F.log2(n / k))
    return F.when(n > 0, bits / n).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column, asked: Column) -> dict[str, Column]:
    """Features of the URL's text alone."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda of, pattern: F.length(of) - F.length(F.regexp_replace(of, pattern, ""))
    return {
        "length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/").cast("double"), "labels": count(host, r"\.").cast("double"), "digit_ratio": count(text, "[0-9]") / n,
        "path_digits": count(path, "[0-9]").cast("double"), "hyphens": count(host, "-").cast("double"), "params": F.when(asked == "", 0).otherwise(1 + count(asked, "&")).cast("double"),
        "entropy": entropy(text), "host_entropy": entropy(host),
    }


def _buckets() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(kind), F.col(f"_t.{kind}")), F.lit(BUCKETS)).cast("int") for kind in KINDS]


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(F.col("_url"), F.lit(""))), F.lit(FOLDS))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """``(bucket, pages, rate)``, at most ``BUCKETS`` rows, written: pages of all rows, smoothed block rate of the labelled ones of the first folds."""
    mine = (_fold() < STATS) & F.col("_label").isNotNull()
    each = rows.select(F.explode(F.array(*_buckets())).alias("bucket"), mine.cast("long").alias("n"), F.when(mine, F.col("_label")).otherwise(0).cast("long").alias("bad"))
    sums = written(each.groupBy("bucket").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-sums")
    mean = sums.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).first()[0]
    rate = (F.col("bad") + SMOOTH * F.lit(mean)) / (F.col("n") + SMOOTH)
    return written(sums.select("bucket", F.log2(F.col("pages").cast("double")).alias("pages"), rate.alias("rate")), "url-suffixes")


def with_features(rows: DataFrame, statistics: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with a column for each feature, and their names; the statistics are bounded by ``BUCKETS`` rows, so they are broadcast."""
    names = []
    own = lexical(F.col("_url"), F.col("_host"), F.col("_path"), F.col("_asked"))
    rows = rows.withColumns({f"_f_{k}": v for k, v in own.items()} | {f"_b_{k}": b for k, b in zip(KINDS, _buckets(), strict=True)})
    names += [f"_f_{k}" for k in own]
    for kind in KINDS:
        side = statistics.select(F.col("bucket").alias(f"_b_{kind}"), F.col("rate").alias(f"_f_{kind}_rate"), F.col("pages").alias(f"_f_{kind}_pages"))
        rows = rows.join(F.broadcast(side), f"_b_{kind}", "left")
        names += [f"_f_{kind}_rate", *([f"_f_{kind}_pages"] if kind in ("domain", "host") else [])]
    return rows, names


def leaf_value(tree: list, at: int = 0) -> Column:
    """A tree as an expression: ``tree[at]`` is a leaf's weight or (feature, limit); its children stand at 2 at + 1 and 2 at + 2."""
    node = tree[at]
    if not isinstance(node, tuple):
        return F.lit(node)
    feature, limit = node
    return F.when(F.col(feature) <= F.lit(limit), leaf_value(tree, 2 * at + 1)).otherwise(leaf_value(tree, 2 * at + 2))


def margin(trees: list) -> Column:
    """The sum of all trees in fixed point: log-odds times ``ONE``."""
    total = F.lit(0).cast("long")
    for tree in trees:
        total = total + leaf_value(tree).cast("long")
    return total


def _gain(g: int, h: int, rules: UrlRules) -> float:
    return g * g / (h + rules.ridge * ONE)


def best_split(bins: dict[str, list], limits: dict[str, list], rules: UrlRules) -> tuple | None:
    """(feature, limit, g, h) of the greatest gain of a node's histograms ``{feature: [(bin, g, h)]}``, with the sums at or below the limit.

    Ties go to the earlier feature and the lower limit.
    """
    best, found = 1e-9, None
    for feature in limits:
        rows = {b: (g, h) for b, g, h in bins.get(feature, ())}
        all_g, all_h = (sum(r[k] for r in rows.values()) for k in (0, 1))
        g = h = 0
        for b, limit in enumerate(limits[feature]):
            if b in rows:
                g, h = g + rows[b][0], h + rows[b][1]
            if min(h, all_h - h) < rules.least * ONE:
                continue
            gain = _gain(g, h, rules) + _gain(all_g - g, all_h - h, rules) - _gain(all_g, all_h, rules)
            if gain > best * 1.000001:
                best, found = gain, (feature, limit, g, h)
    return found


def bin_limits(values: list[float]) -> list[float]:
    """Limits half-way between the quantiles that differ, so a value that was never seen falls to the side it is nearer to."""
    ends = sorted(set(values))
    return [(a + b) / 2 for a, b in zip(ends, ends[1:], strict=False)]


def grow(histograms, limits: dict[str, list], rules: UrlRules) -> list:
    """One tree in heap order; ``histograms(tree, level)`` gives ``{node: {feature: [(bin, g, h)]}}`` of a level."""
    tree: list = [None] * (2 ** (rules.depth + 1) - 1)
    totals: dict[int, tuple[int, int]] = {}
    for level in range(rules.depth):
        for at, node in sorted(histograms(tree, level).items()):
            one = next(iter(node.values()))
            g, h = totals.setdefault(at, (sum(r[1] for r in one), sum(r[2] for r in one)))
            if split := best_split(node, limits, rules):
                feature, limit, left_g, left_h = split
                tree[at] = (feature, limit)
                totals |= {2 * at + 1: (left_g, left_h), 2 * at + 2: (g - left_g, h - left_h)}
    for at, (g, h) in totals.items():
        if tree[at] is None:
            tree[at] = round(rules.rate * ONE * g / (h + rules.ridge * ONE))
    return [0 if x is None else x for x in tree]


def fit(sample: DataFrame, names: list[str], rules: UrlRules) -> list:
    """Trees over ``sample`` (written, ``_label`` and the features), each a list in heap order; the first is the base score.

    A level of a tree is one aggregate over the sample, with a row a node, feature and bin as its result: at most
    2 ** depth * features * bins rows.
    """
    quantiles = [F.percentile(F.col(n), [k / rules.bins for k in range(rules.bins + 1)]).alias(n) for n in names]
    cuts = sample.agg(F.count("*").alias("_n"), F.sum("_label").alias("_bad"), *quantiles).first()
    if not cuts["_n"]:
        return []
    limits = {n: bin_limits([float(x) for x in cuts[n]]) for n in names}
    odds = math.log((cuts["_bad"] + 1) / (cuts["_n"] - cuts["_bad"] + 1))
    trees: list = [[round(odds * ONE)]]

    def shelf(n: str) -> Column:
        """The number of limits below the value."""
        return F.size(F.filter(F.lit(limits[n]) if limits[n] else F.array().cast("array<double>"), lambda limit: F.col(n) > limit))

    binned = written(sample.select("_label", *names, *[shelf(n).alias(f"_bin{k}") for k, n in enumerate(names)]), "url-binned")
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"_bin{k}").alias("b")) for k in range(len(names))])).alias("x")

    def histograms(tree: list, level: int) -> dict:
        p = 1 / (1 + F.exp(-margin(trees).cast("double") / ONE))
        rows = binned.withColumns({"_at": _place(tree, level), "_g": F.round((F.col("_label") - p) * ONE).cast("long"), "_h": F.round(p * (1 - p) * ONE).cast("long")})
        sums = rows.where(F.col("_at") >= 0).select("_at", "_g", "_h", bins).groupBy("_at", "x.f", "x.b").agg(F.sum("_g"), F.sum("_h"))
        found: dict = {}
        for at, f, b, g, h in sums.collect():
            found.setdefault(at, {}).setdefault(names[f], []).append((b, g, h))
        return found

    for _ in range(rules.trees):
        trees.append(grow(histograms, limits, rules))
    return trees


def _place(tree: list, level: int, at: int = 0) -> Column:
    """The node of a level that a row comes to; -1 if it stops above."""
    if 2**level - 1 <= at:
        return F.lit(at)
    if not isinstance(tree[at], tuple):
        return F.lit(-1)
    feature, limit = tree[at]
    return F.when(F.col(feature) <= F.lit(limit), _place(tree, level, 2 * at + 1)).otherwise(_place(tree, level, 2 * at + 2))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """``(_id, _url, _host, _path, _asked, _rule, _label, _t)``: parts, rule, label (1 blocked, 0 allowed, null undecided) and tokens of every URL."""
    host, path, asked = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host, "_path": path, "_asked": asked})
    rows = rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    rows = rows.withColumn("_label", F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0))
    return rows.withColumn("_t", F.struct(*[v.alias(k) for k, v in tokens(F.col("_host"), F.col("_path")).items()]))


def url_scores(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, how: UrlRules | None = None) -> DataFrame:
    """``(id_col, host, path, rule, rule_verdict, score, held_out)``: every URL with its rule and its probability of being blocked.

    ``held_out`` marks URLs of the fold that neither statistics nor trees saw. Null URLs, and those without
    ``://``, have empty parts and the score that such features get. Without any labelled URL every score is 0.
    Repeated rows score alike; other columns are not looked at, whatever their names. URLs may have any length:
    features are linear in it.
    """
    how = how or UrlRules()
    rows = parsed(pages, id_col, url_col, rules)
    statistics = suffix_statistics(rows)
    taken = rows.where(F.col("_label").isNotNull() & (_fold() >= STATS) & (_fold() < FIT)).select("_url", "_host", "_path", "_asked", "_label", "_t")
    # The bound of the fit: the smallest hashes, whichever rows those are.
    taken = taken.orderBy(F.xxhash64(F.lit("fit"), "_url"), "_url").limit(how.fit_rows)
    sample, names = with_features(taken, statistics)
    trees = fit(written(sample.select("_label", *names), "url-sample"), names, how)
    every, _ = with_features(rows, statistics)
    score = 1 / (1 + F.exp(-margin(trees).cast("double") / ONE)) if trees else F.lit(0.0)
    return every.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("rule_verdict"),
        score.alias("score"), (_fold() >= FIT).alias("held_out"),
    )


def judge(scored: DataFrame, how: UrlRules | None = None) -> DataFrame:
    """``url_scores`` with ``verdict``: the rule's, else block at the threshold or above."""
    how = how or UrlRules()
    own = F.when(F.col("score") >= how.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce("rule_verdict", own))
