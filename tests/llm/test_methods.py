"""Methods against plain versions of themselves, names that clash, and the pipeline on hard tables."""

import math
import random
import re
import struct
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from conftest import SMALL  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from strandplan.llm import hnsw, licenses, linededup, mixing, nearcopies, toxicity, tsmedia, workers  # noqa: E402

MASK = (1 << 64) - 1


def plain_features(text, rules):
    """Buckets of one text, with Python's own integers."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    whole, stem = [zlib.crc32(w.encode()) for w in words], [zlib.crc32(w[:4].encode()) for w in words]

    def bucket(x, kind):
        m = (x + kind) * 0x9E3779B97F4A7C15 & MASK
        m ^= m >> 29
        return (m * 0xBF58476D1CE4E5B9 & MASK) >> 64 - rules.bits

    pairs = [(gap, a, b) for gap in (1, 2, 3) for a, b in zip(whole, whole[gap:], strict=False)]
    found = {bucket(x, 1) for x in whole} | {bucket(x, 2) for x in stem}
    return {0} | found | {bucket((a * 0x100000001B3 & MASK) ^ b, 2 + gap) for gap, a, b in pairs}


def test_ftrl_equals_the_published_update():
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        words = [rnd.choice(("plain", "word", "here", "some", "other", "thing")) for _ in range(rnd.randint(0, 25))]
        if i % 4 == 0:
            words += ["vile"] * rnd.randint(1, 2)
        rows.append((" ".join(words), int(i % 4 == 0)))
    rules = toxicity.FtrlRules(bits=14, l1=0.3, epochs=2, steps=0)
    buckets, weights, bias = toxicity.fit(rows, rules)
    sets = [plain_features(t, rules) for t, _ in rows]
    seen = {}
    for s in sets:
        for b in s:
            seen[b] = seen.get(b, 0) + 1
    share = (sum(y for _, y in rows) + toxicity.PRIOR * toxicity.PRIOR_TEXTS) / (len(rows) + toxicity.PRIOR_TEXTS)
    assert bias == pytest.approx(math.log(share / (1 - share)))
    z, n = {}, {}

    def weight(b):
        x = z.get(b, 0.0)
        if abs(x) <= rules.l1:
            return 0.0
        return -(x - math.copysign(rules.l1, x)) / ((rules.beta + math.sqrt(n.get(b, 0.0))) / rules.alpha + rules.l2)

    for epoch in range(rules.epochs):
        for k in np.random.default_rng(toxicity.SEED + epoch).permutation(len(rows)).tolist():
            used = [b for b in sets[k] if seen[b] >= rules.least_texts]
            w = {b: weight(b) for b in used}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - rows[k][1]
            for b in used:
                sigma = (math.sqrt(n.get(b, 0.0) + g * g) - math.sqrt(n.get(b, 0.0))) / rules.alpha
                z[b] = z.get(b, 0.0) + g - sigma * w[b]
                n[b] = n.get(b, 0.0) + g * g
    want = {b: weight(b) for b in z if weight(b)}
    assert len(want) > 10 and set(buckets.tolist()) == set(want)
    assert all(w == pytest.approx(want[b], rel=1e-9) for b, w in zip(buckets.tolist(), weights.tolist(), strict=True))


def test_ftrl_bound_on_features_leaves_whole_texts_out():
    rules = toxicity.FtrlRules(bits=12, l1=0.1)
    rows = [(f"good words number {'one two three four'.split()[i % 4]}", i % 2) for i in range(40)]
    long = " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(3000))
    small = toxicity.fit(rows, rules, most=5000)
    assert [x.tolist() for x in toxicity.fit([*rows[:20], (long, 1), *rows[20:]], rules, most=1500)[:2]] == [x.tolist() for x in small[:2]]


def slow_alignments(words, index, idf, rules):
    """Each template at every offset, as the rules say it."""
    found = []
    for t, notice in enumerate(index.texts):
        here = sorted({w for w in words if w in notice}, key=lambda w: (-idf.get(w, 0.0), w))[: rules.anchors]
        starts = {w: [i - q for i, x in enumerate(words) if x == w for q, y in enumerate(notice) if y == w] for w in here}
        last, best = -math.inf, None
        for d in range(-len(notice), len(words) + 1):
            if not any(d in s for s in starts.values()):
                continue
            if sum(any(abs(x - d) <= rules.slack for x in s) for s in starts.values()) < min(rules.agree, len(here)):
                continue
            if not all(any(words[s : s + len(p)] == p for s in range(max(0, d + o - rules.slack), d + o + rules.slack + 1)) for o, p in index.keys[t]):
                continue
            share = sum(0 <= d + q < len(words) and words[d + q] == w for q, w in enumerate(notice)) / len(notice)
            if d > last + rules.slack:
                found += [best] if best else []
                last, best = d, None
            if best is None or share > best[2]:
                best = (index.labels[t], max(0, d), share)
        found += [best] if best else []
    return sorted(found)


def test_license_alignments_equal_every_offset():
    rnd = random.Random(8)
    index, rules = licenses.Index(), licenses.LicenseRules()
    total = 0
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 4)):
            notice = list(rnd.choice(index.texts))
            for _ in range(rnd.randint(0, 3)):  # words lost, added and changed
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.randint(0, 1)] = [rnd.choice((b"and", b"license", b"xyz"))] * rnd.randint(0, 2)
                notice = notice or [b"x"]
            words += [b"filler"] * rnd.randint(0, 6) + notice
        idf = {w: rnd.choice((0.5, 1.0, 2.0, 3.0)) for w in index.vocabulary}
        got = licenses.scan(words, index, idf, rules)[1]
        assert got == slow_alignments(words, index, idf, rules)
        total += len(got)
    assert total > 100


def small_demuxer(stream):
    """Payload, units, random-access units and counter gaps by the packet layout alone, a packet at a time."""
    tables, pes, units, entries, gaps, counter, media_pid = {}, [], 0, 0, 0, None, None
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, start, control = (p[1] & 31) << 8 | p[2], p[1] >> 6 & 1, p[3] >> 4 & 3
        body, mark = 4, 0
        if control & 2:
            mark = p[4] > 0 and p[5] >> 6 & 1
            body = 5 + p[4]
        if pid == 0:
            section = p[5 + p[4] :]
            tables["pmt"] = (section[10] & 31) << 8 | section[11]
        elif pid == tables.get("pmt"):
            section = p[5 + p[4] :]
            media_pid = (section[13] & 31) << 8 | section[14]
        elif pid == media_pid:
            gaps += counter is not None and p[3] & 15 != (counter + 1) & 15
            counter = p[3] & 15
            units, entries = units + start, entries + bool(mark)
            if start:
                pes.append(b"")
            pes[-1] += p[body:]
    payload = b""
    for x in pes:
        assert x[:3] == b"\0\0\1"
        size = struct.unpack(">H", x[4:6])[0]
        payload += x[9 + x[8] : 6 + size]
    return payload, units, entries, gaps


def test_transport_stream_by_another_reader(spark):
    rnd = random.Random(2)
    for n in (0, 1, 63, 64, 150, 167, 168, 184, 8191, 8192, 8193, 33_000, 100_001):
        payload, _ = tsmedia.padded("".join(rnd.choice("abé ") for _ in range(n)))
        stream = tsmedia.mux(payload)
        read, units, entries, gaps = small_demuxer(stream)
        assert (read, gaps) == (payload, 0)
        media = tsmedia.demux(stream)
        assert (len(media.stamps), len(media.entries)) == (units, entries)
        assert media.stamps == [at * 90_000 // 8000 for at in range(0, len(payload), 8192)]
        told = dict(x.split("=") for x in tsmedia._describe(payload, media).split(";"))
        assert told["sum"] == str(sum(payload)) and told["levels"] == str(len(set(payload))) and told["step"] == str(sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False)))
        assert (told["packets"], told["units"], told["min"], told["max"]) == (str(len(stream) // 188), str(units), str(min(payload)), str(max(payload)))


def test_line_dedup_passes_columns_of_any_name(spark):
    names = "doc_id long, text string, _doc int, doc int, row string, m_flags int, body string, _key string, _flags string, _n_dropped long"
    docs = spark.createDataFrame([(1, "the same line here\nx", 1, 2, "r", 3, "b", "k", "f", 99), (2, "the same line here\ny", 4, 5, "r", 6, "b", "k", "f", 99)], names)
    rows = sorted(linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).collect())
    assert [(r["doc_id"], r["_doc"], r["doc"], r["_key"], r["_flags"], r["_n_dropped"], r["_kept"]) for r in rows] == [(1, 1, 2, "k", "f", 0, "the same line here\nx"), (2, 4, 5, "k", "f", 1, "y")]


def test_toxicity_keeps_columns_of_any_name(spark):
    model = np.array([], np.int64), np.array([]), 0.0
    docs = spark.createDataFrame([(1, "a", "b", 2.0)], "doc_id long, text string, _scored string, bucket double")
    row = toxicity.score(docs, model, keep=("doc_id", "text", "_scored", "bucket")).first()
    assert row.asDict() == {"doc_id": 1, "text": "a", "_scored": "b", "bucket": 2.0, "score": 0.5}


def test_hnsw_with_one_very_long_vector_a_shard(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[0] *= 10_000
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = hnsw.written(hnsw.usable(rows, "vec_id", "embedding"), "rows")
    index, shards = hnsw.build_index(vectors)
    got = {}
    for r in hnsw.search(index, shards, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(found & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_workers_let_go_of_another_operators_things():
    freed = []
    workers._kept.clear()
    workers.turn("a", lambda: freed.append("a"))
    workers.turn("a", lambda: freed.append("again"))
    assert not freed
    workers.turn("b")
    assert freed == ["again"] and not workers._kept


def test_plain_draws_have_the_fraction_as_probability(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'w w' as text", "if(id % 4 = 0, 'a', 'b') as source")
    rows = mixing.mix(docs, seeds=1).collect()
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        rate = mine[0]["target"] / mine[0]["source_size"]
        assert {r["copies"] for r in mine} <= {math.floor(rate), math.floor(rate) + 1}
        assert abs(np.mean([r["copies"] for r in mine]) - rate) < 4 * math.sqrt(0.25 / len(mine))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0 and (name == "bpe" or got.columns == list(P.COLUMNS))


def test_pipeline_on_odd_rows(spark, tmp_path):
    text = "one line that is long enough\nand another of some length"
    rows = [(None, text, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, " \n\t", "en", None, 3),
            (4, text, "en", "s", 1), (4, text, "en", "s", 1), (5, text.upper(), "en", "t", 1), (6, "long words " * 20_000, "en", "t", 1), (7, "é" * 50, "fr", "t", 1), (7, "another text of id seven", "fr", "t", 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", size int, component string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, left = str(tmp_path), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        left[name] = docs.collect()
    assert len(left["toxicity"]) == len(rows) and len(left["line_dedup"]) == len(rows)
    assert {r["text"] for r in left["line_dedup"] if r["doc_id"] == 5} == {""}
    kept = sorted((r["doc_id"], r["text"][:5]) for r in left["simhash"] if r["doc_id"] is not None)
    assert kept == [(1, ""), (4, "one l"), (6, "long "), (7, "anoth"), (7, "é" * 5)]
    assert sum(r["doc_id"] is None for r in left["simhash"]) == 2
    assert len(left["bpe"]) == len(left["mixing"])


def test_near_copies_equal_all_pairs(spark):
    """Groups of the pipeline's near-dedup against every pair, on whole texts with planted near copies."""
    rng = np.random.default_rng(7)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for k, edits in enumerate((1, 1, 2, 3, 4, 6, 8, 12) * 5):  # chains of copies around the threshold
        words = texts[k].split()[:150]
        for at in rng.integers(0, max(1, len(words)), edits):
            words[at : at + 1] = [f"edit{rng.integers(1000)}"]
        texts += [" ".join(texts[k].split()[:150]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    rows = {r["key"]: r["component_key"] for r in nearcopies.near_copies(docs).collect()}
    keyed = docs.select(nearcopies.text_key("text").alias("key"), "text").dropDuplicates(["key"]).collect()
    sets = [nearcopies.shingle_set(r["text"]) for r in keyed]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([holders[x] for x in s]), minlength=len(sets))
        sizes = np.array([len(x) for x in sets])
        for j in np.flatnonzero(5 * both >= 4 * (len(s) + sizes - both)).tolist():
            if j < i:
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = {}
    for i, r in enumerate(keyed):
        want.setdefault(root(i), set()).add(r["key"])
        got.setdefault(rows[r["key"]], set()).add(r["key"])
    assert links >= 10
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_kept_columns_of_any_name(spark):
    """Names of results, dots and backticks: nothing is lost and nothing stands twice."""
    from strandplan.llm.bpe import encode_texts
    from strandplan.llm.mixing import mix

    rows = [(i, "some words here", "s", 7 * i, "x", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, `a.b` string, `n_tokens` int")
    mixed = mix(docs, keep=("size", "a.b", "text"))
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "size_kept", "a.b", "text"]
    assert {(r["doc_id"], r["size"], r["size_kept"]) for r in mixed.collect()} == {(i, 3, 7 * i) for i in range(4)}
    coded = encode_texts(docs, keep=("doc_id", "n_tokens", "a.b"))
    assert coded.columns == ["doc_id", "n_tokens_kept", "a.b", "n_tokens", "ids", "decoded"]
    assert all(r["decoded"] == "some words here" and r["a.b"] == "x" for r in coded.collect())


def test_source_targets_over_many_sources(spark):
    """As many sources as ranges can hold: the level by ranges equals the level found one by one."""
    from strandplan.llm.mixing import MOST, WEIGHTS, source_targets

    sizes = {f"s{i:04d}": (i * 7919) % 1000 + (50_000 if i == 3 else 0) for i in range(400)} | {None: 31}
    got = {r["source"]: (r["target"], r["rate"]) for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    full, want = set(), {}
    while True:
        rest = sum(sizes.values()) - MOST * sum(sizes[s] for s in full)
        share = rest / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and weight[s] * share > MOST * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        want[s] = MOST * sizes[s] if s in full else weight[s] * share
        assert abs(got[s][0] - want[s]) <= 1e-6 * max(1, want[s]), s
        assert got[s][1] == (0.0 if not sizes[s] else min(got[s][0] / sizes[s], float(MOST)))
