"""The contract's queries: against SQL where there is some, else against plain Python."""

import hashlib
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from conftest import SMALL, same  # noqa: E402

import strandplan.llm.queries as Q  # noqa: E402
from strandplan.llm import licenses, tsmedia  # noqa: E402

ODD = [None, "", " ", "\n", "a", "A" * 30, "x\n" * 40, "password=abc token: 'abcdefg' AKIA" + "Z9" * 10 + " " + "deadbeef" * 5, "é" * 40 + "\nüÜ straße\n" + "line of ten or more\n" * 3,
       "Licensed under the Apache License, Version 2.0.\ncc by nc Released under the MIT License.", "<|endoftext|> a<|endoftext|>", "long " * 30_000, "same text here for two", "same text here for two"]

#: Null turns, roles and texts, ties, repeated rows, a long copy, a null and a negative conversation.
TURNS = [(0, t, "user", f"turn {t}", 1, "x") for t in range(90)] + [(100, t, "user", f"turn {t}", 1, "x") for t in range(90)] + [(c, t, "user", f"turn {t}" if t < 70 else f"{c} goes on", 1, "x") for c in (1, 2, 103) for t in range(72)]
TURNS += [(7, None, None, None, 1, "x"), (7, None, "user", None, 1, "x"), (7, 3, "a", "b" * 40_000, 1, "x"), (7, 3, "a", "b" * 40_000, 1, "x"), (7, 3, "", "tie", 1, "x"), (None, 1, "user", "no conversation", 1, "x"), (-5, 1, "user", "turn 0", 1, "x"), (205, 1, "user", "base is absent", 1, "x"), (300, 0, "", "", 1, "x"), (301, 0, None, None, 1, "x")]
ITEMS = [(0, "Same TEXT here", 1, 0.5), (0, "two two", 1, 0.5), (1, None, 1, 0.5), (2, " \n", 1, 0.5), (3, "nothing that stands anywhere zzqy", 1, 0.5), (4, "straße üü x long 2.0 " * 9_000, 1, 0.5), (None, "line of mine", 1, 0.5)]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Small tables of hard cases: nulls, empty and long texts, repeated rows, extra columns that clash."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", i, 1.5, "k") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long, rate double, size string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1 if i == 7 else 0, "x") for i in range(8)] + [(3, None, None, "y")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    pages = [(i, f"http://h/{i % 3}", h, "z") for i, h in enumerate([None, "", "short", "p" * 100, "p" * 100, "WARC/1.1\r\n\r\n" * 20, "p" * 100, "é" * 60, "é" * 60])]
    spark.createDataFrame([*pages, pages[3]], "page_id long, url string, html string, digest string").write.parquet(f"{d}/pages.parquet")
    vectors = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [3.0, 0.1]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [0.1, 0.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors], "vec_id long, embedding array<double>, label int, score double").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, depth int, label string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string, rank int, score double").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "conversations", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def odd_duck(odd_dir, duck_module):
    c = duck_module.connect()
    for name in ("documents", "labels", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{odd_dir}/{name}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    same(Q.queries()[name](spark, SMALL), duck, Q.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_secrets", "op3_warc", "op6_mixing", "op11_conversation_trie", "op12_lexical_search"])
def test_sql_on_odd_rows(spark, odd_dir, name):
    import duckdb

    got = Q.queries()[name](spark, odd_dir)
    c = odd_duck(odd_dir, duckdb)
    sql = Q.oracle_sql()[name]
    same(got, c, sql)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert Q.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - {"op11_conversation_trie", "op12_lexical_search"}))
def test_odd_rows_keep_their_number(spark, odd_dir, name):
    n = Q.queries()[name](spark, odd_dir).count()
    assert n == {"op3_warc": 10, "op9_hnsw": 2 * 6, "op13_url_filters": 10}.get(name, len(ODD) + 1)


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_licenses_base_places(spark, duck):
    got = {r["doc_id"]: r for r in Q.op2_licenses(spark, SMALL).collect()}
    for doc_id, text in texts(duck):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= r["score"] <= 1


def test_license_templates_find_themselves_and_not_each_other():
    index = licenses.Index()
    idf = dict.fromkeys(index.vocabulary, 1.0)
    for label, notice, _ in licenses.TEMPLATES:
        found = licenses.scan(licenses.words_of("Some words before. " + notice.title() + ". And after."), index, idf, licenses.LicenseRules())[1]
        assert label in {x for x, _, _ in found}
        assert {x for x, _, s in found if s == 1.0} <= {label} | {"gpl-3", "bsd-2", "zlib"}
    assert licenses.scan(licenses.words_of("the license version of this software is hereby mit"), index, idf, licenses.LicenseRules()) == ([], [])


def test_license_is_found_where_its_rarest_word_stands_elsewhere():
    index = licenses.Index()
    notice = "neither the name of google inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    words = licenses.words_of(f"{notice} {'x ' * 50} in no event shall the copyright holder be liable")
    for rarest in ("holder", "copyright", "contributors", "endorse"):
        idf = {w: 1.0 for w in index.vocabulary} | {b"promote": 2.0, b"endorse": 2.5, rarest.encode(): 3.0}
        found = licenses.scan(words, index, idf, licenses.LicenseRules())[1]
        assert [x[0] for x in found] == ["bsd-3"], rarest


def test_bpe_equals_the_library(spark, odd_dir, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandplan.llm.bpe import encode_texts

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (SMALL, odd_dir):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
        for r in encode_texts(docs, keep=("doc_id", "text")).collect():
            want = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["n_tokens"] == len(want)
            assert r["decoded"] == t.decode(want, skip_special_tokens=False)
        for r in Q.op4_bpe(spark, d).join(docs, "doc_id").collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_bpe_words_of_every_shape():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from strandplan.llm.bpe import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        mine = Encoder(f.read())
    theirs = Tokenizer.from_file(path)
    rnd = random.Random(3)
    letters = "ab theénÑ日\n\t 'st'll012½²_<|>́​\x1e\x85😀"
    rows = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(800)] + ["a" * 3000, " " * 500, "0" * 400, "\n" * 99]
    want = [e.ids for e in theirs.encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(c, "<u4").tolist() for c in mine.encode(rows)] == want


def brute_components(rows):
    ids = sorted(rows)
    prints = np.array([rows[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4).tolist():
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_all_pairs(spark, duck, odd_dir):
    for d in (SMALL, odd_dir):
        rows = {r["doc_id"]: slow_print(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        want = brute_components(rows)
        for r in Q.op5_simhash(spark, d).collect():
            assert r["fingerprint"] == f"{rows[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_simhash_covering_and_large_buckets(spark):
    """Chains of prints at most four bits apart, with buckets so small that they are dealt again."""
    from strandplan.llm import simhash

    rnd = np.random.default_rng(5)
    for _ in range(2000):
        bits = rnd.choice(64, 4, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in simhash.masks((1 << 64) - 1))
    rows, x = {}, int(rnd.integers(1 << 62))
    for i in range(300):
        rows[i] = x
        flips = rnd.choice(np.arange(12), 3, replace=False)
        x ^= sum(1 << int(b) for b in flips)
        if i % 60 == 59:
            x = int(rnd.integers(1 << 62))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in set(rows.values())], "fp long")
    links = simhash.near_links(prints, bucket=16).collect()
    parent = {v: v for v in rows.values()}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = brute_components(rows)
    assert len({root(v) for v in rows.values()}) == len(set(want.values()))


def test_line_dedup_on_odd_rows(spark, odd_dir):
    """Against plain Python, a null text as one empty line."""
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    first = {}
    for i, t in enumerate(ODD):
        for line in (t or "").split("\n"):
            first.setdefault(low(line), i)
    for r in Q.op7_line_dedup(spark, odd_dir).collect():
        lines = (ODD[r["doc_id"]] or "").split("\n")
        kept = [x for x in lines if len(low(x)) < 10 or first[low(x)] == r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup_hot_line_over_many_ranges(spark):
    """A line that every document holds is split over the ranges, and all but its first document lose it."""
    from strandplan.llm.linededup import apply_bitmaps, keep_bitmaps

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a very common line here\\nown line number ', id, '\\na very common line here') as text")
    rows = apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "_n_dropped", "_kept").collect()
    assert {r["doc_id"] for r in rows if r["_n_dropped"] == 0} == {0}
    assert all(r["_kept"] == f"own line number {r['doc_id']}" for r in rows if r["doc_id"])


def test_mixing_reaches_targets(spark):
    from strandplan.llm.mixing import mix

    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 60 = 1 then null when id % 7 = 2 then 'tiny' else concat('s', id % 5) end as source")
    rows = mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    for s, (target, size) in targets.items():
        assert target <= 3 * size + 1e-9
        taken = sum(r["size"] * r["copies"] for r in rows if r["source"] == s)
        assert abs(taken - target) <= 0.15 * target
    assert max(r["copies"] for r in rows) <= 3
    assert [r["copies"] for r in mix(docs).orderBy("doc_id").collect()] == [r["copies"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_toxicity_held_out(spark, duck):
    """Held-out accuracy on the largest small table, and no input but the text."""
    d = "/root/testdata/sf0.1"
    rows = Q.op8_toxicity(spark, d).collect()
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.95
    toxic = [r for r in held if label[r["doc_id"]] == 1]
    assert len(toxic) > 50 and np.mean([r["predicted"] for r in toxic]) > 0.85
    clean = [r for r in held if label[r["doc_id"]] == 0]
    assert np.mean([r["predicted"] for r in clean]) < 0.01


def test_hnsw_recall_and_ties(spark, odd_dir):
    from strandplan.llm import hnsw

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rules = hnsw.HnswRules(shard_rows=700)
    vectors = hnsw.usable(table, "vec_id", "embedding")
    index, shards = hnsw.build_index(vectors, rules)
    assert shards > 1
    got = {}
    for r in hnsw.search(index, shards, vectors.where("vec_id % 20 = 0"), 20, rules).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))][:20]
        hits.append(len({v for v, _ in got[q].values()} & set(best.tolist())) / 20)
        assert all(abs(v - s[ids == i][0]) < 1e-12 for i, v in got[q].values())
    assert np.mean(hits) >= 0.9
    odd = [(r["query_id"], r["rank"], r["vec_id"]) for r in Q.op9_hnsw(spark, odd_dir).orderBy("query_id", "rank").collect()]
    assert odd == [(0, 1, 8), (0, 2, 9), (0, 3, 9), (0, 4, 20), (0, 5, 7), (0, 6, 9), (20, 1, 8), (20, 2, 0), (20, 3, 9), (20, 4, 9), (20, 5, 7), (20, 6, 9)]
    # Repeated rows of one id are queries each, and each other's candidates.
    rows = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, -0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    vectors = hnsw.usable(rows, "vec_id", "embedding")
    index, shards = hnsw.build_index(vectors)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in hnsw.search(index, shards, vectors.where("vec_id = 20")).collect())
    assert got == sorted(2 * [(1, 1, 1.0), (2, 20, 1.0), (3, 20, 0.0)] + [(1, 1, 2.0), (2, 20, 0.0), (3, 20, 0.0)])


def test_warc_framing_survives_payloads_that_look_like_records(spark, odd_dir):
    from strandplan.llm import warc
    from strandplan.plans.session import shared_path

    path = shared_path(spark, "test-warc")
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet")
    warc.write_archives(pages, path, archive_bytes=500)
    rows = warc.read_archives(spark, path).collect()
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert len(rows) == pages.count()
    for r in rows:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == want[r["page_id"]]
        else:
            assert want[r["refers_to"]] == want[r["page_id"]] and r["refers_to_id"]
            assert r["refers_to_id"] == next(x["record_id"] for x in rows if x["page_id"] == r["refers_to"])


def test_transport_stream_round_trip_and_faults(spark, odd_dir):
    for n in [*range(0, 400), 8128, 8192, 8193, 70_000]:
        payload, size = tsmedia.padded("z" * n)
        media = tsmedia.demux(tsmedia.mux(payload))
        assert media.payload == payload and size == n and media.gaps == 0 and media.bad_tables == 0
        assert media.stamps == sorted(media.stamps) and len(media.entries) == -(-len(media.stamps) // tsmedia.KEY_EVERY)
    stream = bytearray(tsmedia.mux(b"ab" * 5000))
    gap = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert tsmedia.demux(gap).gaps == 1
    stream[15] ^= 1
    assert tsmedia.demux(bytes(stream)).bad_tables == 1
    for r in Q.op10_transport_stream(spark, odd_dir).collect():
        raw = (ODD[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(tsmedia.mux(payload)).hexdigest()


def test_secrets_entropy_and_allow_list(spark):
    from strandplan.llm.secrets import find_secrets

    key = "q8Zr2LmX0vTn7KcW4yPd9sBh"
    rows = [(1, f"x {key} y"), (2, "an " + "abcdefghijklmnopqrstuvwxyz" * 2), (3, "id 123e4567-e89b-12d3-a456-426614174000 here"), (4, "EXAMPLE" + key), (5, "9" * 40), (6, f"{key} " * 600)]
    got = {r["doc_id"]: r["secrets"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["hit"]) for s in got[1]] == [("entropy", key)] and got[1][0]["s"] == 2
    assert [s["kind"] for i in (2, 3, 4, 5) for s in got[i]] == ["hex"]  # the forty nines, by the fixed pattern
    assert [s["s"] for s in got[6]] == [i * (len(key) + 1) for i in range(600)]


def test_null_ids_and_all_null_columns(spark, tmp_path):
    """Rows without an id, and columns that are null throughout, crash nothing and keep their rows."""
    d = str(tmp_path)
    text = "a line that others hold\nmine alone it is"
    rows = [(None, text, None, None, None), (None, None, None, None, None), (5, text, None, None, None), (6, text.upper(), None, None, None), (None, text, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(None, None, None), (5, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None, None), (None, "u", "x" * 200), (3, None, "x" * 200)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(None, None, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(None, None, None, None), (100, None, None, None), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(None, "mine alone"), (None, None), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # The root and the one turn of a conversation that is its own base; the four documents with words for the item without an id.
    number = {"op3_warc": 3, "op9_hnsw": 0, "op11_conversation_trie": 2, "op12_lexical_search": 4, "op13_url_filters": 3}
    for name, f in Q.queries().items():
        assert f(spark, d).count() == number.get(name, 5), name
    ranked = [(r["item_id"], r["rank"], r["doc_id"]) for r in Q.op12_lexical_search(spark, d).orderBy("rank").collect()]
    assert ranked == [(None, 1, 5), (None, 2, 6), (None, 3, None), (None, 4, None)]
    near = {(r["doc_id"], r["component_id"]) for r in Q.op5_simhash(spark, d).collect()}
    assert near == {(None, 5), (5, 5), (6, 5), (None, None)}
    dropped = {(r["doc_id"], r["n_dropped"]) for r in Q.op7_line_dedup(spark, d).collect()}
    assert dropped == {(5, 0), (6, 2), (None, 2), (None, 0)}
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in Q.op3_warc(spark, d).collect()}
    assert kinds == {(None, "response", None), (None, "revisit", 3), (3, "response", None)}
    import corpus_pipeline

    assert corpus_pipeline.run(spark, d).count() >= 1
