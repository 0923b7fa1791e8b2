"""The contract's queries: each reads its whole table, applies one operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.llm import bpe, convtrie, hnsw, lexical, licenses, linededup, mixing, secrets, simhash, toxicity, tsmedia, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_secrets(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_licenses(licenses.find_licenses(_table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return bpe.encode_texts(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(toxicity.in_training(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hnsw.written(hnsw.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "hnsw-rows")
    index, shards = hnsw.build_index(vectors)
    return hnsw.search(index, shards, vectors.where(F.col("vec_id") % 20 == 0))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tsmedia.media_features(tsmedia.text_media(_table(spark, sf_dir, "documents")))
    return read.withColumnRenamed("id", "doc_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(urls.url_scores(_table(spark, sf_dir, "pages"))).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict:
    """Query functions by name."""
    return {f.__name__: f for f in (op1_secrets, op2_licenses, op3_warc, op4_bpe, op5_simhash, op6_mixing, op7_line_dedup, op8_toxicity, op9_hnsw, op10_transport_stream, op11_conversation_trie, op12_lexical_search, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {"op1_secrets": secrets.op1_sql(), "op3_warc": warc.op3_sql(), "op6_mixing": mixing.op6_sql(), "op7_line_dedup": linededup.op7_sql(), "op11_conversation_trie": convtrie.op11_sql(), "op12_lexical_search": lexical.op12_sql()}
