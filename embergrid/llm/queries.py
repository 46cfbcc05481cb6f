"""The registered queries: each applies its operator to whole tables and derives the result's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, jaccard, langid, lexical, packing, pieces, quality, sharding, token_files, warc, whitening
from .common import stage_path, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), decontaminate.items_sha256().alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), special=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder(4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = stage_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), target)
    return warc.read_index(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the stored map of 40 shards. Then the map is edited for one shard more, stored as version 2 and read back: next_shard and moved say what that edit moves."""
    docs = table(spark, sf_dir, "documents")
    path = stage_path(spark, "slots")
    loads = sharding.slot_bytes(docs)
    first = sharding.first_map(loads, 40)
    sharding.save_map(spark, first, path, 1)
    sharding.save_map(spark, sharding.grow(first, loads, 40), path, 2)
    rows = sharding.assign_by(docs, path, 1).join(F.broadcast(sharding.edited(spark, path, 2)), "virtual_slot")  # one row a slot
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "next_shard", (F.col("shard") != F.col("next_shard")).alias("moved"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(chat.planted(spark))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.remainder(3) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = stage_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), target, special=True)
    return token_files.digests(spark, target)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whitening.report(vectors, whitening.fit(vectors))
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_language_id, op4_warc, op5_jaccard_join, op6_sharding, op7_chat_formatting, op8_quality, op9_token_files, op10_exact_dedup, op11_embedding_whitening, op12_lexical_search, op13_sentencepiece)}
