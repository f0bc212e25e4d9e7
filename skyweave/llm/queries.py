"""The operators' queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, changepoints, langid, licenses, mixing, neardup, oracles, packing, pii, quotes, rules, shards, topk, veccodes
from .common import small_batches, stored


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_additive_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"))


def op2_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.reply_conversations(_table(spark, folder, "conversations"))


def op3_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    judged = rules.judge(docs, rules.fit_quality(docs, _table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    predicted = langid.predict_languages(docs.select("doc_id", "text"), langid.fit_languages(docs))
    with small_batches(spark):
        return stored(predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"), "languages")


def op5_efraimidis_spirakis(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_positional_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents")).drop("notices")


def _personal_data(spark: SparkSession, folder: str, kinds: tuple[pii.Kind, ...]) -> DataFrame:
    docs = pii.find_pii(_table(spark, folder, "documents").select("doc_id", "text"), kinds)
    names = [k.name for k in pii.BASE]
    base = F.filter("pii", lambda x: x["kind"].isin(names))
    counts = [F.size(F.array_remove(F.transform("pii", lambda x: x["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in names]
    top = F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0))
    return docs.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"), top.alias("top_score"))


def op7_checked_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _personal_data(spark, folder, pii.KINDS)


def op8_shortest_pack_first(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op10_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    out = shards.assign_shards(_table(spark, folder, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_change_points(spark: SparkSession, folder: str) -> DataFrame:
    kept = _table(spark, folder, "sale_lines").where("flag = 'kept'")
    return changepoints.change_points(kept, "vendor_id", "shipped_at", "quantity")


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.nearest_exact(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"))


def op13_filtering_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return veccodes.compressed(_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))


def base_quality(spark: SparkSession, folder: str) -> DataFrame:
    """What op3 counts before its learned rules."""
    stats = rules.judge(_table(spark, folder, "documents"), rules.DecisionList(()))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """What op6 finds before its index of notices."""
    return licenses.scan_licenses(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """What op7 finds without its own kinds."""
    return _personal_data(spark, folder, pii.BASE).drop("spans", "top_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_additive_quantisation, op2_quotation_linking, op3_decision_list, op4_language_id, op5_efraimidis_spirakis, op6_positional_licenses, op7_checked_spans, op8_shortest_pack_first, op9_jaccard_join, op10_rendezvous, op11_change_points, op12_exact_top_k, op13_filtering_lloyd)
    return {f.__name__: f for f in (*operators, base_quality, base_licenses, base_personal_data)}


def oracle_sql() -> dict[str, str]:
    """For nine operators, and for the columns of others that SQL can express. The rest is trained models, a tokenizer and patterns that look around: brute-force tests stand for them."""
    return oracles.oracle_sql()
