"""The registered queries of this subpackage: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, classifier, extraction, licenses, mixing, pieces, rules, sharding, similarity, topk, warc, whitening
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return views.select("conv_id", "perspective", "part", "n_turns", "rendered", spans.alias("loss_spans"), masked.alias("n_loss"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op4_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pieces.encode(_table(spark, sf_dir, "documents")))


def digest(encoded: DataFrame) -> DataFrame:
    """What identifies the segmentations of a text: pieces and their checksum, the score, and what the other paths lose and change."""
    others = F.array_join(F.transform("others", lambda o: F.concat((F.col("score") - o["score"]).cast("long").cast("string"), F.lit(":"), F.array_join(F.transform(o["changes"], lambda c: F.concat(c["at"].cast("string"), F.lit("="), F.array_join(c["ids"].cast("array<string>"), "+"))), "&"))), ",")
    return encoded.select("doc_id", "n_pieces", F.crc32("pieces").alias("pieces_crc32"), "score", (F.size("others") + 1).cast("long").alias("n_paths"), others.alias("other_paths"), "exact")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join(_table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(_table(spark, sf_dir, "documents"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = rules.fit(docs, _table(spark, sf_dir, "labels"))
    judged = rules.judge(docs, learned)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.inertias(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


def op13_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.inventory(warc.assemble(warc.read(spark, warc.archive(_table(spark, sf_dir, "pages")))))


QUERIES = {f.__name__: f for f in (op1_vector_shards, op2_perspectives, op3_main_text, op4_nbest_pieces, op5_fair_mix, op6_chosen_path_join, op7_license_diagonals, op8_attention_quality, op9_decision_list, op10_uniform_threshold, op11_jacobi_whitening, op12_va_clusters, op13_transactions)}
