"""The thin ``opN_`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chosen_path, common, fill_middle, fingerprints, lpf_dedup, metric_join, mixing, oracles, packing, pieces, sentencepieces, token_counts, token_ids, toxicity, vector_codes, warc


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(common.table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(common.table(spark, sf_dir, "documents"), token_ids.public_tokenizer())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(documents, common.table(spark, sf_dir, "labels"))
    return toxicity.scores(documents, net).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.removal_report(common.table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), pieces.public_model())


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(common.table(spark, sf_dir, "documents"), pieces.public_model())


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similarity_classes(common.table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(common.table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), token_ids.public_tokenizer())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(common.table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_mixing": op2_mixing, "op3_warc": op3_warc, "op4_sentencepiece": op4_sentencepiece, "op5_ngram_jaccard_join": op5_ngram_jaccard_join, "op6_embedding_near_dedup": op6_embedding_near_dedup, "op7_toxicity": op7_toxicity, "op8_token_counts": op8_token_counts, "op9_suffix_array_dedup": op9_suffix_array_dedup, "op10_token_ids": op10_token_ids, "op11_fill_middle": op11_fill_middle, "op12_packing": op12_packing, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
