"""The corpus pipeline: five stages over ``documents``.

Each stage takes all rows that the one before it kept and returns the columns of
``documents``, but for the last, which returns piece ids.

Defined cases, by stage: a null or empty text counts as empty, gets the
network's base score, is near to nothing, repeats nothing, has no words and so
is never drawn by the mix; equal rows and ties go as the operators state; an
empty table stays empty; extra columns, whatever their names, are carried up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chosen_path, common, lpf_dedup, mixing, pieces, sentencepieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels, does not call toxic."""
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a shingle similarity of 0.8 or more."""
    return chosen_path.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start earlier in the corpus too; the first copy stays, and so does every document."""
    return lpf_dedup.without_later_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as drawn, shard by shard in random order."""
    return mixing.shuffled(mixing.mixed_documents(docs)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the scores of its best segmentations and what they change in those ids."""
    return sentencepieces.encode(docs, pieces.public_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: No SQL states a trained network or sampled draws; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept; what a stage wrote on its way goes when it ends."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch(spark):
            docs = common.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
