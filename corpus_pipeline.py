"""A training corpus from raw documents, stage by stage.

    python corpus_pipeline.py <folder of the tables> <output folder>

Toxic documents go, one document of each SimHash class stays, personal data gets
surrogates, the sources are laid out in the order of their weights,
and all documents are packed into sequences.
"""

from __future__ import annotations

import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import mixing, packing, pii, simhash, toxicity
from caseloom.llm.common import free_name, table
from caseloom.session import build_session, materialize, release

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learned from the labels that are not held out, whose texts are in the raw table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class that fingerprints of three-word shingles link at three bits."""
    return simhash.keep_one(docs)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data; ``n_chars`` follows the text."""
    return pii.with_surrogates(docs, length="n_chars")


def mixed_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mixture, by the default weights of the sources."""
    return mixing.mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids, numbered in the order of the mixture.

    Files reread come in no order, so each document's place in the mixture is found again.
    """
    position = free_name(docs, "_mix_position")
    return packing.pack(mixing.placed(docs, position=position), TOKENIZER, order=position)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_dedup", one_of_near_copies),
    ("surrogates", with_surrogates),
    ("mixing", mixed_by_weight),
    ("packing", packed),
]

# The stages train, hash and schedule; no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each on the whole result of the one before, written between them."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs


if __name__ == "__main__":
    session = build_session("corpus pipeline")
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
    release(session)
