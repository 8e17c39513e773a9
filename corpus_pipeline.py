"""From raw documents to token ids: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelag.llm import digest_index, golay_simhash, letter_vectors, piece_lattice, soft_mixing
from tidelag.llm.shared import tokenizer_file
from tidelag.staging import shared_folder, shuffles_cleaned


EPOCHS = 1.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter go."""
    return letter_vectors.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return digest_index.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of 3-word shingles that differ
    in 3 or fewer bits, as in op 7."""
    return golay_simhash.keep_one(docs, golay_simhash.MOST, golay_simhash.SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for. More tokens than there are, so that
    domains are evened out by repeating the wanted ones, not by cutting clean documents."""
    labels = soft_mixing.domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return soft_mixing.resample(docs, labels, soft_mixing.TARGETS, EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of every row."""
    return piece_lattice.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode),
]

#: SQL expresses neither the language profiles nor the fitted rates nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with shuffles_cleaned(spark):
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
