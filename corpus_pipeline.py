"""Five stages from raw documents to token ids, each by an operator of tidemark.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import credentials, langid, mixing, pieces, simhash
from tidemark.llm.common import drop_saved, free_name, saved_at, saved_paths

#: A document goes if no language has so large a share of its words.
MIN_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and one language for at least half of its words; lang becomes that language."""
    columns, pred, score = docs.columns, free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.identify(docs, docs.filter(~langid.held_out()), keep=columns)
    return found.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_SHARE)).withColumn("lang", F.col(pred)).select(*[F.col(f"`{c}`") for c in columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; n_chars follows."""
    return credentials.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the number and digests of each text's ids and of the text decoded from them."""
    return pieces.digests(docs, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express language identification, fingerprints or merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again.

    When a stage is written, the one before it and what it saved on its way are deleted. The last stage reads what is left
    when its rows are asked for; common.drop_saved() deletes that.
    """
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), saved_paths(spark)
    for name, stage in STAGES[:-1]:
        docs, path = saved_at(stage(spark, docs, sf_dir), name)
        drop_saved(spark, but=[*others, path])
    return STAGES[-1][1](spark, docs, sf_dir)
