"""A training corpus from `documents`: language, quality, near-duplicates, personal data, packing.

Every stage works on all that its predecessor kept and returns the columns of `documents`, the last one the packed
pieces. Between stages the documents are written as Parquet and read again.

Rows, in every stage: columns beside those of `documents` are left out, missing ones are null. A null text has neither a
letter nor a word, so it goes in the first two stages; by itself it is no near-duplicate, has no personal data and packs to
the closing id. Null or repeated doc_ids stay what they are: each row is decided by itself, and of repeated rows, which are
near-duplicates, one stays. Ties among near-duplicates go to the smallest id, then to any one row. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm import jaccard, langid, packing, pii, quality
from parallaxis.llm.queries import tokenizer_file
from parallaxis.llm.runtime import columns_or_null, materialize, maybe_broadcast

KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = tuple(KINDS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, so without a language, go. The languages are learned from the labelled documents; where
    none is labelled, whether a text has a letter still decides."""
    docs = columns_or_null(docs, **KINDS)
    pieces = tokenizer_file("piece_bpe_32k.model")
    langs, logp = langid.train(docs, pieces)
    if not langs:
        return docs.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    named = langid.predict(docs, pieces, langs, logp, keep=COLUMNS[1:])
    return named.where(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or keep too few of their words once their host's common lines are taken out, go;
    the others lose those lines, and the character count follows the text."""
    return quality.clean(columns_or_null(docs, **KINDS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, one without an id only where none has one.
    Rows are told apart by a key of their own, so ids may be null or repeated."""
    keyed = materialize(columns_or_null(docs, **KINDS).withColumn("row", F.monotonically_increasing_id()), "keyed")
    found = materialize(jaccard.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "components")
    several = found.where("row <> component_id").select("component_id").distinct()
    grouped = materialize(found.join(several, "component_id").join(keyed.select("row", "doc_id"), "row"), "grouped")
    stay = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    copies = materialize(grouped.select("row").join(stay, "row", "left_anti"), "copies")
    return keyed.join(maybe_broadcast(copies), "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; the character count follows the text."""
    clean = pii.redact(pii.detect(columns_or_null(docs, **KINDS), keep=COLUMNS[1:]))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row per piece with its ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]
#: Tokenizers and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
