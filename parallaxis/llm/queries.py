"""The thin query of each numbered operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import SQL  # noqa: F401  the queries' SQL stands beside them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wordbpe

    path = tokenizer_file("word_bpe_49k.json")
    out = wordbpe.decode(wordbpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenstore

    out = tokenstore.read(tokenstore.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kdtree

    finite = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')), transform(embedding, x -> cast(floor(64 * cast(x as double)) as double)), null)").alias("vector"))
    return kdtree.top_k(finite, finite.where("vec_id % 20 = 0"), 20).withColumn("score", F.col("score").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    found = warc.read(warc.merge(warc.write(table(spark, sf_dir, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .runtime import held_out

    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .runtime import held_out

    docs, pieces = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    out = langid.predict(docs, pieces, *langid.train(docs, pieces))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .runtime import materialize

    docs = table(spark, sf_dir, "documents")
    decided = materialize(quality.decide(docs), "decided")
    texts = quality.rebuild(docs, decided).select("key", F.sha2("text", 256).alias("text_sha256")).dropDuplicates(["key"])
    return decided.join(texts, "key", "left").drop("key", "gone", "text_key")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.detect(table(spark, sf_dir, "documents"))
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked

    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piecebpe

    path = tokenizer_file("piece_bpe_32k.model")
    out = piecebpe.decode(piecebpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_language_id, op3_jaccard_join, op4_packing, op5_line_quality, op6_bpe_codec, op7_exact_top_k, op8_pii, op9_token_store, op10_warc, op11_lexical_search, op12_piece_codec, op13_importance_resampling)
}
