"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import mixing, near_dedup, secrets, warc
from locusframe.llm.common import read_table


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie; they are a parameter of the operators and not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A document's first id has no id before it to be predicted from, so it bears no loss; of a sequence of 2048 ids 2047 are
#: predicted, so a sequence takes as many loss-bearing ids at most. That binds where a long document's inner ids fill one.
PACKING = {"capacity": 2048, "max_segments": 256, "max_loss": 2047, "loss_from": 1}


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.quality_classifier import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.packing import pack

    packed = pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), **PACKING)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.warc import round_trip

    return round_trip(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.html_extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.vector_search import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), k=5, similarity=0.8, weighted=True).select("doc_id", "class_id", "class_size", "text_class")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, cap=2.0).drop("copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.secrets import count_of, digest, scan_secrets

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_vector_search": op6_vector_search,
    "op7_near_dedup": op7_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_secrets": op10_secrets,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op8_mixing": mixing.oracle(),
    "op10_secrets": secrets.oracle(),
}
