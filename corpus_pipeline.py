"""The training-corpus pipeline: quality classifier, near-duplicates, secrets, source mix, packing.

``STAGES`` are run in order, each on all that its predecessor kept; ``run``
writes each stage's result into the shared folder and reads it again, so that
a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import materialize, read_table
from locusframe.llm.mixing import mix
from locusframe.llm.near_dedup import near_duplicates, node_of
from locusframe.llm.packing import pack
from locusframe.llm.quality_classifier import quality_scores
from locusframe.llm.queries import PACKING, tokenizer_file
from locusframe.llm.secrets import redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3)."""
    scored = quality_scores(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"), threshold=0.3, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id (of rows that share it, one)."""
    docs = docs.select(*COLUMNS)
    classes = near_duplicates(docs, k=5, similarity=0.8)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("doc_id").alias("__id"), F.min("node").alias("__node"))
    kept = kept.select(F.coalesce("__id", F.lit(-1)).alias("__id"), "__node")
    # by id and text, so that copies of a text lie in many tasks
    rows = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-1)), "__node": node_of("text")}).join(kept, ["__id", "__node"])
    place = F.row_number().over(Window.partitionBy("__id", "__node").orderBy("lang", "source", "n_chars"))
    return rows.withColumn("__place", place).where("__place = 1").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    clean = redact(docs.select(*COLUMNS, F.col("text").alias("__before")))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    mixed = mix(docs, weights=(3, 1, 2), total=1.5, cap=2.0, keep=COLUMNS, narrow=False).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    packed = pack(docs, tokenizer_file("word_bpe_49k.json"), **PACKING)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, MinHash and tokenizer can't be expressed in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
