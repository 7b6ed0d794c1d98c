"""A bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows kept out of training: crc32 of the id's text modulo ``folds`` is 0."""
    return F.coalesce((F.crc32(F.col(key).cast("string").cast("binary")) % folds) == 0, F.lit(False))


def agreed_labels(labels: DataFrame, label: str = "quality", key: str = "doc_id", skip_held_out: bool = False) -> DataFrame:
    """All labelled ids (``__id``) with their 0/1 label (``label``); contradicting and null ones take no part."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if skip_held_out:
        known = known.where(~held_out(key))
    agreed = known.groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi")).where("__lo = __hi")
    return agreed.select("__id", F.col("__lo").cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, label: str = "quality", key: str = "doc_id", text: str = "text", skip_held_out: bool = False) -> DataFrame:
    """Texts (``text``) and 0/1 labels (``label``) of at most ``per_class`` documents of each class.

    The documents are those with the smallest hash of their id, so the sample
    is the same in each run.  Ids with contradicting labels, null ids and null
    labels take no part; of rows that share an id the least text is taken.
    """
    agreed = agreed_labels(labels, label, key, skip_held_out)
    order = [F.xxhash64("__id"), F.col("__id")]
    few = [agreed.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = few[0].unionByName(few[1])
    # at most 2 * per_class ids, whatever the size of the corpus
    hit = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(F.broadcast(chosen), "__id")
    return hit.groupBy("__id").agg(F.min("__t").alias("text"), F.min("label").alias("label")).select("text", "label")
