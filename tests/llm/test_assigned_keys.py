"""Keys directly after an equals sign, the usual form of a credential of two parts."""

from __future__ import annotations

import pytest

from locusframe.llm import secrets

ACCESS, KEY = "AKIA" + "B" * 16, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
TEXT = f"AWS_ACCESS_KEY_ID={ACCESS}\nAWS_SECRET_ACCESS_KEY={KEY}\n"


@pytest.mark.parametrize("text,kinds", [(TEXT, ["access", "key"]), (f"{ACCESS} k={KEY}", ["access", "key"]), (f"{ACCESS} k={KEY}=", ["access"]), (f"{ACCESS} k=x{KEY}", ["access"]), (f"k={KEY}", [])])
def test_linked(spark, text, kinds):
    (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [secrets.KINDS[s.rank] for s in row.spans] == kinds


def test_redacted(spark):
    (row,) = secrets.redact(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).collect()
    assert row.text == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]\n"


def test_oracle_agrees(spark, tmp_path):
    """The SQL takes the same spans where keys follow or precede an equals sign."""
    import duckdb

    texts = [TEXT, f"{ACCESS} k={KEY}", f"{ACCESS} k={KEY}=", f"{ACCESS} k=={KEY} x", f"{ACCESS} {KEY}={KEY}", f"{ACCESS} k=x{KEY}", f"k={KEY}", f"user=abc k={KEY}+/", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"{tmp_path}/documents.parquet"
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    theirs = dict(con.execute(f"select doc_id, spans from ({secrets.oracle()})").fetchall())
    mine = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).select("doc_id", secrets.digest("spans").alias("spans")).collect()}
    assert mine == theirs
