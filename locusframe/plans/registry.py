"""Registered queries of the genotype operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.plans.adapter import genotypes, with_cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Register a function of the adapter's genotype set as a query; ``sql`` is over its tables."""

    def add(fn: Callable[[GenotypeSet], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(genotypes(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_cube(sql)
        return fn

    return add


def register_raw(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir)."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def places(c: Column | str, digits: int) -> Column:
    """``c`` rounded as the SQL's engine does it: the product with 10 ** digits is rounded and divided again.

    Spark's own rounds the shortest decimal that stands for the number, which
    is another value where the product isn't that decimal's (0.0653125).
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale
