"""Carry all columns of a table through a text operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def with_column(docs: DataFrame, operator: Callable[[DataFrame, tuple[str, ...]], DataFrame], made: str, name: str, text: str = "text") -> DataFrame:
    """docs with the operator's column `made` under `name` (a free one) beside its own columns, whatever their names.

    The operator gets every column under a made-up name (and the text once more as `text`), so no
    name can clash, and rows are not joined: repeated rows stay apart.
    """
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    kept = tuple(plain.columns)
    out = operator(plain.withColumn("text", F.col(f"__c{names.index(text)}")), kept)
    return out.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(names)], F.col(made).alias(name))
