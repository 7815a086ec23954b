"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import checkpoint_dir as use_checkpoint_dir, cut, small  # noqa: F401

#: An Arrow batch is handed on in slices of about this many bytes of text, so that one batch of very long texts stays small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def unit_hash(col: Column, salt: str) -> Column:
    """A repeatable number in [0, 1) from a column's text; null counts as an empty text."""
    text = F.concat(F.lit(salt + ":"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it unlike every column's, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows that hold about SLICE_BYTES of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(text)
        lengths = np.ones(batch.num_rows, np.int64)
        if at >= 0:
            lengths += np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
        group = np.cumsum(lengths) // SLICE_BYTES
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply a batch function to one text column and return the kept columns with what it makes.

    make() runs once a task and returns the function; that takes a list of texts (None for null)
    and returns columns by the names of schema (a DDL string without the kept columns).
    """
    kept = [f"{'`' + c + '`'} {df.schema[c].dataType.simpleString()}" for c in keep]
    ddl = ", ".join([*kept, schema])
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema).names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        work = None
        for part in slices(batches, "__text"):
            work = work or make()
            made = work(part.column(part.schema.get_field_index("__text")).to_pylist())
            columns = [part.column(i) for i in range(len(kept))]
            for i, name in enumerate(want):
                column = made[name]
                kind = arrow.field(len(kept) + i).type
                columns.append(column if isinstance(column, pa.Array) else pa.array(column, type=kind))
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns)], names=arrow.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, ddl)


def bounded_sample(df: DataFrame, key: str, bound: int, salt: str, by: list[str] | None = None) -> DataFrame:
    """About `bound` rows of df (of each class in `by`), picked by a hash of the key; all rows where there are fewer.

    The counts come from one aggregation of key columns only. Rows with a null class are left out.
    """
    by = by or []
    u = unit_hash(F.col(key), salt)
    if not by:
        rows = df.count()
        return df.filter(u < bound / max(rows, 1))
    known = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in by))
    rate = free_name(df.columns, "rate")
    rates = cut(known.groupBy(*by).agg((F.lit(float(bound)) / F.count(F.lit(1))).alias(rate)))
    return known.join(small(rates), by).filter(u < F.col(rate)).drop(rate).select(df.columns)
