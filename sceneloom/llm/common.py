"""Helpers shared by the text operators.

Operators take any DataFrame that has the columns they name. Where whole rows are
returned, the row travels packed in one struct, so that further columns of any name
can't clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.session import ensure_checkpoint_dir

#: Bytes of text that a task vectorises at a time; a longer single text is taken alone.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and held in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A kept table of few narrow columns, to be broadcast if it has ``rows`` rows at most; beyond that joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def about(rows: int, of: int | Column, *key: Column) -> Column:
    """A condition that keeps some ``rows`` of ``of`` rows by the hash of their key, without any sorting or gathering."""
    whole = 1 << 40
    share = F.lit(float(whole) * rows) / F.greatest(of if isinstance(of, Column) else F.lit(of), F.lit(1))
    return F.pmod(F.xxhash64(*key), F.lit(whole)) < share


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """Each row as the struct ``_row``, beside the operator's own columns."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(e.alias(n) for n, e in own.items()))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def text_key(id_col: Column, text: Column) -> Column:
    """64 bits for a document; rows equal in id and text share it."""
    return F.xxhash64(id_col, F.coalesce(text, F.lit("")), text.isNull())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice has about SLICE_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1
        start = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one entry more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
