"""Input, shared-folder tables and Arrow batches for the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.session import prepare, shared_folder, shuffles_dropped

#: Text bytes that a task works on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/documents.parquet")


def session(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch, so that batches of long texts stay small."""
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def written(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends here, and the shuffles that made them are deleted.

    Each call writes a folder of its own, so that a retried job never meets old files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists").option("compression", codec)
    if partition_by:
        out = out.partitionBy(partition_by)
    with shuffles_dropped(spark):
        out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filled(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if not len(texts) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def runs(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts, null ones as empty, in runs of about ``most`` bytes."""
    texts = filled(texts)
    _, at = raw(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield texts.slice(row, end - row)
        row = end


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with about ``most`` bytes of text, each with its null-free text column."""
    for batch in batches:
        row = 0
        for texts in runs(batch.column(batch.schema.get_field_index(text)), most):
            yield batch.slice(row, len(texts)), texts
            row += len(texts)


def packed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of ``values``, of the given lengths, as a list column."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))
