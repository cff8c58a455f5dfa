"""Vectors of Arrow list columns as matrices, and tables that replace one another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import shared_dir


def matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the places of the vectors with ``width`` entries, all finite, and their entries as doubles."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    right = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (sizes == width))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    x = values[offsets[:-1][right][:, None] + np.arange(width)]
    fine = np.isfinite(x).all(axis=1)
    return right[fine], x[fine]


def listed(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def replaced(df: DataFrame, name: str, old: str | None = None) -> tuple[DataFrame, str]:
    """A table written to the shared folder and read again, and its path; the table at ``old``, which it was made of, goes."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    if old is not None:
        forget(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
