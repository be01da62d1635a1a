"""Cutting lineage through Parquet in the cluster's shared folder, and running numpy code over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.session import shared_folder


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package where it lies, besides what the cluster gives them."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, _ROOT) if x)
    return spark


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the folder named by `spark.checkpoint.dir` and read from there."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_of(schema: str) -> pa.Schema:
    """Arrow fields of a short Spark schema such as 'a long, b int, c binary'."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def over_batches(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]) -> DataFrame:
    """`work` on the Arrow batches of every partition; it yields lists of columns in the order of `schema`."""
    def run(batches):
        fields = table_of(schema)
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)],
                                             schema=fields)
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit words as Spark's longs."""
    return x.view(np.int64)


def key_of(word: int) -> int:
    return int(np.uint64(word).view(np.int64))


def whole_groups(batches, size: int = 1 << 21) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by its first column, in pieces that end where a group of equal values does."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        n += batch.num_rows
        if n >= size:
            columns = [np.concatenate(c) for c in zip(*held)]
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                yield [c[:end] for c in columns]
            held, n = [[c[end:] for c in columns]], n - end
    if n:
        yield [np.concatenate(c) for c in zip(*held)]
