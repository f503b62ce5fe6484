"""Functions over Arrow batches as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rivulet.llm.workspace import materialize


def map_blocks(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow where per_batch yields dicts of columns (numpy, lists or Arrow). after is called at a partition's end: workers are used
    again, and what they hold would lie beside the memory of later stages."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        try:
            for batch in batches:
                for columns in per_batch(batch):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in fields)], schema=fields)
        finally:
            if after:
                after()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text, and row_key: equal for repeated rows only, there for rows whose doc_id is null or given twice."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), *columns)


def each_once(docs: DataFrame, path: str) -> DataFrame:
    """row_key and text of all rows; of rows given twice once. Only these pass an aggregate over texts."""
    rows = keyed(docs).select("row_key", "text")
    twice = materialize(rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), path)
    if twice.isEmpty():
        return rows
    return rows.join(twice, "row_key", "left_anti").unionByName(rows.join(twice, "row_key").dropDuplicates(["row_key"]))


def list_array(values: pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", kind)))
