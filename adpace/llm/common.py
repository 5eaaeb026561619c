"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ``[\x20\x09-\x0D]``: the white space of every contract here, as bytes.split() and strip() take it.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that are Python values at one time.
PART = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: StructType | str
) -> DataFrame:
    """Apply a function on columns of Python values to each Arrow batch.

    ``make`` runs once per task and returns the function, so compiled patterns
    and tables are set up there. Text columns arrive as UTF-8 bytes; a column
    may be returned as an Arrow array. A batch is taken in parts of about ``PART``
    bytes: Python values are many times larger than Arrow's, and a batch is bounded
    in rows only.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in (part for whole in batches for part in batch_parts(whole)):
            columns = {
                name: _values(batch.column(i)) for i, name in enumerate(batch.schema.names)
            }
            made = apply(columns)
            arrays = [
                x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type, from_pandas=False)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def batch_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in parts of at most ``PART`` bytes or one row."""
    if batch.nbytes <= PART or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from batch_parts(batch.slice(0, half))
    yield from batch_parts(batch.slice(half))


#: The former name.
_parts = batch_parts


def _values(column: pa.Array) -> list:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.values.null_count:
        # Row by row through NumPy, which is many times faster than value by value.
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        rows = [values[a:b].tolist() for a, b in zip(at, at[1:])]
        return [x if valid else None for x, valid in zip(rows, column.is_valid().to_pylist())]
    return column.to_pylist()
