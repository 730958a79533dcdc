"""Python over Arrow batches with a declared result schema, for the few steps that built-in expressions can't state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

try:
    from pyspark.sql.pandas.types import to_arrow_schema
except ImportError:  # pragma: no cover
    to_arrow_schema = None


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``df`` through a function from columns to columns (lists by name), batch by batch, without a shuffle.

    ``make`` runs once per task and returns the function, so it can build what the task's batches share.
    Lists are converted to the declared types; None is null whatever the type.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
