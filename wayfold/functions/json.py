"""JSON columns to typed columns or rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_json(frame: DataFrame, column: str, schema: str, subset: Sequence[str] | None = None, unstack: bool = False) -> DataFrame:
    """Replace a JSON text column by its fields, or with ``unstack`` by one row for each non-null field.

    ``schema`` is the DDL of the document (``unstack`` reads it as one type for all fields, as
    in ``map<string, bigint>``).  Rows whose JSON is null or broken keep null fields.
    """
    if subset is not None and unstack:
        raise ValueError("subset cannot be given with unstack")
    rest = [c for c in frame.columns if c != column]
    parsed = frame.select(*rest, F.from_json(column, schema).alias("__json"))
    if unstack:
        return parsed.select(*rest, F.explode(F.map_entries("__json")).alias("e")).select(*rest, F.col("e.value").alias(column)).filter(F.col(column).isNotNull())
    names = subset if subset is not None else [f.name for f in parsed.schema["__json"].dataType.fields]
    return parsed.select(*rest, *[F.col("__json").getField(n).alias(n) for n in names])
