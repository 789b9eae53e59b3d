"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def export(df: DataFrame) -> DataFrame:
    """Whole numbers leave as long, so that both engines agree on types."""
    narrow = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType))
    ]
    return df.withColumns({c: df[c].cast("long") for c in narrow}) if narrow else df
