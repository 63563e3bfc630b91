"""Expressions generated from a schema: trimming and defaults for nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom.functions.text import strip


def tidy(value: Column, dtype: T.DataType) -> Column:
    """The value with every string trimmed and absent lists and maps made empty."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[tidy(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: tidy(item, dtype.elementType))
        return F.coalesce(items, F.array().cast(dtype))
    if isinstance(dtype, T.MapType):
        values = F.transform_values(value, lambda _, v: tidy(v, dtype.valueType))
        return F.coalesce(values, F.create_map().cast(dtype))
    return strip(value) if isinstance(dtype, T.StringType) else value
