"""Canonical JSON, its hash, and keys over chosen fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _sorted(value: Column, kind: DataType) -> Column:
    """The value with the fields of structs and the keys of maps in order, at any depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON text of some columns of df, fields and keys sorted; null fields are written as null, so that
    equal contents have equal texts whatever the order of their fields."""
    whole = F.struct(*[_sorted(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)])
    return F.to_json(whole, {"ignoreNullFields": "false"})


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON, as lower-case hex."""
    return F.sha2(canonical_json(df, columns), 256)
