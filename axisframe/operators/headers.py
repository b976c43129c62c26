"""Algebra on keyed sets of loci: a set is a DataFrame, its header the key columns present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.schema import HEADER, header_of


def mutate_header(df: DataFrame, **parts: str | None) -> DataFrame:
    """Replace key parts by constants; None drops the part."""
    unknown = set(parts) - set(HEADER)
    if unknown:
        raise ValueError(f"no header parts: {sorted(unknown)}")
    kept = df.drop(*(k for k, v in parts.items() if v is None))
    return kept.withColumns({k: F.lit(v) for k, v in parts.items() if v is not None})


def drop_field(df: DataFrame, *fields: str) -> DataFrame:
    return df.drop(*fields)


def add_field(df: DataFrame, **kinds: str) -> DataFrame:
    """Add zero-initialised columns, name=type."""
    zero = lambda kind: F.lit(0).cast(kind) if kind != "string" else F.lit("")
    return df.withColumns({n: zero(k) for n, k in kinds.items()})


def append(x: DataFrame, y: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of both; ``strict`` refuses keys that occur in both, and always their columns must agree."""
    if sorted(x.dtypes) != sorted(y.dtypes):
        raise ValueError("sets of loci differ in their columns")
    by = header_of(x)
    if strict and x.select(*by).join(y.select(*by), by, "left_semi").limit(1).count():
        raise ValueError("duplicate headers")
    return x.unionByName(y)


def headers(df: DataFrame) -> DataFrame:
    return df.select(*header_of(df)).distinct()


def loci_of(df: DataFrame, **key: str) -> DataFrame:
    """The loci of one key."""
    for part, value in key.items():
        df = df.where(F.col(part) == value)
    return df


def header_schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema[h] for h in header_of(df)])


def loci_schema(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in HEADER])


def join_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    clash = set(a.names) & set(b.names)
    if clash:
        raise ValueError(f"fields in both: {sorted(clash)}")
    return T.StructType(a.fields + b.fields)


def same_loci(x: DataFrame, y: DataFrame) -> bool:
    """Equal sets of rows, each as often."""
    if sorted(x.dtypes) != sorted(y.dtypes):
        return False
    y = y.select(*x.columns)
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()


def map_groups(df: DataFrame, f: Callable, schema: T.StructType | str, by: list[str] | None = None) -> DataFrame:
    """Apply a function of an Arrow table to the loci of each key; every key's loci must fit in a task."""
    return df.groupBy(*(by or header_of(df))).applyInArrow(f, schema)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to flat columns, names joined."""

    def leaves(column: Column, field: T.StructField, name: str) -> list[Column]:
        if isinstance(field.dataType, T.StructType):
            return [c for f in field.dataType.fields for c in leaves(column[f.name], f, f"{name}{sep}{f.name}")]
        return [column.alias(name)]

    return df.select(*(c for f in df.schema.fields for c in leaves(F.col(f"`{f.name}`"), f, f.name)))


def output_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*(c for c in ("reference", "start", "stop", "category", "strand") if c in df.columns))
