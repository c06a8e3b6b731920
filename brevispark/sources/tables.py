"""Sources: named tables of a folder, and validated feature/target frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers and booleans are numeric."""
    return isinstance(df.schema[column].dataType, (NumericType, BooleanType))


#: Numbers in text: signs, fractions and exponents; anything else is null.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    if isinstance(kind, BooleanType):
        return F.col(column).cast("int").cast("double")
    if isinstance(kind, StringType):
        return F.when(F.col(column).rlike(NUMBER), F.trim(column).try_cast("double"))
    return F.col(column).cast("double")


def check_columns(df: DataFrame, columns: Sequence[str], numeric: Sequence[bool]) -> None:
    """Column names exist, flags match, and no cell type is nested."""
    if not columns:
        raise ValueError("at least one column is needed")
    if len(columns) != len(numeric):
        raise ValueError("one numeric flag for each column is needed")
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"no column named {c}")
        if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)):
            raise TypeError(f"column {c} is nested")


def infer_target_numeric(df: DataFrame, target: str) -> bool:
    """A float column with any fractional value is numeric; all else is categorical, integral floats included."""
    kind = df.schema[target].dataType.typeName()
    if kind not in ("float", "double", "decimal"):
        return False
    return bool(df.agg(F.max(F.col(target) != F.floor(target))).first()[0])


def resolve_numeric(df: DataFrame, features: Sequence[str], kind: str) -> list[bool]:
    if kind not in ("auto", "numeric", "categorical"):
        raise ValueError("a type is auto, numeric or categorical")
    return [is_numeric(df, c) if kind == "auto" else kind == "numeric" for c in features]


def resolve_target(df: DataFrame, target: str, kind: str) -> bool:
    if kind not in ("auto", "numeric", "categorical"):
        raise ValueError("a type is auto, numeric or categorical")
    return infer_target_numeric(df, target) if kind == "auto" else kind == "numeric"
