"""Semi-structured text as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import ref



def parse(text: Column, strict: bool = True) -> Column:
    """JSON text as VARIANT; bad text fails, or is null if not strict. SQL NULL and JSON null differ."""
    return F.parse_json(text) if strict else F.try_parse_json(text)


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean, null, or invalid."""
    shape = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(text.isNull(), None)
        .when(shape.isNull(), "invalid")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .otherwise("number")
    )


def is_object(text: Column) -> Column:
    """False for anything else, null included."""
    return F.coalesce(json_kind(text) == "object", F.lit(False))


def variant_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df`, refusing the first row that has SQL NULL in one of these columns, JSON null being a value."""
    from ..sources.readers import refusing

    for c in columns:
        df = refusing(df, ref(c).isNull(), F.concat(F.lit(f"null in the required column {c}: "), F.to_json(F.struct(*[ref(x) for x in df.columns if x not in columns]))))
    return df
