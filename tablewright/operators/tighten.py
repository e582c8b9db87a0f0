"""Data-driven types: one pass that plans, then casts that fail rather than lose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref
from ..functions.types import STORED, narrowest

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def bounds(df: DataFrame) -> dict[str, dict]:
    """What planning needs of each column, in one aggregation: bounds of whole numbers, bounds of list
    lengths, and whether all bytes are UTF-8."""
    asked = []
    for i, f in enumerate(df.schema):
        c = ref(f.name)
        if isinstance(f.dataType, _WHOLE):
            asked += [F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}")]
        elif isinstance(f.dataType, T.ArrayType):
            n = F.when(c.isNotNull(), F.size(c))
            asked += [F.min(n).alias(f"low{i}"), F.max(n).alias(f"high{i}")]
        elif isinstance(f.dataType, T.BinaryType):
            asked += [F.coalesce(F.bool_and(F.is_valid_utf8(c.cast("string"))), F.lit(False)).alias(f"text{i}")]
    row = df.agg(*asked).first().asDict() if asked else {}
    return {f.name: {k: row[f"{k}{i}"] for k in ("low", "high", "text") if f"{k}{i}" in row} for i, f in enumerate(df.schema)}


def plan(df: DataFrame) -> list[tuple[str, str]]:
    """(column, label): narrowest whole number, string for UTF-8 bytes, fixed_size_list[n] where all
    lists have n > 0 elements. Columns without values keep their declared type."""
    found = []
    for f, b in zip(df.schema, bounds(df).values(), strict=True):
        if isinstance(f.dataType, _WHOLE) and b["low"] is not None:
            found.append((f.name, narrowest(b["low"], b["high"])))
        elif isinstance(f.dataType, T.ArrayType) and b["low"] is not None and b["low"] == b["high"] > 0:
            found.append((f.name, f"fixed_size_list[{b['low']}]"))
        elif isinstance(f.dataType, T.BinaryType) and b["text"]:
            found.append((f.name, "string"))
    return found


def tighten(df: DataFrame) -> DataFrame:
    """`df` under its plan; the label stands in the column's metadata, as unsigned types are stored wider."""
    todo, made = dict(plan(df)), []
    for f in df.schema:
        c, to = ref(f.name), todo.get(f.name)
        if to in STORED:
            c = c.cast(STORED[to]).alias(f.name, metadata={"label": to})
        elif to == "string":
            c = c.cast("string").alias(f.name)
        elif to:
            c = c.alias(f.name, metadata={"fixed_size": int(to[16:-1])})
        made.append(c)
    return df.select(*made)


def text_types(df: DataFrame) -> dict[str, str]:
    """For columns of text: bigint, double or string, whichever all values can be, in one pass."""
    asked = [F.bool_and(ref(c).try_cast(t).isNotNull() | ref(c).isNull()).alias(f"{t}{i}") for i, c in enumerate(df.columns) for t in ("bigint", "double")]
    row = df.agg(*asked).first()
    return {c: next((t for t in ("bigint", "double") if row[f"{t}{i}"]), "string") for i, c in enumerate(df.columns)}
