"""Unions of tables whose schemas differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref
from ..functions.types import widest


def by_name(inputs: list[DataFrame], renames: dict[str, str] | None = None, constants: list[dict] | None = None, order_column: str | None = None, first_type_wins: bool = False) -> DataFrame:
    """Union-all by name: types are promoted to the widest (or to the first's), missing columns are
    null, `constants` are added by input, and `order_column` numbers the inputs. A rename that collides
    is refused before anything is read."""
    renames = renames or {}
    made = []
    for i, df in enumerate(inputs):
        names = [renames.get(c, c) for c in df.columns]
        extra = (constants or [{}] * len(inputs))[i]
        if len(set(names)) < len(names) or set(extra) & set(names):
            raise ValueError(f"column names of input {i} collide: {names} and {list(extra)}")
        df = df.toDF(*names).withColumns({k: F.lit(v) for k, v in extra.items()})
        made.append(df.withColumn(order_column, F.lit(i)) if order_column else df)
    types: dict[str, T.DataType] = {}
    for df in made:
        for f in df.schema:
            if f.name not in types:
                types[f.name] = f.dataType
            elif not first_type_wins:
                types[f.name] = widest(types[f.name], f.dataType)
    shaped = [df.select(*[(ref(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()]) for df in made]
    return reduce(DataFrame.unionAll, shaped)
