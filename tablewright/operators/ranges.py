"""Joins by order rather than equality: as-of, and points in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ref


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """`left` with `columns` of the last row of `right` at or before it, of the same `by`; nulls where there
    is none. One shuffle by the keys: both sides in one window. Ties on the right: the largest values win,
    column by column in their order; rows without a key or a time find nothing."""
    seen = F.struct(*[ref(c).alias(c) for c in columns])
    keys = [f"__k{i}" for i in range(len(by))]
    names = left.columns
    own = left.select(*[ref(c).alias(k) for c, k in zip(by, keys, strict=True)], ref(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(seen).schema[0].dataType).alias("__seen"), F.struct(*[ref(c) for c in names]).alias("__row"))
    other = right.select(*[ref(c).alias(k) for c, k in zip(by, keys, strict=True)], ref(right_on).alias("__t"), F.lit(0).alias("__side"), seen.alias("__seen"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"))
    other = other.where(" and ".join(["__t is not null", *[f"{k} is not null" for k in keys]]))
    before = Window.partitionBy(*keys).orderBy("__t", "__side", "__seen").rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionAll(other).withColumn("__found", F.last("__seen", True).over(before)).where("__side = 1")
    return met.select("__row.*", *[F.col("__found")[c].alias(c) for c in columns])


def in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """Each row of `points` with each row of `intervals` that has start <= point < end (numbers). An
    interval goes to the cells of the level (a power of two) that is no shorter than it, two at most; a
    point to its cell of every level there is, at most a few dozen. So the join is one of equal cells,
    however long single intervals are. Column names must differ; rows with nulls find nothing."""
    length = ref(end) - ref(start)
    level = F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(1.0)))).cast("int")
    cell = lambda x, k: F.floor(x.cast("double") / F.pow(F.lit(2.0), k))
    left = intervals.where(length > 0).withColumn("__level", level)
    left = left.withColumn("__cell", F.explode(F.sequence(cell(ref(start), F.col("__level")), cell(ref(end), F.col("__level")))))
    levels = [r[0] for r in left.select("__level").distinct().collect()]  # one for each power of two at most
    right = points.where(ref(point).isNotNull()).withColumn("__l", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]) if levels else F.array().cast("array<int>")))
    right = right.withColumn("__c", cell(ref(point), F.col("__l")))
    met = (F.col("__l") == F.col("__level")) & (F.col("__c") == F.col("__cell")) & (ref(point) >= ref(start)) & (ref(point) < ref(end))
    return right.join(left, met).drop("__l", "__c", "__level", "__cell")
