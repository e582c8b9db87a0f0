"""Column profiles of a whole table in three jobs, however many columns it has.

Job A is one aggregation: counts, bounds, means, approximate distinct counts, lengths. Job B counts
equal-width buckets of every column with two or more values, job C the values of string columns with
few distinct ones, as one small struct for each column and row. All count with partial aggregation, so
that what is shuffled is a few rows for each column and task.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref
from ..functions.types import kind, label

#: Buckets of a histogram, values listed, and distinct values beyond which none are.
BUCKETS, TOP, MOST_DISTINCT = 10, 5, 256
#: Columns whose histograms are one aggregation; more would be too much code for one compiled method.
GROUP = 8

SCHEMA = (
    "column string, dtype string, rows long, null_count long, min string, max string, mean double, ndv_approx long, mean_length double, length_min long, length_max long, "
    "length_mean double, true_count long, false_count long, edges array<string>, counts array<long>, not_finite long, top_values array<struct<value:string,count:long>>"
)


def _length(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.char_length(c)
    if isinstance(t, T.BinaryType):
        return F.octet_length(c)
    return F.when(c.isNotNull(), F.size(c))


def _millis(c: Column, t: T.DataType) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def _finite(c: Column, t: T.DataType) -> Column:
    """A number as double; NaN and infinities as null, as they have no bucket."""
    d = c.cast("double")
    if not isinstance(t, (T.FloatType, T.DoubleType)):
        return d
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _distinct(c: Column, rsd: float) -> Column:
    """An estimate of the distinct values, with this relative standard error at most, by a sketch of
    their hashes, which is one value of the aggregation's row, however small the error."""
    size = max(4, ceil(2 * log2(1.04 / rsd)))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), size)), F.lit(0))


def summary(df: DataFrame, rsd: float = 0.02) -> dict:
    """Job A: {"rows": n, what and place of column: value}."""
    asked = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        c, k = ref(f.name), kind(f.dataType)
        add = lambda what, e, i=i: asked.append(e.alias(f"{what}{i}"))
        add("n", F.count(c))
        if k == "numeric":
            x = _finite(c, f.dataType)
            for what, e in (("low", F.min(x)), ("high", F.max(x)), ("mean", F.avg(x)), ("finite", F.count(x)), ("ndv", _distinct(c, rsd))):
                add(what, e)
            if isinstance(f.dataType, (T.IntegralType, T.DecimalType)):  # exact bounds, beyond what a double holds
                add("min", F.min(c).cast("string"))
                add("max", F.max(c).cast("string"))
        elif k == "temporal":
            x = _millis(c, f.dataType)
            for what, e in (("low", F.min(x)), ("high", F.max(x)), ("ndv", _distinct(c, rsd))):
                add(what, e)
        elif k == "bool":
            add("yes", F.count_if(c))
            add("no", F.count_if(~c))
        elif k in ("string", "binary"):
            add("length", F.avg(_length(c, f.dataType)))
            add("ndv", _distinct(c, rsd))
        elif k in ("list", "map"):
            n = _length(c, f.dataType)
            for what, e in (("least", F.min(n)), ("most", F.max(n)), ("length", F.avg(n))):
                add(what, e)
    return df.agg(*asked).first().asDict()


def bucket(x: Column, low: float, high: float, buckets: int = BUCKETS) -> Column:
    """1 to `buckets`, null for null; the largest value is in the last."""
    return F.when(x == high, buckets).when(x.isNotNull(), F.least(F.floor((x - low) / (high - low) * buckets) + 1, F.lit(buckets))).cast("int")


def _counted(df: DataFrame, cells: list[Column], value: str) -> DataFrame:
    """(i, value, n) over an array of struct<i, value> built from each row."""
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where(F.col(value).isNotNull())
    return rows.groupBy("i", value).agg(F.count("*").alias("n"))


def histograms(df: DataFrame, found: dict) -> dict[int, list[int]]:
    """Job B. A column of one value has no cells; the caller knows its count. Cells are counted without
    making rows of them; each group of GROUP columns is one aggregation over these columns alone."""
    asked = []
    for i, f in enumerate(df.schema):
        low, high = found.get(f"low{i}"), found.get(f"high{i}")
        if low is not None and low < high:
            x = _finite(ref(f.name), f.dataType) if kind(f.dataType) == "numeric" else _millis(ref(f.name), f.dataType).cast("double")
            asked.append((i, bucket(x, float(low), float(high))))
    parts = []
    for at in range(0, len(asked), GROUP):
        group = asked[at : at + GROUP]
        cells = df.select(*[b.alias(f"b{i}") for i, b in group])
        counts = cells.agg(*[F.count_if(F.col(f"b{i}") == k + 1).alias(f"n{i}_{k}") for i, _ in group for k in range(BUCKETS)])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.col(f"n{i}_{k}") for k in range(BUCKETS)]).alias("n")) for i, _ in group])).alias("c")).select("c.*"))
    return {r["i"]: r["n"] for r in reduce(DataFrame.unionAll, parts).collect()} if parts else {}


def top_values(df: DataFrame, found: dict, most: int = MOST_DISTINCT, top: int = TOP) -> dict[int, list[tuple[str, int]]]:
    """Job C: for string columns with 1 to `most` distinct values; ties by value. Columns whose estimate
    is near `most` are counted exactly."""
    cells = [F.struct(F.lit(i).alias("i"), ref(f.name).cast("string").alias("v")) for i, f in enumerate(df.schema) if kind(f.dataType) == "string" and 0 < (found.get(f"ndv{i}") or 0) <= most * 1.1]
    if not cells:
        return {}
    ranked = _counted(df, cells, "v").selectExpr("*", "row_number() over (partition by i order by n desc, v) as r", "count(*) over (partition by i) as d").where((F.col("r") <= top) & (F.col("d") <= most))
    out: dict[int, list[tuple[str, int]]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["i"], r["r"])):
        out.setdefault(r["i"], []).append((r["v"], r["n"]))
    return out


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A random sample of exactly n rows; the table itself if it has no more. Chosen by a hash of the
    row, so the layout of the table does not matter."""
    plain = [ref(f.name) if not _unhashed(f.dataType) else F.to_json(F.struct(ref(f.name))) for f in df.schema]
    return df.orderBy(F.xxhash64(F.lit(seed), *plain)).limit(n) if df.count() > n else df


def _unhashed(t: T.DataType) -> bool:
    """Whether the type holds a map or a variant, which have no hash."""
    inner = [t.elementType] if isinstance(t, T.ArrayType) else [f.dataType for f in t] if isinstance(t, T.StructType) else []
    return isinstance(t, (T.MapType, T.VariantType)) or any(map(_unhashed, inner))


def profile(df: DataFrame, sample: int | None = None) -> DataFrame:
    """One row for each column, by SCHEMA. Struct, variant and all-null columns carry only their type
    and null count; columns without a name are passed over."""
    spark: SparkSession = df.sparkSession
    if sample:
        df = sampled(df, sample)
    found = summary(df)
    bars, tops = histograms(df, found), top_values(df, found)
    rows = []
    for i, f in enumerate(df.schema):
        if not f.name:
            continue
        n, k = found[f"n{i}"], kind(f.dataType)
        r = dict.fromkeys(T._parse_datatype_string(SCHEMA).names) | {"column": f.name, "dtype": label(f.dataType, f.metadata), "rows": found["rows"], "null_count": found["rows"] - n}
        get = lambda what, i=i: found.get(f"{what}{i}")
        if n and k in ("numeric", "temporal"):
            low, high = get("low"), get("high")
            shown = _iso if k == "temporal" else repr
            r |= {"ndv_approx": get("ndv"), "mean": get("mean")}
            if low is not None:
                r |= {"min": get("min") or shown(low), "max": get("max") or shown(high)}
                r["edges"] = [shown(low + (high - low) * j / BUCKETS) for j in range(BUCKETS + 1)] if low < high else [shown(low), shown(low)]
                r["counts"] = bars.get(i) if low < high else [get("finite") if k == "numeric" else n]
            if k == "numeric":
                r["not_finite"] = n - get("finite")
        elif n and k == "bool":
            r |= {"true_count": get("yes"), "false_count": get("no")}
        elif n and k in ("string", "binary"):
            r |= {"ndv_approx": get("ndv"), "mean_length": get("length"), "top_values": tops.get(i)}
        elif n and k == "list" and "fixed_size" in f.metadata:
            size = f.metadata["fixed_size"]
            r |= {"length_min": size, "length_max": size, "length_mean": float(size)}
        elif n and k in ("list", "map"):
            r |= {"length_min": get("least"), "length_max": get("most"), "length_mean": get("length")}
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, SCHEMA)


def _iso(ms: float) -> str:
    from datetime import datetime, timedelta, timezone

    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)).isoformat()
