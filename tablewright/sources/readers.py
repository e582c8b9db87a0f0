"""Readers of tabular formats, as lazy DataFrames."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref


class UnsupportedFormat(ValueError):
    """A format for which no reader is installed."""


class BadRecord(ValueError):
    """A record that its reader refuses, named by file and text."""


#: Spellings that the text readers take for null; fixed values.
NULL_SPELLINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")
_MISSING = ("vortex", "lance", "avro", "nimble")


def refusing(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """`df`, failing with `message` at the first row that is `bad`, whatever is later selected, filtered
    or counted: the condition is a filter that depends on chance as far as the optimizer knows, so it is
    neither pruned nor passed by another filter on its way to the source."""
    always = F.monotonically_increasing_id() >= 0
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(always))


def whole(df: DataFrame) -> DataFrame:
    """`df`, each column of each row being worked out, so that a value that cannot be read fails, whatever
    is later selected, filtered or counted."""
    nulls = reduce(lambda x, y: x + y, [ref(c).isNull().cast("long") for c in df.columns], F.lit(0).cast("long"))
    return df.where(nulls + F.monotonically_increasing_id() >= 0)


def with_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds the place of each row in the input's order. The counts of the partitions, one small row
    each, are summed; rows are not moved."""
    mark = df.withColumn("__m", F.monotonically_increasing_id())
    counts = {r["p"]: r["n"] for r in mark.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __start long"))  # a row for each partition
    joined = mark.join(offsets, F.shiftright("__m", 33) == F.col("__p"))
    return joined.withColumn(name, F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__start")


def parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(*paths) if len(paths) == 1 else spark.read.orc(list(paths))


def unchanged(df: DataFrame, seen: dict[str, tuple] | None = None) -> dict[str, tuple]:
    """Length and time of each file behind `df`, from the file system, no row being read; with what was
    seen before, a change is refused."""
    context, now = df.sparkSession.sparkContext, {}
    for f in df.inputFiles():
        target = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(f) if "://" in f or f.startswith("file:") else f)
        try:
            status = target.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(target)
            now[f] = (status.getLen(), status.getModificationTime())
        except Py4JJavaError as e:
            if "FileNotFoundException" not in str(e.java_exception):
                raise
    if seen is not None and now != seen:
        raise BadRecord(f"files changed between passes: {sorted(k for k in {*now, *seen} if now.get(k) != seen.get(k))}")
    return now


def strict_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """CSV by `schema`; a row with too few or too many fields, or with a value that is not of its type, is
    refused and named, whichever columns are asked for. Empty lines are no rows."""
    shape = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "columnPruning": False} | options
    rows = spark.read.schema(shape).options(**options).csv(paths)
    # the parser refuses to look at the column of bad rows alone, so one of the others is looked at as well
    other = F.coalesce(F.substring(ref(schema.names[0]).cast("string"), 1, 0), F.lit(""))
    there = F.concat(F.lit("ragged row or bad value in "), F.input_file_name(), F.lit(": "), F.substring("__bad", 1, 200), other)
    return refusing(rows, F.col("__bad").isNotNull(), there).drop("__bad")


def _open_quotes(spark: SparkSession, paths: str | list[str], quote: str | None) -> bool:
    """Whether any line has an odd number of quotes, so that a value may hold a line break."""
    if not quote:
        return False
    lines = spark.read.text(paths)
    return not lines.where(F.pmod(F.regexp_count("value", F.lit(re.escape(quote))), F.lit(2)) == 1).isEmpty()


def csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, sep: str = ",", quote: str | None = '"', header: bool = True, encoding: str = "UTF-8", multiline: bool | None = None, nulls: tuple[str, ...] = NULL_SPELLINGS, names: list[str] | None = None) -> DataFrame:
    """Text is read as strings, null spellings become null, and each column then takes the narrowest of
    bigint, double and string, or the type of `schema`. A row with too few or too many fields, or a value
    that is not of its type, is refused. With line breaks within values a file is one task; unless
    `multiline` says so, a pass over the lines finds out whether there can be any."""
    from ..operators.tighten import text_types

    if multiline is None:
        multiline = _open_quotes(spark, paths, quote)
    options = {"sep": sep, "quote": quote or "", "header": header, "encoding": encoding, "multiLine": multiline, "escape": quote or "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = names or (wanted.names if wanted is not None else spark.read.options(**options).option("inferSchema", False).csv(paths).columns)
    df = strict_csv(spark, paths, T.StructType([T.StructField(c, T.StringType()) for c in columns]), **options)
    blank = lambda c: F.when(~ref(c).isin(*nulls), ref(c)).alias(c)
    df = df.select(*[blank(c) for c in columns])
    types = {f.name: f.dataType.simpleString() for f in wanted} if wanted is not None else text_types(df)
    return whole(df.select(*[ref(c).cast(types[c]).alias(c) for c in columns]))


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A bad line fails the read, whichever columns are asked for."""
    reader = spark.read.option("mode", "FAILFAST")
    return whole((reader.schema(schema) if schema is not None else reader).json(paths))


def local(files: list[str]) -> bool:
    return all(f.startswith(("file:", "/")) for f in files)


def bare(file: str) -> str:
    from urllib.parse import unquote, urlsplit

    return unquote(urlsplit(file).path) if file.startswith("file:") else file


def arrow_ipc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Arrow files, a file for each task; the schema is that of the first. Unsigned types are widened.
    Files that workers can open are mapped, batch by batch; those of another store come as one value
    each, so they are limited to 2 GB."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())
    if not names:
        raise FileNotFoundError(path)
    mapped = local(names)
    opened = lambda x: pa.ipc.open_file(pa.memory_map(bare(x)) if isinstance(x, str) else pa.py_buffer(x))
    head = names[0] if mapped else bytes(files.orderBy("path").limit(1).select("content").first()["content"])
    widen = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}
    kept = [f for f in opened(head).schema if columns is None or f.name in columns]
    target = pa.schema([pa.field(f.name, widen.get(f.type, f.type)) for f in kept])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for source in b.column(0):
                file = opened(source.as_py())
                for i in range(file.num_record_batches):
                    got = file.get_batch(i)
                    yield pa.RecordBatch.from_arrays([got.column(f.name).cast(f.type) for f in target], schema=target)

    each = spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names), "path") if mapped else files.select("content")
    return each.mapInArrow(read, from_arrow_schema(target))


def duckdb_table(spark: SparkSession, path: str, table: str, schema: str = "main", batch: int = 1 << 20) -> DataFrame:
    """A physical table of a DuckDB file, rows in their order; views are refused. It passes through the
    driver `batch` rows at a time, and is kept as Parquet in the shared folder."""
    import duckdb

    from ..session import scratch

    with duckdb.connect(path, read_only=True) as c:
        kinds = c.execute("select table_type from information_schema.tables where table_schema = ? and table_name = ?", [schema, table]).fetchall()
        if not kinds or kinds[0][0] != "BASE TABLE":
            raise BadRecord(f"{schema}.{table} is no physical table of {path}")
        quoted = ".".join('"' + n.replace('"', '""') + '"' for n in (schema, table))
        batches, to, n = c.sql(f"select * from {quoted}").to_arrow_reader(batch), scratch(spark, "duckdb"), 0
        for n, b in enumerate(batches, 1):
            spark.createDataFrame(pa.Table.from_batches([b])).coalesce(1).write.parquet(f"{to}/part={n:06d}")
        if not n:
            return spark.createDataFrame(batches.schema.empty_table())
    return spark.read.parquet(to).drop("part")


_STATS = "file string, row_group int, rows long, column string, nulls long, bytes long, low string, high string"


def _footer_rows(file: str, meta) -> Iterator[tuple]:
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            s = col.statistics
            bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
            yield (file, g, group.num_rows, col.path_in_schema, s.null_count if s is not None and s.has_null_count else None, col.total_compressed_size, *bounds)


def footers(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(file, row_group, rows, column, nulls, bytes, low, high) from the footers of the Parquet files
    behind `df`; bounds as text, null where a group has none. Workers read those that they can open, the
    driver those of another store, through Spark's file systems."""
    import pyarrow.parquet as pq

    files = df.inputFiles()
    if not local(files):
        return spark.createDataFrame([r for f in files for r in _footer_rows(f, pq.read_metadata(_tail(spark, f)))], _STATS)
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(64, len(files))))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [r for f in b.column(0).to_pylist() for r in _footer_rows(f, pq.read_metadata(bare(f)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _STATS.split(", ")])

    return names.mapInArrow(read, _STATS)


def row_count(spark: SparkSession, df: DataFrame) -> int:
    """Rows of the Parquet files behind `df`, from their footers."""
    groups = footers(spark, df).groupBy("file", "row_group").agg(F.max("rows").alias("rows"))
    return groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def _tail(spark: SparkSession, file: str) -> io.BytesIO:
    """A Parquet file of nothing but its footer, which is all that is read of it."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(file)
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)

    def last(n: int) -> bytes:
        stream.seek(size - n)
        return bytes(context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        return io.BytesIO(b"PAR1" + last(int.from_bytes(last(8)[:4], "little") + 8))
    finally:
        stream.close()


def footer_summary(stats: DataFrame) -> DataFrame:
    """column, groups, rows, bytes, nulls, low, high. Nulls are unknown if any group lacks its count;
    bounds are the least and the largest of the groups', as numbers where they are such, and unknown if
    any group that holds a value lacks them."""
    order = lambda c: F.struct(F.col(c).try_cast("double").alias("a"), F.col(c).try_cast("decimal(38,0)").alias("b"), F.col(c).alias("c"))
    known = F.bool_and(F.col("low").isNotNull() & F.col("high").isNotNull() | F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False)))
    has = F.col("low").isNotNull()
    return stats.groupBy("column").agg(
        F.count("*").alias("groups"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.when(F.bool_and(F.col("nulls").isNotNull()), F.sum("nulls")).alias("nulls"),
        F.when(known, F.min(F.when(has, order("low")))["c"]).alias("low"),
        F.when(known, F.max(F.when(has, order("high")))["c"]).alias("high"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file as it is."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def first_files(paths: list[str], n: int | None) -> list[str]:
    """The first n by name; all for None."""
    return sorted(paths) if n is None else sorted(paths)[:n]


class Reader(Protocol):
    """What READERS hold: a lazy table of the files at `path`."""

    def __call__(self, spark: SparkSession, path: str, **options) -> DataFrame: ...


#: Formats that can be read, by name, and endings of files.
READERS: dict[str, Reader] = {"parquet": parquet, "orc": orc, "csv": csv, "tsv": lambda s, p, **o: csv(s, p, sep="\t", **o), "jsonl": jsonl, "arrow": arrow_ipc}
ENDINGS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".tsv": "tsv", ".json": "jsonl", ".jsonl": "jsonl", ".arrow": "arrow", ".feather": "arrow"}


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """By format, or by the ending of the name."""
    fmt = fmt or ENDINGS.get(os.path.splitext(path.removesuffix(".gz"))[1].lower(), "")
    if fmt in _MISSING:
        raise UnsupportedFormat(f"{fmt}: no reader is installed here")
    if fmt not in READERS:
        raise UnsupportedFormat(f"{fmt or path}: unknown format")
    return READERS[fmt](spark, path, **options)
