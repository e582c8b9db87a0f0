"""What the operators share: the word rule, lineage cuts in the shared folder, and row keys."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable, scratch

#: A word is a run of anything but the six ASCII white-space characters. In Python, bytes.split()
#: splits UTF-8 text at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once as Parquet in the shared folder and read again. A lost executor then costs
    a re-read, not a recomputation. The files go when the application ends."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes the files of what cut() returned, once nothing reads them any more."""
    for df in cuts:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: Most rows of a batch that goes to Python: texts can be long, and a worker holds a batch several times.
TEXT_ROWS = 2500


def text_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to TEXT_ROWS rows, unless it has them smaller already, and
    lets workers import this package."""
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As cut(), in buckets of `key`, so that what groups or joins by it needs no exchange of these rows."""
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch(spark, "cut")).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    _names.append(name)
    return spark.table(name)


_names: list[str] = []


@atexit.register
def _drop() -> None:
    """Takes the names out of the catalog; the files go by themselves."""
    spark = SparkSession.getActiveSession()
    for name in _names if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may have ended
            spark.sql(f"drop table if exists {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*parts: Column) -> Column:
    """128 bits of the values, nulls told from empty strings. Equal rows share a key, so what is
    decided by key holds for each copy of a row."""
    coded = [F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\x1f", *coded)))
