"""Text layouts that are no plain table, parsed with built-in functions; no record is dropped silently."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref
from .readers import BadRecord, bare, csv, first_files, local, refusing, strict_csv, whole, with_index


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def _holding(rows: DataFrame, ok: Column, what: str) -> DataFrame:
    """`rows`, failing at the first whose `value` does not hold `ok`, whatever is later asked for."""
    return refusing(rows, ~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{what}: "), F.substring(F.coalesce(F.col("value"), F.lit("")), 1, 200)))


def daily_fixed_width(spark: SparkSession, path: str, missing: int = -9999) -> DataFrame:
    """Station, element and up to 31 days in one line: a row for each day that has a value. A line of
    another length and a day that its month lacks are refused."""
    rows = _holding(_lines(spark, path).where("value != ''"), F.char_length("value") == 269, "a line is not 269 characters long")
    day = F.explode(F.sequence(F.lit(1), F.lit(31)))
    rows = rows.select("value", day.alias("day"))
    at = 22 + (F.col("day") - 1) * 8
    cell = lambda from_, n: F.substring(F.col("value"), at + from_, F.lit(n))
    rows = rows.select(
        F.substring("value", 1, 11).alias("station"), F.substring("value", 12, 4).cast("int").alias("year"), F.substring("value", 16, 2).cast("int").alias("month"), "day", F.substring("value", 18, 4).alias("element"),
        F.trim(cell(0, 5)).cast("int").alias("measured"), *[F.nullif(F.trim(cell(5 + i, 1)), F.lit("")).alias(n) for i, n in enumerate(("m_flag", "q_flag", "s_flag"))],
    )
    date = F.make_date("year", "month", "day")  # fails on a date that is none
    return whole(rows.where(F.col("measured") != missing).select("station", date.alias("date"), "element", F.col("measured").alias("value"), "m_flag", "q_flag", "s_flag"))


def xml_rows(spark: SparkSession, path: str, schema: T.StructType | str, row_tag: str = "row") -> DataFrame:
    """Attributes of <row .../> as typed columns; an attribute that the schema lacks, or a value that
    is not of its type, is refused."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    seen = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    attributes = [c[1:] for c in seen.columns if c.startswith("_") and not c.startswith("_corrupt")]
    if unknown := sorted(set(attributes) - set(wanted.names)):
        raise BadRecord(f"attributes not in the schema: {', '.join(unknown)}")
    text = T.StructType([T.StructField(f"_{f.name}", T.StringType()) for f in wanted])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(text).load(path)
    return whole(rows.select(*[F.col(f"`_{f.name}`").cast(f.dataType).alias(f.name) for f in wanted]))


def word_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """The last `dimension` fields are the vector, all before them the token, blanks included."""
    parts = F.split("value", " ")
    ok = F.size(parts) > dimension
    rows = _holding(_lines(spark, path).where("value != ''"), ok, f"fewer than {dimension} numbers").select(parts.alias("p"))
    n = F.size("p")
    return whole(rows.select(F.array_join(F.slice("p", F.lit(1), n - dimension), " ").alias("token"), F.transform(F.slice("p", n - dimension + 1, F.lit(dimension)), lambda x: x.cast("float")).alias("vector")))


def white_space(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Fields by white space, as many in every line; columns are whole numbers, numbers or text."""
    from ..operators.tighten import text_types

    rows = _lines(spark, path).where("trim(value) != ''").select(F.split(F.trim("value"), r"\s+").alias("p"), "value")
    widths = rows.agg(F.min(F.size("p")), F.max(F.size("p"))).first()
    if widths[0] != widths[1]:
        raise BadRecord(f"lines have from {widths[0]} to {widths[1]} fields")
    names = names or [f"c{i}" for i in range(widths[0] or 0)]
    if len(names) != (widths[0] or 0):
        raise BadRecord(f"{len(names)} names for {widths[0]} fields")
    text = rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    types = text_types(text)
    return text.select(*[ref(n).cast(types[n]).alias(n) for n in names])


def after_preamble(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Skips all lines before the first that holds one number for each name; from there on every line must."""
    rows = with_index(_lines(spark, path)).withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = (F.size("p") == len(names)) & F.forall("p", lambda x: x.try_cast("double").isNotNull())
    first = rows.where(good).agg(F.min("row_index")).first()[0]
    if first is None:
        raise BadRecord(f"no line of {path} holds {len(names)} numbers")
    body = _holding(rows.where((F.col("row_index") >= first) & (F.trim("value") != "")), good, "not a row of numbers")
    return body.select(*[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def tabs_then_json(spark: SparkSession, path: str) -> DataFrame:
    """type, key, revision, last_modified and a JSON record, cut at the first four tabs."""
    p = F.split("value", "\t", 5)
    rows = _holding(_lines(spark, path).where("value != ''"), F.size(p) == 5, "fewer than five fields").select(p.alias("p"))
    at = lambda i: F.col("p")[i]
    return whole(rows.select(at(1).alias("key"), at(2).cast("long").alias("revision"), F.to_timestamp_ntz(at(3)).alias("last_modified"), at(0).alias("type"), F.parse_json(at(4)).alias("record")))


def tagged_games(spark: SparkSession, path: str) -> DataFrame:
    """Chess games: a block of [Tag "value"] lines, an empty line, the moves. (tags, moves) by game."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n(?=\[Event )")).alias("value")).where("trim(value) != ''")
    head = F.regexp_extract("value", r"(?s)^\s*((?:\[[^\n]*\]\n)+)\n", 1)
    tags = F.map_from_arrays(F.regexp_extract_all(head, F.lit(r'\[(\w+) "([^"]*)"\]'), F.lit(1)), F.regexp_extract_all(head, F.lit(r'\[(\w+) "([^"]*)"\]'), F.lit(2)))
    moves = F.trim(F.regexp_replace(F.regexp_replace("value", r"(?s)^\s*(?:\[[^\n]*\]\n)+\n", ""), r"\s+", " "))
    return _holding(text, head != "", "a game without tags").select(tags.alias("tags"), moves.alias("moves"))


def raw_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each line that is not blank as it is, in column raw_json."""
    return _lines(spark, path).where("trim(value) != ''").select(F.col("value").alias("raw_json"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of documents, region/code.json: region, code, document (VARIANT)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("f"))
    return whole(rows.select(F.regexp_extract("f", r"([^/]+)/[^/]+$", 1).alias("region"), F.regexp_extract("f", r"([^/]+)\.json$", 1).alias("code"), F.parse_json("value").alias("document")))


def wrapped_jsonl(spark: SparkSession, path: str | list[str], wrap: int = 65_535) -> DataFrame:
    """Lines of JSON of which some were cut at `wrap` bytes: a record goes on in the next line as long
    as it is no JSON by itself and a piece is exactly that long. Objects only. Files are read one for
    each task, as compressed ones are, and in order: line by line where workers can open them, else as
    one value each, which is limited to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())
    if mapped := local(names):
        each = spark.createDataFrame([(n, None) for n in names], "path string, content binary").repartition(max(1, len(names)), "path")
    else:
        each = files.select("path", "content")

    def records(name: str, lines: Iterator[bytes]) -> Iterator[str]:
        held = b""
        for line in lines:
            line = line.removesuffix(b"\n")
            whole_record = held + line
            if not whole_record.strip():
                continue
            try:
                if not isinstance(json.loads(whole_record), dict):
                    raise BadRecord(f"{name}: not an object: {whole_record[:200]!r}")
                yield whole_record.decode()
                held = b""
            except BadRecord:
                raise
            except ValueError:
                if len(line) != wrap:
                    raise BadRecord(f"{name}: bad record: {whole_record[:200]!r}") from None
                held = whole_record
        if held:
            raise BadRecord(f"{name}: ends within a record")

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with open(bare(name), "rb") if mapped else io.BytesIO(content.as_py()) as raw:
                    start = raw.read(2)
                    raw.seek(0)
                    out = []
                    for r in records(name, gzip.open(raw) if start == b"\x1f\x8b" else raw):
                        out.append(r)
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["raw"])
                            out = []
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["raw"])

    return whole(each.mapInArrow(join, "raw string").select(F.parse_json("raw").alias("record")))


def number_in_name(path: str) -> int:
    """The number at the end of a file's name, 0 without one."""
    return int(m[1]) if (m := re.search(r"(\d+)\.\w+$", path)) else 0


def piped_parts(spark: SparkSession, parts: list[tuple[str, str]], all_text: bool = False) -> DataFrame:
    """Pipe-separated files, each with its CREATE TABLE: united by name, the first type of a column
    winning. Parts are taken by the number at the end of their names."""
    from ..functions.types import from_ddl
    from ..operators.union import by_name

    tables = [strict_csv(spark, p, from_ddl(ddl, all_text), sep="|", quote="", nullValue="null") for p, ddl in sorted(parts, key=lambda x: number_in_name(x[0]))]
    return by_name(tables, first_type_wins=True)


def splits_from_names(spark: SparkSession, paths: list[str], column: str = "split") -> DataFrame:
    """Parquet shards such as train-00000-of-00002.parquet, with the split as a column."""
    from ..operators.union import by_name

    return by_name([spark.read.parquet(p).withColumn(column, F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z_]+)", 1)) for p in paths])


def with_duration(df: DataFrame, start: str, end: str, name: str = "duration_us") -> DataFrame:
    """Signed microseconds from start to end; null where either is."""
    return df.withColumn(name, F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)))


def zipped_by_position(tables: list[DataFrame]) -> DataFrame:
    """Columns side by side, row by row; tables of unlike length are refused."""
    lengths = [t.count() for t in tables]
    if len(set(lengths)) > 1:
        raise BadRecord(f"tables of {lengths} rows cannot be zipped")
    out = with_index(tables[0])
    for t in tables[1:]:
        out = out.join(with_index(t), "row_index")
    return out.drop("row_index")


def readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated date, time, code, value, in files named by a number at their end: patient_id, the
    code as a number up to 255 that is written plainly, the value as it is, and as a number where it is
    one that a double gives back. Fields may be empty; a line of another shape is refused."""
    p = F.split("value", "\t")
    code, raw = p[2], p[3]
    rows = _lines(spark, path).where("trim(value) != ''")
    rows = _holding(rows, F.size(p) == 4, "not four fields")
    rows = _holding(rows, code.rlike("^(0|[1-9][0-9]{0,2})$") & (F.when(code.rlike("^[0-9]{1,3}$"), code.cast("int")) <= 255), "a code that is no small number")
    number = raw.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    back = F.when(number, raw.cast("double")).cast("decimal(38,18)") == F.when(number, raw).cast("decimal(38,18)")
    rows = _holding(rows, ~number | back, "a value that no double gives back")
    who = F.regexp_extract("file", r"(\d+)[^/\d]*$", 1).cast("int")
    return rows.select(who.alias("patient_id"), F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), p[0].alias("date"), p[1].alias("time"), code.cast("int").alias("code"), F.when(number, raw.cast("double")).alias("value"), raw.alias("raw_value"))


def nested_zip_csv(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """CSV files in a zip, and in zips within it, unpacked to `folder` (the shared one if none is given)
    and united by name."""
    from ..operators.union import by_name
    from ..session import put, scratch

    folder = folder or scratch(spark, "unzipped")
    found: list[str] = []

    def unpack(data: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.endswith(".zip"):
                    unpack(z.read(name))
                elif name.endswith(".csv"):
                    found.append(f"{folder}/{len(found):04d}-{name.rsplit('/', 1)[-1]}")
                    put(spark, found[-1], z.read(name))

    with open(path, "rb") as f:
        unpack(f.read())
    if not found:
        raise BadRecord(f"no CSV in {path}")
    return by_name([csv(spark, f) for f in found])


def readings_archive(spark: SparkSession, path: str) -> DataFrame:
    """The readings of an archive, with archives within it, of files named data-NN."""
    from .archives import unpacked

    return readings(spark, unpacked(spark, path, ["data-[0-9]*"]))


def json_columns(spark: SparkSession, paths: str | list[str], columns: tuple[str, ...] = ("sections", "infoboxes"), most_files: int | None = None) -> DataFrame:
    """Parquet shards united by name, with their columns of JSON text as VARIANT behind the others; SQL
    null stays null and differs from JSON null; bad JSON fails."""
    files = first_files([paths] if isinstance(paths, str) else paths, most_files)
    df = spark.read.option("mergeSchema", True).parquet(*files)
    rest = [ref(c) for c in df.columns if c not in columns]
    return whole(df.select(*rest, *[F.parse_json(ref(c)).alias(c) for c in columns]))


def blocklist(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Hosts of lists with # comments, or in the layout of a hosts file: column host, distinct."""
    bare = F.trim(F.regexp_replace("value", "#.*$", ""))
    host = F.lower(F.regexp_extract(bare, r"(\S+)$", 1))
    return _lines(spark, path).select(F.regexp_replace(host, r":\d+$", "").alias("host")).where("host like '%.%'").distinct()


def map_elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes, ways or relations of a file of map data."""
    from .osm import osm

    return osm(spark, path, kind)


def transport_file(spark: SparkSession, path: str) -> DataFrame:
    """The table of a SAS transport file."""
    from .xport import xport

    return xport(spark, path)


#: Name -> function(spark, inputs..., **parameters) -> DataFrame; recipes name them.
HANDLERS = {
    "daily_fixed_width": daily_fixed_width, "xml_rows": xml_rows, "word_vectors": word_vectors, "white_space": white_space, "after_preamble": after_preamble, "tabs_then_json": tabs_then_json,
    "tagged_games": tagged_games, "raw_json": raw_json, "json_documents": json_documents, "wrapped_jsonl": wrapped_jsonl, "piped_parts": piped_parts, "splits_from_names": splits_from_names,
    "readings": readings, "readings_archive": readings_archive, "json_columns": json_columns, "nested_zip_csv": nested_zip_csv, "blocklist": blocklist,
    "map_elements": map_elements, "transport_file": transport_file,
}
