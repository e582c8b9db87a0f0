"""A lazy handle on a table, and recipes that make tables."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import project, renamed
from ..functions.types import label
from ..operators.tighten import tighten
from ..operators.union import by_name
from ..session import put
from ..sources import readers, sinks, text


class SchemaDrift(RuntimeError):
    """A table is not what its recipe expects."""


@dataclass
class Dataset:
    """Nothing is read before it is asked for. With `pinned`, the files behind the table (their names,
    lengths and times) are those of the first look: each further use checks them, and refuses to read
    another generation."""

    spark: SparkSession
    name: str
    make: Callable[[], DataFrame]
    pinned: bool = False
    seen: dict | None = field(default=None, repr=False)

    def frame(self, columns: list[str] | None = None) -> DataFrame:
        df = self.make()
        if self.pinned:
            self.seen = readers.unchanged(df, self.seen)
        return df if columns is None else project(df, columns)

    def head(self, n: int) -> DataFrame:
        """The first n rows in the order of the input."""
        return readers.with_index(self.frame(), "__at").orderBy("__at").limit(n).drop("__at")

    @property
    def columns(self) -> list[str]:
        return self.make().columns

    def describe(self) -> list[tuple[str, str]]:
        return [(f.name, label(f.dataType, f.metadata)) for f in self.make().schema]

    def batches(self, columns: list[str] | None = None) -> Iterator[dict]:
        """Row by row, a partition at a time in the driver."""
        return (r.asDict() for r in self.frame(columns).toLocalIterator())

    def to_arrow(self, columns: list[str] | None = None) -> pa.Table:
        return self.frame(columns).toArrow()

    def to_pandas(self, columns: list[str] | None = None):
        return self.frame(columns).toPandas()

    def register(self, view: str | None = None) -> str:
        self.make().createOrReplaceTempView(view or self.name)
        return view or self.name

    def schema_hash(self) -> str:
        """Of the sorted name:type pairs, so column order does not matter."""
        return hashlib.sha256("|".join(sorted(f"{n}:{t}" for n, t in self.describe())).encode()).hexdigest()

    def validate(self, rows: int | None = None, schema: str | None = None, strict: bool = True) -> list[str]:
        """Differences from the expected row count and schema hash (a prefix will do)."""
        found = []
        if schema is not None and not self.schema_hash().startswith(schema):
            found.append(f"schema {self.schema_hash()[:12]}, expected {schema}")
        if rows is not None and (n := self.make().count()) != rows:
            found.append(f"{n} rows, expected {rows}")
        if found and strict:
            raise SchemaDrift(f"{self.name}: " + "; ".join(found))
        return found


def open_folder(spark: SparkSession, folder: str, names: list[str], pinned: bool = False) -> dict[str, Dataset]:
    return {n: Dataset(spark, n, lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet"), pinned) for n in names}


def listed(datasets: dict[str, Dataset]) -> DataFrame:
    """The catalog as a table: slug, columns (name and label), schema_hash, files, bytes; from schemas and
    file listings alone, sorted by slug."""
    spark = next(iter(datasets.values())).spark
    rows = []
    for slug, d in sorted(datasets.items()):
        files = readers.unchanged(d.make())
        rows.append((slug, d.describe(), d.schema_hash(), len(files), sum(size for size, _ in files.values())))
    return spark.createDataFrame(rows, "slug string, columns array<struct<name:string,dtype:string>>, schema_hash string, files int, bytes long")


def all_columns(datasets: dict[str, Dataset]) -> DataFrame:
    """slug, name, dtype of each column of each table."""
    return listed(datasets).selectExpr("slug", "inline(columns)")


def selected(recipes: list[Recipe], slugs: list[str] | None = None, everything: bool = False, hydrated: bool = False, derived: str = "keep") -> list[Recipe]:
    """The recipes asked for: those named, in that order and each once, or all in their own order, then
    without hydrated ones unless asked for. With derived="reject" recipes with a parent are left out of
    all, and refused by name. Every unknown name is reported, with the nearest known one."""
    import difflib

    slugs = list(slugs or ())
    if everything == bool(slugs):
        raise ValueError("name slugs, or ask for everything; not both, and not nothing")
    if everything:
        return [r for r in recipes if (not r.parent if derived == "reject" else hydrated or not r.hydrated)]
    by = {r.slug: r for r in recipes}
    near = lambda s: "".join(f" (did you mean {n}?)" for n in difflib.get_close_matches(s, by, 1))
    if unknown := [s for s in slugs if s not in by]:
        raise KeyError("; ".join(f"unknown {s}{near(s)}" for s in unknown))
    chosen = [by[s] for s in dict.fromkeys(slugs)]
    if derived == "reject" and (refused := [r.slug for r in chosen if r.parent]):
        raise ValueError(f"derived from other tables: {', '.join(refused)}")
    return chosen


def profile_document(df: DataFrame, slug: str, sample: int | None = None) -> dict:
    """The profile of a table, ready for JSON: numbers that are not finite are null, and credentials and
    paths are taken out of bounds and top values."""
    from ..functions.scalar import redacted
    from ..operators.profile import profile

    found = profile(df, sample)
    shown = lambda c: redacted(F.col(c)).alias(c)
    top = F.transform("top_values", lambda v: F.struct(redacted(v["value"]).alias("value"), v["count"].alias("count"))).alias("top_values")
    made = {"min": shown("min"), "max": shown("max"), "top_values": top}
    rows = [r.asDict(True) for r in found.select(*[made.get(c, F.col(c)) for c in found.columns]).collect()]
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return {"slug": slug, "rows": rows[0]["rows"] if rows else 0, "sample_rows": sample, "columns": [{k: plain(v) for k, v in r.items() if k != "rows" and v is not None} for r in rows]}


def publish_profile(d: Dataset, to: str, sample: int | None = None) -> str:
    """Writes `to`/slug/profile.json; refused if the files change while they are profiled."""
    before = readers.unchanged(d.make())
    document = profile_document(d.make(), d.name, sample)
    readers.unchanged(d.make(), before)
    return put(d.spark, f"{to}/{d.name}/profile.json", (json.dumps(document, indent=2, default=str) + "\n").encode())


def profile_paths(slug: str, built: str, promoted: str | None = None, *frozen: str) -> list[str]:
    """Where the profile of a table is looked for, freshest first, each once: beside the built table, then
    among the promoted ones, then in further folders in their order."""
    return list(dict.fromkeys([f"{built}/{slug}/profile.json", *[f"{f}/{slug}.json" for f in (promoted, *frozen) if f]]))


def found_profile(spark: SparkSession, slug: str, built: str, promoted: str | None = None, *frozen: str) -> str | None:
    """The first of profile_paths() that there is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p))
    return next((p for p in profile_paths(slug, built, promoted, *frozen) if there(p)), None)


#: Name -> function(recipe) -> local paths; a recipe may name one in place of its inputs. Only these are run.
FETCHERS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Recipe:
    """How a table is made: inputs read by a format or a handler, united, tightened, renamed, checked,
    and written."""

    slug: str
    inputs: tuple[str, ...]
    reader: str = "parquet"
    handler: str | None = None
    parameters: dict = field(default_factory=dict)
    renames: dict = field(default_factory=dict)
    normalise: bool = False
    tight: bool = False
    rows: int | None = None
    schema: str | None = None
    parent: str | None = None
    fetcher: str | None = None
    hydrated: bool = False

    def fetched(self) -> tuple[str, ...]:
        """The inputs: those given, or what the fetcher brings."""
        if self.fetcher is None:
            return self.inputs
        if self.fetcher not in FETCHERS:
            raise KeyError(f"{self.slug}: no fetcher {self.fetcher}; there are {', '.join(sorted(FETCHERS)) or 'none'}")
        return tuple(FETCHERS[self.fetcher](self))

    def fingerprint(self, parents: dict[str, Recipe] | None = None) -> str:
        """Of all that decides the content, the parent's included."""
        own = json.dumps({k: v for k, v in self.__dict__.items() if k not in ("rows", "schema")}, sort_keys=True, default=list)
        above = (parents or {}).get(self.parent or "")
        return hashlib.sha256((own + (above.fingerprint(parents) if above else "")).encode()).hexdigest()

    def frame(self, spark: SparkSession) -> DataFrame:
        inputs = self.fetched()
        if self.handler:
            df = text.HANDLERS[self.handler](spark, list(inputs) if len(inputs) > 1 else inputs[0], **self.parameters)
        else:
            df = by_name([readers.read(spark, p, self.reader, **self.parameters) for p in inputs], self.renames)
        if self.normalise:
            df = renamed(df)
        return tighten(df) if self.tight else df

    def build(self, spark: SparkSession, to: str) -> Dataset:
        """Checked before it is published."""
        made = Dataset(spark, self.slug, lambda: self.frame(spark))
        made.validate(self.rows, self.schema)
        sinks.publish(made.frame(), to)
        return Dataset(spark, self.slug, lambda: spark.read.parquet(to))


def recipe_faults(recipes: list[Recipe], unused: bool = False) -> list[tuple[str, str]]:
    """(slug, fault): repeated slugs, unknown handlers and fetchers, parents that are missing or have
    parents. Handlers and fetchers that no recipe names have the fault "unused", under their own name, if
    `unused` asks for them."""
    by = {r.slug: r for r in recipes}
    out = [(s, "repeated slug") for s in sorted({r.slug for r in recipes if sum(x.slug == r.slug for x in recipes) > 1})]
    out += [(r.slug, f"unknown handler {r.handler}") for r in recipes if r.handler and r.handler not in text.HANDLERS]
    out += [(r.slug, f"unknown fetcher {r.fetcher}") for r in recipes if r.fetcher and r.fetcher not in FETCHERS]
    out += [(r.slug, f"missing parent {r.parent}") for r in recipes if r.parent and r.parent not in by]
    out += [(r.slug, f"parent {r.parent} has a parent") for r in recipes if r.parent in by and by[r.parent].parent]
    if unused:
        out += [(n, "unused") for n in sorted({*text.HANDLERS, *FETCHERS} - {r.handler for r in recipes} - {r.fetcher for r in recipes})]
    return out


def hydrated(df: DataFrame, url: str, fetch: Callable[[str], tuple[int, str, bytes]], blocked: DataFrame | None = None, limit: int | None = None, bypass: bool = False, risk_accepted: bool = False) -> DataFrame:
    """`df`, or its first `limit` rows, with content and provenance of the URLs that the filter allows.
    `fetch` is handed in; only what it returns is recorded. A blocklist joins on the host, so it may be of
    any size. To go without the filter takes both `bypass` and `risk_accepted`."""
    from ..functions.scalar import host_of, url_decision

    if bypass and not risk_accepted:
        raise ValueError("bypass fetches whatever the rows hold; accept the risk as well")
    if limit is not None:
        df = readers.with_index(df, "__at").orderBy("__at").limit(limit).drop("__at")
    mark = F.lit(False)
    if blocked is not None:
        df = df.withColumn("__host", host_of(F.trim(F.col(url)))).join(blocked.select(F.col("host").alias("__blocked")).distinct(), F.col("__host") == F.col("__blocked"), "left")
        mark = F.col("__blocked").isNotNull()
    df = df.withColumn("__decision", url_decision(F.col(url), mark, bypass))
    df = df.drop("__host", "__blocked")
    shape = pa.struct([("http_status", pa.int16()), ("content_type", pa.string()), ("sha256", pa.binary()), ("bytes_total", pa.int32()), ("filter_decision", pa.string()), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            content, notes = [], []
            for u, d in zip(b.column(url).to_pylist(), b.column("__decision").to_pylist(), strict=True):
                note, body = dict.fromkeys(("http_status", "content_type", "sha256", "bytes_total", "error")) | {"filter_decision": d}, None
                if u is not None and d.startswith("allowed"):
                    try:
                        note["http_status"], note["content_type"], body = fetch(u)
                        note |= {"sha256": hashlib.sha256(body).digest(), "bytes_total": len(body)}
                    except OSError as e:
                        note["error"] = str(e)
                content.append(body)
                notes.append(note)
            keep = [i for i, n in enumerate(b.schema.names) if n != "__decision"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(content, pa.binary()), pa.array(notes, shape)], names=[*[b.schema.names[i] for i in keep], "content", "provenance"])

    from pyspark.sql import types as T

    note = "struct<http_status:smallint,content_type:string,sha256:binary,bytes_total:int,filter_decision:string,error:string>"
    schema = T.StructType([*[f for f in df.schema if f.name != "__decision"], *T._parse_datatype_string(f"content binary, provenance {note}").fields])
    return df.mapInArrow(run, schema)
