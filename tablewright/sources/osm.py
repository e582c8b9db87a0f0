"""Map data in blocks of protocol buffers (.osm.pbf): nodes, ways and relations as tables.

The driver lists a file's blocks by their headers alone; each block is then read, inflated and decoded by
itself, so a file of any size is as many tasks as wanted. The lines of ways come from a join of their
references with the nodes. Files must be where the driver and the workers can open them."""

from __future__ import annotations

import datetime as dt
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import line_wkb, point_wkb
from .readers import BadRecord, bare

KINDS = ("nodes", "ways", "relations")
_TAGS = "tags array<struct<key:string,value:string>>"
_HEAD = "id long, version int, timestamp string"
_SHAPES = {"nodes": f"{_HEAD}, lon double, lat double, {_TAGS}", "ways": f"{_HEAD}, refs array<long>, {_TAGS}", "relations": f"{_HEAD}, members array<struct<ref:long,role:string,type:string>>, {_TAGS}"}
#: What a block may need of its reader, and letters of the kinds of members.
FEATURES, MEMBERS = ("OsmSchema-V0.6", "DenseNodes"), "nwr"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers as they stand, anything of a length as bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        elif tag & 7 == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise BadRecord(f"a field of kind {tag & 7}")
        yield tag >> 3, value


def packed(raw: bytes) -> np.ndarray:
    """A run of whole numbers, all at once."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.nonzero(b < 128)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)


def signed(n):
    """Numbers whose lowest bit is the sign."""
    if isinstance(n, np.ndarray):
        n = n.view(np.uint64)
        return ((n >> np.uint64(1)) ^ (np.uint64(0) - (n & np.uint64(1)))).view(np.int64)
    return (n >> 1) ^ -(n & 1)


def blocks(path: str) -> list[tuple[str, int, int]]:
    """(path, offset, size) of each block of data; a file that needs what is not known here is refused."""
    found = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size, at = header[3], f.tell()
            if header[1] == b"OSMHeader":
                needs = [v.decode() for k, v in fields(inflated(f.read(size))) if k == 4]
                if unknown := [n for n in needs if n not in FEATURES]:
                    raise BadRecord(f"{path} needs {', '.join(unknown)}")
            elif header[1] == b"OSMData":
                found.append((path, at, size))
            f.seek(at + size)
    return found


def inflated(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise BadRecord("a block that is neither plain nor zlib")


def _time(units: int | None, granularity: int) -> str | None:
    return dt.datetime.fromtimestamp(units * granularity / 1000, dt.timezone.utc).isoformat() if units else None


def decoded(raw: bytes, kind: str) -> list[tuple]:
    """Rows of one kind of a block."""
    parts: dict[int, list] = {}
    for k, v in fields(raw):
        parts.setdefault(k, []).append(v)
    text = [v.decode("utf-8", "replace") for k, v in fields(parts[1][0]) if k == 1]
    one = lambda k, default: parts[k][0] if k in parts else default
    whole = lambda n: n - (1 << 64) if n >> 63 else n
    grain, clock, lat0, lon0 = one(17, 100), one(18, 1000), whole(one(19, 0)), whole(one(20, 0))
    degrees = lambda offset, n: (offset + grain * n) / 1e9

    def common(m: dict) -> tuple[int, str | None, list]:
        info = dict(fields(m.get(4, b"")))
        tags = [{"key": text[k], "value": text[v]} for k, v in zip(packed(m.get(2, b"")).tolist(), packed(m.get(3, b"")).tolist(), strict=True)]
        return info.get(1, 0), _time(info.get(2), clock), tags

    rows = []
    for group in parts.get(2, []):
        for k, v in fields(group):
            if k == 2 and kind == "nodes":
                rows += _dense(v, text, clock, degrees, lat0, lon0)
            elif k == KINDS.index(kind) + (1 if kind == "nodes" else 2):
                m = dict(fields(v))
                version, time, tags = common(m)
                if kind == "nodes":
                    rows.append((signed(m[1]), version, time, degrees(lon0, signed(m[9])), degrees(lat0, signed(m[8])), tags))
                elif kind == "ways":
                    rows.append((whole(m[1]), version, time, np.cumsum(signed(packed(m.get(8, b"")))).tolist(), tags))
                else:
                    refs = np.cumsum(signed(packed(m.get(9, b"")))).tolist()
                    members = zip(refs, packed(m.get(8, b"")).tolist(), packed(m.get(10, b"")).tolist(), strict=True)
                    rows.append((whole(m[1]), version, time, [{"ref": r, "role": text[s], "type": MEMBERS[t]} for r, s, t in members], tags))
    return rows


def _dense(raw: bytes, text: list[str], clock: int, degrees, lat0: int, lon0: int) -> list[tuple]:
    m = dict(fields(raw))
    info = dict(fields(m.get(5, b"")))
    run = lambda part, k: np.cumsum(signed(packed(part.get(k, b""))))
    ids, lat, lon = run(m, 1), run(m, 8), run(m, 9)
    versions = packed(info[1]).tolist() if 1 in info else [0] * len(ids)
    times = run(info, 2).tolist() if 2 in info else [None] * len(ids)
    tags: list[list] = [[] for _ in ids]
    at, pairs = 0, packed(m.get(10, b"")).tolist()
    i = 0
    while i < len(pairs):  # a zero ends the tags of a node
        if pairs[i] == 0:
            at, i = at + 1, i + 1
        else:
            tags[at].append({"key": text[pairs[i]], "value": text[pairs[i + 1]]})
            i += 2
    return [(n, v, _time(t, clock), degrees(lon0, x), degrees(lat0, y), g) for n, v, t, x, y, g in zip(ids.tolist(), versions, times, lon.tolist(), lat.tolist(), tags, strict=True)]


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    found = blocks(bare(path))
    arrow = to_arrow_schema(T._parse_datatype_string(_SHAPES[kind]))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(name, "rb") as f:
                    f.seek(at)
                    rows = decoded(inflated(f.read(size)), kind)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(arrow)], schema=arrow)

    listed = spark.createDataFrame(found, "path string, offset long, size long").repartition(max(1, min(len(found), 10_000)), "path", "offset")
    return listed.mapInArrow(read, _SHAPES[kind])


def _located(df: DataFrame, kinds: list[str]) -> DataFrame:
    """`geometry` marked as what it is: WKB in WGS 84."""
    geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": kinds, "crs": None}}}
    return df.withMetadata("geometry", {"geo": json.dumps(geo)})


def osm(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """nodes (id, version, timestamp, lon, lat, tags, geometry), ways (id, version, timestamp, refs, tags,
    geometry) or relations (id, version, timestamp, members, tags). A way has a line if the file has all
    its nodes, and two of them at different places; one place after the other counts once."""
    if kind not in KINDS:
        raise ValueError(f"one of {', '.join(KINDS)}, not {kind}")
    rows = _elements(spark, path, kind)
    if kind == "relations":
        return rows
    if kind == "nodes":
        return _located(rows.withColumn("geometry", point_wkb(F.col("lon"), F.col("lat"))), ["Point"])
    nodes = _elements(spark, path, "nodes").select(F.col("id").alias("n"), "lon", "lat")
    used = rows.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "ref")).join(nodes, F.col("ref") == F.col("n"))
    points = used.groupBy("way").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    moved = lambda p, i: (i == 0) | (p["lon"] != F.col("p")[i - 1]["lon"]) | (p["lat"] != F.col("p")[i - 1]["lat"])
    line = F.flatten(F.transform(F.filter("p", moved), lambda p: F.array(p["lon"], p["lat"])))
    lines = points.select("way", F.size("p").alias("found"), line_wkb(line).alias("geometry"))
    there = F.when(F.col("found") == F.size("refs"), F.col("geometry")).alias("geometry")
    return _located(rows.join(lines, F.col("id") == F.col("way"), "left").select(*rows.columns, there), ["LineString"])
