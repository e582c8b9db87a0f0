"""SAS transport files, version 5: records of 80 bytes, numbers as IBM floats, text padded with blanks.

One file is one task, read in pieces. Text is UTF-8 if all of the file's is, else Latin-1. Labels stand in
the columns' metadata. A missing number is null; text loses the blanks at its end. Files must be where
the driver and the workers can open them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import BadRecord, bare

RECORD, PIECE_ROWS = 80, 65_536
#: How header records begin, formats of dates and of times of day with a date, and the day zero.
HEADER = b"HEADER RECORD*******"
DATES, DATETIMES = ("DATE", "MMDDYY", "DDMMYY", "YYMMDD", "JULIAN", "E8601DA"), ("DATETIME", "E8601DT")
EPOCH_DAYS = 3653  # from 1960-01-01 to 1970-01-01


@dataclass(frozen=True)
class Variable:
    name: str
    label: str
    kind: str  # double, date, timestamp_ntz or string
    size: int
    at: int


def ibm_doubles(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of rows of up to 8 bytes each: a sign, an exponent of 16 and a fraction of 56 bits."""
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, : raw.shape[1]] = raw
    mark = full[:, 0]
    missing = (full[:, 1:] == 0).all(axis=1) & ((mark == ord(".")) | (mark == ord("_")) | ((mark >= ord("A")) & (mark <= ord("Z"))))
    bits = full.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(float)
    value = np.ldexp(fraction, 4 * ((mark & 127).astype(int) - 64) - 56)
    return np.where(mark & 128, -value, value), missing


def variables(path: str) -> tuple[list[Variable], int]:
    """The file's columns, and where its rows begin. Files with several tables are refused."""
    with open(path, "rb") as f:
        data = f.read(RECORD * 3)
        if not data.startswith(HEADER + b"LIBRARY"):
            raise BadRecord(f"{path} is no transport file of version 5")
        width = 140
        while True:
            record = f.read(RECORD)
            if len(record) < RECORD:
                raise BadRecord(f"{path} ends within its headers")
            if record.startswith(HEADER + b"MEMBER"):
                width = int(record[74:78] or width)
            if record.startswith(HEADER + b"NAMESTR"):
                count = int(record[54:58])
                break
        block = f.read(-(-count * width // RECORD) * RECORD)
        found = []
        for i in range(count):
            one = block[i * width : (i + 1) * width]
            kind, _, size, _ = struct.unpack(">hhhh", one[:8])
            name, label, form = (one[a:b].decode("latin-1").strip(" \0") for a, b in ((8, 16), (16, 56), (56, 64)))
            stem = form.rstrip("0123456789.")
            of = "string" if kind == 2 else "date" if stem in DATES else "timestamp_ntz" if stem in DATETIMES else "double"
            found.append(Variable(name, label, of, size, struct.unpack(">i", one[84:88])[0]))
        if not f.read(RECORD).startswith(HEADER + b"OBS"):
            raise BadRecord(f"{path}: no rows where they should begin")
        return found, f.tell()


def _pieces(path: str, found: list[Variable], start: int) -> Iterator[np.ndarray]:
    """Rows as bytes. What fills the last record up are blanks, less than a record of them; a row of
    blanks there is no row."""
    width = max(v.at + v.size for v in found)
    with open(path, "rb") as f:
        f.seek(0, 2)
        size = f.tell() - start
        f.seek(start)
        rows = size // width
        while rows:
            raw = np.frombuffer(f.read(width * min(rows, PIECE_ROWS)), np.uint8).reshape(-1, width)
            if HEADER + b"MEMBER" in raw.tobytes():
                raise BadRecord(f"{path} holds more than one table")
            rows -= len(raw)
            if not rows:
                keep = len(raw)
                while keep and (len(raw) - keep + 1) * width <= RECORD - 1 and (raw[keep - 1] == 32).all():
                    keep -= 1
                raw = raw[:keep]
            yield raw


def _batch(raw: np.ndarray, found: list[Variable], encoding: str, schema: pa.Schema) -> pa.RecordBatch:
    out = []
    for v, field in zip(found, schema, strict=True):
        cells = np.ascontiguousarray(raw[:, v.at : v.at + v.size])
        if v.kind == "string":
            out.append(pa.array([bytes(c).decode(encoding).rstrip(" \0") for c in cells], field.type))
            continue
        value, missing = ibm_doubles(cells)
        if v.kind == "date":
            value = (value - EPOCH_DAYS).astype("datetime64[D]")
        elif v.kind == "timestamp_ntz":
            value = np.round((value - EPOCH_DAYS * 86_400) * 1e6).astype("int64").astype("datetime64[us]")
        out.append(pa.array(value, field.type, mask=missing))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def xport(spark: SparkSession, path: str) -> DataFrame:
    """The one table of the file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    file = bare(path)
    found, start = variables(file)
    types = {"double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}
    schema = T.StructType([T.StructField(v.name, types[v.kind], True, {"sas_label": v.label} if v.label else {}) for v in found])
    arrow = to_arrow_schema(schema)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name in b.column(0).to_pylist():
                encoding = "utf-8"
                try:
                    for raw in _pieces(name, found, start):
                        for v in found:
                            if v.kind == "string":
                                for cell in np.ascontiguousarray(raw[:, v.at : v.at + v.size]):
                                    bytes(cell).decode()
                except UnicodeDecodeError:
                    encoding = "latin-1"
                for raw in _pieces(name, found, start):
                    yield _batch(raw, found, encoding, arrow)

    return spark.createDataFrame([(file,)], "path string").mapInArrow(read, schema)
