"""Scalar functions as Column expressions; Python only where a byte layout has to be packed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bounds of the size buckets, in bytes.
SIZES = (("xs", 10 << 20), ("s", 100 << 20), ("m", 1 << 30), ("l", 10 << 30))


def size_bucket(n_bytes: Column) -> Column:
    out = F.when(n_bytes.isNull(), None)
    for name, bound in SIZES:
        out = out.when(n_bytes < bound, name)
    return out.otherwise("xl")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or brackets; null where there is none."""
    authority = F.lower(F.trim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    authority = F.regexp_replace(authority, "^.*@", "")
    six = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    host = F.when(six != "", six).otherwise(F.regexp_extract(authority, r"^([^:]*)", 1))
    return F.when(host != "", host)


def url_decision(url: Column, blocked: Column | None = None, bypass: bool = False) -> Column:
    """allowed, blocked_scheme or blocked_by_host. `blocked` is a condition on the host. With `bypass`
    everything is allowed_bypass."""
    if bypass:
        return F.lit("allowed_bypass")
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = host_of(F.trim(url))
    fine = scheme.isin("http", "https") & host.isNotNull() & ~host.endswith(".onion")
    out = F.when(~F.coalesce(fine, F.lit(False)), "blocked_scheme")
    if blocked is not None:
        out = out.when(blocked, "blocked_by_host")
    return out.otherwise("allowed")


def iso_millis(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 in UTC; the fraction only where there is one."""
    ts = F.timestamp_millis(ms)
    fraction = F.when(F.pmod(ms, F.lit(1000)) != 0, F.concat(F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("000"))).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


#: What may stand right before a path of a machine, the first folders of such paths, words that
#: make a query key secret wherever they stand in it, whole keys, and beginnings of keys.
PATH_LEADS = r"[\s\"'`=,;:\[(<]"
HOST_ROOTS = ("home", "Users", "root", "srv", "tmp", "var/tmp", "var/folders", "private", "mnt", "media", "opt", "scratch")
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "credential", "signature")
SECRET_KEYS = ("key", "sig", "auth", "pwd")
SECRET_STARTS = ("x-amz-", "x-goog-")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def redacted(text: Column) -> Column:
    """Credentials of URLs and paths of machines replaced by a mark: a user part with or without a
    password (digits and a slash behind a colon are a port and a path), values of secret query keys,
    and paths under HOST_ROOTS or a Windows user's folder."""
    user, password = r"[^@:/?#\s]+", r"(?!\d*/)[^@?#\s]*"
    out = F.regexp_replace(text, rf"(?<=[A-Za-z0-9+.-]://){user}(?::{password})?@", "<redacted-credential>@")
    part = r"[\w.-]*"
    key = rf"{part}{_any(SECRET_WORDS)}{part}|{_any(SECRET_KEYS)}|{_any(SECRET_STARTS)}[a-z-]+"
    out = F.regexp_replace(out, rf"(?i)([?&;])({key})=[^&#\s\"']+", "$1$2=<redacted-credential>")
    lead, rest, end = rf"(?:^|(?<={PATH_LEADS})|(?<=file://))", r"[^\s\"']*", r"(?=[\s\"']|$)"
    out = F.regexp_replace(out, rf"{lead}/{_any(HOST_ROOTS)}(?:/{rest}|{end})", "<redacted-path>")
    return F.regexp_replace(out, rf"{lead}[A-Za-z]:\\Users\\{rest}", "<redacted-path>")


def is_number(text: Column) -> Column:
    """Whether the text is a number that its decimal form gives back."""
    return F.coalesce(F.try_to_number(text, F.lit("S999999999999D999999")).isNotNull() | text.try_cast("decimal(38,10)").isNotNull(), F.lit(False))


def optional_int(text: Column) -> Column:
    """A whole number that may begin with "+"; "?" and "" are null, anything else fails."""
    return F.when(~text.isin("?", ""), F.regexp_replace(F.trim(text), r"^\++", "").cast("int"))


def reversible(value: Column, narrow: str, wide: str) -> Column:
    """Whether a cast to `narrow` loses nothing."""
    return value.isNull() | value.try_cast(narrow).cast(wide).eqNullSafe(value)


#: The signs of a sparkline, a blank and eight heights.
SPARKS = " ▁▂▃▄▅▆▇█"


def sparkline(counts: Column) -> Column:
    """A sign for each count by its share of the largest, rounded half to even; blanks for zeros only."""
    top = F.array_max(counts)
    place = lambda c: F.coalesce(F.rint(F.try_divide(c, top) * (len(SPARKS) - 1)), F.lit(0.0)).cast("int") + 1
    return F.array_join(F.transform(counts, lambda c: F.substring(F.lit(SPARKS), place(c), F.lit(1))), "")


@F.pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Well-known binary of points, little-endian; null where a coordinate is."""
    packed = np.zeros(len(x), [("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
    packed["order"], packed["kind"], packed["x"], packed["y"] = 1, 1, x, y
    raw, size = packed.tobytes(), packed.itemsize
    out = pd.Series([raw[i : i + size] for i in range(0, len(raw), size)], dtype=object)
    return out.where(~(x.isna() | y.isna()).reset_index(drop=True), None)


@F.pandas_udf(T.BinaryType())
def line_wkb(xy: pd.Series) -> pd.Series:
    """Well-known binary of a line from a flat list x, y, x, y, ...; null for less than two points."""
    head = np.array([(1, 2, 0)], [("order", "u1"), ("kind", "<u4"), ("points", "<u4")])

    def one(v) -> bytes | None:
        if v is None or len(v) < 4:
            return None
        head["points"] = len(v) // 2
        return head.tobytes() + np.asarray(v, "<f8").tobytes()

    return xy.map(one)


def type_text(label: str) -> str:
    """A type's label with the bodies of structs left out, so that structs of any shape are one type."""
    out, depth, at = [], 0, 0
    while at < len(label):
        opened = next((w for w in ("struct<", "STRUCT(") if label.startswith(w, at)), None)
        if depth:
            depth += (label[at] in "<(") - (label[at] in ">)")
            if not depth:
                out.append("..." + label[at])
        elif opened:
            out.append(opened)
            depth, at = 1, at + len(opened) - 1
        else:
            out.append(label[at])
        at += 1
    return "".join(out)


def lossy_text(raw: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))
