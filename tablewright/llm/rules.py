"""Quality rules: base statistics of each text, and cross-document line frequency.

Lines are normalised (words joined by one space, A-Z lower-cased) and hashed to 128 bits; for each
host the documents that hold a line are counted, exact copies of a text as one, as they are repeated
documents and no frequent lines; a line in more documents than the host's limit is removed, and a
document of which too few words are left is rejected as depleted. The limit is a share of the host's
documents, between a floor for small hosts and a ceiling, so that it does not grow with a large host.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of
its own; repeated rows are copies, and each is judged; an empty table gives an empty result. Columns
besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Base limits: fewest words, and most words in repeated windows, in percent.
MIN_WORDS, MOST_REPEAT = 20, 30
#: A line is frequent in more than this percentage of its host's documents, taken as LEAST_DOCS at least and
#: MOST_DOCS at most.
MAX_SHARE, LEAST_DOCS, MOST_DOCS = 10, 5, 20
#: A document is depleted if less than this percentage of its words is left.
LEAST_LEFT = 30
#: Parts that the lines of a host are dealt over in the join with its frequent lines.
SALTS = 8

_BASE = "doc_id {id}, host string, copy binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:binary,words:int>>"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # a linear hash of each window tells quickly that nothing repeats; equal hashes are then compared in full
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h, spread = np.zeros(n, np.uint64), (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        spread ^= spread >> np.uint64(29)
        for k in range(window):
            h = h * mult + spread[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[suspects]
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    found = suspects[count[which.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int, list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the distinct normalised lines
    as hash and words in the text."""
    raw = (text or "").encode()
    words = raw.split()
    space = len(raw) - sum(map(len, words))
    seen, dup, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        if own := line.split():
            dup += line in seen
            seen.add(line)
            key = xxhash.xxh128_digest(b" ".join(own).lower())
            lines[key] = lines.get(key, 0) + len(own)
    return len(words), len(text or "") - space, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(words), [{"line": k, "words": v} for k, v in lines.items()]


def _base_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int32())]))
    for b in batches:
        got = [base(t.as_py()) for t in b.column(2)]
        numbers = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
        copies = pa.array([xxhash.xxh128_digest((t.as_py() or "").encode()) for t in b.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), copies, *numbers, pa.array([g[5] for g in got], line)], names=["doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def frequent_lines(lines: DataFrame, hosts: DataFrame, max_share: int = MAX_SHARE, least_docs: int = LEAST_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, line) of the lines above their host's limit, from one row for each document and distinct
    line, and (host, docs). Counts are partial before the shuffle, so a hot line is no hot key."""
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    limit = F.least(F.greatest(F.col("docs") * max_share, F.lit(100 * least_docs)), F.lit(100 * most_docs))
    return often.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") * 100 > limit).select("host", "line")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_share: int = MAX_SHARE, least_docs: int = LEAST_DOCS, most_docs: int = MOST_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """doc_id, the base statistics, removed_words (in frequent lines), base_failed, kept."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    light = rows.mapInArrow(_base_batches, _BASE.format(id=rows.schema["doc_id"].dataType.simpleString()))
    light = cut(light.withColumn("row", F.monotonically_increasing_id()))  # written once, so the ids stay
    lines = light.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    texts = light.groupBy("host", "copy").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    again = cut(texts.where("n > 1").select(F.col("host").alias("h"), F.col("copy").alias("c"), "first"))
    once = light.join(again, (F.col("copy") == F.col("c")) & F.col("host").eqNullSafe(F.col("h")), "left").where("first is null or row = first")
    counted = once.select("host", F.explode("lines.line").alias("line"))
    heavy = cut(frequent_lines(counted, texts.groupBy("host").agg(F.count("*").alias("docs")), max_share, least_docs, most_docs))
    dealt = heavy.select(F.col("host").alias("h"), F.col("line").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    hit = lines.join(dealt, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")) & (F.pmod("row", F.lit(SALTS)) == F.col("s")))
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT)
    left = (F.col("n_words") - F.col("removed_words")) * 100 >= F.col("n_words") * least_left
    return (
        light.drop("lines", "host", "copy")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & left)
        .drop("row")
    )


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
win as (select r, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) > 8),
keyed as (select r, i, array_to_string(ws[i:i + 7], ' ') as k from win),
twice as (select r, i from (select r, i, count(*) over (partition by r, k) as c from keyed) where c > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
ln as (select r, host, unnest(string_split(text, chr(10))) as line from d),
good as (select r, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n from good group by r),
nl as (select r, host, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k, len(ws) as n from good),
hosts as (select host, count(distinct text) as docs from d group by host),
txt as (select r, text from d),
heavy as (select nl.host, k from nl join txt using (r) join hosts on nl.host is not distinct from hosts.host group by nl.host, k, docs
          having count(distinct text) * 100 > least(greatest(docs * 10, 500), 2000)),
gone as (select r, sum(n) as n from nl where exists (select 1 from heavy where heavy.k = nl.k and heavy.host is not distinct from nl.host) group by r),
b as (select doc_id, cast(len(ws) as bigint) as n_words,
             cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
             cast(coalesce(gone.n, 0) as bigint) as removed_words
      from w left join rep using (r) left join dup using (r) left join gone using (r))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and (n_words - removed_words) * 100 >= n_words * 30 as kept
from b
"""
