"""Line dedup by distinct-site spread.

Lines are normalised and hashed; a HyperLogLog sketch of the sites that hold each line is built by
partial aggregation and merged in the shuffle. Lines whose estimate is near the threshold get an exact
distinct count. A line on SITES sites or more is boilerplate: it stays in the first document that has
it (smallest doc_id) and is removed everywhere else, so no content leaves the corpus.

With SPREAD every line that has a word counts: fewer sites are asked of longer lines, and documents
rather than sites are counted for lines of LONG words or more, as such passages may be repeated within
one site. With a plain number of `sites` there is one threshold, and lines of fewer than MIN_WORDS
words stay. `kept`, for the pipeline, keeps of exact copies of a text the first, as all lines of the
others stand there; they would be left as fragments of their shorter lines otherwise.

Defined results: a null text stays null with no lines; a null site is a site of its own; empty lines
are never removed; a document with a null doc_id is
never the first; repeated rows are treated alike; an empty table gives an empty result. Further
columns pass through `dedup` under their own names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, row_key, text_batches

#: Sites on which a line counts as boilerplate, and the fewest words of a line that can.
SITES, MIN_WORDS = 10, 4
#: (fewest words of a line, sites that it needs), and from how many words on documents count.
SPREAD, LONG = ((1, 15), (2, 10), (4, 5), (20, 3), (50, 2)), 20
#: Size of a sketch (2^LG_K slots), and the relative error beyond which its estimate is trusted: three
#: standard errors of 1.04 / 2^(LG_K / 2), and one site at least.
LG_K, BAND = 12, 0.05
#: Parts that the rows of a line are dealt over where its sites are counted exactly.
SALTS = 32


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str, spread: tuple[tuple[int, int], ...] = ((MIN_WORDS, SITES),), long: int | None = None) -> DataFrame:
    """(key, doc_id, site, pos, line, need): a row for each line that can be boilerplate, and the sites
    it needs. Lines of `long` words or more have their document for site."""
    own = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit(""))
    unit = F.concat(F.lit("d"), F.coalesce(F.col(doc_id).cast("string"), F.md5(text)))
    rows = docs.select(row_key(F.col(doc_id), F.col(site), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), own.alias("site"), unit.alias("unit"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("norm", normalised(F.col("raw"))).where("norm != ''")
    words = F.size(F.split("norm", " ", max(long or 0, *[n for n, _ in spread])))
    rows = rows.withColumn("words", words).where(F.col("words") >= min(n for n, _ in spread))
    need = F.lit(None).cast("int")
    for n, sites in sorted(spread):
        need = F.when(F.col("words") >= n, sites).otherwise(need)
    if long is not None:
        rows = rows.withColumn("site", F.when(F.col("words") >= long, F.col("unit")).otherwise(F.col("site")))
    return rows.select("key", "doc_id", "site", "pos", F.unhex(F.md5("norm")).alias("line"), need.alias("need"))


def boilerplate(lines: DataFrame, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(line, first): the boilerplate lines and the smallest doc_id that has each."""
    est = lines.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first"), F.min("need").alias("need"), (F.min("site") != F.max("site")).alias("several"))
    est = est.where("several or need < 2").select("line", "first", "need", F.hll_sketch_estimate("sketch").alias("estimate"))
    width = F.greatest(F.lit(1.0), F.col("need") * band)
    est = cut(est.where(F.col("estimate") >= F.col("need") - width))
    near = est.where(F.col("estimate") <= F.col("need") + width)
    # a common line is dealt over SALTS parts, and its sites meet again by line and site, each part having one row of each
    dealt = near.select(F.col("line").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    held = lines.join(dealt, (F.col("line") == F.col("l")) & (F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)) == F.col("s")), "left_semi")
    exact = held.select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("exact"))
    return est.join(exact, "line", "left").where(F.coalesce("exact", "estimate") >= F.col("need")).select("line", "first")


def owned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` with __owner, the smallest doc_id of the rows with the same text. The join has plain
    exchanges on both sides, so that a text with a large share of all rows is split."""
    coded = docs.withColumn("__text_key", F.unhex(F.md5(F.col(text))))
    copies = cut(coded.groupBy("__text_key").agg(F.min(doc_id).alias("__owner"), F.count("*").alias("n")).where("n > 1 and __text_key is not null").select(F.col("__text_key").alias("__same"), "__owner"))
    return coded.join(copies, F.col("__text_key") == F.col("__same"), "left").withColumn("__owner", F.coalesce("__owner", F.col(doc_id))).drop("__text_key", "__same")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, gone in zip(b.column("__text").to_pylist(), b.column("__gone").to_pylist(), strict=True):
            if text is not None and gone:
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            texts.append(text)
        keep = [i for i, name in enumerate(b.schema.names) if name not in ("__text", "__gone")]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(texts, pa.string())], names=[*[b.schema.names[i] for i in keep], "__text"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, spread: tuple[tuple[int, int], ...] | None = None, long: int | None = None) -> DataFrame:
    """`docs` with boilerplate lines removed from `text`, and line_count and removed_lines behind its
    columns. `spread` takes the place of the one threshold of `sites`."""
    return _removed(docs, doc_id, text, site, line_rows(docs, doc_id, text, site, spread or ((MIN_WORDS, sites),), long))


def _removed(docs: DataFrame, doc_id: str, text: str, site: str, rows: DataFrame) -> DataFrame:
    """As dedup(), by the rows of line_rows()."""
    text_batches(docs.sparkSession)
    lines = cut(rows)
    marked = cut(boilerplate(lines))
    gone = lines.join(marked, "line").where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("key").agg(F.collect_set("pos").alias("__gone"))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    inner = inner.withColumn("__key", row_key(F.col(at[doc_id]), F.col(at[site]), F.col(at[text])))
    joined = inner.join(gone, F.col("__key") == F.col("key"), "left").drop("__key", "key")
    joined = joined.withColumn("__lines", F.coalesce(F.size(F.split(at[text], "\n", -1)), F.lit(0)).cast("long")).withColumn("__lines", F.when(F.col(at[text]).isNull(), 0).otherwise(F.col("__lines")).cast("long"))
    joined = joined.withColumn("__removed", F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long")).withColumnRenamed(at[text], "__text")
    rest = [c for c in joined.columns if c not in ("__text", "__gone")]
    schema = joined.select(*rest, "__text").schema
    out = joined.mapInArrow(_without, schema).withColumnRenamed("__text", at[text])
    return out.select(*[F.col(f"c{i}") for i in range(len(names))], "__lines", "__removed").toDF(*names, "line_count", "removed_lines")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", spread: tuple[tuple[int, int], ...] = SPREAD, long: int | None = LONG) -> DataFrame:
    """The columns of `docs`; a document goes if removal left none of its words, or if a smaller doc_id
    has the same text, as all its lines stand in other documents. One that had no words before stays."""
    out = _removed(owned(docs, doc_id, text), doc_id, text, site, line_rows(docs, doc_id, text, site, spread, long))
    empty = n_words(F.col(text)) == 0
    return out.where(F.when(F.col("removed_lines") == 0, empty).otherwise(False) | ~empty & F.col("__owner").eqNullSafe(F.col(doc_id))).select(*docs.columns)


ORACLE_SQL = r"""
with l as (select doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as raw from documents),
n as (select *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) as norm from l),
w as (select *, case when norm = '' then 0 else len(string_split(norm, ' ')) end as words from n),
b as (select norm, min(doc_id) as first from w where words > 0 group by norm, words
      having count(distinct case when words >= 20 then 'd' || coalesce(doc_id::varchar, md5(text)) else coalesce('s' || source, '') end)
             >= case when words >= 50 then 2 when words >= 20 then 3 when words >= 4 then 5 when words >= 2 then 10 else 15 end),
k as (select w.doc_id, w.source, w.text, pos, raw, b.norm is not null and w.doc_id is distinct from b.first as gone from w left join b on w.norm = b.norm)
select doc_id, cast(count(*) as bigint) as line_count, cast(count(*) filter (gone) as bigint) as removed_lines,
       coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as text
from k group by doc_id, source, k.text
"""
