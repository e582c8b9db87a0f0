"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end as one stream of words, which is
cut into blocks of equal size. The schedule has one slot for each block taken. Slot i belongs to the
van der Corput point rev(i), the reversed bits of i; the point falls into one source's share of the
cumulative weights; slots are ranked within their source, and the slot of rank r takes block r modulo
the source's number of blocks. A prefix of the schedule is thus near the target weights, whatever its
length. All points of a whole period are used, so each source gets exactly the slots that its target
needs, and the last slot is cut to the words still missing: the words taken are floor(target).

Defined results: a null text has size 0; a null source is a source of its own, the last; a source
without words gets target 0; repeated rows count each for itself; ties of the shuffle are broken by
doc_id, then size; an empty table gives an empty result. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .common import cut, n_words

#: Weights by rank of the source in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of all targets together, as a share of all words; most of a source's words, as a share of its own.
TOTAL_SHARE, MOST_SHARE = 1.5, 2
#: Words of a block.
BLOCK_WORDS = 1024
#: Hexadecimal digits of the shuffling hash that make a bucket: prefix sums run over 16^3 buckets of
#: a source first, then inside each bucket, so no task sorts a whole source.
BUCKET_DIGITS = 3
#: Slots of a source that are made together, and most slots of a task.
CHUNK_SLOTS, TASK_SLOTS = 8192, 1 << 20


def shuffled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, h): the size in words and the place in the shuffle."""
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    return out.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most_share: int = MOST_SHARE) -> DataFrame:
    """(source, source_size) -> with target: `total_share` of all words by weight; a target stops at
    `most_share` of the source's words, and what is over goes to the others by weight. That is the
    water level of min(cap, level * weight), found by sorting the sources by cap / weight; the windows
    run over one row for each source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        per_source.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) - 1 as pos", "sum(source_size) over () as all_size")
        .withColumn("w", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most_share)
        .selectExpr(
            "*",
            "coalesce(sum(cap) over (order by cap / w, pos rows between unbounded preceding and 1 preceding), 0) as cap_before",
            "sum(w) over () - coalesce(sum(w) over (order by cap / w, pos rows between unbounded preceding and 1 preceding), 0) as w_left",
        )
        .withColumn("level", (F.lit(float(total_share)) * F.col("all_size") - F.col("cap_before")) / F.col("w_left"))
        .selectExpr("source", "source_size", "pos", "w", "cap", "coalesce(max(case when level * w <= cap then level end) over (), 0D) as level")
        .selectExpr("source", "source_size", "pos", "least(cast(cap as double), level * w) as target")
    )


def quotas(with_target: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds what the schedule needs of each source: words to take, blocks, slots, and the source's
    interval [lo, hi) of points of `bits` bits."""
    return (
        with_target.withColumn("words", F.floor("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("rest", F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(0).cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.expr("(words div source_size) * blocks") + F.ceil(F.col("rest") / block_words)).otherwise(0).cast("long"))
        .selectExpr("*", "sum(slots) over (order by pos rows unbounded preceding) as hi", "greatest(length(bin(greatest(sum(slots) over (), 1) - 1)), 1) as bits")
        .withColumn("lo", F.col("hi") - F.col("slots"))
    )


def schedule(quota: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each slot: slot (its place in the mix, with gaps up to the next power of two),
    source, rank, block, words. The rank is the number of earlier slots whose point lies in the
    source's interval; for reversed bits it is a sum over the bits of the point, so no sort is needed."""
    below = (
        "aggregate(sequence(0, bits - 1), 0L, (n, m) -> n + case when (point >> m) & 1 = 0 then 0L else "
        "greatest(0L, least(1L << (bits - 1 - m), ({end} - (point & ((1L << m) - 1)) + (1L << (m + 1)) - 1) div (1L << (m + 1)))) end)"
    )
    chunks = quota.where("slots > 0").selectExpr("*", f"explode(sequence(lo, hi - 1, {CHUNK_SLOTS}L)) as chunk")
    total, n = quota.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("slots") / CHUNK_SLOTS)), F.lit(0))).first()
    tasks = max(1, min(n, max(parallelism(quota.sparkSession), -(-total // TASK_SLOTS))))
    return (
        chunks.repartition(tasks)
        .selectExpr("*", f"explode(sequence(chunk, least(chunk + {CHUNK_SLOTS} , hi) - 1)) as point")
        .withColumn("slot", F.expr("cast(conv(reverse(lpad(bin(point), bits, '0')), 2, 10) as long)"))
        .withColumn("rank", F.expr(below.format(end="hi")) - F.expr(below.format(end="lo")))
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn("block_size", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words))
        .withColumn("words", F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest") - F.col("block") * block_words).otherwise(F.col("block_size")))
        .select("slot", "source", "pos", "rank", "block", "words", "block_size")
    )


def _joined(docs: DataFrame, doc_id: str, text: str, source: str, block_words: int) -> DataFrame:
    """The slots joined to the documents of their blocks: the columns of a document (start is its place
    in the source's stream), block, slot, first (word of the document) and words. A piece of a document
    that no slot takes, and a document without words, have null slots."""
    rows = cut(shuffled(docs, doc_id, text, source).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    quota = cut(quotas(targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))), block_words))
    starts = by_bucket.selectExpr("source as s", "bucket as b", "coalesce(sum(bucket_size) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0) as bucket_start")
    starts = starts.join(quota.select(F.col("source").alias("q"), "pos", "source_size", "target"), F.col("s").eqNullSafe(F.col("q")))
    placed = (
        rows.selectExpr("doc_id", "source", "size", "bucket", "sum(size) over (partition by source, bucket order by h, doc_id, size rows unbounded preceding) - size as within")
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .selectExpr("doc_id", "source", "pos", "size", "source_size", "target", "bucket_start + within as start", "monotonically_increasing_id() as row")
    )
    pieces = placed.selectExpr("*", f"explode(if(size > 0, sequence(start div {block_words}, (start + size - 1) div {block_words}), array(-1L))) as block")
    slots = schedule(quota, block_words).select("slot", F.col("pos").alias("p"), F.col("block").alias("at"), F.col("words").alias("most"))
    words = f"least(start + size, block * {block_words} + most) - greatest(start, block * {block_words})"
    met = (F.col("pos") == F.col("p")) & (F.col("block") == F.col("at")) & (F.expr(words) > 0)
    first = f"greatest(start, block * {block_words}) - start"
    # slots grow with the words, and pack so well that their bytes on disk would pass for a table to broadcast
    return pieces.join(slots.hint("merge"), met, "left").selectExpr("row", "doc_id", "source", "pos", "size", "source_size", "target", "start", "block", "slot", f"{first} as first", f"if(slot is null, 0L, {words}) as words")


def sequence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, block, start, doc_id, first, words: the mix itself. In the order of slot and start
    it is read off as `words` words of each document, from word `first` on."""
    return _joined(docs, doc_id, text, source, block_words).where("slot is not null").select("slot", "source", "block", "start", "doc_id", "first", "words")


def _taken(docs: DataFrame, doc_id: str, text: str, source: str, block_words: int) -> DataFrame:
    """One row for each document, with taken and slots: where it begins, each time that it is taken."""
    begins = F.array_sort(F.collect_list(F.when(F.col("first") == 0, F.col("slot"))))
    by = ["row", "doc_id", "source", "size", "source_size", "target"]
    return _joined(docs, doc_id, text, source, block_words).groupBy(*by).agg(F.sum("words").alias("taken"), begins.alias("slots"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many of a document's words the mix takes,
    repeats counted, summed over `sequence`. No document is taken more than twice, as no target is over
    twice its source."""
    return _taken(docs, doc_id, text, source, block_words).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it (never, once or twice; the one document of
    a source that is taken in part, by what is nearer), in the order of the slots at which it begins, so
    that a prefix is near the weights. Rows equal in id, source and size share what they are taken."""
    took = _taken(docs, doc_id, text, source, block_words).where("size > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    took = took.agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("__times"), F.max(F.struct(F.size("slots").alias("n"), "slots"))["slots"].alias("__slots")).where("__times > 0")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source")) & (n_words(F.col(text)) == F.col("__size"))
    rows = docs.join(took, same).withColumn("__slot", F.explode(F.slice("__slots", F.lit(1), F.col("__times"))))
    return rows.orderBy("__slot").drop("__id", "__source", "__size", "__times", "__slots", "__slot")


#: The same mix without schedule or blocks: `words` words of a circular stream take a document's
#: words once for each whole round, and once more where the rest of a round reaches it.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, row_number() over (order by source asc nulls last) - 1 as pos, sum(source_size) over () as all_size from s),
c as (select *, case pos % 3 when 0 then 3 when 1 then 1 else 2 end as w, 2 * source_size as cap from w),
o as (select *, coalesce(sum(cap) over (order by cap / w, pos rows between unbounded preceding and 1 preceding), 0) as cap_before,
             sum(w) over () - coalesce(sum(w) over (order by cap / w, pos rows between unbounded preceding and 1 preceding), 0) as w_left from c),
l as (select *, (1.5::double * all_size - cap_before) / w_left as level from o),
t as (select source, source_size, least(cap::double, coalesce(max(case when level * w <= cap then level end) over (), 0) * w) as target from l),
p as (select d.*, t.source_size, t.target, cast(floor(t.target) as bigint) as words,
             sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows unbounded preceding) - d.size as start
      from d join t on d.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       cast(case when source_size = 0 then 0 else (words // source_size) * size + greatest(0, least(size, words % source_size - start)) end as bigint) as taken
from p
"""
