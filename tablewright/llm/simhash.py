"""SimHash near-dedup through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most
three bits, one segment differs in at most one; so both share that segment as it is, or with one bit
wildcarded. Each distinct fingerprint is indexed under its 2 segments and their 2 * 32 one-wildcard
variants; keys that only one fingerprint has go; those that are left are grouped and verified.

No group is compared in full where it is large. A key of more than DENSE fingerprints is indexed once
more, by the halves of its other segment in the same manner (the key with a wildcard, if it has one,
separates fingerprints by that bit first, as equal ones meet under the plain key). Such a group
leaves at most 18 bits free, so it has at most 2^18 members, and they are linked by looking up the
988 places within three bits. Within a group only a spanning forest of its links is returned, which
keeps every component and never grows with the square of a group.

Defined results: fewer words than a shingle: the whole sequence is one shingle; no word, or null: the
fingerprint is zero, linked like any other; repeated rows and ids each keep their row; an empty table
gives an empty result. Columns besides the named ones are ignored by `near_duplicates`; `one_of_each`
keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .common import cut, row_key, text_batches
from .components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Most fingerprints of a key that are compared pair by pair; beyond it the key is refined.
DENSE = 2048


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have, as an unsigned number; zero for none."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 65_536):
        ones += np.unpackbits(h[part : part + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return batches


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _variants(value: str, bits: int, shift: int) -> str:
    """SQL of array<struct<wild, part, bit>>: the `bits` bits of `value` from `shift` on, as they are
    (wild -1, bit null) and with each one wildcarded (bit being what stood there)."""
    part = f"(shiftright({value}, {shift}) & {(1 << bits) - 1}L)"
    return f"transform(sequence(-1, {bits - 1}), w -> struct(cast(w + {shift} * 100 as int) as wild, if(w < 0, {part}, {part} & ~shiftleft(1L, w)) as part, if(w < 0, null, cast(shiftright({part}, w) & 1 as int)) as bit))"


def keyed(fps: DataFrame) -> DataFrame:
    """(fp, wild, part, bit): the 66 keys of each fingerprint. `wild` names segment and wildcard."""
    both = f"concat({_variants('fp', 32, 0)}, {_variants('fp', 32, 32)})"
    return fps.selectExpr("fp", f"inline({both})")


def near(values: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (member, smallest of its tree).
    Breadth first; each member is compared once with those not reached yet."""
    rest, out = np.sort(values), []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for f in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[f : f + 256, None] ^ rest[None, :]) <= most).any(axis=0)
            front, rest = rest[hit], rest[~hit]
            out += [(int(x), int(root)) for x in front]
    return out


def near_bounded(values: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """The same forest for values that agree in all but a few bits, by looking up each neighbour."""
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [1 << i for i in range(64) if free >> i & 1]
    steps = np.array([sum(c) for k in range(1, most + 1) for c in combinations(bits, k)], np.uint64)
    rest, out = np.sort(values), []
    waiting = np.ones(len(rest), bool)
    for i in range(len(rest)):
        if not waiting[i]:
            continue
        waiting[i] = False
        front = rest[i : i + 1]
        while len(front):
            reached = []
            for f in range(0, len(front), 512):
                at = np.searchsorted(rest, (front[f : f + 512, None] ^ steps[None, :]).ravel())
                want = (front[f : f + 512, None] ^ steps[None, :]).ravel()
                at[at == len(rest)] = 0
                at = np.unique(at[rest[at] == want])
                at = at[waiting[at]]
                waiting[at] = False
                reached.append(rest[at])
            front = np.concatenate(reached)
            out += [(int(x), int(rest[i])) for x in front]
    return out


def _forests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group is linked when the next key begins. Groups of one are passed
    over and groups of two compared at once, as most are such."""

    def batch(ends: np.ndarray) -> pa.RecordBatch:
        ends = ends.reshape(-1, 2).astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def forest(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.unique(np.concatenate(parts))
        bounded = len(values) > DENSE and int(np.bitwise_or.reduce(values ^ values[0])).bit_count() <= 20
        return batch(np.array((near_bounded if bounded else near)(values), np.uint64))

    last, parts = None, []
    for b in it:
        if not b.num_rows:
            continue
        fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
        keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[1:]], axis=1)
        starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1])
        ends = np.concatenate([starts[1:], [len(keys)]])
        inner, size = np.arange(1, len(starts) - 1), ends - starts
        two = inner[size[inner] == 2]
        x, y = fp[starts[two]], fp[starts[two] + 1]
        close = (np.bitwise_count(x ^ y) <= MOST_BITS) & (x != y)
        yield batch(np.stack([x[close], y[close]], axis=1))
        for g in [0, *inner[size[inner] > 2], *([len(starts) - 1] if len(starts) > 1 else [])]:
            if (key := tuple(keys[starts[g]])) != last:
                if parts:
                    yield forest(parts)
                last, parts = key, []
            parts.append(fp[starts[g] : ends[g]])
    if parts:
        yield forest(parts)


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links that join all fingerprints (distinct longs in column fp) within MOST_BITS bits. The
    fingerprints are dealt over all tasks first, as each becomes 66 rows. Spark takes the keys to be as small as
    the file of fingerprints and would send all of them through the driver, so the join is told to merge."""
    keys = keyed(fps.repartition(parallelism(fps.sparkSession), "fp"))
    # under a wildcard only fingerprints that differ in that bit are new to each other
    shared = keys.groupBy("wild", "part").agg(F.count("*").alias("n"), F.min("bit").alias("b0"), F.max("bit").alias("b1"))
    shared = shared.where("n > 1 and not b0 <=> b1 or n > 1 and b0 is null").selectExpr("wild as w", "part as p", "n")
    met = keys.join(shared.hint("merge"), (F.col("wild") == F.col("w")) & (F.col("part") == F.col("p")))
    # the bits of the other segment, by halves, for keys with too many fingerprints
    other = "if(wild < 99, shiftright(fp, 32) & 4294967295L, fp & 4294967295L)"
    fine = f"concat({_variants(f'({other})', 16, 0)}, {_variants(f'({other})', 16, 16)})"
    plain = "array(struct(cast(-9 as int) as wild, 0L as part, cast(null as int) as bit))"
    met = met.selectExpr("fp", "wild", "part", f"explode(if(n > {dense}, {fine}, {plain})) as f").selectExpr("fp", "wild", "part", "f.wild as wild2", "f.part as part2")
    key = ["wild", "part", "wild2", "part2"]
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_forests, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the component).
    The joins merge, and those on the fingerprint have plain exchanges on both sides, so that a fingerprint
    with a large share of all documents is split and nothing is sent through the driver."""
    docs_fp = cut(fingerprints(docs, doc_id, text, width))
    classes = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut(components(links(classes.select("fp"))))
    rooted = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(rooted.join(least.hint("merge"), "root").select(F.col("fp").alias("f"), "component_id"))
    return docs_fp.join(labels.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- documents alike in most of their shingles ------------------------------------------------------
#
# Links are those of texts that share four fifths of their five-word shingles. They are found by the
# method above: each distinct set of hashed shingles has a fingerprint, fingerprints meet by their
# deletion-variant keys and are joined at MOST_BITS by star contraction, and the sets of a component of
# fingerprints are verified exactly. Equal sets are one node throughout.
#
# That joins what differs in little; of texts alike to four fifths just, one bit in seven differs, and
# no number of bits at which groups stay small would show nearly all of them. What is left is completed
# by the smallest values of the shingles under BANDS * ROWS hash functions: two sets of similarity s
# share a band's key with probability s^ROWS, so of pairs at four fifths (1 - 0.8^ROWS)^BANDS = 2 in a
# million share none. Keys whose members the fingerprints have joined already go; those of the others are
# verified as exactly.
#
# The members of a group (`band` below: a band's key, or a component of fingerprints) are compared in one
# task where they are few. One of more than CROWDED members is thinned first, over all tasks: each member is compared with one pivot, and is linked to it
# if alike. One minus the similarity is a distance, so a member at distance x of its pivot cannot be
# linked to another that is further away than x and a link's length together. Linked members to which
# that applies for all that are not linked leave the group, as nothing but the pivot's component is open
# to them. Of a large group of near copies next to nothing stays.

BANDS, ROWS = 25, 4
#: Least similarity (size of the intersection by size of the union) of a link, as a fraction.
ALIKE = (4, 5)
#: Members of a group from which it is thinned, and how often at most.
CROWDED, THINNINGS = 256, 4
#: Odd factors of the hash functions, and of the values in a key.
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS unsigned keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        x = _FACTORS[:, None] * shingles[None, at : at + 512]
        least = np.minimum(least, x.min(axis=1))
    keys = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))) * _FACTORS[:BANDS]


def _node(shingles: np.ndarray) -> int:
    """A set's name as a signed long."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _met(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(t.as_py(), width) for t in b.column(2)]
            fps = np.fromiter((majority(x) for x in sets), np.uint64, len(sets))
            keys = [band_keys(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_node(x) for x in sets], pa.int64()), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "fp", "bands"])

    return batches


def _sets(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["n", "shingles"])

    return batches


def near_sets(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of hashes, as near(); places, not values. Breadth
    first; each member is compared once with those not reached yet."""
    num, den = ALIKE
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    flag = np.zeros(len(ids) and int(ids.max()) + 1, np.int64)
    # `flat` has the members of `rest` one after the other; it is packed anew whenever some are reached
    rest, flat, out = np.arange(len(sets)), ids, []
    while len(rest) > 1:
        root, front = rest[0], [rest[0]]
        flat, rest = flat[size[root] :], rest[1:]
        while front and len(rest):
            x = front.pop()
            mine = ids[start[x] : start[x] + size[x]]
            flag[mine] = 1
            same = np.add.reduceat(flag[flat], np.cumsum(size[rest]) - size[rest])
            flag[mine] = 0
            hit = same * den >= (size[rest] + size[x] - same) * num
            if hit.any():
                front += rest[hit].tolist()
                out += [(int(y), int(root)) for y in rest[hit]]
                flat, rest = flat[np.repeat(~hit, size[rest])], rest[~hit]
    return out


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, shingles) sorted by key; a group is linked when the next key begins."""

    def forest(group: dict[int, bytes]) -> list[tuple[int, int]]:
        nodes = list(group)
        return [(nodes[x], nodes[y]) for x, y in near_sets([np.frombuffer(v, np.uint64) for v in group.values()])]

    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    last, group = None, {}
    for b in it:
        pairs = []
        for key, node, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if len(group) > 1:
                    pairs += forest(group)
                last, group = key, {}
            group[node] = shingles
        yield batch(pairs)
    if len(group) > 1:
        yield batch(forest(group))


def _distances(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, pivot, shingles, others): how many shingles are the same, and how many there are."""
    for b in it:
        same, total = [], []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            same.append(len(np.intersect1d(x, y, assume_unique=True)))
            total.append(len(x) + len(y) - same[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64()), pa.array(total, pa.int64())], names=["node", "pivot", "same", "total"])


def thinned(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """`members` (band, node) without those that need no further comparison, and links (a, b) found on
    the way; `sets` (n, shingles) has the set of each node."""
    num, den = ALIKE
    links = []
    for turn in range(THINNINGS):
        chance = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("pivot"))
        groups = members.groupBy("band").agg(F.count("*").alias("size"), F.min(chance)["pivot"].alias("pivot"))
        groups = cut(groups.where(F.col("size") > CROWDED).select(F.col("band").alias("b"), "pivot"))
        if groups.isEmpty():
            break
        hot = cut(members.join(groups, F.col("band") == F.col("b")).select("band", "node", "pivot"))
        pairs = hot.select("node", "pivot").distinct()  # groups of the same documents have the same pivot
        pairs = pairs.join(sets, F.col("node") == F.col("n")).select("node", "pivot", "shingles")
        pairs = pairs.join(sets.select(F.col("n").alias("m"), F.col("shingles").alias("others")), F.col("pivot") == F.col("m")).select("node", "pivot", "shingles", "others")
        far = cut(pairs.mapInArrow(_distances, "node long, pivot long, same long, total long").selectExpr("node as x", "pivot as y", f"same * {den} >= total * {num} as linked", "1 - same / total as d"))
        links.append(far.where("linked and x != y").select(F.col("x").alias("a"), F.col("y").alias("b")))
        placed = hot.join(far, (F.col("node") == F.col("x")) & (F.col("pivot") == F.col("y"))).select("band", "node", "linked", "d")
        edge = placed.where("not linked").groupBy(F.col("band").alias("e")).agg(F.min("d").alias("least"))
        stay = placed.join(edge, F.col("band") == F.col("e"), "left").where(f"not linked or d >= least - {1 - num / den} - 1e-9")
        rest = members.join(groups, F.col("band") == F.col("b"), "left_anti")
        members = cut(rest.select("band", "node").unionByName(stay.select("band", "node")))
    return members, links


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join the nodes of each group of `members` (band, node) that are alike."""
    members, early = thinned(members, sets)
    met = members.join(sets.hint("merge"), F.col("node") == F.col("n")).select("band", "node", "shingles")
    found = met.repartition("band").sortWithinPartitions("band").mapInArrow(_alike, "a long, b long")
    for more in early:
        found = found.unionByName(more)
    return found


def near_groups(classes: DataFrame) -> DataFrame:
    """(band, node): nodes of `classes` (node, fp) whose fingerprints are in one component, and the smallest
    fingerprint of it; those that no other node is with are left out."""
    roots = cut(components(links(classes.select("fp").distinct()))).withColumnsRenamed({"node": "f", "root": "r"})
    named = cut(classes.join(roots.hint("merge"), F.col("fp") == F.col("f"), "left").select(F.coalesce("r", "fp").alias("band"), "node"))
    shared = named.groupBy("band").count().where("count > 1").select(F.col("band").alias("b"))
    return cut(named.join(shared.hint("merge"), F.col("band") == F.col("b")).select("band", "node"))


def band_groups(classes: DataFrame) -> DataFrame:
    """(band, node): nodes of `classes` (node, bands) that share a band's key; of keys with the same members, one."""
    keys = classes.select("node", "bands").repartition(parallelism(classes.sparkSession), "node").select("node", F.explode("bands").alias("band"))
    groups = keys.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    groups = cut(groups.groupBy("n", "x", "lo", "hi").agg(F.min("band").alias("b")).select("b"))
    return cut(keys.join(groups.hint("merge"), F.col("band") == F.col("b")).select("band", "node"))


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, key, root): key tells rows apart by id and text, root names the component."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    seen = cut(rows.mapInArrow(_met(width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, node long, fp long, bands array<long>"))
    classes = cut(seen.groupBy("node").agg(F.min(F.struct("key", "fp", "bands")).alias("c")).select("node", "c.*"))
    near, banded = near_groups(classes.select("node", "fp")), band_groups(classes)
    met = near.select("node").unionByName(banded.select("node")).distinct()
    wanted = classes.select("node", "key").join(met.hint("merge"), "node").select(F.col("node").alias("n"), F.col("key").alias("k"))
    texts = rows.join(wanted.hint("merge"), F.col("key") == F.col("k")).select("n", "text")
    sets = cut(texts.mapInArrow(_sets(width), "n long, shingles binary").dropDuplicates(["n"]))
    first = cut(components(verified(near, sets))).withColumnsRenamed({"node": "a", "root": "b"})
    # groups of bands that hold more than the fingerprints have joined
    rooted = banded.join(first.hint("merge"), F.col("node") == F.col("a"), "left").select("band", F.coalesce("b", "node").alias("root"))
    parted = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("band").alias("p"))
    left = cut(banded.join(parted.hint("merge"), F.col("band") == F.col("p")).select("band", "node"))
    roots = cut(components(verified(left, sets).unionByName(first))).withColumnsRenamed({"node": "n", "root": "r"})
    return seen.select("doc_id", "key", "node").join(roots.hint("merge"), F.col("node") == F.col("n"), "left").select("doc_id", "key", F.coalesce("r", "node").alias("root"))


def alike(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the component): components of documents whose sets of
    `width`-word shingles are the same to four fifths or more."""
    rows = cut(_labelled(docs, doc_id, text, width))
    least = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "r"))
    return rows.join(least.hint("merge"), F.col("root") == F.col("r")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their component, and of several texts with that
    doc_id, one; of repeated rows of it, all stay. A null doc_id is the largest; of rows without any
    other, one stays."""
    rows = cut(_labelled(docs, doc_id, text, width))
    best = cut(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b")).select(F.col("root").alias("r"), F.col("b.key").alias("best")))
    lost = rows.join(best.hint("merge"), F.col("root") == F.col("r")).where("key != best").select(F.col("key").alias("__lost")).distinct()
    keyed = docs.withColumn("__row_key", row_key(F.col(doc_id), F.col(text)))
    keyed = keyed.where(F.col(doc_id).isNotNull()).unionByName(keyed.where(F.col(doc_id).isNull()).dropDuplicates(["__row_key"]))
    return keyed.join(lost.hint("merge"), F.col("__row_key") == F.col("__lost"), "left_anti").drop("__row_key")
