"""Exact top-k inner products by aggregation without random access.

The vectors of a block are one sorted list for each component, sorted once, and read best first for
the sign that a query has there. All lists are read to the same depth, which doubles from 1/64 on. A
vector that no list has shown yet can score at most what the last values read add up to; as long as
that is not below a query's floor (the k-th best score so far), nothing can be dropped, and reading
goes on. From there on each vector has an upper bound: its components read so far, and for the others
the last value read of their list. Vectors whose bound is below the floor are out; once few are left,
the query stops reading, and their final scores are resolved. In a first block, which has no floor
yet, lower bounds give one: components read, and for the others the worst value of their list.

The stated query set and the vectors meet in a grid: both are dealt into parts of bounded size, a
query goes to each part of the vectors, and a cell returns its k best for each query, which are ranked
by a window with its own map-side limit. The plan does not grow with the number of queries.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part;
vectors are compared only with those of their length; rows with the query's id are its own; a query id
that repeats is searched once, with its smallest vector; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty result. Scores are exact for any size of
components; one beyond a long is an error. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .common import cut

K = 5
#: Vectors of a block, and queries that read its lists at once.
BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors and queries of a cell of the grid. With few vectors there are cells for every core, of LEAST_PART at least.
VECTOR_PART, QUERY_CHUNK, LEAST_PART = 131_072, 32_768, 1024
#: Shares of the lists read, step by step, and the share of a query's pairs left at which it stops.
DEPTHS, FEW = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 0.7, 0.85), 0.02


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): v = floor(256 * x) of each component x, for vectors that take part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("raw")).where("vec_id is not null and size(raw) > 0")
    rows = rows.select("vec_id", F.col("raw").alias(vector)).where(~bad)
    # floor() to a long would cut components beyond 2^63, which are whole numbers already
    v = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(F.lit(256.0) * x.cast("double")).cast("double")).otherwise(F.lit(256.0) * x.cast("double")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def survivors(x: np.ndarray, lists: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(vector, query) places of the pairs that may be among the k best, by bounds from the sorted
    `lists` of `x`, and how many entries of the lists were read."""
    n, width = x.shape
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    size = float(np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * width)
    slack = 0.0 if size < 2.0**52 else size * 2.0**-45  # rounding, where sums are not exact
    todo, rows, read = np.arange(len(q)), np.arange(n), 0
    found_v, found_q = [], []
    for share in DEPTHS:
        t, last = max(1, int(n * share)), share == DEPTHS[-1]
        last_up, last_down = lists[n - t], lists[t - 1]
        outside = up[todo] @ last_up + down[todo] @ last_down
        known = np.isfinite(floor[todo])
        if last:
            at = todo
        else:
            at = todo[np.where(known, outside < floor[todo] - slack, share >= 0.5)]
        if not len(at):
            continue
        both = np.concatenate([up[at], down[at]], axis=1).T
        high = np.concatenate([np.maximum(x[rows], last_up), np.minimum(x[rows], last_down)], axis=1) @ both
        own = ids[rows][:, None] == qids[at][None, :]
        best = floor[at].copy()
        new = np.nonzero(~np.isfinite(best))[0]
        if len(new) and len(rows) > k:
            low = np.concatenate([np.where(x[rows] >= last_up, x[rows], lists[0]), np.where(x[rows] <= last_down, x[rows], lists[-1])], axis=1) @ both[:, new]
            low[own[:, new]] = -np.inf
            best[new] = np.partition(low, len(rows) - k, axis=0)[len(rows) - k]
        alive = (high >= best - slack) & ~own
        done = alive.sum(axis=0) <= FEW * n
        if last:
            done[:] = True
        v_at, q_at = np.nonzero(alive[:, done])
        found_v.append(rows[v_at])
        found_q.append(at[done][q_at])
        read += int(done.sum()) * t * width
        todo = np.setdiff1d(todo, at[done], assume_unique=True)
        if len(todo) == (~done).sum():  # all that read on have bounds, so a vector that is out for each of them is dropped
            rows = rows[alive[:, ~done].any(axis=1)]
        if not len(todo):
            break
    return np.concatenate([np.zeros(0, int), *found_v]), np.concatenate([np.zeros(0, int), *found_q]), read


def resolved(x: np.ndarray, q: np.ndarray, v_at: np.ndarray, q_at: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs."""
    if not len(v_at):
        return np.zeros(0, np.int64)
    if np.abs(x).max() * np.abs(q).max() * q.shape[1] < 2.0**53:
        parts = [np.einsum("ij,ij->i", x[v_at[i : i + 65_536]], q[q_at[i : i + 65_536]]) for i in range(0, len(v_at), 65_536)]
        return np.concatenate(parts).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x[i], q[j], strict=True)) for i, j in zip(v_at, q_at, strict=True)], np.int64)


def _matrices(table: pa.Table, vec_id: str, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, matrix)}."""
    table = table.combine_chunks()
    ids = table.column(vec_id).to_numpy()
    lists = table.column(vector)
    lengths = lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, int)
    flat, ends, out = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0), np.cumsum(lengths), {}
    for d in np.unique(lengths).tolist():
        at = np.nonzero(lengths == d)[0]
        out[d] = ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)] if len(at) < len(ids) else flat.reshape(-1, d)
    return out


def searched(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, vec_id, score) of the k best vectors of each query, and the entries of lists
    read, those of the scores resolved included."""
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor, read = np.full(len(qids), -np.inf), 0
    for b in range(0, len(ids), BLOCK):
        bi, bx = ids[b : b + BLOCK], x[b : b + BLOCK]
        lists, new = np.sort(bx, axis=0), []
        for f in range(0, len(qids), QUERY_BLOCK):
            part = slice(f, f + QUERY_BLOCK)
            v_at, q_at, n = survivors(bx, lists, bi, q[part], qids[part], floor[part], k)
            new.append((q_at + f, bi[v_at], resolved(bx, q[part], v_at, q_at)))
            read += n + len(v_at) * x.shape[1]
        at, vec, score = (np.concatenate([found[i], *[g[i] for g in new]]) for i in range(3))
        order = np.lexsort((vec, -score, at))
        at, vec, score = at[order], vec[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, vec, score, rank = at[rank < k], vec[rank < k], score[rank < k], rank[rank < k]
        found = at, vec, score
        floor[at[rank == k - 1]] = score[rank == k - 1]
    return *found, read


def _cell(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        there, out = _matrices(vectors, "vec_id", "v"), []
        for d, (qids, q) in _matrices(queries, "query_id", "q").items():
            if d in there:
                at, vec, score, _ = searched(*there[d], qids, q, k)
                out.append(pa.table([qids[at], vec, score], names=["query_id", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors of each query, its own row left out."""
    rows = usable(vectors, vec_id, vector)
    asked = cut(usable(queries, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, m = rows.count(), asked.count()
    across = max(1, -(-n // VECTOR_PART), min(2 * parallelism(vectors.sparkSession), n // LEAST_PART))
    down = max(1, -(-m // QUERY_CHUNK))
    place = F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    # by place in the files, not by id, as one id may stand in many rows
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(across)).cast("int").alias("a"), place.alias("d"))
    right = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"), F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int").alias("d"))
    found = left.groupBy("a", "d").cogroup(right.groupBy("a", "d")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    ranked = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
           where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
