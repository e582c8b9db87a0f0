"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document: good, bad, or nothing. The votes of all
documents are counted by pattern (there are at most 3 to the power of the labellers, whatever the
corpus), and expectation-maximisation over these counts estimates how accurate each labeller is and
the posterior of each pattern. The posteriors label a bounded sample (TRAIN_DOCS documents of smallest
hash), on which a linear scorer over hashed features is trained: shapes of words and of pairs of
words, and how much of the text repeats. The scorer decides on every document, as it generalises over
patterns on which the labellers are split.

Defined results: a document without a word is rejected with score 0; repeated rows get the same
score; an empty table gives an empty result. Columns besides the named ones are ignored by `scored`;
`kept` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, text_batches
from .linear import fit_sparse
from .rules import repeat_words

#: Frequent words of the corpus's languages.
COMMON_WORDS = frozenset("the of and to in is that it for was on are as with be by this der die das und in den von zu mit sich ein nicht ist im des auf le la les de des et un une que qui en dans est pour pas au el los las y en del se con por para una no su al".encode().split())
#: Hashed features, and most documents that the scorer is trained on.
DIMS, TRAIN_DOCS = 4096, 8000
#: A document is kept from this score on.
KEEP_FROM = 0.5
GOOD, BAD, NONE = "+", "-", "0"
#: So many labellers come first that look for junk and are silent elsewhere; silence of the others,
#: which judge prose of some length, says nothing.
DETECTORS = 6

_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"a+|A+|9+")
_SYMBOLS = b"#*$%&|<>"


def votes(words: list[bytes], repeated: int) -> str:
    """One character for each labeller."""
    n = len(words)
    if not n:
        return "-" * 9
    raw = b" ".join(words)
    letters = sum(map(len, words))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    bare = sum(w.isascii() and not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words)
    doubled = sum(len(w) > 1 and w[-1] == w[-2] and w[-1:] in b"!?*$%&#|" for w in words)
    common = sum(w in COMMON_WORDS for w in words)
    unique = len(set(words)) / n
    mean = letters / n
    bad = lambda found: BAD if found else NONE
    return "".join([
        # detectors of one kind of junk each: silent elsewhere
        bad(symbols >= 0.1 * letters),
        bad(repeated >= 0.3 * n),
        bad(bare >= 0.15 * n),
        bad(upper >= 0.4 * letters),
        bad(doubled >= 0.1 * n),
        bad(mean > 15),
        # labellers of ordinary prose
        GOOD if common >= 0.08 * n else BAD if n >= 30 and common < 0.02 * n else NONE,
        NONE if n < 20 else GOOD if 2.5 <= mean <= 10 else BAD,
        NONE if n < 50 else GOOD if unique >= 0.4 else BAD if unique < 0.25 else NONE,
    ])


def features(raw: bytes, words: list[bytes], repeated: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and values: square roots of the shares of word shapes and of pairs of shapes, and
    a place for the share of repeated words."""
    shapes = _RUNS.sub(lambda m: m[0][:1], raw.translate(_SHAPE)).split()
    counts: dict[bytes, int] = {}
    for s in shapes:
        counts[s] = counts.get(s, 0) + 1
    for s in map(b" ".join, zip(shapes, shapes[1:], strict=False)):
        counts[s] = counts.get(s, 0) + 1
    places = np.fromiter((xxhash.xxh32_intdigest(s) % (DIMS - 16) for s in counts), np.int64, len(counts))
    total = np.bincount(places, np.fromiter(counts.values(), float, len(counts)), DIMS - 16)  # keys that collide are one
    at = np.nonzero(total)[0].astype(np.int32)
    value = np.sqrt(total[at] / max(len(words), 1))
    share = min(15, int(16 * repeated / max(len(words), 1)))
    return np.append(at, np.int32(DIMS - 16 + share)), np.append(value, 1.0)


def _observed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for t in b.column(2):
            raw = (t.as_py() or "").encode()
            words = raw.split()
            repeated = repeat_words(words)
            at, value = features(raw, words, repeated)
            out.append((votes(words, repeated), len(words), at, value.astype(np.float32)))
        arrays = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["doc_id", "key", "votes", "n_words", "at", "value"])


def observe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, votes, n_words, at, value): each document's votes and hashed features; key tells
    rows apart by id and text."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_observed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, votes string, n_words long, at array<int>, value array<float>")


def posteriors(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """Expectation-maximisation over the counts of vote patterns: the posterior of good for each
    pattern, each labeller's accuracy on good and on bad documents where it votes, and the share of
    good ones. It starts from detectors that are rarely wrong and see part of the junk each, which also
    settles which class is which."""
    if not patterns:
        return {}, [], 0.0
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[{GOOD: 1, BAD: 0, NONE: 2}[c] for c in k] for k in keys])
    m = v.shape[1]
    # p[class][labeller][vote]; a detector's silence is a vote
    p = np.stack([np.tile([0.4, 0.2, 0.4], (m, 1)), np.tile([0.02, 0.49, 0.49], (m, 1))])
    p[:, DETECTORS:, 2] = 1
    share = 0.8
    for _ in range(rounds):
        like = np.stack([np.log(p[c][np.arange(m), v]).sum(axis=1) for c in (0, 1)])
        gap = np.clip(like[1] + np.log(share) - like[0] - np.log(1 - share), -500, 500)
        post = 1 / (1 + np.exp(-gap))
        before, share = share, float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for c, w in enumerate((n * (1 - post), n * post)):
            for j in range(m):
                got = np.bincount(v[:, j], w, 3) + 1
                p[c][j] = got / got.sum() if j < DETECTORS else np.append(got[:2] / got[:2].sum(), 1)
        if abs(before - share) < 1e-10:
            break
    accuracy = [(float(p[1][j][1] / (p[1][j][0] + p[1][j][1])), float(p[0][j][0] / (p[0][j][0] + p[0][j][1]))) for j in range(m)]
    return dict(zip(keys, post.tolist(), strict=True)), accuracy, share


def _patterns(seen: DataFrame) -> dict[str, int]:
    return dict(seen.where("n_words > 0").groupBy("votes").count().collect())  # at most 3^9 rows


def labellers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """labeller (its place in the votes), on_good and on_bad (how often it is right where it votes, by
    the model), good_share (of documents that have words); no row for a table without any."""
    _, accuracy, share = posteriors(_patterns(observe(docs, doc_id, text)))
    return docs.sparkSession.createDataFrame([(j, good, bad, share) for j, (good, bad) in enumerate(accuracy)], "labeller int, on_good double, on_bad double, good_share double")


def fit(seen: DataFrame) -> np.ndarray:
    """Weights of the scorer, from rows as observe() gives them."""
    post, _, _ = posteriors(_patterns(seen))
    got = seen.where("n_words > 0").select(F.xxhash64("key").alias("h"), "key", "votes", "at", "value").orderBy("h", "key").limit(TRAIN_DOCS).toArrow()
    if not got.num_rows:
        return np.zeros(DIMS + 1)
    size = np.array([len(x) for x in got["at"]])
    at, value = np.concatenate(got["at"].to_pylist()), np.concatenate(got["value"].to_pylist())
    return fit_sparse(np.repeat(np.arange(len(size)), size), at.astype(int), value, np.array([post[p] for p in got["votes"].to_pylist()]), DIMS)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, key, votes, score (0 to 1, higher is better), kept."""
    seen = cut(observe(docs, doc_id, text))
    weights = fit(seen)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.column(4).to_pylist()
            z = np.array([np.dot(weights[i], v) for i, v in zip(at, b.column(5).to_pylist(), strict=True)]) + weights[-1]
            p = np.where(b.column(3).to_numpy(zero_copy_only=False) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p), pa.array(p >= keep_from)], names=["doc_id", "key", "votes", "score", "kept"])

    return seen.mapInArrow(run, f"doc_id {seen.schema['doc_id'].dataType.simpleString()}, key binary, votes string, score double, kept boolean")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that the scorer keeps."""
    lost = scored(docs, doc_id, text).where("not kept").select(F.col("key").alias("__lost")).distinct()
    keyed = docs.withColumn("__row_key", row_key(F.col(doc_id), F.col(text)))
    return keyed.join(lost, F.col("__row_key") == F.col("__lost"), "left_anti").select(*[keyed[f"`{c}`"] for c in docs.columns])
