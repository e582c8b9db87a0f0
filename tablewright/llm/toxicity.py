"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one trained on ordinary windows, and one that
has, behind the same bytes, the words and beginnings of words that toxic windows have in excess.
(zstandard's own trainer on toxic windows spends the dictionary on what both kinds of text share; the
README has figures of what was tried.) A window of text that is shorter under the toxic dictionary
than under the ordinary one speaks for toxicity. From the differences of a document's windows, a logistic model
with a calibrated window threshold gives the score.

The model is fitted on a bounded sample: at most TRAIN_DOCS documents of each label (smallest hashes
of the id), two thirds for the dictionaries (at most TRAIN_WINDOWS windows of each label), a third for
the calibration. Whole texts of all documents are scored.

Defined results: a null or empty text has no windows and gets the model's score for none; documents
without a label, or with a null one, are no training rows; with training rows of one label only, the
score is that label's share, 1 or 0, and without any it is 0; repeated rows each get their score; an
empty table gives an empty result. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .linear import fit_dense

#: Bounds of the sample, by label.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 80_000
#: Least bytes of a window, which ends at the end of a word; longer words are cut, so a window has at most
#: WINDOW + LONG_WORD bytes.
WINDOW, LONG_WORD = 48, 256
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
#: How windows are compressed: the best parse, with matches from three bytes on, as faster strategies pass over
#: the short ones that tell the labels apart.
SETTINGS = {"strategy": zstandard.STRATEGY_BTOPT, "min_match": 3, "search_log": 5, "hash_log": 17, "chain_log": 17, "window_log": 17, "write_content_size": False, "write_dict_id": False}
#: The beginning of a word is in excess in toxic windows from so many contexts, standard errors and times the
#: ordinary rate; beginnings have from LEAST_BYTES to MOST_BYTES.
LEAST_CONTEXTS, LEAST_ERRORS, LEAST_TIMES = 6, 6.0, 8.0
LEAST_BYTES, MOST_BYTES = 4, 12
#: Window thresholds, in bytes saved, of which calibration takes one.
THRESHOLDS = tuple(range(2, 18))
#: Further ones at which windows are counted for the logistic model, whatever the calibrated one is.
STEPS = (2, 3, 4, 6, 8)


def windows(text: str | None) -> list[bytes]:
    """The whole text, A-Z lower-cased, in windows of words."""
    out, now, size = [], [], 0
    for word in (text or "").encode().lower().split():
        for part in [word] if len(word) <= LONG_WORD else [word[i : i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]:
            now.append(part)
            size += len(part) + 1
            if size > WINDOW:
                out.append(b" ".join(now))
                now, size = [], 0
    return [*out, b" ".join(now)] if now else out


def contexts(parts: list[bytes]) -> Counter:
    """In how many different contexts (the words beside it) each word stands: what copies of a text
    repeat counts once."""
    out, seen = Counter(), set()
    for part in parts:
        around = [b"", *part.split(), b""]
        for three in zip(around, around[1:], around[2:], strict=False):
            if (key := xxhash.xxh3_64_intdigest(b" ".join(three))) not in seen:
                seen.add(key)
                out[three[1]] += 1
    return out


def beginnings(words: Counter) -> Counter:
    """The same of what words begin with."""
    out = Counter()
    for word, n in words.items():
        for k in range(LEAST_BYTES, min(MOST_BYTES, len(word) - 1) + 1):
            out[word[:k]] += n
    return out


def excess(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Beginnings of words, then words, that toxic windows have in excess, the most telling last. Of
    beginnings that lengthen each other the most telling stays, of equals the longest."""
    t, o = contexts(toxic), contexts(ordinary)
    n, m = max(t.total(), 1), max(o.total(), 1)

    def found(t: Counter, o: Counter) -> dict[bytes, float]:
        out = {}
        for w, k in t.items():
            if k >= LEAST_CONTEXTS and k / n >= LEAST_TIMES * (o[w] + 0.5) / m:
                p = (k + o[w]) / (n + m)
                errors = (k / n - o[w] / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-18)
                if errors > LEAST_ERRORS:
                    out[w] = errors
        return out

    words, starts = found(t, o), found(beginnings(t), beginnings(o))
    taken: set[bytes] = set()
    chosen = []
    for w in sorted(starts, key=lambda w: (-starts[w], -len(w), w)):
        if w not in taken and not any(w[:k] in chosen for k in range(LEAST_BYTES, len(w))):
            chosen.append(w)
            taken |= {w[:k] for k in range(LEAST_BYTES, len(w) + 1)}
    return [w for w in chosen[::-1] if w not in words] + sorted(words, key=lambda w: (words[w], w))


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = THRESHOLDS[0]
    weights: np.ndarray | None = None
    constant: float | None = None

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out, settings = [], zstandard.ZstdCompressionParameters(**SETTINGS)
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            out.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=d))
        return out

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        """Of rows as saved() gives them."""
        n = np.maximum(stats[:, 3], 1)
        over = stats[:, 4:][:, [THRESHOLDS.index(t) for t in (self.threshold, *STEPS)]]
        return np.column_stack([stats[:, 0] / 4, stats[:, 1] / 4, stats[:, 2], np.log1p(stats[:, 3]), np.log1p(over), 10 * over / n[:, None]])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        x = self.inputs(stats)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def saved(text: str | None, ordinary, toxic) -> list[float]:
    """Most, second most and mean bytes saved by a window, windows, and windows at each threshold."""
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], float)
    if not len(d):
        return [0.0] * (4 + len(THRESHOLDS))
    top = np.sort(d)[::-1]
    return [top[0], top[1] if len(d) > 1 else 0.0, d.mean(), len(d), *[(d >= t).sum() for t in THRESHOLDS]]


def _stats(batch_texts, model: Model) -> np.ndarray:
    o, t = model.compressors()
    return np.array([saved(x.as_py(), o, t) for x in batch_texts], float).reshape(-1, 4 + len(THRESHOLDS))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """labels: (doc_id, label 0/1), training rows only. What comes to the driver is bounded by
    TRAIN_DOCS and TRAIN_WINDOWS."""
    text_batches(docs.sparkSession)
    known = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")).where("label is not null and id is not null")
    known = known.withColumn("h", F.xxhash64("id"))
    counts = dict(known.groupBy("label").count().where("label in (0, 1)").collect())
    if not counts.get(0) or not counts.get(1):
        return Model(b"", b"", constant=1.0 if counts.get(1) else 0.0)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy("h", "id").limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))  # at most 2 * TRAIN_DOCS ids

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(y, w, xxhash.xxh64_intdigest(w) >> 1) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["label", "w", "h"])

    cuts = sample.where("pmod(h, 3) != 0").select("label", "text").mapInArrow(cut_up, "label int, w binary, h long").distinct()
    toxic, ordinary = (cuts.where(F.col("label") == y).orderBy("h", "w").limit(TRAIN_WINDOWS).select("w").toArrow().column(0).to_pylist() for y in (1, 0))
    base = trained(ordinary, ORDINARY_BYTES)
    model = Model(base, base + b"".join(b" " + w + b" " for w in excess(toxic, ordinary))[-TOXIC_BYTES:])

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            stats = _stats(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats.tolist(), pa.list_(pa.float64()))], names=["label", "stats"])

    got = sample.where("pmod(h, 3) = 0").select("label", "text").mapInArrow(measure, "label int, stats array<double>").toArrow().to_pydict()
    y = np.array(got["label"], float)
    if len(set(got["label"])) < 2:
        return Model(base, model.toxic, constant=counts[1] / (counts[0] + counts[1]))
    stats = np.array(got["stats"], float)
    hit = [(np.mean(stats[y == 1, 4 + i] > 0) - np.mean(stats[y == 0, 4 + i] > 0), -t) for i, t in enumerate(THRESHOLDS)]
    model.threshold = -max(hit)[1]
    # the sample has as many of each label as it can; weights give back their shares
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    model.weights = fit_dense(model.inputs(stats), y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = model.scores(_stats(b.column(1), model) if model.constant is None else np.zeros((b.num_rows, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
