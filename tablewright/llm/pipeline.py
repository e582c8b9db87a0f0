"""A training corpus from raw documents, stage by stage.

Each stage gets what the one before kept, read again from Parquet, and all but the last return the
columns of documents. Columns are those of the documents table; further ones pass through.

1. quality: weak labels and a hashed linear scorer; rejected documents go.
2. line dedup: lines on many sites stay in the first document that has them; a document that loses
   every word, as all its lines stand elsewhere, goes.
3. near-dedup: fingerprints meet by deletion variants, are joined by star contraction, and verified on sets
   of five-word shingles; what they cannot show meets by smallest hash values and is verified likewise. Of
   documents alike to four fifths, the one with the smallest doc_id stays.
4. mixing: documents are repeated or left out so that the sources' words come to their targets.
5. BPE: the ids of each document, and the digest of what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, mixing, quality, simhash
from .common import cut, table
from .queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.kept(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = pa.array([sha256(t.as_py().encode()).hexdigest() for t in b.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).value_lengths().cast(pa.int64()), b.column(1), digests], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    return bpe.encode(docs, path, then=(bpe.decode_batches(path), _with_digest), gives="n_tokens long, ids array<int>, decoded_sha256 string")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Learning, fingerprints and BPE are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
