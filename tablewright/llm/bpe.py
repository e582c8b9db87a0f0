"""BPE encoding and decoding through a table of distinct words.

Texts are cut into words whose encodings, one after the other, are the encoding of the text. Each
chunk of documents (at most CHUNK_BYTES of text, or one document) keeps its distinct words and, for
each document, the place of every word in them. The chunks' words are dealt by hash into buckets; the
task of a bucket meets equal words of all chunks, encodes each distinct word once, and returns its ids
to every chunk that has it; there the ids are joined back by position. Words and ids travel packed, so
the shuffle holds each distinct word of a chunk once, not each word of the corpus. Decoding joins the
ids with the vocabulary's pieces, which is a map-side join as a vocabulary has a fixed size.

Defined results: a null text is empty and has no ids; a special token's string in a text is that
token, as the library has it; repeated rows are encoded each; ids outside the vocabulary decode to
nothing; an empty table gives an empty result. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, text_batches

#: Text of a chunk, and fewest buckets. Buckets follow spark.sql.shuffle.partitions, which is sized to the data,
#: so that the distinct words of one stay few: they grow slower than the text.
CHUNK_BYTES, LEAST_BUCKETS = 32_000_000, 64
#: Ids of a batch of results.
BATCH_IDS = 2_000_000

#: How byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = regex.compile(PATTERN)
_PLAIN = regex.compile(r"\S(?:.*\S)?", regex.DOTALL)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _specials(path: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it is split."""
    return tuple(sorted((t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]), key=len, reverse=True))


def split_words(text: str, specials: tuple[str, ...] = (), plain: dict[str, bool] | None = None) -> list[str]:
    """Words that make up `text`, each of which can be encoded by itself.

    A word never holds a space behind its first character unless it has to: a space with no white
    space beside it always begins a piece of the pattern. Where white space stands together, or a
    word is long, the pattern's own pieces are taken."""
    if specials and any(s in text for s in specials):
        parts = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else split_words(part, (), plain))]
    if not text:
        return []
    plain = {} if plain is None else plain
    segments, out, run = text.split(" "), [], None
    for i, s in enumerate(segments):
        ok = plain.get(s)
        if ok is None:
            ok = plain[s] = len(s) <= 64 and _PLAIN.fullmatch(s) is not None
        word = " " + s if i else s
        if ok and run is None:
            out.append(word)
        elif run is None:  # a stretch that needs the pattern begins; the word before may belong to it
            run = (out.pop() if out else "") + word
        else:
            run += word
            if ok:  # it ends behind a plain word, as the next cut is safe
                out += _PIECES.findall(run)
                run = None
    return out + (_PIECES.findall(run) if run is not None else [])


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    body = b"".join(np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.compress(head + body, 1)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.uint32, n), 4 * n, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, -1).T).view(np.uint32).ravel())
        at += 4 * int(size)
    return out


_ROW = "chunk long, bucket int, doc_id {id}, places binary, words binary"
#: What stands in `bucket` of the rows that are no words: places of a document's words, ranks of a chunk's words.
DOC, RANKS = -1, -2


def _chunks(path: str, buckets: int):
    """Rows of documents (places of their words, as ranks), of a chunk's words by bucket, in order of
    the words, and one of the ranks of these words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, plain, number = _specials(path), {}, 0
        first = TaskContext.get().partitionId() << 32
        index: dict[str, int] = {}
        docs: list[np.ndarray] = []
        ids: list[pa.Array] = []
        size = 0

        def rows(chunk: int, bucket: list[int], doc_ids: pa.Array, places: list[bytes | None], words: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(bucket), pa.int64()), pa.array(bucket, pa.int32()), doc_ids, pa.array(places, pa.binary()), pa.array(words, pa.binary())], names=["chunk", "bucket", "doc_id", "places", "words"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal index, docs, ids, size, number, plain
            chunk = first + number
            raw = [w.encode() for w in index]
            times = np.zeros(len(raw), np.int64)
            for d in docs:
                np.add.at(times, d, 1)
            rank = np.empty(len(raw), np.uint32)  # frequent words get small numbers, which pack well
            rank[np.argsort(-times, kind="stable")] = np.arange(len(raw), dtype=np.uint32)
            for s in range(0, len(docs), 1000):
                part = docs[s : s + 1000]
                yield rows(chunk, [DOC] * len(part), pa.concat_arrays(ids[s : s + 1000]), [_pack(rank[d]) for d in part], [None] * len(part))
            mine: list[list[int]] = [[] for _ in range(buckets)]
            for i in sorted(range(len(raw)), key=raw.__getitem__):
                mine[xxhash.xxh32_intdigest(raw[i]) % buckets].append(i)
            yield rows(chunk, [RANKS], pa.nulls(1, ids[0].type), [_pack(rank[[i for m in mine for i in m]])], [None])
            full = [(b, m) for b, m in enumerate(mine) if m]
            for s in range(0, len(full), 64):
                part = full[s : s + 64]
                yield rows(chunk, [b for b, _ in part], pa.nulls(len(part), ids[0].type), [_pack(np.array([len(raw[i]) for i in m])) for _, m in part], [zstandard.compress(b"".join(raw[i] for i in m), 6) for _, m in part])
            index, docs, ids, size, plain = {}, [], [], 0, {}
            number += 1

        for b in it:
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                words = split_words(text, specials, plain)
                docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words)))
                ids.append(b.column(0).slice(i, 1))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from close()
        if docs:
            yield from close()

    return run


def _encode_buckets(path: str):
    """Words of one bucket come together; each distinct one is encoded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, last = _tokenizer(path), {}, None
        for b in it:
            out = []
            for bucket, places, words in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                sizes = _unpack(places.as_py(), 1)[0]
                raw, at, mine = zstandard.decompress(words.as_py()), 0, []
                for n in sizes.tolist():
                    mine.append(raw[at : at + n])
                    at += n
                new = [w for w in mine if w not in known]
                for w, e in zip(new, tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = e.ids
                got = [known[w] for w in mine]
                out.append(_pack(np.fromiter(map(len, got), np.uint32, len(got)), np.fromiter((x for g in got for x in g), np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["chunk", "bucket", "places"])

    return run


def _positions(id_type: pa.DataType, then: tuple):
    """Of one chunk: its documents' places and words' ranks, and the ids of its words by bucket."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        sizes, flat = [], []
        for blob in words.column("places"):
            lens, ids = _unpack(blob.as_py(), 2)
            sizes.append(lens)
            flat.append(ids)
        ids = np.concatenate([np.zeros(0, np.uint32), *flat]).astype(np.int32)
        lens = np.concatenate([np.zeros(0, np.uint32), *sizes]).astype(np.int64)
        kind = docs.column("bucket").to_numpy()
        rank = _unpack(docs.column("places")[int(np.nonzero(kind == RANKS)[0][0])].as_py(), 1)[0]
        size, begin = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        size[rank], begin[rank] = lens, np.cumsum(lens) - lens

        def batches() -> Iterator[pa.RecordBatch]:
            doc_ids, got, n = [], [], 0

            def batch() -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(doc_ids, id_type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))], names=["doc_id", "ids"])

            for i in np.nonzero(kind == DOC)[0].tolist():
                at = _unpack(docs.column("places")[i].as_py(), 1)[0]
                k = size[at]
                got.append(ids[np.repeat(begin[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())])
                doc_ids.append(docs.column("doc_id")[i].as_py())
                n += len(got[-1])
                if n >= BATCH_IDS:
                    yield batch()
                    doc_ids, got, n = [], [], 0
            if doc_ids:
                yield batch()

        out = batches()
        for f in then:
            out = f(out)
        return pa.Table.from_batches(out)

    return run


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The bytes of each id of the vocabulary; its last entry, empty, is for ids outside of it."""
    byte_of = _byte_of()
    tok = _tokenizer(path)
    shown = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    return pa.array([*(bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s in shown), b""], pa.binary())


def decode_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `text` to batches with a column ids: the id-to-piece join, and the pieces of a row as one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in it:
            ids = b.column(b.schema.get_field_index("ids"))
            at = ids.flatten().to_numpy(zero_copy_only=False)
            at = np.where((at >= 0) & (at < len(table) - 1), at, len(table) - 1)
            joined = table.take(pa.array(at))
            raw, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int32, len(at) + 1, 4 * joined.offset)
            edges = ends[np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
            data = memoryview(raw) if raw is not None else memoryview(b"")
            texts = [bytes(data[s:e]).decode("utf-8", "replace") for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return run


def digest_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens and the SHA-256 of ids and text, of batches with doc_id, ids, text."""
    hexed = lambda a: pa.array([sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in a.cast(pa.binary())], pa.string())
    for b in it:
        ids = b.column(1)
        text = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), ids.flatten().cast(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), ids.value_lengths().cast(pa.int64()), hexed(pc.binary_join(text, ",")), hexed(b.column(2))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", then: tuple = (), gives: str = "ids array<int>") -> DataFrame:
    """doc_id, ids. `path` is the tokenizer's file, on every executor. `then` are further functions
    over batches of (doc_id, ids), run in the same worker, and `gives` what comes of them."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    buckets = max(LEAST_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = bucketed(rows.mapInArrow(_chunks(path, buckets), _ROW.format(id=kind)), "chunk")
    words = made.where("bucket >= 0").select("chunk", "bucket", "places", "words").repartition("bucket").sortWithinPartitions("bucket")
    back = words.mapInArrow(_encode_buckets(path), "chunk long, bucket int, places binary")
    parts = made.where("bucket < 0").select("chunk", "bucket", "doc_id", "places")
    run = _positions(to_arrow_type(rows.schema["doc_id"].dataType), then)
    return parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, {gives}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with text."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string"
    return encoded.select("doc_id", "ids").mapInArrow(decode_batches(path), schema)


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding each text."""
    return encode(docs, path, doc_id, text, (decode_batches(path), digest_batches), "n_tokens long, ids_sha256 string, decoded_sha256 string")
