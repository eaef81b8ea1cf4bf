"""SentencePiece encoding and decoding through a table of distinct words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.llm.blocks import pack, pack_texts, squeeze, unpack, unpack_texts
from tracemill.llm.common import settle_and_free

MARK = "▁"
#: A marked word: white space markers, then what follows up to the next marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of documents that share one list of distinct words.
BLOCK_CHARS = 32_000_000
#: Documents of one batch of the result.
BATCH_DOCS = 500
#: Words of the lists of all blocks that meet in one bucket, on average.
BUCKET_WORDS = 200_000


def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _narrow(sp) -> np.dtype:
    """The type that ids travel as."""
    return np.dtype("<u2" if sp.get_piece_size() <= 1 << 16 else "<u4")


def read_model(path: str | Path) -> bytes:
    """The bytes of a model, which must be one that segments each marked word on its own.

    That is so if no piece holds a marker behind another character, a text starts with a marker and
    its blanks are kept. Other models raise ``ValueError``.
    """
    model = Path(path).read_bytes()
    sp = _library(model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross the marker, such as {crossing[:3]}")
    if sp.normalize("  a  b ") != f"{MARK * 3}a{MARK * 2}b{MARK}":
        raise ValueError("the model drops blanks or adds no marker at the start")
    return model


def _split(batches: Iterator[pa.RecordBatch], model: bytes, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as numbers into the block's list of distinct words."""
    sp = _library(model)
    task, blocks = TaskContext.get().partitionId(), 0

    def row(ids: list, places: list[np.ndarray], known: dict[str, int]) -> pa.RecordBatch:
        # Frequent words get small numbers, and words of one frequency are in order: both pack better.
        words, every = list(known), np.concatenate(places)
        count = np.bincount(every, minlength=len(words)).tolist()
        order = sorted(range(len(words)), key=lambda i: (-count[i], words[i]))
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | blocks], pa.int64()), pa.array([ids], pa.list_(id_type)),
             pa.array([[len(p) for p in places]], pa.list_(pa.int32())), pa.array([pack(number[every])], pa.binary()),
             pa.array([len(words)], pa.int64()), pa.array([pack_texts([words[i][1:] for i in order])], pa.binary())],
            names=["block", "ids", "sizes", "places", "n_words", "words"])

    ids, places, size, known = [], [], 0, defaultdict()
    known.default_factory = known.__len__
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            chunks = CHUNK.findall(sp.normalize(text.as_py() or ""))
            ids.append(doc_id)
            places.append(np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks)))
            size += sum(map(len, chunks))
            if size >= BLOCK_CHARS:
                yield row(ids, places, known)
                ids, places, size, blocks = [], [], 0, blocks + 1
                known.clear()
    if ids:
        yield row(ids, places, known)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct words (without their first marker) by bucket, the same word always in the same one; ``at`` are their numbers in the block, as differences."""
    import xxhash

    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("words")):
            words = unpack_texts(packed.as_py())
            bucket = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
            bucket = (bucket % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[at[0]]], pa.int64()), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()),
                     pa.array([pack(np.diff(at, prepend=0))], pa.binary()),
                     pa.array([pack_texts([words[i] for i in at.tolist()], 15)], pa.binary())],
                    names=["bucket", "block", "n", "at", "words"])


def _segment(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """Ids of the words of each row, in a stream sorted by bucket: a distinct word is segmented once."""
    sp = _library(model)
    # The library puts one marker in front itself, but not in front of nothing.
    alone, last, table = [sp.piece_to_id(MARK)], None, {}
    for batch in batches:
        for bucket, block, n, at, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "at", "words"))):
            if bucket != last:
                last, table = bucket, {}
            words = unpack_texts(packed)
            fresh = [w for w in words if w not in table]
            table.update(zip(fresh, (np.array(ids or alone, np.int32) for ids in sp.encode(fresh, num_threads=1))))
            ids = [table[w] for w in words]
            flat = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([at], pa.binary()),
                 pa.array([pack(np.fromiter(map(len, ids), np.int32, n))], pa.binary()), pa.array([len(flat)], pa.int64()),
                 pa.array([squeeze(flat.astype(_narrow(sp)).tobytes(), 15)], pa.binary())],
                names=["block", "n", "at", "lengths", "n_ids", "flat"])


def _join_back(batches: Iterator[pa.RecordBatch], model: bytes, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Ids of the documents, in a stream that holds the ids of a block's words before the block: taken by the documents' numbers."""
    sp = _library(model)
    narrow, parts = _narrow(sp), []
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1).to_pylist()[0]
            if block["places"] is None:
                parts.append(block)
                continue
            length, start = np.zeros(block["n_words"], np.int32), np.zeros(block["n_words"], np.int64)
            flat, total = [np.zeros(0, np.int32)], 0
            for part in parts:
                at, size = np.cumsum(unpack(part["at"], part["n"])), unpack(part["lengths"], part["n"])
                length[at], start[at] = size, total + np.cumsum(size) - size
                ids = pa.decompress(part["flat"], part["n_ids"] * narrow.itemsize, codec="zstd", asbytes=True)
                flat.append(np.frombuffer(ids, narrow).astype(np.int32))
                total += part["n_ids"]
            parts, flat = [], np.concatenate(flat)
            places = unpack(block["places"], sum(block["sizes"]))
            ends = np.cumsum([0, *block["sizes"]])
            for first in range(0, len(ends) - 1, BATCH_DOCS):
                cuts = ends[first:first + BATCH_DOCS + 1]
                every = []
                for s, e in zip(cuts, cuts[1:]):
                    at = places[s:e]
                    size = length[at].astype(np.int64)
                    every.append(flat[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["ids"][first:first + BATCH_DOCS], id_type), pa.array(every, pa.list_(pa.int32())),
                     pa.array([sp.decode(ids.tolist()) for ids in every], pa.string())], names=["doc_id", "ids", "decoded"])


def encode_pieces(docs: DataFrame, model_path: str | Path) -> DataFrame:
    """Piece ids of every text and the text they decode to: ``doc_id, ids, decoded``.

    Texts become numbers into a list of the distinct marked words of their block (some millions of characters, so a
    word is met once a block at most, however frequent). The lists of all blocks are dealt to buckets by word, whose number
    follows their size; there each distinct word is segmented once, and its ids go back to the blocks that hold it,
    by position. What is shuffled is packed. Null and empty texts have no ids and decode to an empty
    text; repeated rows give repeated results, a null id stays null, other columns are ignored, an empty table gives an
    empty one. A very long text is a block of its own.
    """
    model = read_model(model_path)
    schema = docs.schema["doc_id"].dataType
    id_type, sql_type = to_arrow_type(schema), schema.simpleString()
    parts = settle_and_free(docs.select("doc_id", "text").mapInArrow(
        lambda batches: _split(batches, model, id_type),
        f"block long, ids array<{sql_type}>, sizes array<int>, places binary, n_words long, words binary"))
    buckets = -(-(parts.agg(F.sum("n_words")).first()[0] or 1) // BUCKET_WORDS)
    words = (
        parts.select("block", "words")
        .mapInArrow(lambda batches: _deal(batches, buckets), "bucket long, block long, n long, at binary, words binary")
        .repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: _segment(batches, model), "block long, n long, at binary, lengths binary, n_ids long, flat binary")
    )
    both = parts.drop("words").unionByName(words, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("places").isNotNull()).mapInArrow(
        lambda batches: _join_back(batches, model, id_type), f"doc_id {sql_type}, ids array<int>, decoded string")


def piece_digest(encoded: DataFrame) -> DataFrame:
    """Number and checksums of ids and decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
