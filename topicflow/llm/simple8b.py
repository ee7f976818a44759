"""Token ids in 64-bit words of varying counts (Simple-8b), written and read by Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicflow.llm.tokens import default_vocabulary, encode_column, in_order
from topicflow.operators.joins import join_bounded

# Ids in a word and bits of each, by the word's upper four bits. The first two stand for runs of zeros and
# the last is the escape, a word for one id that no other selector can hold.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096
"""Ids in a block; every block starts with a new word."""
SEGMENT = 1 << 20
"""Ids after which a segment is closed."""
END = 0
_MAGIC = b"S8BT"
_HEADER = struct.Struct("<4sIQQQ")  # magic, ids in a block, documents, ids, words


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, one byte each; halves of 32 bits are exact as doubles."""
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    if not len(ids) or int(ids.max()) < 1 << 32:
        return low
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1].astype(np.uint8)
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and for every block of ids the number of words before it.

    Each word takes as many ids as fit; a block's last word may be short, the rest of it is zero.
    """
    n = len(ids)
    if n and int(ids.max()) >> int(WIDTHS[-1]):
        raise ValueError("ids of more than 60 bits cannot be written")
    values = np.concatenate([ids.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    # most bits of the next 1, 2, 4 ... ids, by doubling; any other number of ids is two such runs that overlap
    runs = [_bit_lengths(values)]
    while 1 << len(runs) <= COUNTS[0]:
        half = 1 << (len(runs) - 1)
        longer = runs[-1].copy()
        np.maximum(longer[:-half], runs[-1][half:], out=longer[:-half])
        runs.append(longer)
    selector = np.full(n, len(COUNTS) - 1, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        k = int(COUNTS[s]).bit_length() - 1
        rest = int(COUNTS[s]) - (1 << k)
        most = np.maximum(runs[k][:n], runs[k][rest : rest + n]) if rest else runs[k][:n]
        selector[most <= WIDTHS[s]] = s
    # blocks are independent, so all of them go forward by a word at a time
    firsts = np.arange(0, n, BLOCK)
    at, ends, blocks = firsts.copy(), np.minimum(firsts + BLOCK, n), np.arange(len(firsts))
    counts, places, owners = COUNTS[selector], [], []
    while len(at):
        places.append(at)
        owners.append(blocks)
        at = at + counts[at]
        more = at < ends
        at, ends, blocks = at[more], ends[more], blocks[more]
    at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    words_in = np.bincount(np.concatenate(owners), minlength=len(firsts)) if owners else np.zeros(0, np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    ends = np.minimum((at // BLOCK + 1) * BLOCK, n)
    for s in range(2, len(COUNTS)):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            starts, last = at[rows], ends[rows]
            packed = np.zeros(len(rows), np.uint64)
            for k in range(int(COUNTS[s])):
                there = starts + k < last
                packed |= np.where(there, values[starts + k], 0).astype(np.uint64) << np.uint64(k * WIDTHS[s])
            words[rows] |= packed
    return words, (np.cumsum(words_in) - words_in).astype(np.uint64)


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids; all words of a selector are taken apart at once, as the block offsets say where each word's ids go."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    first = offsets.astype(np.int64)
    of_block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    at = before - before[first][of_block] + of_block * block if len(words) else before
    ends = np.minimum((of_block + 1) * block, n)
    ids = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        if s < 2:
            continue
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        packed, starts, last = words[rows], at[rows], ends[rows]
        for k in range(int(COUNTS[s])):
            there = starts + k < last
            ids[starts[there] + k] = (packed[there] >> np.uint64(k * WIDTHS[s])) & mask
    return ids


def segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment: header; doc_id, whether it is known, and length of each document; block offsets; words."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, offsets = pack_words(flat)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<u4")
    header = _HEADER.pack(_MAGIC, BLOCK, len(doc_ids), len(flat), len(words))
    return b"".join([header, numbers.tobytes(), known.tobytes(), lengths.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def documents_of(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of the documents of a segment."""
    magic, block, docs, n, n_words = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    numbers, known, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    offsets = take("<u8", -(-n // block))
    ids = unpack_words(take("<u8", n_words), offsets, n, block).astype("<u4")
    for number, there, part in zip(numbers.tolist(), known.tolist(), np.split(ids, np.cumsum(lengths)[:-1]) if docs else []):
        yield (number if there else None), part


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write the ids of all texts, each followed by `end`, in ascending doc_id order (nulls last) to the folder `path`.

    Every partition of the folder holds a range of documents as a row of segments (part, before, ids, data), `before` being
    the ids of the segments before it in its partition; the files are
    Parquet, so that Spark's commit leaves whole files only and any store will do.  Null and empty texts are `end` alone.
    Rows that repeat a doc_id are written one after the other, ordered by their text.
    """
    name = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "ids": pa.array([size], pa.int64()), "data": pa.array([segment(doc_ids, ids)], pa.binary())})

        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode_column(batch.column("text").to_pylist(), name)):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(found + last, "<u4"))
                size += len(ids[-1])
                if size >= SEGMENT:
                    yield close()
                    before, size, doc_ids, ids = before + size, 0, [], []
        if doc_ids:
            yield close()

    in_order(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "part int, before long, ids long, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the documents in a folder: ids of all documents before, and own ids as little-endian uint32.

    What comes before a segment is its `before` and the totals of earlier partitions, a number for each; data stays where
    it is read.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                start = batch.column("start")[k].as_py()
                doc_ids, starts, ids = [], [], []
                for doc_id, found in documents_of(batch.column("data")[k].as_py()):
                    doc_ids.append(doc_id)
                    starts.append(start)
                    ids.append(found.tobytes())
                    start += len(found)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    based = join_bounded(stored.select("part", "before", "data"), parts, "part", "inner")
    return based.select((F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(run, "doc_id long, start long, ids binary")
