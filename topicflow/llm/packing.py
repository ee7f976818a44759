"""Packing token ids into sequences of bounded length, in document order, by dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import parts, release_memory
from topicflow.llm.tokens import default_vocabulary, encode_column, encoder, in_order

WINDOW = 1024
SENTENCE_PENALTY = 8
"""What a cut inside a document costs, in tokens of padding, at the end of a sentence."""
HARD_PENALTY = 64
"""What it costs inside a sentence."""
HARD_STEP, HARD_GAP = 32, 128
"""Where sentence ends are more than HARD_GAP ids apart, cuts are possible every HARD_STEP ids."""
SEQUENCE_COST = 256
"""What a sequence costs whatever its length, so that unpadded short ones do not take the place of full ones."""
SOLVED_AT_ONCE = 256
"""Windows solved together; the last sequence of each lot but the last is solved again with the next."""
END = 0


def cuts(points: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices of `points` at which to cut, the last included: least padding plus penalties in all.

    points ascend from 0 and are at most `window` apart.  A sequence of n ids costs window - n of padding, or nothing if n
    is a power of two.  The best earlier cut within a window is the head of a queue that ascends in cost, so every point
    enters and leaves it once; the powers of two are looked up.
    """
    at = np.full(int(points[-1]) + 1, -1, np.int64)
    at[points] = np.arange(len(points))
    exact: list[list[int] | None] = [None] * len(points)
    power = 1
    while power < window:
        ends = np.flatnonzero(points >= power)
        starts = at[points[ends] - power]
        for j, i in zip(ends[starts >= 0].tolist(), starts[starts >= 0].tolist()):
            if exact[j] is None:
                exact[j] = [i]
            else:
                exact[j].append(i)
        power *= 2
    place, penalty = points.tolist(), penalties.tolist()
    best, origin = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - window:
            queue.popleft()
        cost, i = queue[0]
        cost += window - p
        if p - place[i] == window:
            cost = best[i]
        for k in exact[j] or ():
            if best[k] <= cost:
                cost, i = best[k], k
        cost += penalty[j] + SEQUENCE_COST
        best[j], origin[j] = cost, i
        value = cost + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    found = [len(place) - 1]
    while origin[found[-1]]:
        found.append(origin[found[-1]])
    return found[::-1]


def _points(lengths: list[int], ids: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the ids of several documents may be cut, and what each costs."""
    total = len(ids)
    price = np.full(total + 1, -1.0)
    price[np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1] = SENTENCE_PENALTY
    price[np.cumsum(lengths)] = 0
    price[0] = price[total] = 0
    known = np.flatnonzero(price >= 0)
    for k in np.flatnonzero(np.diff(known) > HARD_GAP).tolist():
        price[known[k] + HARD_STEP : known[k + 1] : HARD_STEP] = HARD_PENALTY
    points = np.flatnonzero(price >= 0)
    return points, price[points]


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each text's ids are followed by `end` (null or empty text: `end` alone).  Documents are dealt out by ranges of
    doc_id (nulls last, equal ids by their text) and packed in that order; every range ends its last sequence.  Sequences hold
    at most `window` ids without a gap; ids are little-endian uint32.  sequence_id ascends with the documents.
    """
    name = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        ends_sentence = encoder(name).ends_sentence()
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its ids before these, all its ids, these
        size = 0

        def solve(whole: bool) -> pa.RecordBatch:
            nonlocal waiting, size, sequence
            lengths = [len(w[3]) for w in waiting]
            points, penalties = _points(lengths, np.concatenate([w[3] for w in waiting]), ends_sentence)
            chosen = points[cuts(points, penalties, window)].tolist()
            if not whole and len(chosen) > 1:
                chosen.pop()
            rows, k, used, begin = [], 0, 0, 0
            for stop in chosen:
                place = begin
                while place < stop:
                    doc_id, before, tokens, ids = waiting[k]
                    n = min(len(ids) - used, stop - place)
                    rows.append((doc_id, before + used, n, ids[used : used + n].tobytes(), tokens, sequence, place - begin))
                    place, used = place + n, used + n
                    if used == len(ids):
                        k, used = k + 1, 0
                begin, sequence = stop, sequence + 1
            waiting = waiting[k:]
            if used:
                doc_id, before, tokens, ids = waiting[0]
                waiting[0] = (doc_id, before + used, tokens, ids[used:])
            size = sum(len(w[3]) for w in waiting)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        last = np.array([end], "<u4").tobytes()
        for batch in parts(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode_column(batch.column("text").to_pylist(), name)):
                ids = np.frombuffer(found + last, "<u4")
                waiting.append((doc_id, 0, len(ids), ids))
                size += len(ids)
                if size >= SOLVED_AT_ONCE * window:
                    yield solve(whole=False)
        if waiting:
            yield solve(whole=True)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_order(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)
