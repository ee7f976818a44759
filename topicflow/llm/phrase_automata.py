"""Passages that recur across documents: phrases, sharded automata over them, and the windows they open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import RangeHashes, bitmap, hash_words, mix64, split_by_bitmap, words
from topicflow.session import materialize

WINDOW = 50
PHRASE = 10
"""Words of a phrase; every window is known by the phrase of least hash in it, so equal windows have the same phrase."""
_PLACE_BITS = np.uint64(28)


def window_phrases(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, RangeHashes]:
    """Runs of windows with one phrase: where the phrase is, and first and last window of the run."""
    ranges = RangeHashes(hashes)
    starts = np.arange(len(hashes) - phrase + 1)
    order = mix64(ranges.of(starts, starts + phrase))
    order = (order >> _PLACE_BITS << _PLACE_BITS) | starts.astype(np.uint64)  # equal phrases: the first in the window
    width = window - phrase + 1
    least, size = order, 1
    while size * 2 <= width:
        least, size = np.minimum(least[: len(least) - size], least[size:]), size * 2
    least = np.minimum(least[: len(order) - width + 1], least[width - size :][: len(order) - width + 1])
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:], len(place)) - 1, ranges


def _runs(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, phrase, context, low, high): a run of windows, the hash of its phrase and of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hashes = hash_words(words(text))
                if len(hashes) < window:
                    continue
                place, low, high, ranges = window_phrases(hashes, window, phrase)
                columns = (np.full(len(low), doc_id), ranges.of(place, place + phrase).view(np.int64), ranges.of(low, high + window).view(np.int64), low.astype(np.int32), high.astype(np.int32))
                for part, column in zip(parts, columns):
                    part.append(column)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["doc_id", "phrase", "context", "low", "high"])

    return docs.mapInArrow(run, "doc_id long, phrase long, context long, low int, high int")


def compile_automaton(phrases: dict[tuple[int, ...], int]) -> ahocorasick.Automaton:
    """An automaton over sequences of word numbers that reports the key of every phrase it meets."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase, key in phrases.items():
        automaton.add_word(phrase, key)
    automaton.make_automaton()
    return automaton


def _windows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, window, start): windows that hold one of the phrases a document of the same shard was asked about.

    A shard is a batch of documents with their phrases: its automaton holds the phrases these may contain and no others, so
    that each document meets one automaton only, however many phrases there are in all.  Every document of the batch
    streams through it, and all occurrences count, wherever the phrase was first found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: dict[bytes, int] = {}
            texts, phrases = [], {}
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("phrases").to_pylist()):
                tokens = words(text)
                hashes = hash_words(tokens)
                text_numbers = tuple(numbers.setdefault(w, len(numbers)) for w in tokens)
                place, _, _, ranges = window_phrases(hashes, window, phrase)
                keys = ranges.of(place, place + phrase).view(np.int64)
                for at in place[np.isin(keys, np.array(asked, np.int64))].tolist():
                    phrases.setdefault(text_numbers[at : at + phrase], len(phrases))
                texts.append((text_numbers, ranges))
            automaton = compile_automaton(phrases)
            ids, found, starts = [], [], []
            for doc_id, (text_numbers, ranges) in zip(batch.column("doc_id").to_pylist(), texts):
                last = np.fromiter((end for end, _ in automaton.iter(text_numbers)), np.int64) if phrases else np.zeros(0, np.int64)
                # windows that hold [last - phrase + 1, last]
                opened = np.zeros(len(text_numbers) + 1, np.int64)
                np.add.at(opened, np.maximum(last - window + 1, 0), 1)
                np.add.at(opened, last - phrase + 2, -1)
                start = np.flatnonzero(np.cumsum(opened)[: len(text_numbers) - window + 1] > 0)
                ids.append(np.full(len(start), doc_id))
                found.append(ranges.of(start, start + window).view(np.int64))
                starts.append(start.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found)), pa.array(np.concatenate(starts))], ["doc_id", "window", "start"])

    return docs.select("doc_id", "text", "phrases").mapInArrow(run, "doc_id long, window long, start int")


def _covered(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, ranges): first and last start of windows that also start in a document with a smaller doc_id."""
    runs = materialize(_runs(docs, window, phrase), "runs")
    recurring = runs.groupBy("phrase").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("context").alias("c"), F.max("context").alias("d")
    )
    recurring = recurring.filter("first < last").select("phrase", (F.col("c") != F.col("d")).alias("varies"))
    runs = materialize(runs.join(recurring, "phrase"), "recurring-runs")
    # equal runs share all their windows: the first document that has the run stands for it
    owners = runs.groupBy("context").agg(F.min("doc_id").alias("owner"))
    runs = materialize(runs.join(owners, "context"), "owned-runs")
    whole = runs.filter("doc_id > owner").select("doc_id", F.struct("low", "high").alias("range"))
    # runs that agree in part, about one phrase, are compared window by window, and only in the documents that stand for them
    asked = materialize(runs.filter("doc_id = owner AND varies").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases")), "asked")
    there, _ = split_by_bitmap(docs, "doc_id", bitmap(asked, "doc_id"))
    windows = materialize(_windows(there.join(asked, "doc_id"), window, phrase), "windows")
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    single = windows.join(firsts.select("window", "first"), "window").filter("doc_id > first")
    ranges = whole.unionByName(single.select("doc_id", F.struct(F.col("start").alias("low"), F.col("start").alias("high")).alias("range")))
    return ranges.groupBy("doc_id").agg(F.collect_set("range").alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of `window` words around it also starts in a document with a smaller doc_id, both as they are
    in the input.  Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged.  A repeat within one document alone stays.

    Null and empty texts have no words.  Rows without doc_id take no part and stay whole; rows that repeat a doc_id and
    text share what is removed (a doc_id is taken to name one text).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.filter("doc_id IS NOT NULL")
    ranges = materialize(_covered(known, window, phrase), "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                tokens = words(text)
                counts.append(len(tokens))
                if not found:
                    removed.append(0)
                    kept.append(b" ".join(tokens).decode("utf-8", "surrogatepass"))
                    continue
                marks = np.zeros(len(tokens) + 1, np.int64)
                for one in found:
                    marks[one["low"]] += 1
                    marks[min(one["high"] + window, len(tokens))] -= 1
                stays = np.cumsum(marks)[:-1] == 0
                removed.append(len(tokens) - int(stays.sum()))
                kept.append(b" ".join(tokens[k] for k in np.flatnonzero(stays).tolist()).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    hit, clean = split_by_bitmap(rows, "doc_id", bitmap(ranges, "doc_id"))
    empty = F.lit(None).cast(ranges.schema["ranges"].dataType)
    both = hit.join(ranges, "doc_id", "left").unionByName(clean.withColumn("ranges", empty))
    return both.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
