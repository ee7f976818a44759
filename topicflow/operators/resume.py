"""Going on from earlier results."""

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from topicflow.functions.text import paper_hash
from topicflow.operators.joins import is_small
from topicflow.session import materialize
from topicflow.sources import tables

CHUNKS = 10

MAX_BROADCAST_IDS = 1_000_000
"""Ids alone are short: more of them than of other rows are broadcast, within the same bytes."""


def fingerprint(
    rows: list[Row] | None, topic: str | None, default_label: str = "", threshold: float | None = None, scorer: str = "", classifier: str = ""
) -> str:
    """Identifies what a result depends on; results of another taxonomy, topic, threshold or scorer are not reused."""
    content = [topic, default_label, threshold, scorer, classifier] + [[r.priority, r.key, r.label, list(r.patterns)] for r in rows or []]
    return hashlib.md5(json.dumps(content, ensure_ascii=False).encode()).hexdigest()


def processed_ids(results: DataFrame) -> DataFrame:
    return results.select("id").distinct()


def filter_unprocessed(papers: DataFrame, results: DataFrame, max_rows: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Papers without an earlier result, found by ids; texts stay where they are if they can.

    Few earlier results are broadcast.  Otherwise ids alone meet in an anti join, and if few papers are new, their ids
    are broadcast.  With many of both the papers themselves are joined, which moves nothing when papers and results are
    stored by id (`tables.write_bucketed` with the same number of buckets).  A paper without id has no result.
    """
    done = results.select("id")
    if is_small(done, max_rows):
        return papers.join(F.broadcast(done), "id", "left_anti")
    new = materialize(papers.select("id").join(done, "id", "left_anti"), "new-ids")
    if is_small(new, max_rows):
        return papers.filter("id IS NULL").unionByName(papers.join(F.broadcast(new), "id", "left_semi"))
    return papers.join(done, "id", "left_anti")


def chunk_of(chunks: int) -> Column:
    """The range of hashes a paper lies in; copies of a text lie in one."""
    head = F.conv(F.substring(paper_hash(F.col("title"), F.col("abstract")), 1, 8), 16, 10).cast("long")
    return F.floor(head * chunks / F.lit(1 << 32)).cast("int")


def in_chunks(papers: DataFrame, path: str, chunks: int, classify: Callable[[DataFrame], DataFrame], reread: bool = True) -> None:
    """Classify the papers without a committed result under `path`, one range of hashes after the other.

    Every chunk is written and then marked, and only marked chunks count.  A run that stops in between has kept the
    chunks before; when it is started again, `classify` sees each paper that has no committed result, and no other.
    """
    for chunk in range(chunks):
        part = papers.filter(chunk_of(chunks) == chunk) if chunks > 1 else papers
        todo = filter_unprocessed(part, tables.read_committed(papers.sparkSession, path))
        if chunks > 1:
            if reread:
                todo = materialize(todo, "chunk")
            if todo.isEmpty():
                continue
        tables.commit_results(classify(todo), path, chunk, chunks)


def union_results(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier results, also of papers that are no longer in the input, then the new ones."""
    return earlier.unionByName(new, allowMissingColumns=True)
