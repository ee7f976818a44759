"""Buckets of lines: equal lines are one, and only what may be linked is compared."""

import numpy as np
from pyspark.sql import functions as F

from topicflow.llm import common, line_dedup


def test_equal_lines_make_no_bucket():
    keys, marks = np.array([5, 9, 5, 9, 9, 7], np.uint32), np.array([1, 2, 1, 3, 2, 1], np.uint32)
    names, ids = line_dedup.crowded(keys, marks, np.array([30, 40, 10, 50, 20, 60]))
    assert sorted(ids.tolist()) == [20, 50] and len(set(names.tolist())) == 1  # 30 and 10 are equal, 20 stands for 40
    assert not len(line_dedup.crowded(keys[:1], marks[:1], np.array([1]))[0])


def test_first_of_equal_lines():
    halves = np.array([[1, 2], [1, 3], [1, 2], [1, 2]], np.uint64)
    found = line_dedup.first_of_equal(halves, np.array([4, 1, 3, 3]), np.array([0, 0, 5, 2], np.int32), np.array([10, 11, 12, 13]))
    assert {r["id"]: r["line"] for r in found.to_pylist()} == {10: 13, 11: 11, 12: 13, 13: 13}


def test_sketches_of_lines_together():
    lines = ["", "abc", "x" * 900, "the quick brown fox jumps over " * 9]
    counts, sketches = line_dedup.line_sketches(lines)
    for k, line in enumerate(lines):
        distinct = np.unique(line_dedup._hashes(np.frombuffer(line.ljust(line_dedup.SHINGLE, "\0").encode("utf-32-le"), np.uint32)))
        assert counts[k] == len(distinct) and (sketches[k] == common.odd_sketch(distinct, line_dedup.SKETCH_LONGS)).all()


def test_components_compare_what_may_be_linked(spark):
    """A small bucket with one link, and a large chain of links, each of whose buckets also holds strangers."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    sets = {k: draw(100) for k in (1, 3, 4)}
    sets[2] = np.concatenate([sets[1][:95], draw(5)])
    sets[100] = draw(100)
    for k in range(101, 180):
        sets[k] = np.concatenate([sets[k - 1][3:], draw(3)])
    sets |= {k: draw(100) for k in range(200, 210)}
    rows = [(0, 7, k) for k in (1, 2, 3, 4)] + [(0, 8, k) for k in sets if k >= 100]
    shared = spark.createDataFrame([(*r, 100) for r in rows], "band int, key long, id long, n long")
    sketches = spark.createDataFrame([(k, 100, common.odd_sketch(s, 16).tolist()) for k, s in sets.items()], "id long, n long, sketch array<long>")
    compared = []

    def compare(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        compared.extend(found)
        likeness = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in found]
        schema = "a long, b long, likeness double, linked boolean"
        measured = spark.createDataFrame([(a, b, x, x >= 0.8) for (a, b), x in zip(found, likeness)], schema)
        return measured.select("a", "b"), measured

    found = {r.id: r.root for r in common.components_of_buckets(shared, compare, 0.8, sketches, 16).collect()}
    assert found == {2: 1} | {k: 100 for k in range(101, 180)}
    assert {p for p in compared if p[1] < 100} == {(1, 2)}  # 3 and 4 are never compared: their sketches forbid a link
    assert len(compared) == len(set(compared))


def test_bitmap_in_pieces(spark):
    every = spark.range(20_000).select(F.col("id").alias("k"))
    hit, miss = common.split_by_bitmap(every, "k", common.bitmap(every.filter("k % 3 = 0"), "k"))
    assert hit.filter("k % 3 = 0").count() == every.filter("k % 3 = 0").count() and miss.filter("k % 3 = 0").isEmpty()
    assert hit.count() + miss.count() == 20_000 and hit.count() < 6800
