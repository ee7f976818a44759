"""What tasks leave behind in the worker processes that outlive them."""

import os

import pyarrow as pa

from topicflow.llm import common, packing


def test_packing_lets_go_of_the_word_hashes_of_earlier_steps(spark):
    def seen(fill):
        def run(batches):
            for _ in batches:
                pass
            if fill:
                common.hash_words([b"%d" % k for k in range(5000)])
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int64()), "held": pa.array([len(common._hashes)], pa.int64())})

        return {r.pid: r.held for r in spark.range(64, numPartitions=64).mapInArrow(run, "pid long, held long").collect()}

    filled = seen(True)
    assert all(filled.values())
    packing.pack(spark.createDataFrame([(1, "one text")], "doc_id long, text string")).collect()
    assert 0 in [held for pid, held in seen(False).items() if pid in filled]


def test_batches_come_in_parts():
    batch = pa.RecordBatch.from_pydict({"k": list(range(2500))})
    parts = list(common.parts([batch, batch.slice(0, 0), batch.slice(0, 7)]))
    assert [len(p) for p in parts] == [1000, 1000, 500, 7]
    assert [k for p in parts for k in p.column("k").to_pylist()] == [*range(2500), *range(7)]
