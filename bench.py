"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS:   cores (default 8)

A query's time is the median of RUNS runs, of which the first also compiles its code.
"""

import json
import os
import statistics
import time

from checks.compare import session
from checks.registry import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = (
    "classify_rules",
    "classify_rules_all",
    "classify_custom",
    "classify_many",
    "match_evidence_builtin",
    "filter_topic_default",
    "filter_topic_custom",
    "topk_trend",
    "category_share",
    "research_trend",
    "orders_trend",
    "orders_share",
    "hybrid_classify",
    "cache_join",
    "filter_unprocessed",
    "score_batches",
    "parse_responses",
    "first_success",
    "paper_id",
    "normalize_note",
    "compile_taxonomy",
    "keyword_variants",
    "reclass_stats",
    "last_errors",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session(CPUS)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    run(spark, HEADLINE[0])  # warm-up: JVM, file listing, code generation
    seconds = {name: round(statistics.median(run(spark, name) for _ in range(RUNS)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "papers_per_sec": {
                    "rule classification, every paper": round(documents / seconds["classify_rules_all"]),
                    "topic filter and rule classification": round(documents / seconds["classify_rules"]),
                    "hybrid classification": round(documents / seconds["hybrid_classify"]),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
