"""Results, caches and scorers that outlive a run: chunks, buckets, stored answers."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicflow.operators import resume, scoring
from topicflow.plans.reclassify import reclassify_scored
from topicflow.plans.setup import custom_setup
from topicflow.plans.trend_report import classify_papers, score_papers
from topicflow.session import new_dir
from topicflow.sources import tables

SCORE = "paper_hash string, category_key string, category_label string, confidence double, reasoning string"


@pytest.fixture(scope="module")
def setup(spark):
    return custom_setup(spark, "anything", "Red:red;Blue:blue")


def papers(spark, n, start=0):
    rows = spark.range(start, start + n)
    title = F.concat(F.lit("title "), F.col("id") % 90)  # some texts are copies
    return rows.select(
        F.concat(F.lit("p"), F.col("id")).alias("id"),
        F.lit("C").alias("conf"),
        F.lit(2024).alias("year"),
        title.alias("title"),
        F.when(F.col("id") % 3 == 0, "about red").when(F.col("id") % 3 == 1, "blue").alias("abstract"),
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_with(df, column):
    """The shuffles whose rows hold `column`."""
    return [line for line in plan_of(df).splitlines() if "Exchange " in line and "BroadcastExchange" not in line and column in line] or [
        part for part in _formatted(df).split("\n\n") if ") Exchange" in part and column in part
    ]


def _formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# --- resuming ---------------------------------------------------------------


@pytest.mark.parametrize("max_rows", [100_000, 60, 0])
def test_unprocessed_papers(spark, max_rows):
    """By a broadcast of the done ids, of the new ids, and by a join."""
    df = papers(spark, 150).unionByName(papers(spark, 1).withColumn("id", F.lit(None).cast("string")))
    done = papers(spark, 100).select("id").unionByName(papers(spark, 5).select("id")).unionByName(spark.createDataFrame([(None,)], "id string"))
    left = resume.filter_unprocessed(df, done, max_rows)
    assert sorted(r.id or "" for r in left.collect()) == sorted(["", *(f"p{k}" for k in range(100, 150))])
    if max_rows:
        assert not exchanges_with(left, "abstract")


def test_chunks_read_once_write_their_texts_once(spark, monkeypatch):
    """Without `reread` nothing but the results is written; what is classified is the same."""
    df, wrote, write = papers(spark, 60), [], resume.materialize
    monkeypatch.setattr(resume, "materialize", lambda part, name: wrote.append(name) or write(part, name))
    for reread in (True, False):
        wrote.clear()
        path = new_dir(spark, "results")
        for _ in range(2):
            resume.in_chunks(df, path, 3, lambda todo: todo.withColumn("category_key", F.lit("k")), reread)
        assert ("chunk" in wrote) == reread
        assert sorted(r.id for r in tables.read_committed(spark, path).collect()) == sorted(f"p{k}" for k in range(60))


def test_more_ids_than_rows_are_broadcast(spark):
    """Done and new ids above the bound for rows, but few bytes: the texts stay where they are."""
    done = spark.range(150_000).select(F.concat(F.lit("p"), F.col("id")).alias("id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = resume.filter_unprocessed(papers(spark, 120_000, 149_990), done)
        assert "BroadcastHashJoin" in plan_of(left) and not exchanges_with(left, "abstract")
        assert {r.id for r in left.select("id").collect()} == {f"p{k}" for k in range(150_000, 269_990)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bucketed_tables_are_joined_without_moving_a_text(spark):
    stored, results = new_dir(spark, "papers"), new_dir(spark, "results")
    tables.write_bucketed(papers(spark, 300), stored, "id", 8)
    tables.write_bucketed(papers(spark, 200).select("id", F.lit("k").alias("category_key")), results, "id", 8)
    df = tables.read_bucketed(spark, stored, tables.PAPERS, "id", 8)
    done = tables.read_bucketed(spark, results, "id string, category_key string", "id", 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = resume.filter_unprocessed(df, done, max_rows=0)
        assert "SortMergeJoin" in plan_of(left) and "Exchange" not in plan_of(left)
        assert sorted(r.id for r in left.collect()) == sorted(f"p{k}" for k in range(200, 300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_chunks_cover_all_and_keep_copies_together(spark):
    df = papers(spark, 500).withColumn("chunk", resume.chunk_of(7))
    got = df.groupBy("title", "abstract").agg(F.countDistinct("chunk").alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).collect()
    assert {r.n for r in got} == {1} and min(r.low for r in got) == 0 and max(r.high for r in got) == 6


def logging_scorer(folder):
    """A scorer that writes down each paper it is asked for."""

    def scorer(frame: pd.DataFrame) -> pd.Series:
        import uuid

        out = []
        for ids in frame["ids"]:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(ids))
            out.append(json.dumps({"classifications": [{"id": i, "category_key": "custom_2", "confidence": 0.9} for i in ids]}))
        return pd.Series(out)

    return scorer


def asked(folder):
    return sorted(i for p in folder.iterdir() for i in p.read_text().split("\n"))


def test_a_run_that_stops_in_a_chunk_goes_on_after_the_last_whole_one(spark, setup, tmp_path, monkeypatch):
    df = papers(spark, 120)
    results, cache = new_dir(spark, "results"), new_dir(spark, "cache")
    given = dict(results_path=results, scorer=logging_scorer(str(tmp_path)), cache_path=cache, chunks=5)
    commit, calls = tables.commit_results, []

    def failing(found, path, chunk, chunks):
        calls.append(chunk)
        if chunk == 3:
            found.write.parquet(f"{path}/parts/half-done")  # written, but not marked
            raise RuntimeError("lost the driver")
        commit(found, path, chunk, chunks)

    monkeypatch.setattr(tables, "commit_results", failing)
    with pytest.raises(RuntimeError):
        classify_papers(df, setup, **given)
    first = asked(tmp_path)
    monkeypatch.setattr(tables, "commit_results", commit)
    got = classify_papers(df, setup, **given)
    assert calls == [0, 1, 2, 3] and got.count() == 120 and got.select("id").distinct().count() == 120
    assert {(r.category_key, r.method) for r in got.collect()} == {("custom_2", "llm")}
    texts = df.select("title", "abstract").distinct().count()
    # the answers of chunk 3 had reached the cache, so every text was asked for once in both runs together
    assert len(asked(tmp_path)) == len(set(asked(tmp_path))) == texts == 90 and 0 < len(first) < texts
    again = classify_papers(papers(spark, 130), setup, **given)
    assert again.count() == 130 and len(asked(tmp_path)) == texts  # ten more papers, all of them copies
    assert classify_papers(df, setup, **{**given, "threshold": 0.95}).filter("method = 'rule_fallback'").count() == 120


def test_uncommitted_parts_are_not_read(spark):
    path = new_dir(spark, "results")
    assert tables.read_committed(spark, path, "id string").collect() == []
    spark.range(3).write.parquet(f"{path}/parts/lost")
    assert tables.read_committed(spark, path, "id string").collect() == []
    tables.commit_results(spark.range(5), path, 0, 2)
    tables.commit_results(spark.range(5, 7), path, 1, 2)
    assert sorted(r.id for r in tables.read_committed(spark, path).collect()) == list(range(7))


# --- the stored cache --------------------------------------------------------


def scores(spark, keys, value, more=()):
    rows = [(f"{k:032x}", "custom_1", "Red", value, f"at {value}") for k in keys]
    return spark.createDataFrame(rows + list(more), SCORE)


def test_stored_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.read_stored_cache(spark, path).collect() == []
    tables.update_stored_cache(scores(spark, [], 0.1), path, 16)
    assert tables.read_stored_cache(spark, path).collect() == []
    tables.update_stored_cache(scores(spark, range(200), 0.1), path, 16)
    _, before = tables._cache_versions(spark, path)
    twice = [(f"{3:032x}", "custom_2", "Blue", 0.9, "greater"), (None, "custom_2", "Blue", 0.9, "no hash")]
    tables.update_stored_cache(scores(spark, [3, 1000], 0.5, twice), path, 16)
    _, after = tables._cache_versions(spark, path)
    touched = {r.b for r in scores(spark, [3, 1000], 0.5).select(tables._cache_bucket(16).alias("b")).collect()}
    assert {b for b in after if before.get(b) != after[b]} == touched and len(before) == 16
    got = {int(r.paper_hash, 16): (r.confidence, r.reasoning) for r in tables.read_stored_cache(spark, path).collect()}
    assert got == {**{k: (0.1, "at 0.1") for k in range(200)}, 3: (0.9, "greater"), 1000: (0.5, "at 0.5")}
    tables.update_stored_cache(scores(spark, [3], 0.2), path, 16)  # the last write wins, also over a greater score
    got = {int(r.paper_hash, 16): r.confidence for r in tables.read_stored_cache(spark, path).collect()}
    assert got[3] == 0.2 and len(got) == 201


def test_an_update_that_stops_before_its_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    tables.update_stored_cache(scores(spark, range(20), 0.1), path, 4)
    spark.range(1).selectExpr("'x' AS paper_hash", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/versions/lost")
    assert tables.read_stored_cache(spark, path).count() == 20


# --- scorers -----------------------------------------------------------------


def prompts(spark, batches):
    rows = [(0, k, ids, "p") for k, ids in enumerate(batches)]
    return spark.createDataFrame(rows, "bucket int, batch_no int, ids array<string>, prompt string").coalesce(1)


def test_prompts_of_a_table_scorer_are_built_once(spark):
    """Neither the scorer nor the ids that its responses meet collect the texts of a batch again."""
    stored = spark.createDataFrame([("1", "k", 0.9, "r", None)], "id string, category_key string, confidence double, reasoning string, error string")
    rows = [(0, k // 2, k % 2, str(k), f"h{k}", f"title {k}", None) for k in range(5)]
    batched = spark.createDataFrame(rows, "bucket int, batch_no int, position int, id string, paper_hash string, title string, abstract string")
    responses = scoring.apply_scorer(scoring.build_prompts(batched, "d"), scoring.predictions_scorer(stored))
    assert not exchanges_with(responses, "title") and "Paper ID" not in plan_of(responses)
    got = {(r.batch_no, tuple(r.ids)): len(json.loads(r.response)["classifications"]) for r in responses.collect()}
    assert got == {(0, ("0", "1")): 1, (1, ("2", "3")): 0, (2, ("4",)): 0}


def test_predictions_move_no_text(spark, tmp_path):
    """The checks' predictions: texts are hashed before their hashes meet the labels."""
    from checks import views

    spark.createDataFrame([(k, f"title {k % 3}\nabstract", "en", "web") for k in range(9)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = views.predictions(spark, str(tmp_path))
        moved = [part for part in _formatted(found).split("\n\n") if ") Exchange" in part and "abstract" in part]
        assert not moved
        assert sorted(r.reasoning for r in found.collect()) == ["seen in 0", "seen in 1", "seen in 2"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shipped_scorer(spark, setup):
    stored = spark.createDataFrame(
        [("1", "custom_1", 0.9, "r", None), ("1", "custom_2", 0.8, "greater", None), ("2", None, None, None, None), ("4", "custom_1", 1.0, "r", "refused 4"), ("5", "k", 0.3, "r", "refused 5"), ("9", "k", 1.0, "not asked", None)],
        "id string, category_key string, confidence double, reasoning string, error string",
    )
    responses = scoring.apply_scorer(prompts(spark, [["2", "1", "3"], ["6"], ["7", "5", "4"]]), scoring.predictions_scorer(stored))
    refused = ("other", 0.0, "API Error: refused 5", True)
    got = {r.id: (r.category_key, r.confidence, r.reasoning, r.failed) for r in scoring.parse_responses(responses, setup.rows, "Other").collect()}
    assert got == {
        "1": ("custom_2", 0.8, "greater", False),
        "2": ("other", 0.5, "", False),
        "3": ("other", 0.0, "No classification returned", False),
        "6": ("other", 0.0, "No classification returned", False),
        "7": refused,
        "5": refused,
        "4": refused,
    }


def test_batches_that_a_table_scorer_leaves_out_have_failed(spark):
    silent = scoring.TableScorer("silent", lambda p: p.filter("batch_no = 1").select("bucket", "batch_no", F.lit('{"classifications": []}').alias("response")))
    got = {r.id: r.failed for r in scoring.parse_responses(scoring.apply_scorer(prompts(spark, [["a"], ["b"]]), silent), [], "Other").collect()}
    assert got == {"a": True, "b": False}


@pytest.mark.parametrize("answers", [0, 1, 4])
def test_a_wrong_number_of_responses_fails_its_batch_only(spark, answers):
    def scorer(frame):
        if (frame["batch_no"] == 1).any():
            return ['{"classifications": []}'] * answers if len(frame) > 1 or answers != 1 else []
        return ['{"classifications": []}'] * len(frame)

    parsed = scoring.parse_responses(scoring.apply_scorer(prompts(spark, [["a"], ["b"], ["c"]]), scorer), [], "Other")
    got = {r.id: r.reasoning for r in parsed.collect()}
    assert got == {"a": "No classification returned", "b": f"API Error: ValueError: {0 if answers == 1 else answers} responses for 1 batches", "c": "No classification returned"}


def test_texts_move_once_on_their_way_to_the_prompts(spark):
    df = papers(spark, 400)
    keys = scoring.score_batches(scoring.keys_to_score(df, spark.createDataFrame([], tables.CACHE)))
    assert not exchanges_with(keys, "abstract")
    built = scoring.build_prompts(scoring.attach_texts(keys, df), "definitions")
    with_texts = [p for p in _formatted(built).split("\n\n") if ") Exchange" in p and ("papers" in p or "abstract" in p or "buf" in p)]
    assert len(with_texts) == 1


def test_papers_listed_twice_are_in_a_prompt_once(spark, setup):
    df = papers(spark, 3).unionByName(papers(spark, 3))
    keys = scoring.score_batches(scoring.keys_to_score(df, spark.createDataFrame([], tables.CACHE)))
    (row,) = scoring.build_prompts(scoring.attach_texts(keys, df), "d").collect()
    assert len(row.ids) == 3 and row.prompt.count("Paper ID: ") == 3


def test_a_classifier_of_the_users_own(spark, setup):
    def longest(text):
        return F.struct(F.when(F.length(text) > 15, "long").alias("category_key"), F.when(F.length(text) > 15, "Long").alias("category_label"))

    df = papers(spark, 6)
    got = {r.id: (r.category_key, r.category_label, r.method) for r in classify_papers(df, setup, classifier=longest).collect()}
    assert got["p0"] == ("long", "Long", "rule") and got["p2"] == ("other", setup.default_label, "rule")
    cache = scoring.with_hash(df).limit(1).select("paper_hash", F.lit("k").alias("category_key"), F.lit("L").alias("category_label"), F.lit(0.9).alias("confidence"), F.lit("r").alias("reasoning"))
    mixed = classify_papers(df, setup, predictions=cache, classifier=longest)
    assert sorted({r.method for r in mixed.collect()}) == ["llm", "rule_fallback"]
    path = new_dir(spark, "results")
    assert classify_papers(df, setup, results_path=path, classifier=longest).filter("category_key = 'long'").count() == 2
    assert classify_papers(df, setup, results_path=path).filter("category_key = 'long'").count() == 0  # not the same results


def test_reclassify_with_a_scorer_and_a_cache(spark, setup, tmp_path):
    cache = new_dir(spark, "cache")
    stored = papers(spark, 40).select("conf", "year", "title", "abstract", F.lit("Red").alias("category"))
    scorer = logging_scorer(str(tmp_path))
    first = reclassify_scored(stored, scorer, setup, cache)
    assert tuple(first.stats.first()) == (40, 40, 0, 40, "100.0")
    assert all(len(p.read_text().split("\n")) <= 5 for p in tmp_path.iterdir()) and len(asked(tmp_path)) == 40
    reclassify_scored(stored, scorer, setup, cache)
    assert len(asked(tmp_path)) == 40  # all known
    assert score_papers(papers(spark, 40), tables.read_stored_cache(spark, cache), scorer, setup).fresh.count() == 0
