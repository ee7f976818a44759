"""Scoring by an external scorer, in batches, with a cache and a rule fallback."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.text import match_text, paper_hash
from topicflow.operators.classify import category_key, category_label, rule_priority
from topicflow.operators.joins import join_bounded, join_skewed
from topicflow.session import materialize

SCORE_COLUMNS = ["category_key", "category_label", "confidence", "reasoning"]
ROWS_PER_BUCKET = 10_000
ANSWERS = (
    "struct<classifications: array<struct<"
    "id: string, category_key: string, confidence: double, reasoning: string>>>"
)

# A scorer gets one row per batch (bucket, batch_no, ids, prompt) and returns the
# response text of each; None stands for a batch that failed.
Scorer = Callable[[pd.DataFrame], "pd.Series"]

# Rules of the user's own: the text of a paper -> struct (category_key, category_label).
Classifier = Callable[[Column], Column]


@dataclass(frozen=True)
class TableScorer:
    """A scorer that is a job: `respond` takes the batches (bucket, batch_no, ids, prompt) as a table.

    It returns (bucket, batch_no, response); a batch it leaves out has failed.  `name` tells its
    results apart from those of other scorers.
    """

    name: str
    respond: Callable[[DataFrame], DataFrame]


def scorer_name(scorer: "Scorer | TableScorer | None") -> str:
    """What results of the scorer are kept under."""
    if scorer is None:
        return ""
    return scorer.name if isinstance(scorer, TableScorer) else getattr(scorer, "__qualname__", type(scorer).__qualname__)


def predictions_scorer(predictions: DataFrame, name: str = "predictions") -> TableScorer:
    """The shipped scorer: answers with stored predictions (id, category_key, confidence, reasoning, error).

    The ids of all batches meet the predictions in one join by id.  A paper without a prediction gets no
    answer, null fields are left out of the answer, and a batch with a paper whose `error` is not null fails
    with that text (the first one by position).  Of repeated ids the greatest prediction counts.
    """
    fields = ("category_key", "confidence", "reasoning", "error")
    known = predictions.groupBy("id").agg(F.max(F.struct(*fields)).alias("stored"))

    def respond(prompts: DataFrame) -> DataFrame:
        asked = prompts.select("bucket", "batch_no", F.posexplode("ids").alias("position", "id"))
        joined = join_skewed(asked, known, "id", "position")
        answer = F.struct("id", "stored.category_key", "stored.confidence", "stored.reasoning")
        found = F.struct("position", F.when(F.col("stored").isNotNull(), answer).alias("answer"), F.col("stored.error").alias("error"))
        # a group is one batch
        batches = joined.groupBy("bucket", "batch_no").agg(F.array_sort(F.collect_list(found)).alias("found"))
        errors = F.filter(F.transform("found", lambda x: x.error), lambda e: e.isNotNull())
        answers = F.filter(F.transform("found", lambda x: x.answer), lambda a: a.isNotNull())
        response = F.coalesce(F.try_element_at(errors, F.lit(1)), F.to_json(F.struct(answers.alias("classifications"))))
        return batches.select("bucket", "batch_no", response.alias("response"))

    return TableScorer(name, respond)


def with_hash(papers: DataFrame) -> DataFrame:
    return papers.withColumn("paper_hash", paper_hash(F.col("title"), F.col("abstract")))


def cache_join(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Papers with their cached score and from_cache; many papers may share one hash."""
    hits = cache.select("paper_hash", *SCORE_COLUMNS, F.lit(True).alias("from_cache"))
    return join_skewed(with_hash(papers), hits, "paper_hash", "id").withColumn(
        "from_cache", F.coalesce("from_cache", F.lit(False))
    )


def keys_to_score(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """(paper_hash, paper_id, id) of the distinct texts the cache does not know; `id` is what a batch sends.

    Copies of a text are reduced to their lowest id before the shuffle, and the anti join meets every hash once.
    Only hashes and ids move.
    """
    first = with_hash(papers).groupBy("paper_hash").agg(F.min("id").alias("paper_id"))
    unknown = first.join(cache.select("paper_hash"), "paper_hash", "left_anti")
    # answers come back by id, so an id with several texts is told apart by their hashes
    shared = unknown.groupBy("paper_id").agg(F.count("*").alias("_texts"))
    sent_as = F.when(F.col("_texts") > 1, F.concat_ws("#", "paper_id", "paper_hash")).otherwise(F.col("paper_id"))
    return unknown.join(shared, "paper_id").select("paper_hash", "paper_id", sent_as.alias("id"))


def attach_texts(keys: DataFrame, papers: DataFrame) -> DataFrame:
    """`keys` with title and abstract: the one step in which texts meet them, by a broadcast when the keys are few.

    A paper that is listed several times gives as many equal rows.
    """
    texts = with_hash(papers.select(F.col("id").alias("paper_id"), "title", "abstract"))
    return join_bounded(texts, keys, ["paper_id", "paper_hash"], "inner").select(*keys.columns, "title", "abstract")


def to_score(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts the cache does not know: (paper_hash, id, title, abstract), one row per text."""
    keys = materialize(keys_to_score(papers, cache), "to-score")
    return attach_texts(keys, papers).select("paper_hash", "id", "title", "abstract").dropDuplicates(["paper_hash"])


def score_batches(
    papers: DataFrame, batch_size: int = fixed.BATCH_SIZE, buckets: int | None = None
) -> DataFrame:
    """Adds bucket, batch_no and position: batches of at most `batch_size` papers.

    All it needs is paper_hash and id, so number the keys and attach the texts afterwards.  Papers are spread evenly over buckets by their hash and numbered inside one,
    so no window holds more than a bucket.  The numbering depends only on the
    data; a task that is run again gives the same batches.
    """
    if buckets is None:
        buckets = max(1, -(-papers.count() // ROWS_PER_BUCKET))
    spread = F.conv(F.substring("paper_hash", 1, 8), 16, 10).cast("bigint")
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("paper_hash", "id")) - 1
    return (
        papers.withColumn("bucket", (spread % buckets).cast("int"))
        .withColumn("_number", number)
        .withColumn("batch_no", F.floor(F.col("_number") / batch_size).cast("int"))
        .withColumn("position", (F.col("_number") % batch_size).cast("int"))
        .drop("_number")
    )


def prompt_entry() -> Column:
    """A paper in the prompt, with its whole abstract."""
    return F.concat(
        F.lit("Paper ID: "), F.col("id"),
        F.lit("\nTitle: "), F.coalesce("title", F.lit("")),
        F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("")),
    )


def build_prompts(batched: DataFrame, definitions: str) -> DataFrame:
    """One row per batch: (bucket, batch_no, ids, prompt).  A batch is at most batch_size papers, equal rows are one."""
    entry = F.struct("position", F.col("id"), prompt_entry().alias("entry"))
    papers = F.array_sort(F.collect_set(entry))
    return (
        batched.groupBy("bucket", "batch_no")
        .agg(papers.alias("papers"))
        .select(
            "bucket",
            "batch_no",
            F.transform("papers", lambda p: p.id).alias("ids"),
            F.concat(
                F.lit(fixed.PROMPT_HEAD + definitions + fixed.PROMPT_PAPERS),
                F.array_join(F.transform("papers", lambda p: p.entry), "\n\n"),
                F.lit(fixed.PROMPT_TAIL),
            ).alias("prompt"),
        )
    )


def apply_scorer(prompts: DataFrame, scorer: Scorer | TableScorer) -> DataFrame:
    """(bucket, batch_no, ids, response): the scorer is called in the tasks, once per Arrow batch of prompts.

    A scorer that wants a batch to count as failed returns None or a text without a
    list of classifications for it.  If it raises, or returns more or fewer responses
    than it got batches, the batches of the call are tried one by one, and those for
    which that happens again fail with the error as their response.  A `TableScorer`
    is a job over all batches instead, which are written first: it and the ids that its
    responses are joined to read them, and the texts do not move once more for each.
    """
    if isinstance(scorer, TableScorer):
        prompts = materialize(prompts, "prompts")
        responses = scorer.respond(prompts).select("bucket", "batch_no", "response")
        return prompts.select("bucket", "batch_no", "ids").join(responses, ["bucket", "batch_no"], "left")

    def called(frame: pd.DataFrame) -> list[str | None]:
        responses = list(scorer(frame))
        if len(responses) != len(frame):
            raise ValueError(f"{len(responses)} responses for {len(frame)} batches")
        return responses

    def one_by_one(frame: pd.DataFrame) -> list[str | None]:
        responses: list[str | None] = []
        for k in range(len(frame)):
            try:
                responses += called(frame.iloc[[k]])
            except Exception as error:  # any error of a user's scorer fails this batch only
                responses.append(f"{type(error).__name__}: {error}")
        return responses

    def answered(frame: pd.DataFrame) -> list[str | None]:
        try:
            return called(frame)
        except Exception:  # see above
            return one_by_one(frame)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["bucket", "batch_no", "ids"]].assign(response=answered(frame))

    return prompts.mapInPandas(run, "bucket int, batch_no int, ids array<string>, response string")


def parse_responses(responses: DataFrame, rows: list[Row], default_label: str) -> DataFrame:
    """One row per paper of every batch: (id, category_key, category_label, confidence, reasoning, failed).

    Answers are found by id inside their own batch, so no join is needed.  A
    paper without an answer, and every paper of a failed batch, gets the default
    category with confidence 0.
    """
    answers = F.from_json("response", ANSWERS).classifications
    readable = F.try_parse_json("response").isNotNull() & answers.isNotNull()
    label_of = F.create_map(*[F.lit(v) for r in rows for v in (r.key, r.label)])
    reason = F.concat(
        F.lit(fixed.FAILURE_REASON_PREFIX),
        F.coalesce("response", F.lit("no response")),
    )
    answer = F.col("answer")
    key = F.when(answer.isNotNull(), F.coalesce(answer.category_key, F.lit(fixed.DEFAULT_KEY))).otherwise(
        fixed.DEFAULT_KEY
    )
    return (
        responses.withColumn("failed", F.coalesce(~readable, F.lit(True)))
        .withColumn("answers", F.coalesce(answers, F.array().cast(ANSWERS.split("classifications: ")[1][:-1])))
        .withColumn("id", F.explode("ids"))
        .withColumn(
            "answer", F.try_element_at(F.filter("answers", lambda a: a.id == F.col("id")), F.lit(1))
        )
        .select(
            "id",
            key.alias("category_key"),
            F.coalesce(F.try_element_at(label_of, key), F.lit(default_label)).alias("category_label"),
            F.when(answer.isNull(), 0.0)
            .otherwise(F.coalesce(answer.confidence, F.lit(fixed.MISSING_CONFIDENCE)))
            .alias("confidence"),
            F.when(F.col("failed"), reason)
            .when(answer.isNull(), fixed.MISSING_ANSWER_REASON)
            .otherwise(F.coalesce(answer.reasoning, F.lit("")))
            .alias("reasoning"),
            "failed",
        )
    )


def was_answered() -> Column:
    """Whether a parsed row is the scorer's own answer, not a default for a missing one."""
    missing = (F.col("confidence") == 0.0) & (F.col("reasoning") == fixed.MISSING_ANSWER_REASON)
    return ~F.col("failed") & ~missing


def scored_join(papers: DataFrame, scores: DataFrame) -> DataFrame:
    """Papers with their own score, by id; papers without one are kept."""
    return papers.join(scores, "id", "left")


def low_confidence(scores: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Scores that go to the rules; one that equals the threshold does not."""
    return scores.filter(F.col("confidence") < threshold)


def hybrid_classify(
    papers: DataFrame,
    predictions: DataFrame | None,
    rows: list[Row] | Classifier,
    default_label: str,
    threshold: float = fixed.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Prediction where its confidence reaches the threshold, rules elsewhere.

    The rules are those of a taxonomy's rows, or a classifier of the user's own, which makes a struct
    (category_key, category_label) of a paper's text; a null key or label of it is the default.

    predictions: (paper_hash, category_key, category_label, confidence, reasoning),
    one row per hash; None means there is no scorer.  A paper without a
    prediction counts as one the scorer gave no answer for.  The rules run only
    on rows that need them.
    """
    text = match_text(F.col("title"), F.col("abstract"))
    if callable(rows):
        rule, result = rows(text), F.col("_rule")
        key = F.coalesce(result.category_key, F.lit(fixed.DEFAULT_KEY))
        label = F.coalesce(result.category_label, F.lit(default_label))
    else:
        rule, result = rule_priority(text, rows), F.col("_rule")
        key, label = category_key(result, rows), category_label(result, rows, default_label)
    if predictions is None:
        return papers.withColumn("_rule", rule).select(
            *papers.columns,
            key.alias("category_key"),
            label.alias("category_label"),
            F.lit(1.0).alias("confidence"),
            F.lit(fixed.RULE_REASON).alias("reasoning"),
            F.lit("rule").alias("method"),
        )
    scored = predictions.select("paper_hash", *[F.col(c).alias(f"_{c}") for c in SCORE_COLUMNS])
    joined = join_skewed(with_hash(papers), scored, "paper_hash", "id")
    confidence = F.coalesce("_confidence", F.lit(0.0))
    low = confidence < threshold
    fallback_reason = F.concat(
        F.lit("LLM low confidence ("), F.format_number(confidence, 2), F.lit("), used rule")
    )
    return joined.withColumn("_rule", F.when(low, rule)).select(
        *papers.columns,
        F.when(low, key).otherwise(F.col("_category_key")).alias("category_key"),
        F.when(low, label)
        .otherwise(F.col("_category_label"))
        .alias("category_label"),
        F.when(low, fixed.FALLBACK_CONFIDENCE).otherwise(confidence).alias("confidence"),
        F.when(low, fallback_reason).otherwise(F.coalesce("_reasoning", F.lit(""))).alias("reasoning"),
        F.when(low, "rule_fallback").otherwise("llm").alias("method"),
    )
