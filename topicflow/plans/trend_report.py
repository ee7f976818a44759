"""Landed pages -> papers -> classified papers -> share and trend."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.text import match_text
from topicflow.operators import report, resume, scoring, taxonomy
from topicflow.operators.topic import on_topic
from topicflow.plans.setup import Setup
from topicflow.session import materialize
from topicflow.sources import landing, tables


@dataclass(frozen=True)
class Collected:
    papers: DataFrame
    fetch_log: DataFrame


def collect_papers(
    pages: DataFrame,
    pairs: DataFrame,
    setup: Setup,
    attempts: DataFrame | None = None,
    last_offset: int | None = None,
    strict: bool = False,
    keep: Callable[[Column, Column], Column] | None = None,
) -> Collected:
    """On-topic accepted papers of the requested (conf, year) pairs, and where each pair was found.

    The pages are read twice: once for one summary row per page, which is written and
    from which each pair's candidate is chosen and the log is made, and once to take apart
    the chosen candidates' pages.  Payloads are neither sorted nor moved, but for those of
    pages that landed several times.  Running numbers follow the order of a column `ordinal`
    of `pairs`, if there is one.
    Pages stored by conference and year are pruned to the requested pairs at the scan.
    A pair that is requested twice counts once.  Without `attempts` the errors of
    the log are derived from the pages.  `keep` is a predicate over title and
    abstract that takes the place of the topic's words.
    """
    ordered, pairs = pairs, pairs.select(landing.PAIR).distinct()
    wanted = landing.requested_pages(pages, pairs)
    summary = materialize(landing.page_summary(wanted, strict), "page-summary")
    winners = materialize(landing.first_success(landing.candidate_counts(summary, last_offset)), "winners")
    accepted = landing.normalize_note(landing.accepted_notes(wanted, winners, strict, last_offset, summary)).drop("note")
    title, abstract = F.col("title"), F.col("abstract")
    wanted_text = keep(title, abstract) if keep else on_topic(match_text(title, abstract), setup.topic_patterns)
    matched = materialize(accepted.filter(wanted_text), "matched")
    if attempts is None:
        attempts = landing.derived_attempts(summary)
    return Collected(
        papers=landing.paper_ids(matched, ordered).select("id", "conf", "year", "title", "abstract"),
        fetch_log=landing.fetch_log(pairs, winners, landing.last_errors(attempts)),
    )


@dataclass(frozen=True)
class Scored:
    predictions: DataFrame
    """All that is known of any text, defaults for missing answers included."""
    cache: DataFrame
    """The earlier cache with the new answers."""
    fresh: DataFrame
    """The new answers alone."""


def score_papers(
    papers: DataFrame,
    cache: DataFrame,
    scorer: scoring.Scorer | scoring.TableScorer,
    setup: Setup,
    batch_size: int = fixed.BATCH_SIZE,
) -> Scored:
    """Score the texts the cache does not know; every distinct text is sent once.

    Batches are numbered by hash and id; texts join them once, on the way to the prompts.  The responses are written before anything else is done with them, so neither
    a retry downstream nor a second use calls the scorer again.
    """
    spark = papers.sparkSession
    unscored = materialize(scoring.keys_to_score(papers, cache), "unscored")
    table = taxonomy.rows_table(spark, setup.rows, "active")
    definitions = taxonomy.definitions_text(table, setup.default_label).first()["definitions"]
    batched = materialize(scoring.score_batches(unscored, batch_size), "batched")
    prompts = scoring.build_prompts(scoring.attach_texts(batched, papers), definitions)
    responses = materialize(scoring.apply_scorer(prompts, scorer), "responses")
    scored = scoring.parse_responses(responses, setup.rows, setup.default_label)
    answered = unscored.select("id", "paper_hash").join(scored, "id")
    fresh = answered.select("paper_hash", *scoring.SCORE_COLUMNS)
    own = answered.filter(scoring.was_answered()).select(fresh.columns)
    return Scored(predictions=tables.upsert_cache(cache, fresh), cache=tables.upsert_cache(cache, own), fresh=own)


def classify_papers(
    papers: DataFrame,
    setup: Setup,
    predictions: DataFrame | None = None,
    results_path: str | None = None,
    threshold: float = fixed.CONFIDENCE_THRESHOLD,
    keep_earlier: bool = True,
    classifier: scoring.Classifier | None = None,
    scorer: scoring.Scorer | scoring.TableScorer | None = None,
    cache_path: str | None = None,
    batch_size: int = fixed.BATCH_SIZE,
    chunks: int | None = None,
) -> DataFrame:
    """Classified papers; with `results_path` only those without an earlier result are classified.

    Earlier results are kept apart by what they depend on, so a changed topic, taxonomy, threshold or scorer starts
    anew.  They are written in `chunks` (default: one, or ten with a scorer), each of which is kept if the run stops
    later.  `classifier` takes the place of the taxonomy's rules.  With a `scorer` papers are scored chunk by chunk;
    answers go to the cache under `cache_path` and are taken from there.
    """
    spark, rules = papers.sparkSession, classifier or setup.rows

    def classify(part: DataFrame) -> DataFrame:
        found = predictions
        if scorer is not None:
            cache = tables.read_stored_cache(spark, cache_path) if cache_path else spark.createDataFrame([], tables.CACHE)
            scored = score_papers(part, cache, scorer, setup, batch_size)
            found = materialize(scored.predictions, "predictions")
            if cache_path:
                tables.update_stored_cache(scored.fresh, cache_path)
        return scoring.hybrid_classify(part, found, rules, setup.default_label, threshold)

    if results_path is None:
        return classify(papers)
    kind = scoring.scorer_name(scorer) or ("predictions" if predictions is not None else "")
    path = f"{results_path}/{setup.fingerprint(threshold, kind, scoring.scorer_name(classifier))}"
    reread = scorer is not None or predictions is not None
    resume.in_chunks(papers, path, chunks or (1 if scorer is None else resume.CHUNKS), classify, reread)
    results = tables.read_committed(spark, path).drop("written_at")
    return results if keep_earlier else results.join(papers.select("id"), "id", "left_semi")


@dataclass(frozen=True)
class Report:
    share: DataFrame
    trend: DataFrame
    categories: DataFrame
    methods: DataFrame | None


def build_report(
    table: DataFrame, years: list[int], k: int = fixed.DEFAULT_TOPK, long_tail_label: str = fixed.LONG_TAIL_LABEL
) -> Report:
    """Share and trend from a classified table, or from a stored one with `year` and `category`."""
    table = tables.require_columns(tables.category_from_label(table), "year", "category")
    return Report(
        share=report.category_share(table),
        trend=report.topk_trend(table, years, k, long_tail_label),
        categories=report.category_counts(table),
        methods=report.method_counts(table) if "method" in table.columns else None,
    )
