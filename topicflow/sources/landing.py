"""Landed listing pages -> accepted notes -> papers.

A landed page is (conf, year, candidate, offset, payload): the raw text one
request returned for one candidate location of a conference's submissions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.text import error_snippet, strip
from topicflow.operators.joins import join_bounded
from topicflow.session import materialize

PAIR = ["conf", "year"]
CANDIDATE = ["conf", "year", "candidate"]
PAIRS_PER_BLOCK = 1000
"""Requested pairs whose counts are summed up together."""


# --- where to look --------------------------------------------------------


def fetch_plan(pairs: DataFrame) -> DataFrame:
    """(conf, year) -> every location to try, `candidate` being the order of trying."""

    def place(template: str) -> Column:
        return F.format_string(
            template.replace("{conf}", "%1$s").replace("{year}", "%2$d"), F.col("conf"), F.col("year")
        )

    strategies = len(fixed.STRATEGIES)
    candidates = [
        F.struct(
            F.lit((b * len(fixed.INVITATION_FORMATS) + i) * strategies + s).alias("candidate"),
            F.lit(base).alias("baseurl"),
            place(invitation).alias("invitation"),
            F.lit(strategy).alias("strategy"),
        )
        for b, base in enumerate(fixed.BASE_URLS)
        for i, invitation in enumerate(fixed.INVITATION_FORMATS)
        for s, strategy in enumerate(fixed.STRATEGIES)
    ]
    return pairs.select("conf", "year", F.explode(F.array(*candidates)).alias("c")).select("conf", "year", "c.*")


def conf_years(confs: DataFrame, years: list[int]) -> DataFrame:
    """Every conference with every requested year."""
    return confs.select("conf", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))


def strategy_of(candidate: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, fixed.STRATEGIES)), (candidate % len(fixed.STRATEGIES) + 1).cast("int"))


def requested_pages(pages: DataFrame, pairs: DataFrame, max_listed: int = 1000) -> DataFrame:
    """Pages of the requested (conf, year) pairs.

    The pairs are joined; when there are few, their conferences and years also
    become literal filters, which reach the scan and prune its partitions.
    """
    listed = pairs.select(PAIR).take(max_listed + 1)
    if len(listed) <= max_listed:
        pages = pages.filter(
            F.col("conf").isin({r["conf"] for r in listed}) & F.col("year").isin({r["year"] for r in listed})
        )
    return join_bounded(pages, pairs.select(PAIR), PAIR, "inner")


# --- pages to notes -------------------------------------------------------


def parse_payload(pages: DataFrame) -> DataFrame:
    """Adds `body`, the payload as a variant; null when it is not JSON."""
    return pages.withColumn("body", F.try_parse_json("payload"))


def note_list(body: Column) -> Column:
    """The notes in a payload: the list itself, or the first known key that holds a list."""
    paths = ["$"] + [f"$.{key}" for key in fixed.NOTE_LIST_KEYS]
    return F.coalesce(
        *[F.try_variant_get(body, path, "array<variant>") for path in paths], F.array().cast("array<variant>")
    )


def bad_payloads(pages: DataFrame) -> DataFrame:
    """Pages that are not JSON, with the head of what came instead."""
    return (
        parse_payload(pages)
        .filter(F.col("body").isNull())
        .drop("body")
        .withColumn("error", _bad_head())
    )


def _bad_head() -> Column:
    return F.concat(F.lit("Non-JSON response. Head: "), error_snippet(F.coalesce("payload", F.lit(""))))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages -> one row per note (conf, year, candidate, offset, position, note)."""
    return parse_payload(pages).select(
        *CANDIDATE, "offset", F.posexplode(note_list(F.col("body"))).alias("position", "note")
    )


def page_sizes(pages: DataFrame) -> DataFrame:
    """(conf, year, candidate, offset, n): how many notes each page holds; null when it is not JSON."""
    n = F.when(F.col("body").isNotNull(), F.size(note_list(F.col("body"))))
    return parse_payload(pages).select(*CANDIDATE, "offset", n.alias("n"))


def _up_to(pages: DataFrame, last_offset: int | None) -> DataFrame:
    return pages if last_offset is None else pages.filter(F.col("offset") <= last_offset)


def _before_end() -> Column:
    return F.col("first_empty").isNull() | (F.col("offset") < F.col("first_empty"))


def pages_until_empty(pages: DataFrame, last_offset: int | None = None) -> DataFrame:
    """Pages of each candidate, in offset order, up to the first empty one; one landing of each page.

    Neither a short page nor one that is not JSON stops the listing; a given `last_offset`
    leaves out the pages past it.  Sizes and landings are told by one row per page without
    its payload, so payloads stay where they are, but for those of pages that landed twice.
    """
    listed = _up_to(pages, last_offset)
    summary = materialize(_per_page(parse_payload(listed), F.when(F.col("body").isNotNull(), F.size(note_list(F.col("body")))).alias("n")), "page-sizes")
    first_empty = F.min(F.when(F.col("n") == 0, F.col("offset"))).alias("first_empty")
    ends = summary.groupBy(CANDIDATE).agg(first_empty).filter(F.col("first_empty").isNotNull())
    before = join_bounded(listed, materialize(ends, "first-empty"), CANDIDATE).filter(_before_end()).drop("first_empty")
    return one_landing(before, summary)


# --- note fields ----------------------------------------------------------


def _is_object(field: Column) -> Column:
    return F.coalesce(F.schema_of_variant(field).startswith("OBJECT"), F.lit(False))


def _field(note: Column, name: str) -> Column:
    return F.try_variant_get(note, f"$.content['{name}']", "variant")


def _text(field: Column) -> Column:
    """A field that is a bare value or {"value": ...}, as text; empty when missing or null."""
    value = F.when(_is_object(field), F.try_variant_get(field, "$.value", "string")).otherwise(
        F.try_variant_get(field, "$", "string")
    )
    return F.coalesce(value, F.lit(""))


def normalize_note(notes: DataFrame) -> DataFrame:
    """Adds note_id, title and abstract; an empty abstract takes the note's TL;DR."""
    note = F.col("note")
    tldr, other = _field(note, "TL;DR"), _field(note, "TLDR")
    # An object counts as given even when the value in it is empty.
    given = (F.schema_of_variant(tldr) != "OBJECT<>") & (_is_object(tldr) | (_text(tldr) != ""))
    summary = strip(F.when(given, _text(tldr)).otherwise(_text(other)))
    abstract = strip(_text(_field(note, "abstract")))
    return (
        notes.withColumn("note_id", F.try_variant_get(note, "$.id", "string"))
        .withColumn("title", strip(_text(_field(note, "title"))))
        .withColumn("abstract", F.when(abstract == "", summary).otherwise(abstract))
    )


def venue_id(conf: Column, year: Column) -> Column:
    return F.concat(conf, F.lit(".cc/"), year.cast("string"), F.lit("/Conference"))


def has_venueid(note: Column, conf: Column, year: Column) -> Column:
    """What the listing's own venueid filter keeps: bare or wrapped value equal."""
    return _text(_field(note, "venueid")) == venue_id(conf, year)


def is_accepted(note: Column, conf: Column, year: Column, strict: bool = False) -> Column:
    """Accepted by venue id, or by the venue text.

    The venue id counts only as a bare string unless `strict`, which also reads
    it out of {"value": ...}.  "accept" in any case is enough, also in "not accepted".
    """
    field = _field(note, "venueid")
    by_id = _text(field) == venue_id(conf, year)
    if not strict:
        by_id = by_id & ~_is_object(field)
    venue = _text(_field(note, "venue"))
    named = F.contains(venue, F.concat_ws(" ", conf, year.cast("string")))
    return by_id | F.contains(F.lower(venue), F.lit("accept")) | named


def filter_accepted(notes: DataFrame, strict: bool = False) -> DataFrame:
    return notes.filter(is_accepted(F.col("note"), F.col("conf"), F.col("year"), strict))


def filter_venueid(notes: DataFrame) -> DataFrame:
    return notes.filter(has_venueid(F.col("note"), F.col("conf"), F.col("year")))


# --- choosing a candidate -------------------------------------------------


def landing_order() -> Column:
    return F.xxhash64("payload")


def _per_page(parsed: DataFrame, *facts: Column) -> DataFrame:
    """(conf, year, candidate, offset, facts, landings): one row per page, without payloads.

    Of several landings of a page the one counts whose payload has the greatest hash; `landings` is how many there are.
    A page that landed twice with different payloads says nothing about which came later, so the choice is only the same
    everywhere.
    """
    page = parsed.select(*CANDIDATE, "offset", F.struct(landing_order().alias("landing"), *facts).alias("page"))
    one = page.groupBy(*CANDIDATE, "offset").agg(F.max("page").alias("page"), F.count("*").alias("landings"))
    return one.select(*CANDIDATE, "offset", "page.*", "landings").drop("landing")


def one_landing(pages: DataFrame, summary: DataFrame) -> DataFrame:
    """The landing of each page that counts.  Only payloads of pages with several landings are brought together."""
    page = [*CANDIDATE, "offset"]
    repeated = summary.filter("landings > 1").select(page)
    if repeated.isEmpty():
        return pages
    once = join_bounded(pages, repeated, page, "left_anti")
    again = join_bounded(pages, repeated, page, "left_semi").groupBy(page).agg(F.max_by("payload", landing_order()).alias("payload"))
    return once.select(*page, "payload").unionByName(again)


def derived_attempts(summary: DataFrame) -> DataFrame:
    """(conf, year, attempt, error): pages that are not JSON, and candidates with submissions of which none was accepted.

    attempt is the candidate's number; a candidate's errors are told by their page.
    """
    bad = summary.filter("n IS NULL").select(*PAIR, F.col("candidate").cast("bigint").alias("attempt"), "error")
    counts = candidate_counts(summary).filter("accepted = 0 AND submissions > 0")
    plan = fetch_plan(counts.select(PAIR).distinct()).select(*CANDIDATE, "baseurl", "invitation")
    said = F.format_string("%s %s: has submissions=%d but no accepted papers found", "baseurl", "invitation", "submissions")
    none = counts.join(plan, CANDIDATE).select(*PAIR, F.col("candidate").cast("bigint").alias("attempt"), said.alias("error"))
    return bad.unionByName(none)


def page_summary(pages: DataFrame, strict: bool = False) -> DataFrame:
    """(conf, year, candidate, offset, n, accepted, error, landings), one row per page.

    Everything the choice of a candidate and its log need, from one narrow pass over
    the payloads.  Notes listed through the venueid filter are all accepted; n is null
    for a page that is not JSON, and `error` has the head of what came instead.
    """
    notes = F.col("notes")
    kept = F.filter(notes, lambda note: is_accepted(note, F.col("conf"), F.col("year"), strict))
    filtered = strategy_of(F.col("candidate")) == "venueid"
    parsed = parse_payload(pages).withColumn("notes", note_list(F.col("body")))
    return _per_page(
        parsed,
        F.when(F.col("body").isNotNull(), F.size(notes)).alias("n"),
        F.when(filtered, F.size(notes)).otherwise(F.size(kept)).alias("accepted"),
        F.when(F.col("body").isNull(), _bad_head()).alias("error"),
    )


def candidate_counts(summary: DataFrame, last_offset: int | None = None) -> DataFrame:
    """(conf, year, candidate) -> submissions, accepted and first_empty, up to the first empty page.

    How many submissions there were is unknown behind the venueid filter.  A
    candidate without notes gives no row, nor does one with a page before its end
    that is not JSON: its listing failed.
    """
    first_empty = F.min(F.when(F.col("n") == 0, F.col("offset"))).over(Window.partitionBy(CANDIDATE))
    filtered = strategy_of(F.col("candidate")) == "venueid"
    unknown = F.lit(fixed.UNKNOWN_SUBMISSIONS).cast("bigint")
    return (
        _up_to(summary, last_offset)
        .withColumn("first_empty", first_empty)
        .filter(_before_end())
        .groupBy(CANDIDATE)
        .agg(
            F.sum("n").alias("submissions"),
            F.sum("accepted").alias("accepted"),
            F.min("first_empty").alias("first_empty"),
            F.bool_or(F.col("n").isNull()).alias("failed"),
        )
        .filter(~F.col("failed"))
        .drop("failed")
        .withColumn("submissions", F.when(filtered, unknown).otherwise(F.col("submissions")))
    )


def first_success(counts: DataFrame) -> DataFrame:
    """Per (conf, year) the first candidate, in order of trying, with an accepted note."""
    best = F.min(F.struct("candidate", "submissions", "accepted", "first_empty")).alias("best")
    return counts.filter(F.col("accepted") > 0).groupBy(PAIR).agg(best).select(*PAIR, "best.*")


def accepted_notes(
    pages: DataFrame, winners: DataFrame, strict: bool = False, last_offset: int | None = None, summary: DataFrame | None = None
) -> DataFrame:
    """Accepted notes of the winning candidates; only their pages are taken apart into notes, where they lie.

    `summary` tells which pages landed several times; without it their keys are counted.
    """
    if summary is None:
        summary = pages.groupBy(*CANDIDATE, "offset").agg(F.count("*").alias("landings"))
    chosen = join_bounded(_up_to(pages, last_offset), winners.select(*CANDIDATE, "first_empty"), CANDIDATE, "inner")
    filtered = strategy_of(F.col("candidate")) == "venueid"
    return scan_pages(one_landing(chosen.filter(_before_end()), summary)).filter(
        filtered | is_accepted(F.col("note"), F.col("conf"), F.col("year"), strict)
    )


def fetch_log(pairs: DataFrame, winners: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per requested (conf, year): where it was found, or why it was not."""
    plan = fetch_plan(pairs).select(*CANDIDATE, "baseurl", "invitation")
    found = join_bounded(plan, winners, CANDIDATE, "inner").drop("candidate", "first_empty")
    joined = pairs.select(PAIR).join(found, PAIR, "left").join(errors.select(*PAIR, "error"), PAIR, "left")
    failed = F.col("accepted").isNull()
    return joined.select(
        *PAIR,
        F.coalesce("baseurl", F.lit("")).alias("baseurl"),
        F.coalesce("invitation", F.lit("")).alias("invitation"),
        F.coalesce("submissions", F.lit(0)).cast("int").alias("submissions"),
        F.coalesce("accepted", F.lit(0)).cast("int").alias("accepted"),
        F.when(failed, F.coalesce("error", F.lit("Nothing listed"))).alias("error"),
    )


def last_errors(attempts: DataFrame, k: int = fixed.ERROR_LINES_KEPT) -> DataFrame:
    """(conf, year, attempt, error) -> the last k errors of each pair, oldest first.

    The rank filter is applied in every input partition before the shuffle, so a
    pair with very many errors sends at most k rows per partition.
    """
    latest = Window.partitionBy(PAIR).orderBy(F.desc("attempt"))
    return (
        attempts.withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= k)
        .groupBy(PAIR)
        .agg(F.array_sort(F.collect_list(F.struct("attempt", "error"))).alias("kept"))
        .select(*PAIR, F.array_join(F.transform("kept", lambda e: e.error), "\n").alias("error"))
    )


# --- papers ---------------------------------------------------------------


def _pair_starts(counts: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(conf, year, _pair_n) -> (conf, year, _before_pair): the notes of all pairs before, as prefix sums in two levels.

    Pairs are summed up inside blocks, and blocks, of which there are few, with each other.  With a column `ordinal` in
    `pairs` blocks are ranges of it, else pairs are in alphabetical order and a block is a conference.
    """
    if pairs is None or "ordinal" not in pairs.columns:
        blocked = counts.select("*", F.col("conf").alias("_block"), F.col("year").alias("_place"))
    else:
        places = pairs.groupBy(PAIR).agg(F.min("ordinal").alias("_place"))
        blocked = counts.join(places, PAIR).withColumn("_block", F.floor(F.col("_place") / PAIRS_PER_BLOCK))
    inside = F.sum("_pair_n").over(Window.partitionBy("_block").orderBy("_place", *PAIR)) - F.col("_pair_n")
    blocks = blocked.groupBy("_block").agg(F.sum("_pair_n").alias("_block_n"))
    earlier = blocks.select(F.col("_block").alias("_other"), F.col("_block_n").alias("_other_n"))
    before = blocks.join(earlier, F.col("_other") < F.col("_block"), "left").groupBy("_block").agg(F.sum("_other_n").alias("_before"))
    placed = blocked.withColumn("_inside", inside).join(before, "_block")
    return placed.select(*PAIR, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias("_before_pair"))


def paper_ids(matched: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Adds `id`: conf_year_noteid, or the running count of matched notes instead of a missing note id.

    Notes with an id stay in their stage.  The count, which runs over pairs in the order of
    `pairs.ordinal` (without it alphabetically), offset and position, is put together from
    pre-aggregated counts per pair and per page and the position within one page; it carries
    keys only, so no task sees more than one page's keys, one pair's page counts or one block
    of pairs.
    """
    page = [*PAIR, "offset"]
    counted = matched.groupBy(page).agg(F.count("*").alias("_n"))
    counts = counted.groupBy(PAIR).agg(F.sum("_n").alias("_pair_n"))
    before_page = F.sum("_n").over(Window.partitionBy(PAIR).orderBy("offset")) - F.col("_n")
    starts = (
        counted.withColumn("_before_page", before_page)
        .join(_pair_starts(counts, pairs), PAIR)
        .select(*page, (F.col("_before_page") + F.col("_before_pair")).alias("_start"))
    )
    in_page = F.row_number().over(Window.partitionBy(page).orderBy("position")) - 1
    numbers = (
        matched.select(*page, "position", "note_id")
        .withColumn("_in_page", in_page)
        .filter(F.col("note_id").isNull())
        .join(starts, page)
        .select(*page, "position", (F.col("_start") + F.col("_in_page")).alias("_number"))
    )
    named = matched.filter(F.col("note_id").isNotNull()).withColumn("id", F.concat_ws("_", "conf", "year", "note_id"))
    numbered = (
        matched.filter(F.col("note_id").isNull())
        .join(numbers, [*page, "position"])
        .withColumn("id", F.concat_ws("_", "conf", "year", "_number"))
        .drop("_number")
    )
    return named.unionByName(numbered)
