"""Every checked query: a Spark function (spark, sf_dir) -> DataFrame and its SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext as S
from checks import views as V
from topicflow.functions import fixed, text
from topicflow.functions.keywords import keyword_variants, label_keywords
from topicflow.operators import classify, compare, joins, pattern_index, report, resume, scoring, taxonomy, topic
from topicflow.plans import reclassify as reclassify_plan
from topicflow.plans.setup import custom_setup
from topicflow.session import materialize, new_dir
from topicflow.sources import landing, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that must agree with it."""

    def register(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return register


def years(values: list[int]) -> str:
    return ", ".join(map(str, values))


# --- scans -------------------------------------------------------------------


def _pages(spark, sf_dir) -> DataFrame:
    """The listing pages as a stored table, which is what landed pages are."""
    return materialize(V.landed_pages(spark, sf_dir), "pages")


@check(f"""WITH {S.LANDED_ALL}
SELECT conf, "year", candidate, "offset", position, note_id FROM page_notes""")
def scan_pages(spark, sf_dir):
    notes = landing.normalize_note(landing.scan_pages(_pages(spark, sf_dir)))
    return notes.select("conf", "year", "candidate", "offset", "position", "note_id")


@check("""SELECT 'WEB' AS conf, page_id * 1000 AS "offset",
       'Non-JSON response. Head: ' || replace(left(html, 400), chr(10), ' ') AS error FROM pages""")
def bad_payloads(spark, sf_dir):
    pages = _pages(spark, sf_dir).unionByName(V.web_pages(spark, sf_dir))
    return landing.bad_payloads(pages).select("conf", "offset", "error")


@check(f"""WITH confs AS (SELECT DISTINCT upper(lang) AS conf FROM documents)
SELECT conf, y AS "year", CAST(b.pos * 12 + i.pos * 2 + s.pos AS INTEGER) AS candidate, b.url AS baseurl,
       replace(replace(i.inv, '@C', conf), '@Y', CAST(y AS VARCHAR)) AS invitation, s.name AS strategy
FROM confs, (SELECT CAST(unnest([{years(V.YEARS)}]) AS INTEGER) AS y),
     (VALUES (0, 'https://api2.openreview.net'), (1, 'https://api.openreview.net')) b(pos, url),
     (VALUES (0, '@C.cc/@Y/Conference/-/Submission'), (1, '@C.cc/@Y/Conference/-/Blind_Submission'),
             (2, '@C.cc/@Y/Conference/-/Paper'), (3, '@C.cc/@Y/conference/-/submission'),
             (4, '@C.cc/@Y/conference/-/blind_submission'), (5, '@C.cc/@Y/conference/-/Blind_Submission')) i(pos, inv),
     (VALUES (0, 'venueid'), (1, 'all')) s(pos, name)""")
def fetch_plan(spark, sf_dir):
    confs = V.papers(spark, sf_dir).select("conf").distinct()
    return landing.fetch_plan(landing.conf_years(confs, V.YEARS))


@check(f"""SELECT conf, y AS "year" FROM (SELECT DISTINCT upper(lang) AS conf FROM documents),
       (SELECT CAST(unnest([{years(V.YEARS)}]) AS INTEGER) AS y)""")
def conf_year_cross(spark, sf_dir):
    return landing.conf_years(V.papers(spark, sf_dir).select("conf").distinct(), V.YEARS)


@check(f"""WITH {S.LANDED_ALL} SELECT conf, "year", candidate, "offset", n FROM kept_pages""")
def pages_until_empty(spark, sf_dir):
    return landing.page_sizes(landing.pages_until_empty(_pages(spark, sf_dir)))


def _candidate_counts(pages: DataFrame) -> DataFrame:
    return landing.candidate_counts(landing.page_summary(pages))


@check(f"""WITH {S.LANDED_ALL} SELECT * FROM counts""")
def fetch_counts(spark, sf_dir):
    return _candidate_counts(_pages(spark, sf_dir)).drop("first_empty")


@check(f"""WITH {S.LANDED_ALL} SELECT * FROM winners""")
def first_success(spark, sf_dir):
    return landing.first_success(_candidate_counts(_pages(spark, sf_dir))).drop("first_empty")


@check(f"""WITH {S.PAPERS} SELECT conf, "year", title, abstract, source AS category
FROM papers JOIN documents USING (doc_id)""")
def scan_papers_csv(spark, sf_dir):
    sources = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category_label"))
    path = new_dir(spark, "papers-csv")
    tables.write_simple(V.papers(spark, sf_dir).join(sources, "doc_id"), path)
    return tables.require_columns(tables.read_csv(spark, path, tables.SIMPLE))


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS} SELECT * FROM predictions""")
def scan_cache(spark, sf_dir):
    path = new_dir(spark, "cache-json")
    score = F.struct("category_key", "category_label", "confidence", "reasoning")
    V.predictions(spark, sf_dir).select(F.to_json(F.create_map("paper_hash", score))).write.text(path)
    return tables.read_cache_json(spark, path, lines=True)


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT id, conf, "year", title, abstract, category_key FROM classified""")
def scan_checkpoint(spark, sf_dir):
    path = new_dir(spark, "checkpoint-json")
    result = F.array(F.struct("id", "conf", "year", "title", "abstract", "category_key")).alias("results")
    V.classified(spark, sf_dir).select(F.to_json(F.struct(result, F.lit(0.0).alias("timestamp")))).write.text(path)
    schema = f"{tables.PAPERS}, category_key string"
    return tables.read_checkpoint_json(spark, path, schema, lines=True)


# --- sinks: written to the shared folder and read back -----------------------


def _fetch_log(spark, sf_dir) -> DataFrame:
    pages = _pages(spark, sf_dir)
    pairs = landing.conf_years(pages.select("conf").distinct(), V.YEARS)
    winners = materialize(landing.first_success(_candidate_counts(pages)), "winners")
    return landing.fetch_log(pairs, winners, landing.last_errors(V.attempts(spark, sf_dir)))


@check(f"""WITH {S.LANDED_ALL},
confs AS (SELECT DISTINCT upper(lang) AS conf FROM documents)
SELECT c.conf, y AS "year",
       CASE WHEN w.candidate IS NULL THEN '' ELSE 'https://api2.openreview.net' END AS baseurl,
       coalesce(c.conf || '.cc/' || y || '/Conference/-/' ||
         CASE w.candidate // 2 WHEN 0 THEN 'Submission' WHEN 1 THEN 'Blind_Submission' WHEN 2 THEN 'Paper' END, '') AS invitation,
       CAST(coalesce(w.submissions, 0) AS INTEGER) AS submissions,
       CAST(coalesce(w.accepted, 0) AS INTEGER) AS accepted,
       CASE WHEN w.candidate IS NULL THEN 'Nothing listed' END AS error
FROM confs c CROSS JOIN (SELECT CAST(unnest([{years(V.YEARS)}]) AS INTEGER) AS y)
LEFT JOIN winners w ON w.conf = c.conf AND w."year" = y""")
def write_fetch_log(spark, sf_dir):
    path = new_dir(spark, "fetch-log")
    tables.write_fetch_log(_fetch_log(spark, sf_dir), path)
    return tables.read_csv(spark, path, tables.FETCH_LOG)


@check(f"""WITH {S.HYBRID_ALL}
SELECT id, conf, "year", title, abstract, category_key, category_label, confidence, reasoning, method FROM hybrid""")
def write_detailed(spark, sf_dir):
    path = new_dir(spark, "detailed")
    tables.write_detailed(_hybrid(spark, sf_dir).drop("doc_id"), path)
    return tables.read_results(spark, path)


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT conf, "year", title, abstract, category_label AS category FROM classified""")
def write_simple(spark, sf_dir):
    path = new_dir(spark, "simple")
    tables.write_simple(V.classified(spark, sf_dir), path)
    return tables.read_csv(spark, path, tables.SIMPLE)


@check(f"""WITH {S.HYBRID_ALL} SELECT id, title, abstract, category_key, category_label, confidence, reasoning, method
FROM hybrid""")
def write_reclassified(spark, sf_dir):
    path = new_dir(spark, "reclassified")
    tables.write_reclassified(_hybrid(spark, sf_dir).drop("doc_id", "conf", "year"), path)
    return tables.read_results(spark, path)


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT id, category_key FROM classified""")
def write_checkpoint(spark, sf_dir):
    path = new_dir(spark, "checkpoint")
    done = _labelled(spark, sf_dir, V.classified(spark, sf_dir))
    tables.write_checkpoint(done, path)
    earlier = tables.read_results(spark, path)
    tables.write_checkpoint(resume.filter_unprocessed(V.classified(spark, sf_dir), earlier), path)
    return tables.read_results(spark, path).select("id", "category_key")


def _licensed(spark, sf_dir) -> DataFrame:
    """New results for the texts that mention a license."""
    documents = V.table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("license")))
    return (
        scoring.with_hash(V.papers(spark, sf_dir).join(documents.select("doc_id", "source"), "doc_id"))
        .groupBy("paper_hash")
        .agg(F.max("source").alias("reasoning"))
        .select(
            "paper_hash",
            F.lit(fixed.DEFAULT_KEY).alias("category_key"),
            F.lit(fixed.CUSTOM_DEFAULT_LABEL).alias("category_label"),
            F.lit(0.75).alias("confidence"),
            "reasoning",
        )
    )


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}, fresh AS (
  SELECT {S.HASH} AS paper_hash, 'other' AS category_key, {S.OTHER} AS category_label,
         CAST(0.75 AS DOUBLE) AS confidence, max(source) AS reasoning
  FROM papers JOIN documents d USING (doc_id) WHERE contains(d.text, 'license') GROUP BY ALL)
SELECT * FROM fresh UNION ALL
SELECT * FROM predictions WHERE paper_hash NOT IN (SELECT paper_hash FROM fresh)""")
def upsert_cache(spark, sf_dir):
    path = new_dir(spark, "cache")
    tables.write_cache(tables.upsert_cache(V.predictions(spark, sf_dir), _licensed(spark, sf_dir)), path)
    return tables.read_results(spark, path, tables.CACHE)


@check(ORACLES["write_checkpoint"])
def write_checkpoint_chunks(spark, sf_dir):
    """The same in chunks: labelled papers first, then all papers, of which the labelled ones are done."""
    path, papers = new_dir(spark, "checkpoint"), V.on_topic(spark, sf_dir)
    rows = V.custom_rows(spark)
    for part, chunks in ((_labelled(spark, sf_dir, papers), 2), (papers, 3)):
        resume.in_chunks(part, path, chunks, lambda todo: classify.classify_rules(todo, rows, fixed.CUSTOM_DEFAULT_LABEL), reread=False)
    return tables.read_committed(spark, path).select("id", "category_key")


@check(ORACLES["upsert_cache"])
def update_stored_cache(spark, sf_dir):
    """The same by buckets: the predictions are stored first, then the new results rewrite the buckets they fall in."""
    path = new_dir(spark, "stored-cache")
    tables.update_stored_cache(V.predictions(spark, sf_dir), path)
    tables.update_stored_cache(_licensed(spark, sf_dir), path)
    return tables.read_stored_cache(spark, path)


# --- projections -------------------------------------------------------------


@check(f"""WITH {S.NOTES} SELECT doc_id, note_id, title, abstract FROM normalized""")
def normalize_note(spark, sf_dir):
    return landing.normalize_note(V.notes(spark, sf_dir)).select("doc_id", "note_id", "title", "abstract")


@check(f"""WITH {S.LANDED_ALL}, chosen AS (
  SELECT n.* FROM page_notes n JOIN kept_pages USING (conf, "year", candidate, "offset")
  JOIN winners w USING (conf, "year", candidate) WHERE candidate % 2 = 0 OR n.accepted),
matched AS (SELECT * FROM chosen WHERE {S.words(S.TXT, S.TOPIC_WORDS)})
SELECT conf || '_' || "year" || '_' || coalesce(note_id, CAST(
         row_number() OVER (ORDER BY conf, "year", "offset", position) - 1 AS VARCHAR)) AS id,
       conf, "year", title, abstract FROM matched""")
def paper_id(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    winners = materialize(landing.first_success(_candidate_counts(pages)), "winners")
    chosen = landing.normalize_note(landing.accepted_notes(pages, winners)).drop("note")
    matched = materialize(topic.filter_topic(chosen, V.TOPIC), "matched")
    return landing.paper_ids(matched).select("id", "conf", "year", "title", "abstract")


@check(f"""WITH {S.PAPERS} SELECT id, {S.TXT} AS match_text, CAST(length({S.TXT}) AS INTEGER) AS size FROM papers""")
def match_text(spark, sf_dir):
    joined = text.match_text(F.col("title"), F.col("abstract"))
    return V.papers(spark, sf_dir).select("id", joined.alias("match_text"), F.length(joined).alias("size"))


@check(f"""WITH {S.PAPERS} SELECT id, {S.HASH} AS paper_hash FROM papers""")
def paper_hash(spark, sf_dir):
    return scoring.with_hash(V.papers(spark, sf_dir)).select("id", "paper_hash")


@check(rf"""WITH {S.PAPERS}, labels_ AS (
  SELECT id, ['📚 ', '🛡️ ', '[] ', ''][1 + doc_id % 4] || title AS label FROM papers)
SELECT id, trim(regexp_replace(label, '^[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+\s*', ''), {S.WS}) AS display FROM labels_""")
def display_label(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ["📚 ", "🛡️ ", "[] ", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    label = F.concat(prefix, "title")
    return V.papers(spark, sf_dir).select("id", text.display_label(label).alias("display"))


@check("""SELECT o_orderkey, CASE WHEN o_totalprice / 10000 >= 2 THEN printf('%.1f%%', o_totalprice / 10000) ELSE '' END
  AS pct_label FROM orders""")
def pct_label(spark, sf_dir):
    pct = F.col("o_totalprice") / 10000
    return V.table(spark, sf_dir, "orders").select("o_orderkey", text.pct_label(pct).alias("pct_label"))


@check(f"""SELECT doc_id, trim(chr(9) || chr(12288) || text || chr(160) || ' ' || chr(10), {S.WS}) AS stripped FROM documents""")
def py_strip(spark, sf_dir):
    padded = F.concat(F.lit("\t　"), "text", F.lit("\xa0 \n"))
    return V.table(spark, sf_dir, "documents").select("doc_id", text.strip(padded).alias("stripped"))


@check(f"""WITH {S.PAPERS} SELECT id, left(title, 60) || '...' AS title_60, left(abstract, 500) || '...' AS abstract_500,
  left(abstract, 100) AS reasoning_100, replace(left(abstract, 400), chr(10), ' ') AS error_400 FROM papers""")
def truncate(spark, sf_dir):
    title, abstract = F.col("title"), F.col("abstract")
    return V.papers(spark, sf_dir).select(
        "id",
        text.truncate(title, 60, "...").alias("title_60"),
        text.truncate(abstract, 500, "...").alias("abstract_500"),
        text.truncate(abstract, 100).alias("reasoning_100"),
        text.error_snippet(abstract).alias("error_400"),
    )


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT conf, "year", title, abstract, category_label AS category FROM classified""")
def drop_rename(spark, sf_dir):
    return tables.simple_table(V.classified(spark, sf_dir))


@check(f"""WITH {S.CLASSIFIED_ALL}
SELECT id, conf, "year", title, abstract, doc_id, source, n_chars, category_key, category_label
FROM classified JOIN (SELECT doc_id, source, n_chars FROM documents) USING (doc_id)""")
def carry_columns(spark, sf_dir):
    more = V.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    wide = V.on_topic(spark, sf_dir).join(more, "doc_id")
    return classify.classify_rules(wide, V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL)


# --- filters -----------------------------------------------------------------


@check(f"""WITH {S.NOTES} SELECT doc_id FROM notes WHERE accepted""")
def filter_accepted(spark, sf_dir):
    return landing.filter_accepted(V.notes(spark, sf_dir)).select("doc_id")


@check(f"""WITH {S.NOTES} SELECT doc_id FROM notes WHERE by_id OR accepted""")
def filter_accepted_strict(spark, sf_dir):
    return landing.filter_accepted(V.notes(spark, sf_dir), strict=True).select("doc_id")


@check(f"""WITH {S.NOTES} SELECT doc_id FROM notes WHERE by_id""")
def filter_venueid(spark, sf_dir):
    return landing.filter_venueid(V.notes(spark, sf_dir)).select("doc_id")


@check(f"""WITH {S.RESEARCH}, {S.RESEARCH_ON_TOPIC} SELECT id, conf, "year" FROM research_on_topic""")
def filter_topic_default(spark, sf_dir):
    return topic.filter_topic(V.research_papers(spark, sf_dir)).select("id", "conf", "year")


@check(f"""WITH {S.PAPERS}, {S.ON_TOPIC} SELECT id, conf, "year", title, abstract FROM on_topic""")
def filter_topic_custom(spark, sf_dir):
    return V.on_topic(spark, sf_dir).drop("doc_id")


def _labelled(spark, sf_dir, papers: DataFrame) -> DataFrame:
    """The papers somebody has labelled already."""
    numbers = V.table(spark, sf_dir, "labels").select("doc_id")
    return joins.join_bounded(papers, numbers, "doc_id", "left_semi", 4_000_000)  # short rows; their bytes are bounded too


@check(f"""WITH {S.PAPERS} SELECT id FROM papers WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def filter_unprocessed(spark, sf_dir):
    papers = V.papers(spark, sf_dir)
    return resume.filter_unprocessed(papers, _labelled(spark, sf_dir, papers)).select("id")


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}
SELECT paper_hash, confidence FROM predictions WHERE confidence < CAST(0.6 AS DOUBLE)""")
def low_confidence(spark, sf_dir):
    return scoring.low_confidence(V.predictions(spark, sf_dir)).select("paper_hash", "confidence")


@check(f"""WITH {S.PAPERS} SELECT id, "year", CAST(quality AS VARCHAR) AS category FROM papers JOIN labels USING (doc_id)""")
def drop_null_keys(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))
    joined = V.papers(spark, sf_dir).join(labels, "doc_id", "left")
    return report.drop_null_keys(joined, "year", "category").select("id", "year", "category")


@check(f"""WITH {S.ORDERS_BY_YEAR} SELECT * FROM orders_by_year WHERE "year" IN ({years(V.ORDER_YEARS)})""")
def restrict_years(spark, sf_dir):
    return report.restrict_years(V.orders_by_year(spark, sf_dir), V.ORDER_YEARS)


# --- rule classification -----------------------------------------------------


@check(f"""WITH {S.RESEARCH_ALL} SELECT id, category_key, category_label FROM research_classified""")
def classify_rules(spark, sf_dir):
    return V.research_classified(spark, sf_dir).select("id", "category_key", "category_label")


@check(f"""WITH {S.RESEARCH} SELECT id, {S.builtin_case("key")} AS category_key FROM research_papers""")
def classify_rules_all(spark, sf_dir):
    """Also the papers that are off topic."""
    papers = V.research_papers(spark, sf_dir)
    return classify.classify_rules(papers, taxonomy.builtin_rows(), fixed.BUILTIN_DEFAULT_LABEL).select(
        "id", "category_key"
    )


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT id, category_key, category_label FROM classified""")
def classify_custom(spark, sf_dir):
    return V.classified(spark, sf_dir).select("id", "category_key", "category_label")


_MANY = {
    "articles": {
        ("custom_1", "Le"): "le|la|les",
        ("custom_2", "Der"): "der|die|das|ders",
        ("custom_3", "The"): "the|thes",
    },
    "links": {
        ("custom_1", "And"): "and|or|ands",
        ("custom_2", "Of"): "of|ofs",
        ("custom_3", "Zu"): "zu|von|zus",
    },
    "vision": {
        ("custom_1", "视觉语言融合"): "of the|on the|visual|vision|image|language|linguistic|text|nlp|fusion|integration"
        "|multimodal|视觉语言融合",
        ("custom_2", "跨模态检索"): "to|que|retrieval|search|matching|cross-modal|multimodal|跨模态检索",
    },
}


@check(
    f"WITH {S.PAPERS} "
    + " UNION ALL ".join(
        f"SELECT id, '{name}' AS taxonomy_id, {S.first_match(c, 0, 'other')} AS category_key, "
        f"{S.first_match(c, 1, fixed.CUSTOM_DEFAULT_LABEL)} AS category_label FROM papers"
        for name, c in _MANY.items()
    )
)
def classify_many(spark, sf_dir):
    specs = spark.createDataFrame([(n, "any", s) for n, s in V.MORE_SPECS.items()], "taxonomy_id string, topic string, spec string")
    compiled = taxonomy.compile_taxonomies(taxonomy.parse_specs(specs))
    return pattern_index.classify_many(V.papers(spark, sf_dir), compiled, fixed.DEFAULT_KEY, fixed.CUSTOM_DEFAULT_LABEL)


_ESCAPE = r"regexp_replace(k, '([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\x0c])', '\\\1', 'g')"
# A keyword is searched for only in the texts that hold it as they stand, which settles nearly all of them.
_KEYWORD_HITS = rf"""spec_words AS MATERIALIZED (SELECT DISTINCT unnest(keywords) AS k FROM keyworded),
lowered AS MATERIALIZED (SELECT id, {S.TXT} AS txt, lower({S.TXT}) AS low FROM research_papers),
held AS MATERIALIZED (SELECT id, txt, k FROM lowered, spec_words WHERE contains(low, lower(k))),
hits AS MATERIALIZED (SELECT id, k FROM held WHERE regexp_matches(txt, '(?i)(?:^|{S.W})' || {_ESCAPE} || '(?:{S.W}|$)'))"""


def _spec_taxonomies(spark, sf_dir) -> DataFrame:
    """A taxonomy for every part."""
    return taxonomy.compile_taxonomies(taxonomy.parse_specs(V.specs(spark, sf_dir)))


@check(rf"""WITH {S.RESEARCH}, {S.SPECS}, {_KEYWORD_HITS} SELECT id, '\b' || {_ESCAPE} || '\b' AS pattern FROM hits""")
def regex_join(spark, sf_dir):
    """Papers with all patterns of all parts' taxonomies."""
    patterns = _spec_taxonomies(spark, sf_dir).select(F.explode("patterns").alias("pattern"))
    return pattern_index.regex_join(V.research_papers(spark, sf_dir), patterns)


@check(f"""WITH {S.RESEARCH}, {S.SPECS}, {_KEYWORD_HITS},
named_words AS (SELECT taxonomy_id, priority, label, unnest(keywords) AS k FROM keyworded)
SELECT id, taxonomy_id, 'custom_' || min(priority) AS category_key, arg_min(label, priority) AS category_label
FROM hits JOIN named_words USING (k) GROUP BY id, taxonomy_id""")
def classify_table(spark, sf_dir):
    """Papers in the taxonomies of all parts, matches only."""
    return pattern_index.classify_table(V.research_papers(spark, sf_dir), _spec_taxonomies(spark, sf_dir))


@check(
    f"""WITH {S.RESEARCH_ALL},
builtin(priority, key, label, n_patterns) AS (VALUES """
    + ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', {len(r[4])})" for r in S.BUILTIN)
    + """)
SELECT CAST(priority AS INTEGER) AS priority, key, label, CAST(n_patterns AS INTEGER) AS n_patterns,
       (SELECT count(*) FROM research_classified WHERE category_key = key) AS papers FROM builtin"""
)
def taxonomy_table(spark, sf_dir):
    """The built-in categories with how many papers each one holds."""
    counts = V.research_classified(spark, sf_dir).groupBy(F.col("category_key").alias("key")).agg(F.count("*").alias("papers"))
    return (
        taxonomy.builtin_table(spark)
        .join(counts, "key", "left")
        .select("priority", "key", "label", F.size("patterns").alias("n_patterns"), F.coalesce("papers", F.lit(0)).alias("papers"))
    )


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS} SELECT paper_hash, category_key, category_label FROM predictions""")
def lookup_category(spark, sf_dir):
    names = taxonomy.rows_table(spark, V.custom_rows(spark), "custom")
    keys = V.predictions(spark, sf_dir).select("paper_hash", "category_key")
    return classify.lookup_category(keys, names, fixed.CUSTOM_DEFAULT_LABEL)


@check(
    f"WITH {S.PAPERS}, {S.ON_TOPIC} "
    + " UNION ALL ".join(
        f"""SELECT id, CAST({n} AS INTEGER) AS priority, '{key}' AS category_key, lower('{word}') AS word,
            regexp_extract({S.TXT}, '(?i)(?:^|{S.W})({word})(?:{S.W}|$)', 1) AS found
            FROM on_topic WHERE {S.words(S.TXT, word)}"""
        for n, ((key, _), alternatives) in enumerate(S.CATEGORY_WORDS.items(), 1)
        for word in alternatives.split("|")
    )
)
def match_evidence(spark, sf_dir):
    hits = classify.match_evidence(V.on_topic(spark, sf_dir), V.custom_rows(spark))
    word = F.lower(F.replace("pattern", F.lit(r"\b"), F.lit("")))
    return hits.select("id", "priority", "category_key", word.alias("word"), "found").distinct()


@check(
    f"WITH {S.RESEARCH}, hits AS (SELECT id, unnest(["
    + ", ".join(
        f"CASE WHEN regexp_matches({S.TXT}, '{S.pattern_sql(p)}') THEN {{'category_key': '{key}', 'pattern_no': {i}}} END"
        for _, key, _, _, patterns in S.BUILTIN
        for i, p in enumerate(patterns, 1)
    )
    + "]) AS hit FROM research_papers) SELECT id, hit.category_key, hit.pattern_no FROM hits WHERE hit IS NOT NULL"
)
def match_evidence_builtin(spark, sf_dir):
    hits = classify.match_evidence(V.research_papers(spark, sf_dir), taxonomy.builtin_rows())
    return hits.select("id", "category_key", "pattern_no")


# --- aggregations ------------------------------------------------------------


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT category, count(*) AS n FROM classified GROUP BY ALL""")
def category_counts(spark, sf_dir):
    return report.category_counts(V.classified(spark, sf_dir))


@check(f"""WITH {S.HYBRID_ALL} SELECT method, count(*) AS n FROM hybrid GROUP BY ALL""")
def method_counts(spark, sf_dir):
    return report.method_counts(_hybrid(spark, sf_dir))


@check(f"""WITH {S.PAPERS}, {S.ON_TOPIC} SELECT conf, "year", count(*) AS matched FROM on_topic GROUP BY ALL""")
def matched_counts(spark, sf_dir):
    return report.matched_counts(V.on_topic(spark, sf_dir))


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT "year", category, count(*) AS "count" FROM classified GROUP BY ALL""")
def year_category_counts(spark, sf_dir):
    return report.year_category_counts(V.classified(spark, sf_dir))


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT "year", """
       + ", ".join(f"""count(*) FILTER (WHERE category = '{c}') AS "{c}" """ for c in
                   ["Licensing", "Credentials", "Deixis", "Prose", fixed.CUSTOM_DEFAULT_LABEL])
       + " FROM classified GROUP BY ALL")
def year_category_pivot(spark, sf_dir):
    names = [r.label for r in V.custom_rows(spark)] + [fixed.CUSTOM_DEFAULT_LABEL]
    return report.year_category_pivot(V.classified(spark, sf_dir), names)


def _spine_sql(source: str, wanted: list[int]) -> str:
    return f"""spine AS (
  SELECT y AS "year", CAST(pos - 1 AS INTEGER) AS position, category,
         (SELECT count(*) FROM {source} d WHERE d."year" = y AND d.category = c.category) AS "count"
  FROM (SELECT DISTINCT category FROM {source}) c,
       (SELECT CAST(unnest([{years(wanted)}]) AS INTEGER) AS y, generate_subscripts([{years(wanted)}], 1) AS pos)),
totals AS (SELECT category, CAST(sum("count") AS BIGINT) AS total FROM spine GROUP BY ALL)"""


def _share_sql(source: str) -> str:
    return f"""SELECT category, trim(regexp_replace(category, '^[^A-Za-z0-9一-鿿]+', ''), {S.WS}) AS display, n,
  100.0::DOUBLE * n / total AS pct,
  CASE WHEN 100.0::DOUBLE * n / total >= 2 THEN printf('%.1f%%', 100.0::DOUBLE * n / total) ELSE '' END AS pct_label
FROM (SELECT category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {source} GROUP BY category)"""


def _trend_sql(k: int, other: str) -> str:
    return f"""kept AS (SELECT category FROM totals ORDER BY total DESC, category LIMIT {k}),
series AS (
  SELECT "year", CASE WHEN category IN (FROM kept) THEN category ELSE '{other}' END AS category,
         category NOT IN (FROM kept) AS is_other, CAST(sum("count") AS BIGINT) AS "count"
  FROM spine GROUP BY ALL)
SELECT "year", category, "count", CAST(sum("count") OVER (PARTITION BY "year") AS BIGINT) AS year_total, is_other FROM series"""


@check(f"""WITH {S.CLASSIFIED_ALL}, {_spine_sql("classified", V.YEARS)} SELECT * FROM spine""")
def year_spine(spark, sf_dir):
    return report.year_spine(V.classified(spark, sf_dir), V.YEARS)


@check(f"""WITH {S.CLASSIFIED_ALL}, {_spine_sql("classified", V.YEARS)} SELECT * FROM totals""")
def category_totals(spark, sf_dir):
    return report.category_totals(V.classified(spark, sf_dir), V.YEARS)


@check(f"""WITH {S.CLASSIFIED_ALL}, {_spine_sql("classified", V.YEARS)}
SELECT "year", CAST(sum("count") AS BIGINT) AS year_total FROM spine GROUP BY ALL""")
def year_totals(spark, sf_dir):
    return report.year_totals(V.classified(spark, sf_dir), V.YEARS)


@check(f"""WITH {S.CLASSIFIED_ALL}, {_spine_sql("classified", V.YEARS)}
SELECT * FROM totals ORDER BY total DESC, category LIMIT 3""")
def topk_categories(spark, sf_dir):
    return report.topk_categories(V.classified(spark, sf_dir), V.YEARS, 3)


@check(f"""WITH {S.CLASSIFIED_ALL} {_share_sql("classified")}""")
def category_share(spark, sf_dir):
    return report.category_share(V.classified(spark, sf_dir))


@check(f"""WITH {S.CLASSIFIED_ALL}, {_spine_sql("classified", V.YEARS)}, {_trend_sql(2, fixed.LONG_TAIL_LABEL)}""")
def topk_trend(spark, sf_dir):
    return report.topk_trend(V.classified(spark, sf_dir), V.YEARS, 2)


@check(f"""WITH {S.RESEARCH_ALL}, named AS (SELECT *, category_label AS category FROM research_classified)
{_share_sql("named")}""")
def research_share(spark, sf_dir):
    return report.category_share(V.research_classified(spark, sf_dir))


@check(f"""WITH {S.RESEARCH_ALL}, named AS (SELECT *, category_label AS category FROM research_classified),
{_spine_sql("named", V.YEARS)}, {_trend_sql(5, fixed.BUILTIN_LONG_TAIL_LABEL)}""")
def research_trend(spark, sf_dir):
    return report.topk_trend(V.research_classified(spark, sf_dir), V.YEARS, 5, fixed.BUILTIN_LONG_TAIL_LABEL)


@check(f"""WITH {S.ORDERS_BY_YEAR} {_share_sql("orders_by_year")}""")
def orders_share(spark, sf_dir):
    return report.category_share(V.orders_by_year(spark, sf_dir))


@check(f"""WITH {S.ORDERS_BY_YEAR}, {_spine_sql("orders_by_year", V.ORDER_YEARS)}, {_trend_sql(3, fixed.LONG_TAIL_LABEL)}""")
def orders_trend(spark, sf_dir):
    return report.topk_trend(V.orders_by_year(spark, sf_dir), V.ORDER_YEARS, 3)


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT min("year") AS year_min, max("year") AS year_max FROM classified""")
def year_range(spark, sf_dir):
    return report.year_range(V.classified(spark, sf_dir))


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT "year", category, count(*) AS "count" FROM classified GROUP BY ALL ORDER BY "year" """)
def sort_years(spark, sf_dir):
    return report.sort_years(report.year_category_counts(V.classified(spark, sf_dir)))


# --- scoring -----------------------------------------------------------------


def _hybrid(spark, sf_dir) -> DataFrame:
    return scoring.hybrid_classify(
        V.papers(spark, sf_dir), V.predictions(spark, sf_dir), V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL
    )


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}
SELECT p.id, s.category_key, s.confidence, s.paper_hash IS NOT NULL AS from_cache
FROM papers p LEFT JOIN predictions s ON s.paper_hash = {S.HASH}""")
def cache_join(spark, sf_dir):
    return scoring.cache_join(V.papers(spark, sf_dir), V.predictions(spark, sf_dir)).select(
        "id", "category_key", "confidence", "from_cache"
    )


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}
SELECT p.id, s.category_key, s.confidence, s.paper_hash IS NOT NULL AS from_cache
FROM papers p LEFT JOIN predictions s ON s.paper_hash = {S.HASH}""")
def cache_join_hot_keys(spark, sf_dir):
    """The same join with keys split from two copies of a text on."""
    papers = scoring.with_hash(V.papers(spark, sf_dir))
    cache = V.predictions(spark, sf_dir).withColumn("from_cache", F.lit(True))
    joined = joins.join_skewed(papers, cache, "paper_hash", "id", max_rows=0, rows_per_split=1)
    return joined.select("id", "category_key", "confidence", F.coalesce("from_cache", F.lit(False)).alias("from_cache"))


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}, scored AS (SELECT id, category_key FROM papers p JOIN predictions s ON s.paper_hash = {S.HASH})
SELECT p.id, s.category_key FROM papers p LEFT JOIN scored s USING (id)""")
def scored_join(spark, sf_dir):
    papers = V.papers(spark, sf_dir)
    scores = scoring.cache_join(papers, V.predictions(spark, sf_dir)).filter("from_cache").select("id", "category_key")
    return scoring.scored_join(papers, scores).select("id", "category_key")


def _batched_sql(size: int = 10) -> str:
    return f"""batched AS (
  SELECT *, CAST(num // {size} AS INTEGER) AS batch_no, CAST(num % {size} AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY paper_hash, id) - 1 AS num
        FROM (SELECT *, CAST(CAST('0x' || substr(paper_hash, 1, 8) AS BIGINT)
                % greatest(1, (SELECT CAST(ceil(count(*) / 10000) AS BIGINT) FROM unscored)) AS INTEGER) AS bucket
              FROM unscored)))"""


def _unscored_sql(known: str) -> str:
    return f"""unscored AS (
  SELECT {S.HASH} AS paper_hash, min(id) AS id, any_value(title) AS title, any_value(abstract) AS abstract
  FROM papers GROUP BY 1 HAVING {S.HASH} NOT IN (SELECT paper_hash FROM predictions WHERE {known})),
{_batched_sql()}"""


UNSCORED_SQL = _unscored_sql("true")


def _batched(spark, sf_dir, cache: DataFrame | None = None) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    keys = scoring.keys_to_score(papers, V.predictions(spark, sf_dir) if cache is None else cache)
    return scoring.score_batches(materialize(keys, "unscored"))


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}, {UNSCORED_SQL}
SELECT paper_hash, id, bucket, batch_no, position FROM batched""")
def score_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("paper_hash", "id", "bucket", "batch_no", "position")


def _definitions(spark) -> str:
    table = taxonomy.rows_table(spark, V.custom_rows(spark), "custom")
    return taxonomy.definitions_text(table, fixed.CUSTOM_DEFAULT_LABEL).first()["definitions"]


def _prompts(spark, sf_dir, cache: DataFrame | None = None) -> DataFrame:
    keys = materialize(_batched(spark, sf_dir, cache), "batched")
    return scoring.build_prompts(scoring.attach_texts(keys, V.papers(spark, sf_dir)), _definitions(spark))


_DEFINITIONS_SQL = f"""1. **Licensing** (key: custom_1)
   包含关键词：Licensing, Licensinged, Licensinging, Licensings, apache, license

2. **Credentials** (key: custom_2)
   包含关键词：Credentials, Credentialsed, Credentialsing, token

3. **Deixis** (key: custom_3)
   包含关键词：Deixis, Deixised, Deixising, here, this

4. **Prose** (key: custom_4)
   包含关键词：Prose, Prosed, Proses, Prosing, from, with

5. **{fixed.CUSTOM_DEFAULT_LABEL}** (key: other)
   {fixed.DEFAULT_DESCRIPTION}"""


@check(f"""WITH {S.PAPERS}, {S.PREDICTIONS}, {UNSCORED_SQL}
SELECT bucket, batch_no, CAST(count(*) AS INTEGER) AS papers,
  '{fixed.PROMPT_HEAD}{_DEFINITIONS_SQL}{fixed.PROMPT_PAPERS}' ||
  string_agg('Paper ID: ' || id || chr(10) || 'Title: ' || title || chr(10) || 'Abstract: ' || abstract,
             chr(10) || chr(10) ORDER BY position) || '{fixed.PROMPT_TAIL}' AS prompt
FROM batched GROUP BY ALL""")
def build_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir).select("bucket", "batch_no", F.size("ids").alias("papers"), "prompt")


def _answers_sql(texts: str) -> str:
    """Answers of the shipped scorer to the batches, and what is made of them."""
    return f"""stored AS (
  SELECT t.id, CASE WHEN tenth <> 7 THEN category_key END AS category_key, CASE WHEN tenth <> 8 THEN confidence END AS confidence, reasoning,
         CASE WHEN tenth = 10 AND category_key <> 'custom_1' THEN 'refused, ' || reasoning END AS error
  FROM (SELECT *, CAST(round(confidence * 10) AS INTEGER) AS tenth FROM predictions) JOIN ({texts}) t USING (paper_hash)),
answered AS (
  SELECT b.id, bucket, batch_no, s.id IS NULL AS missing, s.category_key, s.confidence, s.reasoning,
         first_value(s.error IGNORE NULLS) OVER (PARTITION BY bucket, batch_no ORDER BY position
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS error
  FROM batched b LEFT JOIN stored s USING (id)),
scored AS (
  SELECT id, CASE WHEN given THEN key ELSE 'other' END AS category_key,
         CASE WHEN given THEN CASE key WHEN 'custom_1' THEN 'Licensing' WHEN 'custom_2' THEN 'Credentials' WHEN 'custom_3' THEN 'Deixis'
              ELSE {S.OTHER} END ELSE {S.OTHER} END AS category_label,
         CASE WHEN given THEN coalesce(confidence, CAST(0.5 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS confidence,
         CASE WHEN error IS NOT NULL THEN 'API Error: ' || error WHEN missing THEN 'No classification returned' ELSE reasoning END AS reasoning,
         error IS NOT NULL AS failed
  FROM (SELECT *, coalesce(category_key, 'other') AS key, error IS NULL AND NOT missing AS given FROM answered))"""


_TEXT_IDS = f"SELECT {S.HASH} AS paper_hash, min(id) AS id FROM papers GROUP BY 1"
_SCORED_SQL = f"{S.PAPERS}, {S.PREDICTIONS}, {_unscored_sql('confidence < 0.3')}, {_answers_sql(_TEXT_IDS)}"


def _responses(spark, sf_dir) -> DataFrame:
    scorer = scoring.predictions_scorer(V.stored_answers(spark, sf_dir, V.papers(spark, sf_dir)))
    return scoring.apply_scorer(_prompts(spark, sf_dir, V.known_predictions(spark, sf_dir)), scorer)


@check(f"""WITH {_SCORED_SQL}
SELECT bucket, batch_no, count(*) AS papers, CAST(count(*) FILTER (WHERE error IS NULL AND NOT missing) AS INTEGER) AS answers
FROM answered GROUP BY ALL""")
def apply_scorer(spark, sf_dir):
    answers = F.from_json("response", scoring.ANSWERS).classifications
    return _responses(spark, sf_dir).select(
        "bucket",
        "batch_no",
        F.size("ids").cast("bigint").alias("papers"),
        F.coalesce(F.size(answers), F.lit(0)).alias("answers"),
    )


def _scored(spark, sf_dir) -> DataFrame:
    responses = materialize(_responses(spark, sf_dir), "responses")
    return scoring.parse_responses(responses, V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL)


@check(f"""WITH {_SCORED_SQL} SELECT * FROM scored""")
def parse_responses(spark, sf_dir):
    return _scored(spark, sf_dir)


@check(f"""WITH {_SCORED_SQL} SELECT id, category_key, confidence, reasoning FROM scored WHERE failed""")
def failed_batches(spark, sf_dir):
    return _scored(spark, sf_dir).filter("failed").select("id", "category_key", "confidence", "reasoning")


@check(f"""WITH {S.HYBRID_ALL} SELECT id, category_key, category_label, confidence, reasoning, method FROM hybrid""")
def hybrid_classify(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("id", "category_key", "category_label", "confidence", "reasoning", "method")


@check(f"""WITH {S.CLASSIFIED_ALL} SELECT id, category_key, category_label, CAST(1 AS DOUBLE) AS confidence,
  'Rule-based classification' AS reasoning, 'rule' AS method FROM classified""")
def classify_without_scorer(spark, sf_dir):
    return scoring.hybrid_classify(
        V.on_topic(spark, sf_dir), None, V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL
    ).select("id", "category_key", "category_label", "confidence", "reasoning", "method")


# --- resuming ----------------------------------------------------------------


@check(f"""WITH {S.PAPERS} SELECT id, CAST(quality AS VARCHAR) AS category_key FROM papers JOIN labels USING (doc_id)
UNION ALL SELECT id, NULL FROM papers WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def union_results(spark, sf_dir):
    papers = V.papers(spark, sf_dir)
    labels = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("category_key"))
    earlier = papers.join(labels, "doc_id").select("id", "category_key")
    return resume.union_results(earlier, resume.filter_unprocessed(papers, earlier).select("id"))


@check(f"""WITH {S.PAPERS} SELECT id, conf, "year" FROM papers
UNION ALL SELECT p.id, p.conf, p."year" FROM papers p JOIN labels USING (doc_id)""")
def union_sources(spark, sf_dir):
    papers = V.papers(spark, sf_dir)
    return report.union_sources(papers, _labelled(spark, sf_dir, papers)).select("id", "conf", "year")


@check(f"""WITH {S.PAPERS} SELECT DISTINCT id FROM papers JOIN labels USING (doc_id)""")
def distinct_ids(spark, sf_dir):
    done = _labelled(spark, sf_dir, V.papers(spark, sf_dir))
    return resume.processed_ids(report.union_sources(done, done))


# --- comparing ---------------------------------------------------------------


def _compared(spark, sf_dir) -> DataFrame:
    rules = classify.classify_rules(V.papers(spark, sf_dir), V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL)
    old = rules.select("id", F.col("category_label").alias("category"))
    return compare.compare_join(old, _hybrid(spark, sf_dir))


@check(f"""WITH {S.HYBRID_ALL} SELECT id, rule_label AS old_label, category_label AS new_label, method FROM hybrid""")
def compare_join(spark, sf_dir):
    return _compared(spark, sf_dir).select("id", "old_label", "new_label", "method")


@check(f"""WITH {S.HYBRID_ALL} SELECT id, left(title, 60) || '...' AS title, rule_label AS old_label,
  category_label AS new_label, confidence, method, left(reasoning, 100) || '...' AS reasoning
FROM hybrid WHERE rule_label IS DISTINCT FROM category_label""")
def changed_only(spark, sf_dir):
    return compare.changed_only(_compared(spark, sf_dir))


_STATS_SQL = """SELECT count(*) AS total, count(*) FILTER (WHERE method = 'llm') AS by_llm,
  count(*) FILTER (WHERE method <> 'llm') AS by_rule, count(*) FILTER (WHERE rule_label <> category_label) AS changed,
  printf('%.1f', 100.0::DOUBLE * count(*) FILTER (WHERE rule_label <> category_label) / count(*)) AS changed_pct"""


@check(f"""WITH {S.HYBRID_ALL} {_STATS_SQL} FROM hybrid""")
def reclass_stats(spark, sf_dir):
    return compare.reclass_stats(_compared(spark, sf_dir))


@check(f"""WITH {S.HYBRID_ALL} SELECT rule_label AS old_label, category_label AS new_label, count(*) AS n FROM hybrid GROUP BY ALL""")
def label_transitions(spark, sf_dir):
    return compare.label_transitions(_compared(spark, sf_dir))


@check(f"""WITH {S.PAPERS} SELECT id, title FROM papers ORDER BY id LIMIT 50""")
def sample_head(spark, sf_dir):
    return compare.sample_head(V.papers(spark, sf_dir), 50).select("id", "title")


@check(f"""WITH {S.HYBRID_ALL} SELECT id, title, abstract, category_key, category_label, confidence, reasoning, method FROM hybrid""")
def reclassify(spark, sf_dir):
    """Stored labels in, new labels out: all of the table."""
    from topicflow.plans.reclassify import reclassify as run

    rules = classify.classify_rules(V.papers(spark, sf_dir), V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL)
    stored = rules.select("id", "title", "abstract", F.col("category_label").alias("category"))
    outcome = run(stored, V.predictions(spark, sf_dir), V.custom_rows(spark), fixed.CUSTOM_DEFAULT_LABEL)
    return outcome.results


_SIMPLE_ID = f"""conf || '_' || "year" || '_' || {S.HASH}"""


@check(f"""WITH {S.CLASSIFIED_ALL}, {S.PREDICTIONS},
simple AS (SELECT {_SIMPLE_ID} AS id, {S.HASH} AS paper_hash, category AS old_label FROM classified),
texts AS (SELECT paper_hash, min(id) AS id FROM simple GROUP BY 1),
unscored AS (SELECT * FROM texts), {_batched_sql(5)}, {_answers_sql("SELECT paper_hash, id FROM texts")},
known AS (SELECT paper_hash, s.* FROM scored s JOIN texts USING (id))
SELECT x.id, old_label, CASE WHEN k.confidence < 0.6 THEN old_label ELSE k.category_label END AS new_label,
       CASE WHEN k.confidence < 0.6 THEN CAST(0.5 AS DOUBLE) ELSE k.confidence END AS confidence,
       CASE WHEN k.confidence < 0.6 THEN 'rule_fallback' ELSE 'llm' END AS method
FROM simple x JOIN known k USING (paper_hash)""")
def reclassify_scored(spark, sf_dir):
    """The stored simple table, classified again with the shipped scorer in batches of five; low answers go to the rules."""
    path = new_dir(spark, "simple")
    tables.write_simple(V.classified(spark, sf_dir), path)
    stored = materialize(tables.read_csv(spark, path, tables.SIMPLE), "stored")
    ids = stored.withColumn("id", F.concat_ws("_", "conf", "year", text.paper_hash(F.col("title"), F.col("abstract"))))
    scorer = scoring.predictions_scorer(V.stored_answers(spark, sf_dir, ids))
    done = reclassify_plan.reclassify_scored(stored, scorer, custom_setup(spark, V.TOPIC, V.SPEC), new_dir(spark, "score-cache"))
    return done.compared.select("id", "old_label", "new_label", "confidence", "method")


@check("""SELECT conf, "year", string_agg(error, chr(10) ORDER BY attempt) AS error FROM (
  SELECT upper(event_type) AS conf, CAST(2021 + user_id % 5 AS INTEGER) AS "year", event_id AS attempt,
         'attempt failed: ' || props AS error,
         row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id DESC) AS rn FROM events)
WHERE rn <= 12 GROUP BY ALL""")
def last_errors(spark, sf_dir):
    return landing.last_errors(V.attempts(spark, sf_dir))


# --- compiling specifications ------------------------------------------------


@check(f"""WITH {S.SPECS}
SELECT taxonomy_id, topic, priority, label, array_to_string(keywords, '|') AS keywords, CAST(NULL AS VARCHAR) AS error
FROM keyworded UNION ALL
SELECT taxonomy_id, topic, NULL, NULL, NULL, error FROM spec_errors WHERE error IS NOT NULL""")
def parse_specs(spark, sf_dir):
    parsed = taxonomy.parse_specs(V.specs(spark, sf_dir))
    return parsed.withColumn("keywords", F.array_join("keywords", "|"))


@check(f"""WITH {S.KEYWORDS} SELECT keyword, array_to_string(list_sort({S.variants("keyword")}), '|') AS variants FROM keywords""",
       name="keyword_variants")
def _keyword_variants(spark, sf_dir):
    return V.keywords(spark, sf_dir).select(
        "keyword", F.array_join(F.array_sort(keyword_variants(F.col("keyword"))), "|").alias("variants")
    )


@check(f"""WITH labels_ AS (SELECT p_partkey, p_type, p_name || {S._PART_LABEL} || '、' || p_brand AS label FROM part)
SELECT p_partkey, array_to_string({S.label_words("label")}, '|') AS keywords FROM labels_""",
       name="label_keywords")
def _label_keywords(spark, sf_dir):
    stem = F.create_map(*[F.lit(v) for pair in V.PART_LABELS.items() for v in pair])[F.col("p_type")]
    label = F.concat("p_name", stem, F.lit("、"), "p_brand")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(label_keywords(label), "|").alias("keywords")
    )

@check(rf"""WITH {S.SPECS}
SELECT taxonomy_id, priority, 'custom_' || priority AS key, label,
       '包含关键词：' || array_to_string(keywords, ', ') AS description,
       array_to_string(list_transform(keywords, lambda k: '\b' || {_ESCAPE} || '\b'), ' ') AS patterns
FROM keyworded""")
def compile_taxonomy(spark, sf_dir):
    compiled = taxonomy.compile_taxonomies(taxonomy.parse_specs(V.specs(spark, sf_dir)))
    return compiled.withColumn("patterns", F.array_join("patterns", " "))


@check(rf"""WITH {S.SPECS}, topics AS (
  SELECT taxonomy_id, topic, list_filter(regexp_split_to_array(topic, '[,\s]+'), lambda w: w <> '') AS found FROM specs)
SELECT taxonomy_id, array_to_string(list_transform(list_sort(list_distinct(flatten(list_transform(found, lambda w: {S.variants("w")})))),
         lambda k: '\b' || {_ESCAPE} || '\b'), '|') AS topic_regex,
       'Topic: ' || topic || ' (keywords: ' || array_to_string(found, ', ') || ')' AS topic_description FROM topics""")
def compile_topic(spark, sf_dir):
    return topic.compile_topics(V.specs(spark, sf_dir)).select("taxonomy_id", "topic_regex", "topic_description")


@check(f"""WITH {S.SPECS} SELECT taxonomy_id, label,
  array_to_string(keywords[1:10], ', ') || CASE WHEN len(keywords) > 10 THEN '...' ELSE '' END AS shown FROM keyworded""")
def topk_keywords(spark, sf_dir):
    parsed = taxonomy.parse_specs(V.specs(spark, sf_dir)).filter("error IS NULL")
    return parsed.select("taxonomy_id", "label", taxonomy.top_keywords(F.col("keywords")).alias("shown"))


@check(f"""WITH {S.SPECS} SELECT DISTINCT unnest(keywords) AS keyword FROM keyworded""")
def distinct_keywords(spark, sf_dir):
    return taxonomy.parse_specs(V.specs(spark, sf_dir)).select(F.explode("keywords").alias("keyword")).distinct()


@check(rf"""WITH {S.SPECS}, shown AS (
  SELECT taxonomy_id, priority, label,
         '包含关键词：' || array_to_string(keywords, ', ') AS description
  FROM keyworded)
SELECT taxonomy_id, string_agg(priority || '. **' || label || '** (key: custom_' || priority || ')' || chr(10) || '   ' ||
         description || chr(10), chr(10) ORDER BY priority) || chr(10) || (count(*) + 1) || '. **' || {S.OTHER} ||
         '** (key: other)' || chr(10) || '   {fixed.DEFAULT_DESCRIPTION}' AS definitions
FROM shown GROUP BY taxonomy_id""")
def taxonomy_text(spark, sf_dir):
    compiled = taxonomy.compile_taxonomies(taxonomy.parse_specs(V.specs(spark, sf_dir)))
    return taxonomy.definitions_text(compiled, fixed.CUSTOM_DEFAULT_LABEL)


@check(rf"""WITH {S.SPECS}, shown AS (
  SELECT taxonomy_id, priority, 'custom_' || priority AS key, label,
         '包含关键词：' || array_to_string(keywords, ', ') AS description
  FROM keyworded)
SELECT taxonomy_id, '[' || string_agg('{{"key":"' || key || '","label":"' || label || '","description":"' || description || '"}}',
         ',' ORDER BY priority) || ',{{"key":"other","label":"' || {S.OTHER} || '","description":"{fixed.DEFAULT_DESCRIPTION}"}}]'
       AS definitions FROM shown GROUP BY taxonomy_id""")
def taxonomy_json(spark, sf_dir):
    compiled = taxonomy.compile_taxonomies(taxonomy.parse_specs(V.specs(spark, sf_dir)))
    return taxonomy.definitions_json(compiled, fixed.CUSTOM_DEFAULT_LABEL)
