"""SQL text of the derived views, for DuckDB; each is one common table expression.

The notes and pages of views.py hold the same documents in JSON; here their
content is computed straight from the documents, without JSON.
"""

from checks.views import PART_LABELS, VOCABULARY
from topicflow.functions import fixed
from topicflow.functions.text import WHITESPACE

WS = f"'{WHITESPACE}'"
NL = "chr(10)"
W = r"[^\p{L}\p{N}_]"
OTHER = f"'{fixed.CUSTOM_DEFAULT_LABEL}'"

YEAR = "CAST(2021 + doc_id % 5 AS INTEGER)"


def _papers(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT upper(lang) || '_' || {YEAR} || '_' || doc_id AS id, upper(lang) AS conf, {YEAR} AS "year",
         trim(split_part(text, {NL}, 1), {WS}) AS title,
         trim(CASE WHEN contains(text, {NL}) THEN substr(text, strpos(text, {NL}) + 1) ELSE '' END, {WS}) AS abstract,
         doc_id
  FROM {source})"""


PAPERS = _papers("papers", "documents")


def _vocabulary() -> str:
    text = "text"
    for word, term in VOCABULARY:
        text = f"replace({text}, ' {word} ', ' {term} ')"
    return text


RESEARCH = (
    f"translated AS (SELECT doc_id, lang, {_vocabulary()} AS text FROM documents),\n"
    + _papers("research_papers", "translated")
)


def words(text: str, alternatives: str) -> str:
    """Any of the alternatives between Unicode word boundaries."""
    return rf"regexp_matches({text}, '(?i)(?:^|{W})(?:{alternatives})(?:{W}|$)')"


TXT = f"(title || {NL} || abstract)"

TOPIC_WORDS = "this|thising|thised|with|withs|withing|withed|license|licenses|licensing|licensed"
CATEGORY_WORDS = {
    ("custom_1", "Licensing"): "license|apache|licensing|licensings|licensinging|licensinged",
    ("custom_2", "Credentials"): "token|credentials|credentialsing|credentialsed",
    ("custom_3", "Deixis"): "this|here|deixis|deixising|deixised",
    ("custom_4", "Prose"): "with|from|prose|proses|prosing|prosed",
}


def first_match(categories: dict, part: int, default: str, text: str = TXT) -> str:
    whens = " ".join(f"WHEN {words(text, w)} THEN '{names[part]}'" for names, w in categories.items())
    return f"CASE {whens} ELSE '{default}' END"


ON_TOPIC = f"on_topic AS (SELECT * FROM papers WHERE {words(TXT, TOPIC_WORDS)})"

CLASSIFIED = f"""classified AS (
  SELECT *, {first_match(CATEGORY_WORDS, 0, 'other')} AS category_key,
         {first_match(CATEGORY_WORDS, 1, fixed.CUSTOM_DEFAULT_LABEL)} AS category_label,
         {first_match(CATEGORY_WORDS, 1, fixed.CUSTOM_DEFAULT_LABEL)} AS category
  FROM on_topic)"""

CLASSIFIED_ALL = f"{PAPERS},\n{ON_TOPIC},\n{CLASSIFIED}"


def pattern_sql(pattern: str) -> str:
    r"""A pattern with \b, rewritten for an engine whose \b is ASCII only.

    Boundaries take a character here, so two boundaries around ".*" may be the
    same character.
    """
    line = r"[^\p{L}\p{N}_\n]"
    pattern = pattern.replace(r"\b.*\b", f"(?:{line}|{line}.*{line})")
    pattern = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    out = []
    for branch in _top_level(pattern):
        if branch.startswith(r"\b"):
            branch = f"(?:^|{W})" + branch[2:]
        if branch.endswith(r"\b"):
            branch = branch[:-2] + f"(?:{W}|$)"
        assert r"\b" not in branch, branch
        out.append(branch)
    return "(?i)(?:" + "|".join(out) + ")"


def _top_level(pattern: str) -> list[str]:
    """Pieces between the "|" outside every bracket."""
    pieces, level = [""], 0
    for c in pattern:
        level += (c in "([") - (c in ")]")
        if c == "|" and level == 0:
            pieces.append("")
        else:
            pieces[-1] += c
    return pieces


BUILTIN = sorted(fixed.BUILTIN_TAXONOMY)


def builtin_case(part: str) -> str:
    whens = []
    for priority, key, label, _, patterns in BUILTIN:
        value = {"key": f"'{key}'", "label": f"'{label}'"}[part]
        test = " OR ".join(f"regexp_matches({TXT}, '{pattern_sql(p)}')" for p in patterns)
        whens.append(f"WHEN {test} THEN {value}")
    default = {"key": "'other'", "label": f"'{fixed.BUILTIN_DEFAULT_LABEL}'"}[part]
    return f"CASE {' '.join(whens)} ELSE {default} END"


DEFAULT_TOPIC = " OR ".join(
    f"regexp_matches({TXT}, '{pattern_sql(p)}')"
    for p in (
        r"\bin[- ]context\b",
        r"\bin[- ]context learning\b",
        r"\bICL\b",
        r"\b(in[- ]context) (reason|learn|adapt|generaliz)\w*",
        r"\bmany[- ]shot\b",
        r"\bfew[- ]shot\b",
    )
)
RESEARCH_ON_TOPIC = f"research_on_topic AS (SELECT * FROM research_papers WHERE {DEFAULT_TOPIC})"
RESEARCH_CLASSIFIED = f"""research_classified AS (
  SELECT *, (SELECT max(label) FROM (VALUES {", ".join(f"('{r[1]}', '{r[2]}')" for r in BUILTIN)},
    ('other', '{fixed.BUILTIN_DEFAULT_LABEL}')) t(k, label) WHERE k = category_key) AS category_label
  FROM (SELECT *, {builtin_case('key')} AS category_key FROM research_on_topic))"""
RESEARCH_ALL = f"{RESEARCH},\n{RESEARCH_ON_TOPIC},\n{RESEARCH_CLASSIFIED}"

HASH = "md5(title || '|||' || abstract)"

PREDICTIONS = f"""predictions AS (
  SELECT paper_hash, category_key,
         CASE category_key WHEN 'custom_1' THEN 'Licensing' WHEN 'custom_2' THEN 'Credentials'
              WHEN 'custom_3' THEN 'Deixis' ELSE {OTHER} END AS category_label,
         CAST(doc_id % 11 AS DOUBLE) / 10 AS confidence, 'seen in ' || doc_id AS reasoning
  FROM (SELECT {HASH} AS paper_hash, doc_id,
               CASE WHEN quality = 1 AND toxic = 0 THEN 'custom_1' WHEN quality = 1 AND toxic = 1 THEN 'custom_3'
                    WHEN toxic = 1 THEN 'custom_2' ELSE 'unknown' END AS category_key,
               row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) AS rn
        FROM papers JOIN labels USING (doc_id))
  WHERE rn = 1)"""

HYBRID = f"""hybrid AS (
  SELECT p.id, p.conf, p."year", p.title, p.abstract, p.doc_id, p.rule_key, p.rule_label,
         CASE WHEN low THEN rule_key ELSE pred_key END AS category_key,
         CASE WHEN low THEN rule_label ELSE pred_label END AS category_label,
         CASE WHEN low THEN 0.5 ELSE conf0 END AS confidence,
         CASE WHEN low THEN 'LLM low confidence (' || printf('%.2f', conf0) || '), used rule' ELSE why END AS reasoning,
         CASE WHEN low THEN 'rule_fallback' ELSE 'llm' END AS method
  FROM (SELECT p.*, s.category_key AS pred_key, s.category_label AS pred_label,
               coalesce(s.confidence, CAST(0 AS DOUBLE)) AS conf0, s.reasoning AS why,
               coalesce(s.confidence, CAST(0 AS DOUBLE)) < CAST(0.6 AS DOUBLE) AS low,
               {first_match(CATEGORY_WORDS, 0, 'other')} AS rule_key,
               {first_match(CATEGORY_WORDS, 1, fixed.CUSTOM_DEFAULT_LABEL)} AS rule_label
        FROM papers p LEFT JOIN predictions s ON s.paper_hash = {HASH}) p)"""
HYBRID_ALL = f"{PAPERS},\n{PREDICTIONS},\n{HYBRID}"

ORDERS_BY_YEAR = """orders_by_year AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", o_orderpriority AS category FROM orders)"""

# --- notes and pages ---------------------------------------------------------

NOTES = f"""notes AS (
  SELECT *, (by_id AND bare) OR doc_id % 4 IN (0, 2) AS accepted
  FROM (SELECT doc_id, upper(lang) AS conf, {YEAR} AS "year", doc_id % 2 = 0 AS bare, doc_id % 3 = 0 AS by_id,
               CASE WHEN doc_id % 7 <> 3 THEN 'n' || doc_id END AS note_id,
               trim(split_part(text, {NL}, 1), {WS}) AS title,
               trim(CASE WHEN contains(text, {NL}) THEN substr(text, strpos(text, {NL}) + 1) ELSE '' END, {WS})
                 AS own_abstract,
               CASE WHEN doc_id % 5 = 2 THEN 'About ' || source
                    WHEN doc_id % 5 IN (0, 3) OR (doc_id % 5 = 1 AND doc_id % 2 = 0) THEN 'short ' || source
                    ELSE '' END AS summary
        FROM documents)),
normalized AS (
  SELECT *, CASE WHEN own_abstract = '' THEN summary ELSE own_abstract END AS abstract FROM notes)"""

LANDED = """landed AS (
  SELECT n.*, c.candidate, (doc_id // 100) * 1000 AS "offset", c.listed
  FROM normalized n, LATERAL (
    SELECT 1 AS candidate, NOT accepted AS listed
    UNION ALL SELECT CASE WHEN conf = 'EN' THEN 2 ELSE 5 END, CASE WHEN conf = 'EN' THEN by_id ELSE true END
    UNION ALL SELECT 13, by_id) c),
pages_n AS (
  SELECT conf, "year", candidate, "offset", CAST(count(*) FILTER (WHERE listed) AS INTEGER) AS n
  FROM landed GROUP BY ALL),
kept_pages AS (
  SELECT * FROM (SELECT *, min("offset") FILTER (WHERE n = 0) OVER (PARTITION BY conf, "year", candidate) AS first_empty
                 FROM pages_n)
  WHERE first_empty IS NULL OR "offset" < first_empty),
page_notes AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conf, "year", candidate, "offset" ORDER BY doc_id) - 1 AS INTEGER) AS position
  FROM landed WHERE listed),
counts AS (
  SELECT conf, "year", candidate,
         CASE WHEN candidate % 2 = 0 THEN CAST(-1 AS BIGINT) ELSE count(*) END AS submissions,
         count(*) FILTER (WHERE candidate % 2 = 0 OR accepted) AS accepted
  FROM page_notes JOIN kept_pages USING (conf, "year", candidate, "offset")
  GROUP BY conf, "year", candidate),
winners AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY conf, "year" ORDER BY candidate) AS rn FROM counts WHERE accepted > 0)
  WHERE rn = 1)"""
LANDED_ALL = f"{NOTES},\n{LANDED}"

# --- specifications ----------------------------------------------------------

STEMS = "[" + ", ".join(
    f"{{'stem': '{s}', 'w': [{', '.join(repr(w) for w in english)}]}}" for s, english in fixed.LABEL_STEMS
) + "]"


def variants(k: str) -> str:
    n, low = f"length({k})", f"lower({k})"
    cut = f"substr({k}, 1, {n} - 1)"
    return f"""list_distinct(list_filter([{k},
      CASE WHEN NOT ends_with({low}, 's') THEN {k} || 's' END,
      CASE WHEN ends_with({low}, 'y') AND {n} > 2 THEN {cut} || 'ies' END,
      CASE WHEN {n} > 3 THEN CASE WHEN ends_with({low}, 'e') THEN {cut} ELSE {k} END || 'ing' END,
      CASE WHEN {n} > 3 THEN {k} || CASE WHEN ends_with({low}, 'e') THEN 'd' ELSE 'ed' END END,
      CASE WHEN contains({k}, '-') THEN replace({k}, '-', ' ') END,
      CASE WHEN contains({k}, '-') THEN replace({k}, '-', '') END,
      CASE WHEN contains({k}, ' ') THEN replace({k}, ' ', '-') END,
      CASE WHEN contains({k}, ' ') THEN replace({k}, ' ', '') END], lambda v: v IS NOT NULL))"""


def label_words(label: str) -> str:
    parts = f"list_filter(regexp_split_to_array({label}, '[、，,：:；;\\s]+'), lambda w: w <> '')"
    own = f"list_transform({parts}, lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z-]+') THEN {variants('w')} ELSE [w] END)"
    stems = f"list_transform(list_filter({STEMS}, lambda s: contains({label}, s.stem)), lambda s: s.w)"
    return f"list_sort(list_distinct(list_concat(flatten({stems}), flatten({own}))))"


_PART_LABEL = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{l}'" for t, l in PART_LABELS.items()) + " END"
SPECS = f"""labelled AS (SELECT *, {_PART_LABEL} AS label FROM part),
spec_texts AS (
  SELECT *, label || ': ' || replace(p_name, ' ', ',') || ',, ' || upper(p_brand) AS own,
         p_brand || ':' || p_name || ' ,C++' AS brand_part FROM labelled),
specs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS taxonomy_id,
         CASE WHEN p_size = 44 THEN '' ELSE p_name || ', ' || lower(p_type) END AS topic,
         CASE p_size WHEN 7 THEN own || ';' || p_brand WHEN 13 THEN own || '; :' || p_name WHEN 21 THEN ' '
              WHEN 25 THEN ' ; ;' WHEN 33 THEN own || ';' || brand_part || ';' || label || ':again ' || p_name
              ELSE own || ' ;;' || brand_part || ';' END AS spec
  FROM spec_texts),
pieces AS (
  SELECT taxonomy_id, topic, spec, unnest(string_split(spec, ';')) AS piece, generate_subscripts(string_split(spec, ';'), 1) AS pos
  FROM specs),
parts AS (SELECT * REPLACE (trim(piece, {WS}) AS piece) FROM pieces WHERE trim(piece, {WS}) <> ''),
entries AS (
  SELECT *, trim(split_part(piece, ':', 1), {WS}) AS label,
         CASE WHEN NOT contains(piece, ':') THEN 'missing colon'
              WHEN trim(split_part(piece, ':', 1), {WS}) = '' THEN 'empty label' END AS problem
  FROM parts),
spec_errors AS (
  SELECT s.taxonomy_id, s.topic,
         CASE WHEN (s.topic <> '') <> (s.spec <> '') THEN 'topic and categories must be given together'
              WHEN trim(s.spec, {WS}) = '' THEN 'empty categories'
              WHEN count(e.problem) > 0 THEN min_by(e.problem, e.pos) FILTER (WHERE e.problem IS NOT NULL)
              WHEN count(e.pos) = 0 THEN 'no category' END AS error
  FROM specs s LEFT JOIN entries e USING (taxonomy_id) GROUP BY s.taxonomy_id, s.topic, s.spec),
named AS (
  SELECT taxonomy_id, topic, label, min(pos) AS first_pos, max_by(piece, pos) AS last_piece
  FROM entries JOIN spec_errors USING (taxonomy_id, topic) WHERE error IS NULL GROUP BY ALL),
keyworded AS (
  SELECT taxonomy_id, topic, label,
         CAST(row_number() OVER (PARTITION BY taxonomy_id ORDER BY first_pos) AS INTEGER) AS priority,
         list_sort(list_distinct(list_concat(
           list_filter(list_transform(string_split(substr(last_piece, strpos(last_piece, ':') + 1), ','),
                                      lambda k: lower(trim(k, {WS}))), lambda k: k <> ''),
           {label_words('label')}))) AS keywords
  FROM named)"""

KEYWORDS = """keywords AS (
  SELECT p_name AS keyword FROM part UNION SELECT replace(p_brand, '#', '-') FROM part
  UNION SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '')"""
