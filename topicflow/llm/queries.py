"""One query per operator, over whole tables, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import (
    block_naming,
    divergence,
    host_reputation,
    hyperminhash,
    language_id,
    line_dedup,
    packing,
    phrase_automata,
    prefix_trie,
    raking,
    simple8b,
    tree_concatenation,
    vp_tree,
)
from topicflow.session import new_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vp_tree.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrase_automata.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


# The rules the query is judged by.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' quality and toxic flags are the outcomes of the pages of the same number."""
    labels = table(spark, sf_dir, "labels")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    return host_reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), good.alias("good")), RULES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.sample(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "token-files")
    simple8b.write_ids(table(spark, sf_dir, "documents"), path)
    read = simple8b.read_ids(spark, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = tree_concatenation.decode(tree_concatenation.encode(table(spark, sf_dir, "documents")))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_line_dedup,
        op2_nearest_neighbours,
        op3_repeated_passages,
        op4_host_reputation,
        op5_mixing,
        op6_near_duplicates,
        op7_token_files,
        op8_exact_duplicates,
        op9_language_id,
        op10_packing,
        op11_prefix_trie,
        op12_tree_concatenation,
        op13_source_divergence,
    )
}

ORACLES = {
    "op2_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op3_repeated_passages": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, start, array_to_string(words[start:start + 49], ' ') AS win
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM w WHERE len(words) >= 50)),
        f AS (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY win) AS first FROM s),
        c AS (SELECT DISTINCT doc_id, start + k AS pos FROM f, range(0, 50) r(k) WHERE first < doc_id),
        g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY 1),
        k AS (SELECT doc_id, words, gone, list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM w LEFT JOIN g USING (doc_id))
        SELECT doc_id, len(words) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op4_host_reputation": """
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
              WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
        h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN l ON doc_id = page_id GROUP BY 1),
        u AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM h),
        u2 AS (SELECT host, n, good, array_to_string(parts[-3:], '.') AS l3, array_to_string(parts[-2:], '.') AS l2, parts[-1] AS l1 FROM u),
        u3 AS (SELECT host, n, good, CASE WHEN l2 IN (TWO) THEN l3 ELSE l2 END AS domain, CASE WHEN l2 IN (TWO) THEN l2 ELSE l1 END AS suffix FROM u2),
        s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1.0) / (sum(n) + 2) FROM u3) AS prior FROM u3 GROUP BY 1),
        s2 AS (SELECT suffix, (good + c * prior) / (n + c) AS mean FROM s, (STRENGTH s)),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(mean) AS prior FROM u3 JOIN s2 USING (suffix) GROUP BY 1, 2),
        d2 AS (SELECT domain, (good + c * prior) / (n + c) AS mean FROM d, (STRENGTH d)),
        h2 AS (SELECT host, u3.n, u3.good, mean AS prior FROM u3 JOIN d2 USING (domain)),
        h3 AS (SELECT host, n + c AS size, (good + c * prior) / (n + c) AS mean FROM h2, (STRENGTH h2)),
        b AS (SELECT host, mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) < 0.5 AS bad FROM h3),
        r AS (SELECT page_id, host, path, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR (rule IS NULL AND bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM r LEFT JOIN b USING (host)""",
    "op8_exact_duplicates": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    # the CRC-32 of a string of digits, bit by bit: each byte is followed by eight shifts, for which -1 stands
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id, md5(concat(length(r), ':', r, ':', x)) AS key, strlen(x) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(r), ':', r, ':', x))) AS n
              FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT conv_id, list({'k': key, 's': size} ORDER BY n) AS turns,
                     xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                                     lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
              FROM t GROUP BY 1),
        b AS (SELECT c.conv_id, list_concat(coalesce(d.turns[:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 5),
        m AS (SELECT conv_id, len(turns) AS len, unnest(range(0, len(turns) + 1)) AS depth, list_transform(turns, lambda x: x.k) AS keys, turns FROM b),
        n AS (SELECT depth, keys[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(turns[depth].s), 0) AS size,
                     string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth) AS ends FROM m GROUP BY 1, 2),
        k AS (SELECT path[:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        o AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path),
        s AS (SELECT path[:d] AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
              FROM (SELECT path, n_children, n_convs, size, unnest(range(0, depth + 1)) AS d FROM o) GROUP BY 1)
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
               CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
        FROM o JOIN s ON s.path = o.path LEFT JOIN o p ON o.depth > 0 AND p.path = o.path[:o.depth - 1]""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        w AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM o WHERE o.lang = g.lang AND o.source = g.source), 0) AS total FROM g LEFT JOIN v USING (lang)),
        c AS (SELECT w.lang, w.source, k.term, coalesce(o.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (total + v) AS HUGEINT) AS p
              FROM w JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
        q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS HUGEINT) AS q FROM k JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM c a JOIN c b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM c JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT * FROM x WHERE part = 'pair' OR rank <= 200""",
}

_STRENGTH = """SELECT 1 / least(greatest(coalesce((sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior)))
                 / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS c FROM """
_TWO = ", ".join(f"'{suffix}'" for suffix in host_reputation.TWO_LABEL_SUFFIXES)
ORACLES["op4_host_reputation"] = re.sub(r"STRENGTH (\w+)", lambda m: f"{_STRENGTH}{m[1]} WHERE n > 0", ORACLES["op4_host_reputation"]).replace("(TWO)", f"({_TWO})")
