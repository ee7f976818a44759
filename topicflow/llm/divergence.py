"""How far the sources of a language differ in their words, from bitmaps of the terms that share a count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.operators.joins import join_bounded
from topicflow.session import materialize

LEAST_DOCS = 3
"""Documents of a language that a term needs."""
TOP_TERMS = 200
"""Terms that are reported for a group."""
SCALE = 1_000_000_000
BUCKET_TERMS = 4096
"""Terms of a bucket, on average; its terms are numbered by falling count, so that a word of 64 holds few counts."""
HELD_TERMS = 400_000
"""Distinct terms, over all groups, whose counts a task holds before it passes them on."""
_SLICE = 4 << 20
_CELLS = 1 << 21
# ASCII letters, lower-cased, and all bytes of other characters stay; every other byte ends a term.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text in UTF-8, in order, a few megabytes of it at a time."""
    text = text.translate(_LETTERS)
    start = 0
    while len(text) - start > _SLICE:
        cut = text.find(b" ", start + _SLICE)
        if cut < 0:
            break
        yield text[start:cut].split()
        start = cut
    yield text[start:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up in the tasks.

    A group comes once more with a null term, so that groups without terms are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in held.items():
                rows = len(n) + 1
                columns = [
                    pa.array([lang] * rows, pa.string()),
                    pa.array([source] * rows, pa.string()),
                    pa.array([None, *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(found.__getitem__, n)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            texts = batch.column("text")
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                if group not in held:
                    held[group] = Counter(), Counter()
                n, found = held[group]
                own: set[bytes] = set()
                for terms in terms_of(texts[k].as_py()):
                    n.update(terms)
                    own.update(terms)
                found.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a term, in units of 1 / SCALE from 1 on; null where no term is kept."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) DIV NULLIF({total} + {terms}, 0)")


def _excess(p: str, q: str) -> Column:
    """f of a term's shares; both are at most SCALE + 1, so that the square is a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_sums(source: np.ndarray, p: np.ndarray, zero: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the terms of one word that two sources both have, for all pairs of its sources.

    A row is a (source, count) with the bits of its terms, rows of a source stand together; p is the share at the count
    and zero that at count 0.  Every joint cell, the AND of two rows, gives its number of terms times what f is there
    more than the cells of count 0 make of it, which are counted by complement later.
    Returns the rows at which sources begin, and the sums (source by source).
    """
    starts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    sums = np.zeros((len(starts), len(starts)), np.int64)
    of_row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(source))))
    step = max(1, _CELLS // len(source))
    for first in range(0, len(source), step):
        joint = np.bitwise_count(bits[first : first + step, None] & bits[None, :])
        i, j = np.nonzero(joint)
        n, i = joint[i, j].astype(np.int64), i + first
        worth = _f(p[i], p[j]) - _f(p[i], zero[j]) - _f(zero[i], p[j]) + _f(zero[i], zero[j])
        np.add.at(sums, (of_row[i], of_row[j]), n * worth)
    return starts, sums


def _joint(bitmaps: DataFrame) -> DataFrame:
    """(lang, source, item, value): `joint_sums` of all words, words of a bucket summed up where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}
        rest: pa.Table | None = None

        def flush() -> pa.RecordBatch:
            keys = list(zip(*held)) or [(), (), ()]
            columns = [pa.array(k, pa.string()) for k in keys] + [pa.array(held.values(), pa.int64())]
            out = pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])
            held.clear()
            return out

        def take(rows: pa.Table) -> None:
            """Rows of whole words, in order."""
            if not len(rows):
                return
            bucket, word = rows["bucket"].to_numpy(), rows["word"].to_numpy()
            lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            langs, names = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            of_lang, of_source = lang.indices.to_numpy(), source.indices.to_numpy()
            new = (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1]) | (of_lang[1:] != of_lang[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
            p, zero, bits = rows["p"].to_numpy(), rows["zero"].to_numpy(), rows["bits"].to_numpy().view(np.uint64)
            for a, b in zip(edges, edges[1:]):
                starts, sums = joint_sums(of_source[a:b], p[a:b], zero[a:b], bits[a:b])
                own = [names[s] for s in of_source[a:b][starts].tolist()]
                for x, values in zip(own, sums.tolist()):
                    for y, value in zip(own, values):
                        if value and x != y:
                            key = (langs[of_lang[a]], x, y)
                            held[key] = held.get(key, 0) + value

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            last = [rows[c][-1] for c in ("lang", "bucket", "word")] if len(rows) else []
            cut = len(rows)
            while cut and [rows[c][cut - 1] for c in ("lang", "bucket", "word")] == last:
                cut -= 1
            take(rows.slice(0, cut))
            rest = rows.slice(cut)
            if len(held) > HELD_TERMS:
                yield flush()
        if rest is not None:
            take(rest)
        yield flush()

    key = ["lang", "bucket"]
    order = [*key, "word", "source"]
    dealt = bitmaps.select(*order, "p", "zero", "bits").repartition(*key).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """Per (lang, source): its divergence from each other source of the language, and the terms it has too often.

    Terms are runs of letters (ASCII letters, lower-cased, and all characters beyond ASCII) of the whole texts.  A language
    keeps the V terms that at least `least_docs` of its documents hold.  With n the occurrences of a term in a group or a
    language and N their sum over kept terms, its share is p = 1 + floor(10**9 (n + 1) / (N + V)), and a share p against q
    counts f = floor((p - q)**2 / q).  Returns (lang, source, part, item, value, rank):

    - part `pair`: every other source of the language, f summed over all kept terms, all ranks;
    - part `term`: terms with n > 0 and p above the language's, f, the first `top` ranks.

    Ranks are from 1 per group and part, by falling value, then item in UTF-8 order.

    Sums over all terms are taken from bitmaps: a row is a (source, count) with 64 terms of a bucket of its language, an
    AND of two rows and its ones are a joint cell of two sources, and cells in which a count is 0 are what is left of the
    rows' totals.  Terms are counted in the tasks before they move, and a language's terms lie in as many buckets as it
    needs, so neither a frequent word nor a large language or source meets in one task.  The output has a row per pair
    of sources, and so have the sums; sources are taken to be far fewer than documents.

    Nulls in text, lang and source count as empty strings, which are a language or source like others.  Every row is a
    document, also one that repeats another.  A group without terms has its `pair` rows; a language without kept terms
    has 0 in them; a language with one source has none; no documents give no rows.  Long texts are taken apart in slices.
    Other columns are not read.  Exact below 10**9 kept terms a language.
    """
    counts = materialize(term_counts(docs), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    found = counts.filter("term IS NOT NULL")

    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialize(kept.drop("docs"), "kept-terms")
    languages = materialize(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "languages")
    buckets = F.ceil(F.col("terms") / bucket_terms)
    numbered = join_bounded(kept, languages, "lang", "inner").withColumn("bucket", F.pmod(F.xxhash64("term"), buckets).cast("int"))
    number = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("lang_n"), "term")) - 1
    numbered = numbered.withColumn("number", number).drop("lang_total", "terms")
    cells = materialize(found.drop("docs").join(numbered, ["lang", "term"]), "cells")

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    stats = groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    stats = stats.na.fill(0, ["total", "present", "terms", "lang_total"]).withColumn("zero", _share("0", "total", "terms"))
    stats = materialize(stats, "groups")

    word = F.floor(F.col("number") / 64).cast("int")
    bit = F.expr("shiftleft(1L, number % 64)")
    bitmaps = cells.select("lang", "source", "bucket", word.alias("word"), "n", bit.alias("bit"))
    bitmaps = bitmaps.groupBy("lang", "bucket", "word", "source", "n").agg(F.bit_or("bit").alias("bits"))
    bitmaps = join_bounded(bitmaps, stats, ["lang", "source"], "inner").withColumn("p", _share("n", "total", "terms"))
    bitmaps = materialize(bitmaps.select("lang", "bucket", "word", "source", "n", "p", "zero", "bits"), "bitmaps")

    # what a count of one source is worth against a count of 0 of the other, in both directions
    levels = bitmaps.groupBy("lang", "source", "n", "p").agg(F.sum(F.bit_count("bits").cast("long")).alias("held"))
    others = stats.select("lang", F.col("source").alias("item"), F.col("zero").alias("q"))
    against = join_bounded(levels, others, "lang", "inner").filter("source <> item")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    margins = against.groupBy("lang", "source", "item").agg(exact(F.col("held") * _excess("p", "q")).alias("up"), exact(F.col("held") * _excess("q", "p")).alias("down"))
    down = margins.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("down").alias("value"))
    parts = margins.select("lang", "source", "item", F.col("up").alias("value")).unionByName(down)
    parts = parts.unionByName(_joint(bitmaps).withColumn("value", F.col("value").cast("decimal(38,0)")))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    other = stats.select("lang", F.col("source").alias("item"), F.col("zero").alias("q"), F.col("present").alias("item_present"))
    pairs = join_bounded(stats.select("lang", "source", "zero", "terms", "present"), other, "lang", "inner").filter("source <> item")
    neither = (F.col("terms") - F.col("present") - F.col("item_present")).cast("decimal(20,0)") * _excess("zero", "q")
    value = F.coalesce("value", F.lit(0)) + F.coalesce(neither, F.lit(0))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    terms = join_bounded(cells, stats, ["lang", "source"], "inner").withColumn("p", _share("n", "total", "terms"))
    terms = terms.withColumn("q", _share("lang_n", "lang_total", "terms")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess("p", "q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
