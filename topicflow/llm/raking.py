"""Sampling documents to target weights of source, language and topic by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.session import materialize

MARGINS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 50, 1e-4
# Topics by what a text mentions first in this order; the last is for the others.
TOPICS = [("licence", ["license", "copyright"]), ("contact", ["@"]), ("code", ["{", "();"]), ("prose", [])]


def topic_of(text: str = "text") -> Column:
    """The first topic of TOPICS one of whose marks is in the lower-cased text; the last if none is, or no text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(TOPICS[-1][0])
    for name, marks in reversed(TOPICS[:-1]):
        any_of = F.lit(False)
        for mark in marks:
            any_of = any_of | F.contains(low, F.lit(mark))
        found = F.when(any_of, F.lit(name)).otherwise(found)
    return found


def smoothed(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin's values: natural token shares to `power`, scaled to sum to one."""
    shares = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), power).alias("raw"))
    total = shares.agg(F.sum("raw")).first()[0] or 1.0
    return shares.select(margin, (F.col("raw") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (one row per combination of the margins' values, with tokens) with their fitted `weight`; weights sum to one.

    In every round the weights are scaled to each margin's targets in turn, by one pre-aggregated sum per margin, until no
    sum is off its target by more than `tolerance`.  Values without a target weigh nothing; targets of values
    without tokens are spread over the others.  Null is a value like any other.
    """
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        t = target.select(F.col(margin).alias("_value"), F.col("target").alias(f"_t_{margin}"))
        current = current.join(t, current[margin].eqNullSafe(t["_value"]), "left").drop("_value").na.fill(0.0, [f"_t_{margin}"])
    current = materialize(current, "cells")
    names = cells.columns
    for _ in range(rounds):
        off = []
        for margin in targets:
            sums = current.groupBy(F.col(margin).alias("_value")).agg(F.sum("weight").alias("_sum"), F.first(f"_t_{margin}").alias("_target"))
            reach = sums.agg(F.sum(F.when(F.col("_sum") > 0, F.col("_target")))).first()[0] or 1.0
            scale = sums.select("_value", F.coalesce(F.col("_target") / reach / F.nullif("_sum", F.lit(0.0)), F.lit(0.0)).alias("_scale"))
            current = current.join(scale, current[margin].eqNullSafe(scale["_value"])).withColumn(f"_off_{margin}", F.abs(F.col("_scale") - 1) * F.col("weight"))
            current = current.withColumn("weight", F.col("weight") * F.col("_scale")).drop("_value", "_scale")
            off.append(f"_off_{margin}")
        current = materialize(current, "cells")
        worst = current.agg(F.greatest(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in off))).first()[0]
        current = current.drop(*off)
        if worst <= tolerance:
            break
    return current.select(*names, "weight")


def with_probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """cells with the probability at which their documents are drawn, so that the expected tokens are the budget.

    Probabilities are proportional to weight / tokens, at most one; what the cap leaves over goes to the other cells.
    """
    ratio = F.col("weight") / F.col("tokens")
    scale = budget
    while True:
        full = ratio * scale >= 1
        kept, free, open_ = cells.filter("tokens > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(~full & (F.col("weight") > 0), 1))
        ).first()
        wanted = (budget - kept) / free if open_ and free > 0 else scale
        if wanted <= scale * (1 + 1e-12):
            break
        scale = wanted
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), ratio * scale), F.lit(0.0)))


def draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / float(1 << 48)


def sample(docs: DataFrame, budget_share: float = 0.5, powers: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """Per row of `docs`: doc_id, source, lang, topic, tokens, weight, probability, sampled.

    Tokens are words.  Targets are the natural shares of each margin to a power (source 0.5, lang 0.7, topic 1 unless
    given): below one, small values gain.  The cells' weights are raked to all three, and each document is drawn with its
    cell's probability, independently, by a hash of its doc_id; in expectation `budget_share` of all tokens stay.

    Null source or lang is a value of its own.  Texts without words (null, empty, blank) weigh nothing, are no sample's business
    and stay (probability one).  Rows without doc_id share one draw, as do rows that repeat a doc_id.
    """
    powers = powers or {"source": 0.5, "lang": 0.7, "topic": 1.0}
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    tokens = F.size(words)
    rows = docs.select("doc_id", "source", "lang", topic_of().alias("topic"), tokens.cast("long").alias("tokens"))
    rows = materialize(rows, "documents")
    cells = materialize(rows.filter("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, {m: smoothed(cells, m, powers[m]) for m in MARGINS})
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fitted = materialize(with_probabilities(raked, budget_share * total), "fitted").select(*(F.col(m).alias(f"_{m}") for m in MARGINS), "weight", "probability")
    same = rows["source"].eqNullSafe(fitted["_source"]) & rows["lang"].eqNullSafe(fitted["_lang"]) & (rows["topic"] == fitted["_topic"])
    found = rows.join(fitted, same, "left")
    chance = F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("probability"))
    weight = F.when(F.col("tokens") == 0, 0.0).otherwise(F.col("weight"))
    found = found.select("doc_id", *MARGINS, "tokens", weight.alias("weight"), chance.alias("probability"))
    return found.withColumn("sampled", draw("doc_id", seed) < F.col("probability"))
