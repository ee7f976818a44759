"""Url filter by fixed rules and, where none fits, by the shrunken reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.session import materialize

# Public suffixes of two labels that are common; others have one.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]
LEAST_GOOD_SHARE = 0.5
DEVIATIONS = 1.645
"""The bound lies so many standard deviations of the posterior above its mean (95 %)."""
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5
"""Bounds of the estimated correlation of outcomes within a unit."""


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule `host/path` that fits, null if none does; of equal length the first in order."""

    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        same = (host == name) | host.endswith("." + name)
        return same & path.startswith(slash + start)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    found = [F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for rule, verdict in ordered]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _parents(host: str) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an address or a single label is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    double = last(2).isin(TWO_LABEL_SUFFIXES)
    return F.when(double, last(3)).otherwise(last(2)), F.when(double, last(2)).otherwise(last(1))


def _strength(units: DataFrame) -> float:
    """How many outcomes the parent's mean is worth, from the spread of the units about it.

    Of n outcomes with mean m, the share has variance m (1 - m) (1 / n + r (1 - 1 / n)) if r is their correlation within
    the unit; r is solved from the sums over all units, and the strength is 1 / r - 1.
    """
    variance = F.col("prior") * (1 - F.col("prior"))
    ratio = (F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("prior")) ** 2) - F.sum(variance)) / F.nullif(F.sum(variance * (F.col("n") - 1)), F.lit(0.0))
    bounded = F.least(F.greatest(F.coalesce(ratio, F.lit(MOST_SPREAD)), F.lit(LEAST_SPREAD)), F.lit(MOST_SPREAD))
    return units.filter("n > 0").agg(1 / bounded - 1).first()[0]


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, mean, upper) from (host, n, good): posterior mean of the good share, and its upper bound.

    Outcomes are counted for suffixes, registered domains and hosts.  Each unit's posterior has its parent's mean as prior
    mean, worth as many outcomes as the spread among units of its level says; the suffixes' parent is the whole.
    """
    domain, suffix = _parents("host")
    units = materialize(hosts.select("host", "n", "good", domain.alias("domain"), suffix.alias("suffix")), "hosts")

    def level(key: str, parent: DataFrame | float, parent_key: str | None = None) -> DataFrame:
        keys = [key] if parent_key is None else [key, parent_key]
        counted = units.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        counted = counted.withColumn("prior", F.lit(parent)) if parent_key is None else counted.join(parent, parent_key)
        counted = materialize(counted, key)
        strength = _strength(counted)
        mean = (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)
        return counted.select(*keys, (F.col("n") + strength).alias("size"), mean.alias("mean"))

    prior = lambda df, key: df.select(key, F.col("mean").alias("prior"))
    # one good and one bad outcome more, so that the whole is never 0 or 1
    n, good = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    suffixes = level("suffix", (good + 1) / (n + 2))
    domains = level("domain", prior(suffixes, "suffix"), "suffix")
    found = level("host", prior(domains, "domain"), "domain")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return found.select("host", "mean", (F.col("mean") + DEVIATIONS * deviation).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict.

    outcomes: (page_id, good 0/1), any part of the pages; of several for a page the worst counts.  A page that no rule
    fits is blocked if its host's good share is below LEAST_GOOD_SHARE even at the posterior's upper bound.

    A null url, or one without `://`, has an empty host and path; all such pages share the empty host's reputation.  Pages
    without page_id have no outcome.  Repeated rows count and return as they are.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    judged = rows.join(known, "page_id", "left")
    hosts = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    upper = reputations(hosts).select("host", "upper")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < LEAST_GOOD_SHARE, "block").otherwise("allow")
    found = rows.withColumn("_rule", rule).join(upper, "host", "left")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"))
