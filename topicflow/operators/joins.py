"""Joins whose small side is checked, and joins whose keys may be hot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.session import materialize

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_SPLIT = 1_000_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether `df` has few enough rows and bytes to be sent to every executor.

    Rows are measured by their length as JSON.  Only these lengths are moved, and
    the count stops one row past the bound.
    """
    lengths = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes")).limit(max_rows + 1)
    rows, size = lengths.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_bounded(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join that broadcasts `right` when it is measured to be small, otherwise a shuffle join."""
    return left.join(F.broadcast(right) if is_small(right, max_rows) else right, on, how)


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: str,
    spread: str,
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Equi join on `on`, where one key may hold a large part of `left`.

    A right side measured to be small is broadcast and `left` stays where it is.
    Otherwise keys with more than `rows_per_split` left rows are cut into as many
    parts as they need: the left rows go to a part by the hash of `spread`, and
    only the right rows of those keys are repeated, once per part.  `how` must
    keep left rows independent of each other: inner, left, left_semi or left_anti.

    The hot keys come from one pre-aggregated count.  There are at most
    rows / rows_per_split of them, and they are broadcast if that is few.
    """
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    counts = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > rows_per_split), "hot-keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = hot.select(on, F.ceil(F.col("_n") / rows_per_split).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salted_left = join_bounded(left, hot, on).withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    salted_right = join_bounded(right, hot, on).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted_left.drop("_parts").join(salted_right.drop("_parts"), [on, "_part"], how).drop("_part")
