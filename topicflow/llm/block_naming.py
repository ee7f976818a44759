"""Exact duplicates by deterministic naming of blocks, pairs of blocks, pairs of pairs and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.session import materialize

BLOCK_BYTES = 8192


def _named(distinct: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Distinct rows, sorted in every partition and numbered; written, so that the numbers stay what they are."""
    return materialize(distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int")
    rows = docs.select("doc_id", data.alias("data")).select("doc_id", F.xxhash64("data").alias("text_hash"), "data", count.alias("n"))
    rows = rows.select("doc_id", "text_hash", "n", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    block = F.substring("data", F.col("i") * block_bytes + 1, F.lit(block_bytes))
    return rows.select("doc_id", "text_hash", "n", "i", block.alias("block")).withColumn("hash", F.xxhash64("block"))


def _block_names(blocks: DataFrame) -> DataFrame:
    """(doc_id, text_hash, i, name): equal blocks, and no others, have equal names.

    Blocks are told apart by their bytes and travel once, reduced before the shuffle.  Names go back by the hash of the
    block; hashes that stand for several blocks are named by the bytes.
    """
    names = _named(blocks.select("hash", "block").distinct(), ["block"], ["hash"])
    counted = names.groupBy("hash").agg(F.min("name").alias("name"), F.count("*").alias("_n"))
    plain = blocks.select("doc_id", "text_hash", "n", "i", "hash").join(counted.filter("_n = 1").select("hash", "name"), "hash")
    plain = plain.select("doc_id", "text_hash", "n", "i", "name")
    shared = materialize(counted.filter("_n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return plain
    there = blocks.join(shared, "hash", "left_semi")
    own = _named(there.select("hash", "block").distinct(), ["block"], ["hash", "block"]).withColumn("name", -1 - F.col("name"))
    return plain.unionByName(there.join(own, ["hash", "block"]).select("doc_id", "text_hash", "n", "i", "name"))


def _identities(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(doc_id, text_hash, n, name): n blocks and the name that pairs of names have come down to."""
    key = ["doc_id", "text_hash", "n"]
    named = _block_names(_blocks(docs, block_bytes)).groupBy(*key, "i").agg(F.min("name").alias("name"))
    left = materialize(named, "level")
    size = left.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    done = [left.filter("n = 1").select(*key, "name")]
    left, alive = left.filter("n > 1"), 1
    while alive < size:
        alive *= 2
        # the names of a pair, the second -1 where the sequence is odd; a document's names lie together after one shuffle
        pair = left.groupBy(*key, F.floor(F.col("i") / 2).alias("i")).agg(
            F.min(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.min(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b")
        )
        pairs = materialize(pair, "pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        joined = pairs.join(names, pairs["a"].eqNullSafe(names["a"]) & pairs["b"].eqNullSafe(names["b"]))
        left = materialize(joined.select(*key, "i", "name"), "level")
        done.append(left.filter(F.col("n") <= alive).select(*key, "name"))
        left = left.filter(F.col("n") > alive)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest doc_id stays.

    Texts are cut into blocks of `block_bytes` bytes, which are sorted and named by integers; adjacent names are paired and
    the pairs named again until every text has one name.  Two texts get the same name and number of blocks if and only
    if they are equal, as names are given to contents and not to hashes of them.

    Null texts count as empty.  Rows without doc_id belong to the group of their text and stay only if no row of it has a
    doc_id (keep_id is then null).  Rows that repeat both doc_id and text count in group_size and share the decision.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(F.encode(text, "utf-8")).alias("text_hash"), F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"))
    found = _identities(docs, block_bytes)
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"])
    members = rows.join(found, same).select(rows["doc_id"], "text_sha256", "n", "name")
    members = materialize(members, "members")
    groups = members.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return members.join(groups, ["n", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
