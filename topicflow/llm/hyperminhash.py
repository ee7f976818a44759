"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import bitmap, components_of_buckets, hash_words, odd_sketch, parts, shingle_hashes, split_by_bitmap, words
from topicflow.session import materialize

BANDS, ROWS = 32, 4
"""Bands of a signature and registers in a band: of two sets at similarity 0.8, 5 in 10**8 share no band."""
MANTISSA_BITS = 10
"""Bits that a register keeps after the first one bit."""
SKETCH_LONGS = 32
"""64-bit words of an odd sketch; it tells texts of up to some 3,000 words well apart, longer ones are compared instead."""
CACHED_SETS = 64
_ZERO_LEVELS = 32

_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_MASKS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """One 16-bit register per bucket: 6 bits leading zeros of the bucket's least hash, then 10 bits after its first one.

    Every bucket has a permutation of its own and sees all shingles, so that a set smaller than the number of buckets
    leaves none empty, and two short texts do not look alike for sharing empty buckets.
    """
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.empty(len(_FACTORS), np.uint32)
    step = 1 << 14
    for k, (factor, mask) in enumerate(zip(_FACTORS, _MASKS)):
        least[k] = min(((base[i : i + step] ^ mask) * factor).min() for i in range(0, len(base), step))
    return compress(least)


def compress(least: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of 32-bit values as 16 bits."""
    value = least.astype(np.uint64)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    zeros = (_ZERO_LEVELS - length).astype(np.uint64)
    aligned = (value << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((zeros << np.uint64(MANTISSA_BITS)) | (aligned >> np.uint64(32 - MANTISSA_BITS))).astype(np.uint16)


def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Bounds in [0, 1] of the values that share a register."""
    lows, highs = [0.0], [2.0**-_ZERO_LEVELS]
    for zeros in range(_ZERO_LEVELS):
        start, width = 2.0 ** -(zeros + 1), 2.0 ** -(zeros + 1 + MANTISSA_BITS)
        steps = start + width * np.arange(1 << MANTISSA_BITS)
        lows.extend(steps)
        highs.extend(steps + width)
    return np.array(lows), np.array(highs)


_LOWS, _HIGHS = _cells()


def expected_collisions(n: float, m: float) -> float:
    """Share of registers that two disjoint sets of n and m shingles have in common by chance."""
    below = lambda x, size: np.exp(size * np.log1p(-np.minimum(x, 1 - 1e-16)))
    p = below(_LOWS, n) - below(_HIGHS, n)
    q = below(_LOWS, m) - below(_HIGHS, m)
    return float(np.sum(p * q))


class _Collisions(dict):
    """Collision shares for sizes rounded to quarters of a power of two; they vary slowly with the size."""

    def __missing__(self, key: tuple[int, int]) -> float:
        value = self[key] = expected_collisions(2.0 ** (key[0] / 4), 2.0 ** (key[1] / 4))
        return value


_collisions = _Collisions()


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of pairs of signatures (rows), less what equal registers owe to chance."""
    share = (a == b).mean(axis=1)
    sizes = zip((np.log2(n) * 4).round().astype(int).tolist(), (np.log2(m) * 4).round().astype(int).tolist())
    chance = np.fromiter((_collisions[s] for s in sizes), float, len(n))
    return (share - chance) / (1 - chance)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, number of distinct shingles, a 128-bit digest of the set, its registers (null for an empty set), its odd sketch.

    The registers of a band are the four 16-bit parts of one element of `registers`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            counts, digests, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_hashes(hash_words(words(text, fold=True)), size)
                counts.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(registers(shingles).view(np.int64) if len(shingles) else None)
                sketches.append(odd_sketch(shingles, SKETCH_LONGS))
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "digest", "registers", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, registers array<long>, sketch array<long>")


def _resembling(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs whose collision-corrected estimate reaches `floor`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).flatten().to_numpy().view(np.uint16).reshape(len(batch), BANDS * ROWS) for c in ("ra", "rb")]
            likely = estimate(*sides, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float)) >= floor
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    known = classes.select("id", "n_shingles", "registers")
    left = known.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = known.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    kind = dict(pairs.dtypes)["a"]
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _compared(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pairs with the sizes of intersection and union of their full sets of shingles."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted, _ = split_by_bitmap(docs.select("doc_id", "text"), "doc_id", bitmap(ids, "doc_id"))
    texts = materialize(wanted.join(ids, "doc_id", "left_semi"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[str, set] = OrderedDict()

        def shingles(text: str) -> set:
            found = cache.pop(text, None)
            if found is None:
                tokens = words(text, fold=True)
                found = set(zip(*(tokens[k:] for k in range(size)))) if len(tokens) >= size else {tuple(tokens)} if tokens else set()
            cache[text] = found
            if len(cache) > CACHED_SETS:
                cache.popitem(last=False)
            return found

        for batch in parts(batches):
            common, total = [], []
            for left, right in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                x, y = shingles(left or ""), shingles(right or "")
                common.append(len(x & y))
                total.append(len(x) + len(y) - common[-1])
            columns = [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "total"])

    kind = dict(pairs.dtypes)["a"]
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, common long, total long")
    # rows that share a doc_id: the closest texts count
    return sized.filter("total > 0").groupBy("a", "b").agg(F.max(F.col("common") / F.col("total")).alias("likeness"), F.max(F.struct(F.col("common") / F.col("total"), "common", "total")).alias("best")).select("a", "b", "likeness", "best.common", "best.total")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, slack: float = 0.2) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept (the smallest doc_id of a component stays).

    Equal sets are one class.  Classes that share a band are candidates, confirmed on the full texts if their corrected
    estimate is not more than `slack` (over five standard deviations) below the bound; see `components_of_buckets` for how
    a large group of copies gets by with a few comparisons per member and no link between components is missed.

    Rows without text or words have an empty set and stand alone.  Rows without doc_id take no part: component_id is null
    and they stay.  Rows that share a doc_id are one document: links of either count for both.
    """
    signed = materialize(signatures(docs, size), "signatures")
    classes = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "registers", "sketch"))
    )
    classes = materialize(classes, "classes")
    shared = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode("registers").alias("band", "key"))

    def compare(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        likely = materialize(_resembling(pairs, classes, percent / 100 - slack), "candidates")
        found = materialize(_compared(likely, docs, size), "compared")
        return likely, found.withColumn("linked", F.col("common") * 100 >= F.col("total") * percent).select("a", "b", "likeness", "linked")

    roots = components_of_buckets(shared, compare, percent / 100, classes.withColumnRenamed("n_shingles", "n"), SKETCH_LONGS)

    members = classes.select("digest", F.col("id").alias("class_id")).join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
    found = signed.join(members.select("digest", F.coalesce("root", "class_id").alias("found")), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")))
    result = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
