"""What several operators share: words and their hashes, fixed-size bitmaps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.session import materialize

BITMAP_BYTES = 4096
"""Bytes of one row of bitmap_construct_agg."""
HASH_CACHE = 1_000_000
"""Word hashes a worker process remembers (about 130 MB)."""
SMALL_BUCKET = 64
"""Members up to which a bucket is compared pair by pair: 31.5 pairs a member at most."""
TEXTS_AT_ONCE = 1000
"""Rows of a batch whose texts a worker holds as Python objects."""
_MULTIPLIER = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def words(text: str | None, fold: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the whole text as UTF-8; `fold` lower-cases A-Z.

    Both steps of `bytes` look at ASCII alone, so other letters and other white space stay as they are.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


def hash_words(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def release_memory() -> None:
    """Let go of what earlier tasks have left in this worker process, which outlives them: word hashes and free memory of Arrow's.

    For tasks that remember other things; a worker then holds one operator's caches and not those of all before it.
    """
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def parts(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, at most `rows` at a time; nothing is copied."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHashes:
    """Hashes of any ranges of one sequence, each in constant time (polynomials modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        powers = np.full(n + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        self._inverse = np.full(n + 1, inverse, np.uint64)
        self._inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self._inverse, out=self._inverse)
        self._sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(values * powers[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), which do not depend on where the range lies."""
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    starts = np.arange(max(1, n - size + 1))
    return np.unique(RangeHashes(hashes).of(starts, np.minimum(starts + size, n)))


def odd_sketch(hashes: np.ndarray, longs: int) -> np.ndarray:
    """Parities, as 64 * `longs` bits, of how many of the distinct hashes fall on each bit.

    The exclusive or of two sketches is the sketch of the sets' symmetric difference, so it has at most as many ones as
    the difference has elements.
    """
    bits = 64 * longs
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)


def differing_bits(a: str, b: str, longs: int) -> Column:
    """Ones in the exclusive or of the sketches in columns `a` and `b`."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(longs)])


def bitmap(keys: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """A bitmap of the hashed values of `key`: at most bits / 32768 rows of 4 kB whatever the number of keys.

    As its size is fixed it may be broadcast.  A value that is in it may be missing from `keys`, never the reverse.
    """
    position = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    return (
        keys.select(position.alias("_position"))
        .groupBy(F.bitmap_bucket_number("_position").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_position")).alias("_bits"))
    )


def split_by_bitmap(df: DataFrame, key: str, bits_of: DataFrame, bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose key may be in the bitmap, and those whose key surely is not; neither moves."""
    position = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    tagged = df.withColumn("_position", position).withColumn("_bucket", F.bitmap_bucket_number("_position"))
    # pieces of 64 bytes, as every row that is looked up copies the piece it finds
    pieces = F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BYTES // 64 - 1)), lambda k: F.substring(F.col("_bits"), k * 64 + 1, F.lit(64)))
    pieces = bits_of.select("_bucket", F.posexplode(pieces).alias("_piece", "_bits"))
    offset = F.bitmap_bit_position("_position")
    tagged = tagged.withColumn("_piece", F.shiftright(offset.cast("int"), 9))
    joined = tagged.join(F.broadcast(pieces), ["_bucket", "_piece"], "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright((offset % 512).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit: Column = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), offset % 8).cast("int")) != 0, F.lit(False))
    return joined.filter(hit).select(df.columns), joined.filter(~hit).select(df.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (id, root) per linked id other than the root, its smallest id.

    Distributed union-find by alternating stars: every id is linked to the smallest of its neighbours until nothing
    changes, which takes about log(longest path) rounds.  All rows stay in tables; the driver sees a count and a checksum.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    seen = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = _fingerprint(edges)
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components, as from `components`, after more links (a, b) between the members of these."""
    at_a, at_b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    between = links.join(at_a, "a", "left").join(at_b, "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    found = components(between)
    moved = roots.join(found.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    return materialize(moved.select("id", F.coalesce("top", "root").alias("root")).unionByName(found), "roots")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components_of_buckets(
    shared: DataFrame, compare: Callable[[DataFrame], tuple[DataFrame, DataFrame]], bound: float, sketches: DataFrame, longs: int
) -> DataFrame:
    """Components, as from `components`, of the links between members of the same bucket.

    shared: (band, key, id, n), n the size of the member's set.  compare: takes distinct pairs (a, b), a < b, and returns
    those it will not need to see again and (a, b, likeness, linked) of those it measured.  `bound` is the Jaccard
    similarity of a link.  sketches: (id, n, sketch) with the true size of the set and its `odd_sketch` of `longs` longs.

    Members of a bucket of at most SMALL_BUCKET are compared pair by pair, less the pairs that sizes and sketches rule out.
    Those of a larger one are first compared with their bucket's centre, the member that meets most others over all bands; those in
    another component than the centre then with a centre of their own.  What still stands apart in a bucket is compared
    pair by pair, unless sizes, the distances to the centres (Jaccard distance obeys the triangle inequality) or more
    differing bits of their sketches than linked sets can have differing elements already forbid a link.  So a group of copies of one text costs a few comparisons per member, and no link between components
    of a bucket is missed.
    """
    bucket, farthest = ["band", "key"], 1 - bound + 1e-9
    counted = shared.groupBy(bucket).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("met")).filter("low < high")
    every = materialize(shared.join(counted.drop("low", "high"), bucket), "buckets")
    met = every.filter(F.col("met") > SMALL_BUCKET)
    members = met.drop("met").join(met.groupBy("id").agg(F.sum("met").alias("degree")), "id")
    order = F.struct("degree", F.xxhash64("id"))
    tried: list[DataFrame] = []
    # linked sets differ in at most this share of their sizes' sum
    most = (F.col("n") + F.col("m")) * ((1 - bound) / (1 + bound)) + 1e-6
    few = (differing_bits("sketch", "other_sketch", longs // 4) <= most) & (differing_bits("sketch", "other_sketch", longs) <= most)

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        seen, found = compare(pairs)
        tried.append(seen)
        return found

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of the buckets that still hold more than one component, with their roots."""
        labelled = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = labelled.groupBy(bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        return labelled.join(mixed.select(bucket), bucket, "left_semi")

    def distance(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Members with their distance to `other`, null where it was not measured."""
        pair = (F.least("id", "other") == F.col("a")) & (F.greatest("id", "other") == F.col("b"))
        far = F.when(F.col("id") == F.col("other"), 0.0).otherwise(1 - F.col("likeness"))
        return rows.join(found.select("a", "b", "likeness"), pair, "left").withColumn(name, far).drop("a", "b", "likeness")

    def may_link(*distances: tuple[str, str]) -> Column:
        possible = F.least("n", "m") >= F.greatest("n", "m") * (bound - 1e-9)
        for x, y in distances:
            possible &= F.coalesce(F.abs(F.col(x) - F.col(y)) <= farthest, F.lit(True))
        return possible

    small = every.filter(F.col("met") <= SMALL_BUCKET).select("id", "n", *bucket)
    x, y = small.alias("x"), small.alias("y")
    same = reduce(and_, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket])
    pairs = x.join(y, same & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
    pairs = pairs.filter(may_link()).distinct()
    drawn = sketches.select("id", "sketch")
    pairs = pairs.join(drawn, "id").join(drawn.select(F.col("id").alias("other"), F.col("sketch").alias("other_sketch")), "other").filter(few)
    found = measured(pairs)
    roots = components(found.filter("linked").select("a", "b"))
    if met.isEmpty():
        return roots

    members = materialize(members, "buckets")
    centres = members.groupBy(bucket).agg(F.max_by(F.struct("id", "n"), order).alias("c"))
    members = materialize(members.join(centres.select(*bucket, F.col("c.id").alias("other"), F.col("c.n").alias("m")), bucket), "buckets")
    found = found.unionByName(measured(members.filter((F.col("id") != F.col("other")) & may_link())))
    roots = merged(roots, found.filter("linked").select("a", "b"))

    rest = materialize(distance(apart(members.drop("m"), roots), found, "d1"), "apart")
    centre_root = roots.select(F.col("id").alias("other"), F.col("root").alias("centre_root"))
    strangers = rest.join(centre_root, "other", "left").filter(F.col("root") != F.coalesce("centre_root", "other"))
    centres = strangers.groupBy(bucket).agg(F.max_by(F.struct("id", "n", "root", "d1"), order).alias("c"))
    centres = centres.select(*bucket, F.col("c.id").alias("other"), F.col("c.n").alias("m"), F.col("c.root").alias("other_root"), F.col("c.d1").alias("e1"))
    rest = materialize(rest.drop("other").join(centres, bucket), "apart")
    found = found.unionByName(measured(rest.filter((F.col("root") != F.col("other_root")) & may_link(("d1", "e1")))))
    roots = merged(roots, found.filter("linked").select("a", "b"))

    rest = distance(apart(rest.drop("root", "other_root", "m", "e1"), roots), found, "d2").drop("other", "n")
    rest = materialize(rest.join(sketches.select("id", "n", "sketch"), "id"), "apart")
    renamed = {"id": "other", "n": "m", "root": "other_root", "d1": "e1", "d2": "e2", "sketch": "other_sketch"}
    mates = rest.select(*bucket, *(F.col(x).alias(y) for x, y in renamed.items()))
    different = (F.col("id") < F.col("other")) & (F.col("root") != F.col("other_root"))
    pairs = rest.join(mates, bucket).filter(different & may_link(("d1", "e1"), ("d2", "e2")) & few)
    return merged(roots, measured(pairs).filter("linked").select("a", "b"))
