"""Near-duplicate lines over all documents by MinHash of character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import bitmap, components_of_buckets, mix64, parts, split_by_bitmap
from topicflow.session import discard, materialize, release_shuffles

SHINGLE = 7
"""Characters of a shingle: unrelated lines of prose share nearly none of this length."""
BANDS, ROWS = 33, 4
"""Of two lines at similarity 0.8, 3 in 10**8 share no band; at 0.85, 3 in 10**11.  Three rows need fewer bands, but then
lines of one language that share a few shingles by chance meet, and their number grows with the square of the input."""
SKETCH_LONGS = 16
"""64-bit words of an odd sketch; at 500 characters it rules out most pairs below similarity 0.76, at some 1,500 few."""
GROUP_BYTES = 8 << 20
"""Bytes of text for each group of band keys; a group has some two million of them at the most usual lines."""
HELD_KEYS = 8_000_000
"""Keys of a group after which those of very many lines are passed on."""
HOT_KEY = 100_000
DOCS_AT_ONCE = 2000
LINES_AT_ONCE = 1 << 16
"""Lines numbered together, in two bytes."""
PAIRS_AT_ONCE = 2000
SKETCHED_AT_ONCE = 500
_STEP = 1 << 14
_AT_ONCE = 12
"""Hash functions applied together; their values stay in the processor's cache."""
_BLANK = " \t\x0b\x0c\r"
"""A line of these alone is blank."""

_random = np.random.default_rng(7)
_FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every run of SHINGLE characters."""
    n = len(codes) - SHINGLE + 1
    run, length, left = codes.astype(np.uint64), 1, SHINGLE  # polynomials of all runs of 1, 2, 4 ... characters
    found, done = np.zeros(n, np.uint64), 0
    while left:
        power = np.uint64(pow(0x9E3779B97F4A7C15, length, 1 << 64))
        if left & 1:
            found *= power
            found += run[done : done + n]
            done += length
        left >>= 1
        if left:
            joined = run[:-length] * power
            joined += run[length:]
            run, length = joined, 2 * length
    return mix64(found)


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of band keys (64-bit hashes of the band's minima) per line; a shorter line is one shingle."""
    least = np.full((len(lines), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    first = 0
    while first < len(lines):  # some lines at a time, so that their hashes stay in the processor's cache
        last, size = first, 0
        while last < len(lines) and (size < _STEP or last == first):
            size += max(len(lines[last]), SHINGLE)
            last += 1
        part = [line.ljust(SHINGLE, "\0") for line in lines[first:last]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        hashes = _hashes(codes)
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(lengths)
        for k in range(1, SHINGLE):
            inside[ends - k] = False
        base = (hashes >> np.uint64(32)).astype(np.uint32)[inside[: len(hashes)]]
        starts = np.cumsum(lengths - SHINGLE + 1) - (lengths - SHINGLE + 1)
        products = np.empty((_AT_ONCE, len(base)), np.uint32)
        for k in range(0, BANDS * ROWS, _AT_ONCE):  # base is mixed already, so a product with an odd number orders it anew
            np.multiply(base[None, :], _FACTORS[k : k + _AT_ONCE, None], out=products)
            least[first:last, k : k + _AT_ONCE] = np.minimum.reduceat(products, starts, axis=1).T
        first = last
    minima = least.reshape(len(lines), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(lines), 1))  # so that no two bands share a key
    for k in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, k])
    return keys.view(np.int64)


def likeness(a: str, b: str) -> float:
    """Exact Jaccard similarity of the shingles of two lines."""
    x = {a[k : k + SHINGLE] for k in range(max(1, len(a) - SHINGLE + 1))}
    y = {b[k : k + SHINGLE] for k in range(max(1, len(b) - SHINGLE + 1))}
    common = len(x & y)
    return common / (len(x) + len(y) - common)


def _distinct_lines(batch: pa.RecordBatch) -> dict[str, tuple[int, int]]:
    """The lines of some documents that are not blank, each with its first place there."""
    seen: dict[str, tuple[int, int]] = {}
    texts = batch.column("text")
    for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        if doc_id is None:
            continue
        for pos, line in enumerate((texts[k].as_py() or "").split("\n")):
            if line.strip(_BLANK):
                place = (doc_id, pos)
                if line not in seen or place < seen[line]:
                    seen[line] = place
    return seen


def _shared_set(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number for each run of ids, the same for runs of the same ids in any order."""
    mixed = mix64(ids.view(np.uint64).copy())
    return mix64(np.add.reduceat(mixed, starts) ^ np.add.reduceat(mix64(mixed), starts)).view(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return np.diff(np.append(starts, len(values)))


def first_of_equal(halves: np.ndarray, doc_ids: np.ndarray, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The lines with these 128-bit hashes, each with the id of the one of its hash that has the first place."""
    order = np.lexsort((ids, places, doc_ids, halves[:, 1], halves[:, 0]))
    halves, known = halves[order], [a[order] for a in (ids, doc_ids, places)]
    new = np.ones(len(order), bool)
    new[1:] = (halves[1:] != halves[:-1]).any(axis=1)
    line = known[0][new][np.cumsum(new) - 1]
    return pa.RecordBatch.from_arrays([pa.nulls(len(order), pa.int64()), *map(pa.array, known), pa.array(line)], MEMBERS)


def crowded(keys: np.ndarray, marks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, id) of the ids that share a key of four bytes; buckets of the same ids, as copies make them in many bands, are one.

    Of ids with the same key and mark, which are equal lines, only the smallest is looked at.
    """
    # keys and places in one number, as plain numbers are sorted several times faster than places by a key
    order = (np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys = keys[order]
    sizes = _runs(keys)
    several = np.repeat(sizes > 1, sizes)
    keys, order = keys[several], order[several]
    ids = ids[order]
    both = keys.astype(np.uint64) << np.uint64(32) | marks[order]
    order = np.lexsort((ids, both))
    both, ids = both[order], ids[order]
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    keys, ids = both[first] >> np.uint64(32), ids[first]
    sizes = _runs(keys)
    ids, sizes = ids[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(ids):
        return ids, ids
    names = np.repeat(_shared_set(ids, np.cumsum(sizes) - sizes), sizes)
    order = np.lexsort((ids, names))
    names, ids = names[order], ids[order]
    new = np.concatenate([[True], (names[1:] != names[:-1]) | (ids[1:] != ids[:-1])])
    return names[new], ids[new]


MEMBERS = ["key", "id", "doc_id", "pos", "line"]


def _banded(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, id, doc_id, pos, line): lines by the numbers they get, with a key the members of buckets that hold different lines.

    A line, once per batch of documents, gets a number of its own.  Its band keys go to one of `buckets` groups as plain
    arrays, four bytes for a key, four for its mark and two for its line, and a task takes one group after the other.  A
    mark is a hash of line and key, so equal lines are one before they are buckets, and two lines of one bucket that differ
    and share a mark (1 in 2**32) need not do so in the next.  Keys that very many lines have are passed on as they come.
    Every line also goes to the group of its 128-bit hash, where `line`, the first by place of all equal ones, is found.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, len(whole), DOCS_AT_ONCE):
                seen = list(_distinct_lines(whole.slice(first, DOCS_AT_ONCE)).items())
                for start in range(0, len(seen), LINES_AT_ONCE):
                    part = seen[start : start + LINES_AT_ONCE]
                    keys = band_keys([text for text, _ in part]).view(np.uint64)
                    halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")) for text, _ in part), "<u8").reshape(-1, 2)
                    marks = (((keys ^ halves[:, :1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).ravel()
                    keys = keys.ravel()
                    short = ((keys // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    numbers = np.arange(len(part), dtype=np.uint16)
                    line = np.repeat(numbers, BANDS)
                    order, ends = dealt(keys % np.uint64(buckets))
                    own, own_ends = dealt(halves[:, 0] % np.uint64(buckets))
                    doc_ids, places = np.array([p[0] for _, p in part], "<i8"), np.array([p[1] for _, p in part], "<i4")
                    groups = np.flatnonzero(np.diff(ends) + np.diff(own_ends))
                    columns = [groups.tolist(), [number] * len(groups)]
                    columns += [[a[order[ends[g] : ends[g + 1]]].tobytes() for g in groups] for a in (short, marks, line)]
                    columns += [[a[own[own_ends[g] : own_ends[g + 1]]].tobytes() for g in groups] for a in (halves, doc_ids, places, numbers)]
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["group", "number", *(name for name, _ in arrays)])
                    number += len(part)

    arrays = [("keys", "<u4"), ("marks", "<u4"), ("lines", "<u2"), ("digests", "<u8"), ("doc_ids", "<i8"), ("places", "<i4"), ("own", "<u2")]

    def dealt(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the members of each group are, in one array, and where each group's end there."""
        groups = groups.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # two bytes are sorted by counting
        order = np.argsort(groups, kind="stable")
        return order, np.searchsorted(groups[order], np.arange(buckets + 1))

    def members(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), none, none.cast(pa.int32()), none], MEMBERS)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size, hot, lines = -1, [], 0, np.zeros(0, np.uint32), []

        def hot_rows(k: np.ndarray, m: np.ndarray, i: np.ndarray) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
            is_hot = np.isin(k, hot)
            name = mix64(k[is_hot].astype(np.uint64) * np.uint64(buckets) + np.uint64(group)).view(np.int64)
            return members(name, i[is_hot]), (k[~is_hot], m[~is_hot], i[~is_hot])

        def joined(arrays: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
            return [np.concatenate(a) for a in zip(*arrays)]

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield members(*crowded(*joined(held)))
            if lines:
                yield first_of_equal(*joined(lines))

        for batch in batches:
            for row in range(len(batch)):
                at, number = batch.column("group")[row].as_py(), batch.column("number")[row].as_py()
                if at != group:
                    yield from close()
                    group, held, size, hot, lines = at, [], 0, np.zeros(0, np.uint32), []
                k, m, line, halves, doc_ids, places, own = (np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in arrays)
                lines.append((halves.reshape(-1, 2), doc_ids, places, number + own.astype(np.int64)))
                found = k, m, number + line.astype(np.int64)
                if len(hot):
                    rows, found = hot_rows(*found)
                    yield rows
                held.append(found)
                size += len(found[0])
                if size > HELD_KEYS:
                    found = joined(held)
                    values, counts = np.unique(found[0], return_counts=True)
                    hot = np.union1d(hot, values[counts > HOT_KEY])
                    rows, found = hot_rows(*found)
                    yield rows
                    held, size = [found], 0  # so that the next look is as far away
        yield from close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    grouped = rows.mapInArrow(signed, ", ".join(["group int, number long", *(f"{name} binary" for name, _ in arrays)])).repartition(buckets, "group")
    return grouped.sortWithinPartitions("group").mapInArrow(met, "key long, id long, doc_id long, pos int, line long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the lines (id, doc_id, pos) asked for; few of the others move."""
    place = F.xxhash64("doc_id", "pos").alias("place")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("*", place)
    there, _ = split_by_bitmap(lines, "place", bitmap(wanted.select(place), "place"))
    return there.join(wanted.hint("shuffle_hash"), ["doc_id", "pos"]).select("id", "line")


def _line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines, one line after the other, and where each line's end; a shorter line is one shingle."""
    padded = [line.ljust(SHINGLE, "\0") for line in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    hashes = _hashes(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32))
    inside = np.ones(int(lengths.sum()), bool)
    ends = np.cumsum(lengths)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return hashes[inside[: len(hashes)]], np.cumsum(lengths - SHINGLE + 1)


def line_sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles and odd sketch of each line, all lines together."""
    hashes, ends = _line_hashes(lines)
    starts = np.concatenate([[0], ends[:-1]])
    for first, last in zip(starts.tolist(), ends.tolist()):
        hashes[first:last].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[starts] = True
    bits = 64 * SKETCH_LONGS
    at = np.repeat(np.arange(len(lines)) * bits, ends - starts)[new] + (hashes[new] & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(lines) * bits) & 1).astype(bool)
    return np.add.reduceat(new, starts, dtype=np.int64), np.packbits(odd).view(np.int64).reshape(-1, SKETCH_LONGS)


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, sketch) of the lines: number of distinct shingles and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, SKETCHED_AT_ONCE):
            counts, sketches = line_sketches([line or "" for line in batch.column("line").to_pylist()])
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * SKETCH_LONGS)
            columns = [batch.column("id"), pa.array(counts), pa.ListArray.from_arrays(ends, pa.array(sketches.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sketch"])

    return texts.mapInArrow(run, "id long, n long, sketch array<long>")


def likenesses(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the shingles of each two lines; shingles are told apart by 64-bit hashes."""
    known = {line: k for k, line in enumerate(dict.fromkeys([*left, *right]))}
    hashes, ends = _line_hashes(list(known))
    ends = ends.tolist()
    sets = [_sorted_set(hashes[first:last]) for first, last in zip([0, *ends], ends)]
    out = np.empty(len(left))
    for p, (x, y) in enumerate(zip(map(known.__getitem__, left), map(known.__getitem__, right))):
        if x == y:
            out[p] = 1.0
            continue
        a, b = sets[x], sets[y]
        both = np.concatenate([a, b])
        both.sort(kind="stable")  # two sorted runs are merged
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out[p] = common / (len(both) - common)
    return out


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, likeness) of the lines of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), PAIRS_AT_ONCE):
                batch = whole.slice(k, PAIRS_AT_ONCE)
                found = likenesses(*([x or "" for x in batch.column(c).to_pylist()] for c in ("la", "lb")))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "likeness"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts, _ = split_by_bitmap(texts, "id", bitmap(ends, "id"))
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long, likeness double")
    return sized.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def kept_lines(docs: DataFrame, bound: float = 0.8) -> DataFrame:
    """(doc_id, kept): places of the lines that stay, for documents with a line that is not blank."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    banded = materialize(_banded(docs, max(1, -(-size // GROUP_BYTES))), "banded")
    spark = docs.sparkSession
    release_shuffles(spark)
    # equal lines are one from here on, known by the number of the first of them
    placed = banded.filter("doc_id IS NOT NULL")
    places = placed.filter("id = line").select("id", "doc_id", "pos")
    again = placed.filter("id <> line").select("id", "line").hint("shuffle_hash")
    members = banded.filter("key IS NOT NULL").select("key", "id").join(again, "id", "left")
    members = materialize(members.select("key", F.coalesce("line", "id").alias("id")).distinct(), "members")
    wanted = materialize(places.join(members.select("id").distinct(), "id", "left_semi"), "wanted")
    release_shuffles(spark)
    texts = materialize(_texts(docs, wanted), "candidates")
    release_shuffles(spark)
    sketches = materialize(_sketches(texts), "sketches")

    def compare(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = materialize(pairs, "pairs")
        release_shuffles(spark)
        found = materialize(_compared(pairs, texts), "compared")
        discard(pairs)
        release_shuffles(spark)
        return found.select("a", "b"), found.withColumn("linked", F.col("likeness") >= bound - 1e-12)

    shared = members.join(sketches.select("id", "n"), "id").select("id", "n", F.lit(0).alias("band"), "key")
    shared = materialize(shared, "shared")
    roots = components_of_buckets(shared, compare, bound, sketches, SKETCH_LONGS)

    # of every component the line with the first place stays
    linked = roots.select("id", "root").unionByName(roots.select(F.col("root").alias("id"), "root")).distinct().join(wanted, "id")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "pos", "id")).alias("first")).select("root", F.col("first.id").alias("stays"))
    gone = linked.join(first, "root").filter("id <> stays").select("id")
    kept = places.join(gone.hint("shuffle_hash"), "id", "left_anti").groupBy("doc_id").agg(F.collect_list("pos").alias("kept"))
    kept = materialize(kept, "kept-lines")
    discard(banded, members, wanted, texts, sketches, shared)
    release_shuffles(spark)
    return kept


def not_blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(_BLANK)) != ""


def left_lines(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(row, lines, left): every row of `docs` with a doc_id, whole, its lines, and those of them that stay."""
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("row"))
    found = rows.join(kept.select(F.col("doc_id").alias("named"), "kept").hint("shuffle_hash"), F.col("row")["doc_id"] == F.col("named"), "left")
    places = F.coalesce("kept", F.array().cast("array<int>"))
    split = found.select("row", F.split(F.coalesce(F.col("row")["text"], F.lit("")), "\n").alias("lines"), places.alias("places"))
    return split.select("row", "lines", F.filter("lines", lambda x, k: ~not_blank(x) | F.array_contains(F.col("places"), k)).alias("left"))


def dedup_lines(docs: DataFrame, bound: float = 0.8) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines (not blank), n_removed, text (what is left of it).

    Lines with a Jaccard similarity of `bound` or more in their character shingles are linked, and of every component of
    links over all documents the line stays that comes first by doc_id and place.  Lines are what `\\n` separates, as they
    are; blank lines stay where they are and count nowhere.  Equal lines are reduced before they move, and only documents
    that hold a candidate or lose a line are moved at all.

    A null text stays null with no lines, an empty one empty.  Rows without doc_id take no part and stay whole.  Rows that
    repeat a doc_id and text share the decisions.  A document that loses every line keeps its blank lines.
    """
    rows = docs.select("doc_id", "text")
    row, known = F.col("row"), left_lines(rows, kept_lines(docs, bound))
    known = known.select(
        row["doc_id"].alias("doc_id"),
        F.size(F.filter("lines", not_blank)).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        F.when(row["text"].isNotNull(), F.array_join("left", "\n")).alias("text"),
    )
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), not_blank))
    unknown = rows.filter("doc_id IS NULL").select("doc_id", count.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), "text")
    return known.unionByName(unknown)
