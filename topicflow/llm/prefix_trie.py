"""The trie of conversation beginnings: sorted shards finish their own nodes, those that span shards are put together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.operators.joins import join_bounded
from topicflow.session import materialize

KEY = 16
"""Bytes that stand for a turn: the MD5 of its role and text."""
ENDS_BLOB = 1 << 20
"""Bytes of ids after which a shard passes on the ids that end at a node it shares."""
ROWS_OUT = 10_000
"""Nodes that are passed on together."""

def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of every conv_id: keys of its turns in order, joined, and the UTF-8 bytes of each text.

    Turns are ordered by `turn`, null first, then by key.  Texts are read where they lie and don't move.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # the role's length tells where the role ends
    key = F.unhex(F.md5(F.concat_ws(":", F.char_length(role), role, text))).alias("key")
    size = F.octet_length(text).cast("long").alias("size")
    # a struct sorts by its fields; false before true and so null turns first
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), key, size)
    listed = turns.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return _joined(listed, F.col("turns"))


def _joined(rows: DataFrame, turns: Column) -> DataFrame:
    """conv_id with the keys and sizes of `turns`, an array of structs."""
    path = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), ""))
    return rows.select("conv_id", path.alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes"))


def rebuild(paths: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Paths in which the first h turns are those of conversation c - c % `group`; h = crc32(decimal c) % `most`.

    What a conversation gives to others is at most `most` - 1 turns, and it gives them to `group` conv_ids at most (to
    2 * `group` - 1 around 0, as % keeps the sign).
    """
    head = paths.select(F.col("conv_id").alias("_base"), F.substring("path", 1, KEY * (most - 1)).alias("_path"), F.slice("sizes", 1, most - 1).alias("_sizes"))
    own = paths.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    found = own.join(head, "_base", "left")
    empty, h = F.lit(b""), F.col("_h")
    first = F.coalesce(F.substring("_path", F.lit(1), h * KEY), empty)
    path = F.concat(first, F.substring("path", h * KEY + 1, F.octet_length("path")))
    sizes = F.concat(F.coalesce(F.slice("_sizes", F.lit(1), h), F.array().cast("array<bigint>")), F.slice("sizes", h + 1, F.size("sizes")))
    return found.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def common_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // KEY


class _Open:
    """A node whose members are being read; `start` is the first of its shards if it is shared, else None."""

    def __init__(self, size: int, start: int | None):
        self.size, self.start = size, start
        self.low = self.n = self.children = self.leaves = self.saved = self.blobs = self.blob_bytes = 0
        self.ends = hashlib.sha256()
        self.any_end = False
        self.waiting: list[tuple] = []
        """Finished children, which need this node's smallest member."""
        self.blob: list[str] = []


def first_shard(borders: list[tuple[int, int]], shard: int, depth: int) -> int:
    """The first shard of the node at this depth on the path with which `shard` begins.

    borders[s] is (turns that the last path of shard s - 1 and the first of shard s share, -1 for s = 0; turns that the
    first and the last path of shard s share).  These depths are the trie of the border paths: (first shard, depth) names
    each of its nodes.
    """
    while borders[shard][0] >= depth:
        shard -= 1
        if borders[shard][1] < depth:
            break
    return shard


def shard_nodes(rows: Iterator[tuple[int, int | None, bytes, list[int]]], borders: list[tuple[int, int]]) -> Iterator[tuple]:
    """Nodes of sorted shards, of rows (shard, conv_id, path, sizes) in order of shard, path and conv_id.

    Before its rows a shard has one without conv_id: the path that its last row shares with the next shard.  A node is
    shared if it lies on that path or is among the first borders[shard][0] turns of the shard's first row; all others have
    their members in this shard and are finished as soon as a path without them comes.  Held are the open nodes of one
    path, the finished children of those that are not shared, and a megabyte of ids.

    Gives (kind, start, depth, up, shard, seq, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, size,
    text).  Kinds: `node` is finished; `child` too, but for its parent (start, depth - 1); `part` is what the shard knows
    of the shared node (start, depth) with the parent (up, depth - 1), children, leaves and tokens of shared nodes below
    it left out; `ends` has ids that end at the shared node.
    """
    stack: list[_Open] = []
    path, border, shard, from_left = b"", b"", -1, -1

    def ends_of(node: _Open, depth: int) -> tuple:
        row = ("ends", node.start, depth, None, shard, node.blobs, *[None] * 7, ",".join(node.blob))
        node.blob, node.blob_bytes, node.blobs = [], 0, node.blobs + 1
        return row

    def close() -> Iterator[tuple]:
        """Finish the deepest open node, or what this shard has of it."""
        depth = len(stack) - 1
        node = stack.pop()
        parent = stack[-1] if stack else None
        if node.start is not None:
            yield ("part", node.start, depth, parent.start if parent else None, shard, None, node.low, None, node.n, node.children, node.leaves, node.saved, node.size, None)
            if node.blob:
                yield ends_of(node, depth)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        counts = (node.n, node.children, leaves, saved, None, node.ends.hexdigest())
        for low, child in node.waiting:
            yield ("node", None, depth + 1, None, None, None, low, node.low, *child)
        if parent is None:
            yield ("node", None, 0, None, None, None, node.low, None, *counts)
            return
        if parent.start is None:
            parent.waiting.append((node.low, counts))
        else:
            yield ("child", parent.start, depth, None, None, None, node.low, None, *counts)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved

    for at, conv_id, new, sizes in rows:
        if at != shard:
            while stack:
                yield from close()
            shard, path, border, from_left = at, b"", None, borders[at][0]
        if conv_id is None:
            border = new
            continue
        keep = common_depth(path, new)
        while len(stack) - 1 > keep:
            yield from close()
        if len(stack) <= len(new) // KEY:
            on_border = -1 if border is None else common_depth(border, new)
            for depth in range(len(stack), len(new) // KEY + 1):
                start = first_shard(borders, shard, depth) if depth <= from_left else shard if depth <= on_border else None
                stack.append(_Open(sizes[depth - 1] if depth else 0, start))
        path, from_left = new, -1  # nodes of later rows do not come from the shard before
        for node in stack:
            node.low = min(node.low, conv_id) if node.n else conv_id
            node.n += 1
        last = stack[-1]
        if last.start is None:
            last.ends.update((f",{conv_id}" if last.any_end else str(conv_id)).encode())
            last.any_end = True
        else:
            last.blob.append(str(conv_id))
            last.blob_bytes += len(last.blob[-1]) + 1
            if last.blob_bytes >= ENDS_BLOB:
                yield ends_of(last, len(stack) - 1)
    while stack:
        yield from close()


_OUT = pa.schema(
    [("kind", pa.string())]
    + [(c, pa.int64()) for c in ("start", "depth", "up", "shard", "seq", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")]
    + [("text", pa.string())]
)
_OUT_DDL = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _OUT)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield batch()
            held = []
    if held:
        yield batch()


def _borders(shards: DataFrame) -> DataFrame:
    """(shard, common, within, path) per shard: turns its first path shares with the shard before (-1: none) and with its
    own last path, and the path shared with the next shard (null: none)."""
    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")  # a row per shard
    ends = ends.select("shard", F.lag("last").over(order).alias("before"), "first", "last", F.lead("first").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, before, first, last, after = (batch.column(c).to_pylist() for c in ("shard", "before", "first", "last", "after"))
            common = [-1 if b is None else common_depth(b, f) for b, f in zip(before, first)]
            paths = [None if a is None else x[: KEY * common_depth(x, a)] for x, a in zip(last, after)]
            within = list(map(common_depth, first, last))
            columns = [*(pa.array(x, pa.int32()) for x in (shard, common, within)), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "common", "within", "path"])

    return ends.mapInArrow(run, "shard int, common int, within int, path binary")


def _reduced(parts: DataFrame) -> DataFrame:
    """The shared nodes: parts of a node are added up, then nodes to their parents.

    Every border between shards adds the nodes of one path at most, so this is a few rows per shard.  Sorted by first
    shard and depth they are in depth-first order.
    """
    total = parts.groupBy("start", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("size").alias("size"),
    )
    columns = ["start", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size"]

    def finished(rows: Iterator[list[int]]) -> Iterator[tuple]:
        stack: list[list[int]] = []

        def close() -> tuple:
            start, depth, conv_id, n, children, leaves, saved, size = stack.pop()
            leaves = leaves if children else 1
            saved += (n - 1) * size
            if stack:
                above = stack[-1]
                above[4], above[5], above[6] = above[4] + 1, above[5] + leaves, above[6] + saved
            return start, depth, conv_id, stack[-1][2] if stack else None, n, children, leaves, saved

        for row in rows:
            while len(stack) > row[1]:
                yield close()
            stack.append(row)
        while stack:
            yield close()

    names = ["start", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(r) for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
        yield from _batched(finished(rows), schema)

    return total.select(columns).coalesce(1).sortWithinPartitions("start", "depth").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _ends(pieces: DataFrame) -> DataFrame:
    """(start, depth, ends_sha256): the pieces of each node's ids in order.  A hash has to be taken from one end to the other, which a task does without holding them."""
    schema = pa.schema([("start", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def hashed(rows: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
        key, digest = None, hashlib.sha256()
        for start, depth, ids in rows:
            if (start, depth) != key:
                if key:
                    yield (*key, digest.hexdigest())
                key, digest = (start, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if key:
            yield (*key, digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("start", "depth", "text"))))
        yield from _batched(hashed(rows), schema)

    dealt = pieces.repartition("start", "depth").sortWithinPartitions("start", "depth", "shard", "seq")
    return dealt.select("start", "depth", "text").mapInArrow(run, "start long, depth long, ends_sha256 string")


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct beginning of the `paths` (conv_id, path, sizes), the empty one included.

    Paths are dealt out by ranges and sorted; the ranges' borders depend on the paths and conv_ids, so copies of one path,
    however many, are split too.  `shards` sets the number of ranges (default: the session's shuffle partitions).  Every
    task gets the depths to which the first and last paths of neighbouring shards agree, two numbers per shard, and the
    path at its own border; from them it knows the nodes that span shards.
    """
    spread = paths.repartitionByRange(shards, "path", "conv_id") if shards else paths.repartitionByRange("path", "conv_id")
    sorted_paths = materialize(spread.withColumn("shard", F.spark_partition_id()), "shards")
    borders = materialize(_borders(sorted_paths), "borders")
    known = sorted(borders.select("shard", "common", "within").collect())  # a row per shard
    place = {r.shard: k for k, r in enumerate(known)}
    depths = [(r.common, r.within) for r in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("shard", "conv_id", "path", "sizes")
        rows = ((place[r[0]], *r[1:]) for b in batches for k in range(0, len(b), 256) for r in zip(*(b.slice(k, 256).column(c).to_pylist() for c in columns)))
        yield from _batched(shard_nodes(rows, depths), _OUT)

    own = borders.filter("path IS NOT NULL").select("shard", F.lit(None).cast("long").alias("conv_id"), "path", F.array().cast("array<bigint>").alias("sizes"))
    rows = sorted_paths.select("shard", "conv_id", "path", "sizes").unionByName(own)
    order = ["shard", F.col("conv_id").isNotNull(), "path", "conv_id"]
    found = rows.repartition(max(1, len(known)), "shard").sortWithinPartitions(*order).mapInArrow(run, _OUT_DDL)
    found = materialize(found, "nodes")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = materialize(_reduced(found.filter("kind = 'part'")), "skeleton")
    ends = _ends(found.filter("kind = 'ends'"))
    none = F.sha2(F.lit(b""), 256)
    top = shared.join(ends, ["start", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(names)
    above = shared.select("start", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    below = join_bounded(found.filter("kind = 'child'"), above, ["start", "depth"], "inner").withColumn("parent_conv_id", F.col("above"))
    local = found.filter("kind = 'node'")
    rest = [x.withColumnRenamed("text", "ends_sha256").select(names) for x in (below, local)]
    return top.unionByName(rest[0]).unionByName(rest[1])


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of `turns` (conv_id, turn, role, text); see `rebuild` and `trie`.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of
    its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the UTF-8 bytes of a node's last
    text), ends_sha256 (SHA-256 of the comma-joined conv_ids, ascending, of the members that end there).

    Null role and text count as empty; null turns come first; turns of equal number are ordered by the MD5 of role and
    text, and rows that repeat another are turns of their own.  Rows without conv_id take no part.  A conversation may end
    without turns, at the root.  No rows give no nodes, not even a root.  Other columns are not read.  Turns are
    told apart by 128 bits.  A conversation's path, 16 bytes a turn, is one row; its texts, however long, are not moved.
    """
    return trie(rebuild(turn_paths(turns)), shards)
