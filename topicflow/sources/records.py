"""Records of several lines in text files that many tasks read: quoted CSV, and JSON that was written with indents.

A line belongs to a record by what stands before it in its file: an open quote, or the depth of brackets.  Every split
of a file gives one sum; prefix sums over the splits tell each of them in which state it begins, so its task can take
its own lines apart.  Only the lines of records that go over a split's border are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicflow.operators.joins import join_bounded
from topicflow.session import materialize

ROWS_OUT = 1000


def _quotes() -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))


def _brackets() -> Column:
    """Brackets a line of JSON opens, less those it closes; a string does not go over lines there."""
    bare = F.regexp_replace("value", r'"(?:[^"\\]++|\\.)*+"', "")
    opened = F.length(bare) - F.length(F.translate(bare, "{[", ""))
    return opened - (F.length(bare) - F.length(F.translate(bare, "}]", "")))


def _lines(spark: SparkSession, path: str, change: Column) -> DataFrame:
    """(file, block, value, change): the lines, by the split they are read in, in the order of the file."""
    found = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return found.select("file", "block", "value", change.cast("long").alias("change"))


def _records(spark: SparkSession, path: str, change: Column, base: int, modulus: int | None) -> DataFrame:
    """(file, block, first, text, total): records, in any order; `first` tells the line that begins a file.

    A record begins at a line before which the sum of `change` (modulo `modulus`) is `base`, and ends with the line after
    which it is again.  Lines where the sum is less than `base` before or after stand alone and are left out, but for a
    line that opens and closes all by itself.  total: the sum over the whole file.
    """
    lines = _lines(spark, path, change)
    sums = lines.groupBy("file", "block").agg(F.sum("change").alias("n"))
    by_block = Window.partitionBy("file").orderBy("block")
    whole = F.sum("n").over(Window.partitionBy("file")).alias("total")
    splits = materialize(sums.select("file", "block", (F.sum("n").over(by_block) - F.col("n")).alias("before"), whole), "splits")
    known = join_bounded(lines, splits, ["file", "block"], "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = (None, None)
        state = total = seq = 0
        held: list[str] = []
        within = first = False
        out: list[tuple] = []

        def close(kind: str) -> None:
            nonlocal held, seq, first
            if held:
                text = "\n".join(held)
                out.append((at[0], at[1], kind, seq, first, text, total))
                seq, first = seq + 1, first and not text.strip()
            held = []

        def passed() -> pa.RecordBatch:
            nonlocal out
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
            columns = [pa.array(v, t) for v, t in zip(zip(*out), kinds)]
            out = []
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "seq", "first", "text", "total"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "value", "change", "before", "total"))
            for file, block, value, delta, before, sum_of_file in zip(*columns):
                if (file, block) != at:
                    close("tail" if within else "middle")  # goes on in the next split
                    at, state, total, seq = (file, block), before % modulus if modulus else before, sum_of_file, 0
                    # lines at the beginning of a split may belong to a record of the split before
                    within, first, inherited = False, block == 0, state > base
                after = (state + delta) % modulus if modulus else state + delta
                if inherited:
                    held.append(value)
                    if after <= base:
                        inherited = False
                        close("head")
                elif within:
                    held.append(value)
                    if after <= base:
                        within = False
                        close("record")
                elif state == base and after >= base:
                    held.append(value)
                    within = after > base
                    if not within:
                        close("record")
                elif state == 0 and after == 0 and value.strip():
                    held.append(value)
                    close("alone")
                state = after
            if len(out) >= ROWS_OUT:
                yield passed()
        close("tail" if within else "middle")
        if out:
            yield passed()

    schema = "file string, block long, kind string, seq long, first boolean, text string, total long"
    pieces = known.mapInArrow(run, schema)
    pieces = materialize(pieces, "records")
    # a tail, the splits that are in the middle of its record, and a head: few rows for each split
    parts = pieces.filter("kind IN ('tail', 'middle', 'head')")
    number = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "seq"))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "first", "text"))).alias("rows"), F.max("total").alias("total"))
    text = F.array_join(F.transform("rows", lambda r: r.text), "\n")
    start = F.element_at("rows", 1)
    crossing = joined.select("file", start.block.alias("block"), F.lit("record").alias("kind"), start["first"].alias("first"), text.alias("text"), "total")
    return pieces.filter("kind IN ('record', 'alone')").select(crossing.columns).unionByName(crossing)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of quoted CSV files, line feeds inside quotes kept; blank lines are left out.

    `first` marks the first record of a file.  Quotes inside quotes are doubled.  A quote that is never closed makes the
    rest of its file one record, as for a reader of the whole file.
    """
    found = _records(spark, path, _quotes(), base=0, modulus=2)
    text = F.regexp_replace("text", "\r$", "")
    cleaned = F.when(F.col("first"), F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return found.select("file", "first", cleaned.alias("text")).filter("text <> ''")


def json_entries(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """(file, kind, text, whole): what stands at a depth of brackets in JSON files, one entry or several of one line a row.

    Files that were written with indents are read by many tasks.  A file in one line is a row of kind `alone`.  `whole`
    is false for the rows of a file whose brackets do not match.
    """
    found = _records(spark, path, _brackets(), base=depth, modulus=None)
    text = F.regexp_replace("text", r",\s*$", "")
    return found.select("file", "kind", text.alias("text"), (F.col("total") == 0).alias("whole"))
