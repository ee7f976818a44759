"""Readers and writers of stored tables: papers, results, fetch log, score cache."""

import csv
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.session import materialize
from topicflow.sources.records import csv_records, json_entries

PAPERS = "id string, conf string, year int, title string, abstract string"
SIMPLE = "conf string, year int, title string, abstract string, category string"
FETCH_LOG = "conf string, year int, baseurl string, invitation string, submissions int, accepted int, error string"
DETAILED = (
    f"{PAPERS}, category_key string, category_label string, confidence double, reasoning string, method string"
)
SCORE = "struct<category_key: string, category_label: string, confidence: double, reasoning: string>"
CACHE = "paper_hash string, category_key string, category_label string, confidence double, reasoning string"
COMMITS = "part string, chunk int, chunks int, committed_at timestamp"
POINTERS = "number long, bucket int, version string"
CACHE_BUCKETS = 256

# Text columns that are empty, never missing.
BLANK_COLUMNS = ("title", "abstract", "baseurl", "invitation")

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


# --- readers --------------------------------------------------------------


def _or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What `read` finds, or no rows where nothing has been written yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks, and an optional byte order mark.

    A file is read by as many tasks as it has splits.  Columns are taken by the
    header's names, whatever their order; files of one folder must agree on it.  A
    value that is not of its column's type is null.
    """
    records = csv_records(spark, path)
    headers = [r["text"] for r in records.filter("first").select("text").distinct().take(2)]
    if len(headers) > 1:
        raise ValueError(f"the files have different headers: {headers}")
    if not headers:
        return spark.createDataFrame([], schema)
    names = next(csv.reader([headers[0]]))
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    row = F.from_csv("text", ", ".join(f"`{n}` string" for n in names), {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": "true"})
    raw = records.filter("NOT first").select(row.alias("row"))
    typed = raw.select(*[F.col("row").getField(n).try_cast(types.get(n, "string")).alias(n) for n in names])
    return typed.na.fill("", [n for n in names if n in BLANK_COLUMNS])


def category_from_label(df: DataFrame) -> DataFrame:
    """A table without `category` uses its category_label instead."""
    if "category" not in df.columns and "category_label" in df.columns:
        return df.withColumn("category", F.col("category_label"))
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df` itself; ValueError naming the first column it lacks.  Runs no job."""
    for name in names or ("year", "category"):
        if name not in df.columns:
            raise ValueError(f"missing required column: {name}")
    return df


def _cache_entries(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(file, text, entries, whole): parts of a JSON cache; entries is null where one cannot be read."""
    kind = f"map<string, {SCORE}>"
    if lines:
        texts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        return texts.filter("trim(text) <> ''").select("file", "text", F.from_json("text", kind).alias("entries"), F.lit(True).alias("whole"))
    found = json_entries(spark, path, depth=1)
    one = F.when(F.col("kind") == "alone", F.col("text")).otherwise(F.concat(F.lit("{"), F.col("text"), F.lit("}")))
    return found.select("file", "text", F.from_json(one, kind).alias("entries"), "whole")


def read_cache_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Score cache kept as JSON {hash: result}; a missing file, or one whose brackets do not match, is an empty cache.

    One object per file, which many tasks read if it was written with indents, or with `lines` one object per line.
    Entries that cannot be read are left out; `broken_cache_entries` has them.
    """

    def read() -> DataFrame:
        rows = _cache_entries(spark, path, lines).filter("whole").select(F.explode("entries").alias("paper_hash", "score"))
        return rows.filter("score IS NOT NULL").select("paper_hash", "score.*").withColumn("reasoning", F.coalesce("reasoning", F.lit("")))

    return _or_empty(read, spark, CACHE)


def broken_cache_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, text): what `read_cache_json` leaves out."""
    unread = F.col("entries").isNull() | F.exists(F.map_values("entries"), lambda v: v.isNull()) | ~F.col("whole")
    return _or_empty(lambda: _cache_entries(spark, path, lines).filter(unread).select("file", "text"), spark, "file string, text string")


def read_results(spark: SparkSession, path: str, schema: str = DETAILED) -> DataFrame:
    """Results of earlier runs; none when there is no such table yet."""
    return _or_empty(lambda: spark.read.parquet(path), spark, schema)


def read_checkpoint_json(
    spark: SparkSession, path: str, schema: str = DETAILED, lines: bool = False
) -> DataFrame:
    """Earlier results kept as JSON {"results": [...], "timestamp": seconds}, per file or per line.

    A file that was written with indents is read by many tasks; one whose brackets do not match holds no results.
    """
    fields = spark.createDataFrame([], schema).schema.simpleString()
    whole = f"struct<results: array<{fields}>, timestamp: double>"

    def read() -> DataFrame:
        if lines:
            return spark.read.text(path).select(F.explode(F.from_json("value", whole).results).alias("r")).select("r.*")
        found = json_entries(spark, path, depth=2).filter("whole")
        alone = F.from_json("text", whole).results
        results = F.when(F.col("kind") == "alone", alone).otherwise(F.array(F.from_json("text", fields)))
        return found.select(F.explode(results).alias("r")).filter("r IS NOT NULL").select("r.*")

    return _or_empty(read, spark, schema)


# --- writers --------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that `read_csv` reads back unchanged, spaces at the ends of values included."""
    df.write.options(**CSV_OPTIONS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_fetch_log(log: DataFrame, path: str) -> None:
    write_csv(log, path)


def write_detailed(classified: DataFrame, path: str) -> None:
    """All columns, stored by conference and year so that later reads prune to what they need."""
    classified.write.partitionBy("conf", "year").parquet(path)


def simple_table(classified: DataFrame) -> DataFrame:
    return classified.select("conf", "year", "title", "abstract", F.col("category_label").alias("category"))


def write_simple(classified: DataFrame, path: str) -> None:
    write_csv(simple_table(classified), path)


def write_reclassified(reclassified: DataFrame, path: str) -> None:
    reclassified.write.parquet(path)


def write_checkpoint(results: DataFrame, path: str) -> None:
    """Append one run's results; the job commits them all or not at all."""
    results.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def commit_results(results: DataFrame, path: str, chunk: int = 0, chunks: int = 1) -> None:
    """Write results to a folder of their own under `path`, then a marker that they are whole."""
    part = uuid.uuid4().hex
    results.withColumn("written_at", F.current_timestamp()).write.parquet(f"{path}/parts/{part}")
    marker = results.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(chunk).alias("chunk"), F.lit(chunks).alias("chunks"), F.current_timestamp().alias("committed_at"))
    marker.write.mode("append").parquet(f"{path}/commits")


def read_committed(spark: SparkSession, path: str, schema: str = DETAILED) -> DataFrame:
    """The results under `path` whose marker has been written; what a stopped run left behind is not read."""
    commits = _or_empty(lambda: spark.read.schema(COMMITS).parquet(f"{path}/commits"), spark, COMMITS)
    parts = [f"{path}/parts/{r.part}" for r in commits.select("part").collect()]  # a row per chunk of a run
    return spark.read.parquet(*parts) if parts else spark.createDataFrame([], schema)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store `df` by the hash of `key`; tables with as many buckets are joined on it without moving a row."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """What `write_bucketed` has stored, with its buckets known; any session can read it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def upsert_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """New results, plus the old ones whose hash has no new result."""
    return new.unionByName(old.join(new.select("paper_hash"), "paper_hash", "left_anti"))


def write_cache(cache: DataFrame, path: str) -> None:
    """A new version of the cache; it goes to its own folder, never over the one being read."""
    cache.write.parquet(path)


def _cache_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("paper_hash"), F.lit(buckets)).cast("int")


def _cache_versions(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last number given to an update, and the version in which each bucket stands; at most a row per bucket."""
    pointers = _or_empty(lambda: spark.read.schema(POINTERS).parquet(f"{path}/pointers"), spark, POINTERS)
    current = pointers.groupBy("bucket").agg(F.max(F.struct("number", "version")).alias("last")).collect()
    return max((r.last.number for r in current), default=0), {r.bucket: r.last.version for r in current}


def _cache_of(spark: SparkSession, path: str, versions: dict[int, str]) -> DataFrame:
    folders = [f"{path}/versions/{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(CACHE).parquet(*folders) if folders else spark.createDataFrame([], CACHE)


def read_stored_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache that `update_stored_cache` keeps under `path`; an empty one where there is none yet."""
    return _cache_of(spark, path, _cache_versions(spark, path)[1])


def update_stored_cache(new: DataFrame, path: str, buckets: int = CACHE_BUCKETS) -> None:
    """Insert or replace results in the cache under `path`; only the buckets of hashes in `new` are written.

    A bucket's new version goes to a folder of its own, then a pointer to it is added, so a reader sees a bucket before
    or after, and a run that stops in between changes nothing.  Later updates win; of results that one update repeats
    for a hash, the greatest counts.  One writer at a time.  `buckets` must stay what it was when the cache began.
    """
    spark = new.sparkSession
    score = F.struct("confidence", "category_key", "category_label", "reasoning")
    fresh = new.filter("paper_hash IS NOT NULL").groupBy("paper_hash").agg(F.max(score).alias("score"))
    fresh = fresh.select("paper_hash", "score.*").select([c.split(" ")[0] for c in CACHE.split(", ")]).withColumn("bucket", _cache_bucket(buckets))
    fresh = materialize(fresh, "cache-update")
    number, versions = _cache_versions(spark, path)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most a row per bucket
    if not touched:
        return
    old = _cache_of(spark, path, {b: v for b, v in versions.items() if b in set(touched)}).withColumn("bucket", _cache_bucket(buckets))
    merged = upsert_cache(old, fresh)
    version = uuid.uuid4().hex
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/versions/{version}")
    pointers = fresh.select(F.lit(number + 1).cast("long").alias("number"), "bucket", F.lit(version).alias("version")).distinct()
    pointers.write.mode("append").parquet(f"{path}/pointers")
