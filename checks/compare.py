"""Runs every query and its SQL on one scale factor and reports where they differ.

python -m checks.compare [sf_dir] [query ...]
"""

import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("topicflow")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="topicflow-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sql_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str | None:
    """None when query and SQL agree in columns, types and rows."""
    result = QUERIES[name](spark, sf_dir)
    got = result.toPandas()
    relation = con.sql(ORACLES[name])
    want = relation.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in result.schema}
    names = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    sql_types = {c: names.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    if spark_types != sql_types:
        return f"types {[(c, t, sql_types[c]) for c, t in spark_types.items() if t != sql_types[c]]}"
    got, want = canonical(_nullable(got)), canonical(_nullable(want))
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got.equals(want):
        rows = (got != want).any(axis=1)
        return f"{rows.sum()} of {len(got)} rows differ, first:\n{got[rows].head(2).to_dict('records')}\n{want[rows].head(2).to_dict('records')}"
    return None if len(got) else "no rows"


def _nullable(df: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers stay whole when a column has nulls."""
    for c in df.columns:
        if df[c].dtype == "float64" and df[c].isna().any() and (df[c].dropna() % 1 == 0).all():
            df[c] = df[c].astype("Int64")
    return df.astype(object)


def main(sf_dir: str, *only: str) -> int:
    spark, con = session(), sql_tables(sf_dir)
    bad = 0
    for name in only or QUERIES:
        start = time.time()
        try:
            problem = differences(spark, con, name, sf_dir) if name in ORACLES else "no SQL"
        except Exception:
            problem = " ".join(traceback.format_exc(limit=-3).split("JVM stacktrace")[0][:1500].splitlines())
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(only or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*(sys.argv[1:] or ["/root/testdata/sf0.01"]))))
