"""Run registered queries and their SQL side by side.

    python tests/oracle.py [--sf DIR] [name ...]
"""

import argparse
import math
import pathlib
import sys
import tempfile
import time
import traceback

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tagweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tagweave-tests-"))
        .getOrCreate()
    )


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def compare(df, rows, con, sql: str) -> str | None:
    """None if the rows agree as a bag, else what differs."""
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in rows]
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} against {sorted(relation.columns)}"
    at = [relation.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in relation.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    key = lambda row: tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)
    different = [(a, b) for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {str(different[0])[:600]}"
    kinds = dict(df.dtypes)
    types = {c: (kinds[c], str(relation.types[i])) for c, i in zip(columns, at)}
    names = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"}}
    odd = {c: k for c, k in types.items() if k[1] not in names.get(k[0], {k[1]})}
    return f"types {odd}" if odd else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(args.sf), entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.names or queries:
        start = time.time()
        spark_took = 0.0
        try:
            df = queries[name](spark, args.sf)
            rows = df.collect()
            spark_took = time.time() - start
            if name in sql:
                wrong = compare(df, rows, con, sql[name])
            else:
                wrong = None if rows else "no rows"
        except Exception as error:
            traceback.print_exc(limit=8)
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if wrong is None else "BAD"
        took = time.time() - start
        print(f"{mark} {name:28s} {took:6.1f}s ({spark_took:.1f}s) {'sql' if name in sql else 'rows'} {wrong or ''}", flush=True)
        bad += [name] if wrong else []
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
