"""Run catalogue queries in Spark and their SQL in DuckDB and compare all rows.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con, sql: str) -> str | None:
    """None if schema and all values agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [(c, t, types[c]) for c, t in df.dtypes if SPARK_TYPES.get(t, t) != types[c]]
    theirs = canonical(names, result.fetchall())
    ours = canonical(df.columns, df.collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    pairs = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if pairs:
        return f"{len(pairs)} of {len(ours)} rows differ, first {pairs[0]}"
    return f"types {wrong}" if wrong else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from keelmark.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(query(spark, sf_dir), con, sqls[name])
            else:
                problem = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and not problem.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name:32s} {problem or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
