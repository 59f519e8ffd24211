"""Run queries and their SQL side by side and report differences.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def compare(spark_df, connection, sql: str) -> list[str]:
    """Differences in columns, types, row count or values; empty when equal."""
    problems = []
    relation = connection.sql(sql)
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for name, kind in spark_df.dtypes:
        if name not in types:
            problems.append(f"column {name} missing in SQL")
        elif SAME_TYPE.get(kind) != types[name]:
            problems.append(f"column {name}: {kind} against {types[name]}")
    problems += [f"column {n} missing in query" for n in types if n not in spark_df.columns]
    if any("missing" in p for p in problems):
        return problems
    columns = sorted(spark_df.columns)
    ours = spark_df.select(*columns).toPandas()
    theirs = relation.df()[columns]
    if len(ours) != len(theirs):
        return problems + [f"{len(ours)} rows against {len(theirs)}"]

    def prepared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.copy()
        for c in columns:
            if frame[c].dtype.kind == "f":
                frame[c] = frame[c].map(repr)
            else:
                frame[c] = frame[c].astype(object).where(frame[c].notna(), "<null>").astype(str)
        return frame.sort_values(columns).reset_index(drop=True)

    ours, theirs = prepared(ours), prepared(theirs)
    different = (ours != theirs).any(axis=1)
    if different.any():
        at = different.idxmax()
        problems.append(f"{int(different.sum())} rows differ, e.g. {ours.loc[at].to_dict()} / {theirs.loc[at].to_dict()}")
    return problems


def main(folder: str, names: list[str]) -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    spark, connection = make_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems = compare(df, connection, oracles[name])
            else:
                rows = df.count()
                problems = [] if rows else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} ({kind}) {time.time() - start:.1f}s {'; '.join(problems)}", flush=True)
        spark.catalog.clearCache()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]))
