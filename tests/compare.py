"""Run registered queries beside their SQL twins: ``python tests/compare.py [dir] [name ...]``."""

from __future__ import annotations

import decimal
import importlib
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str):
    import duckdb

    connection = duckdb.connect()
    for name in RAW_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(normal(item) for item in value)
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(normal(row[c]) for c in columns) for row in df.collect())


def twin_rows(connection, sql: str):
    cursor = connection.execute(sql)
    names = [item[0] for item in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(normal(row[i]) for i in order) for row in cursor.fetchall())


def difference(spark, connection, fn, sql, path):
    """Empty text when both sides agree."""
    columns, left = spark_rows(fn(spark, path))
    if sql is None:
        return "", sum(left.values())
    other, right = twin_rows(connection, sql)
    if columns != other:
        return f"columns {columns} vs {other}", sum(left.values())
    if left != right:
        return f"only spark {list((left - right).items())[:3]} only sql {list((right - left).items())[:3]}", sum(left.values())
    return "", sum(left.values())


def main(argv: list[str]) -> int:
    from engramlake.session import build_session

    path = argv[0] if argv else "/root/testdata/sf0.001"
    from engramlake.registry import core

    wanted = argv[1:]
    modules = [w[1:] for w in wanted if w.startswith("@")]
    names = [w for w in wanted if not w.startswith("@")]
    if modules:
        for module in modules:
            importlib.import_module(f"engramlake.registry.{module}")
    spark = build_session(
        master="local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__engramlake__spreadTables": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(path)
    bad = 0
    for name, fn in core.QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem, count = difference(spark, connection, fn, core.TWINS.get(name), path)
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(problem)
        state = "FAIL" if problem else ("ok" if name in core.TWINS else "ok (rows only)")
        print(f"{state:5} {name} rows={count} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
