"""Runs registered queries next to their SQL twins and reports differences.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    number = float(value)
    return "nan" if math.isnan(number) else number


def _type(value) -> str:
    return type(value).__name__


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def differences(spark_result, sql_result, limit: int = 3) -> list[str]:
    (names, left), (other_names, right) = spark_result, sql_result
    if names != other_names:
        return [f"columns {names} != {other_names}"]
    found = []
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    for a, b in zip(left, right):
        if a != b or [_type(x) for x in a] != [_type(x) for x in b]:
            found.append(str([(n, x, y) for n, x, y in zip(names, a, b) if x != y or _type(x) != _type(y)]))
            if len(found) > limit:
                break
    return found


def check(spark, con, sf_dir: str, build, sql: str) -> list[str]:
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return differences(canonical(df.columns, rows), canonical(names, result.fetchall()))


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from holdfast.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = local_session(8), connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in sql:
                found = check(spark, con, sf_dir, build, sql[name])
                verdict = "ok" if not found else "DIFF"
            else:
                rows = build(spark, sf_dir).collect()
                found, verdict = [], f"rows {len(rows)}"
        except Exception as error:  # report and go on with the other queries
            found, verdict = [str(error)[:1500]], "ERROR"
        failed += bool(found)
        print(f"{time.time() - began:6.2f}s {verdict:8} {name}", flush=True)
        for line in found:
            print("        ", line[:1500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
