"""Run queries and their checking SQL side by side: ``python tests/check_oracles.py sf0.01 [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

DATA = os.environ.get("PAPERWEAVE_DATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, int):
        return value
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(columns, rows, con, sql: str) -> list[str]:
    left = table(columns, [tuple(r) for r in rows])
    cursor = con.execute(sql)
    right = table([c[0] for c in cursor.description], cursor.fetchall())
    problems = []
    if left[0] != right[0]:
        problems.append(f"columns {left[0]} / {right[0]}")
    if len(left[1]) != len(right[1]):
        problems.append(f"rows {len(left[1])} / {len(right[1])}")
    if not problems and left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])]
        only_right = [r for r in right[1] if r not in set(left[1])]
        problems.append(f"{len(only_left)} rows differ\n   spark {only_left[:3]!r:.700}\n   check {only_right[:3]!r:.700}")
        types = {(type(a).__name__, type(b).__name__) for x, y in zip(left[1], right[1]) for a, b in zip(x, y) if type(a) is not type(b)}
        problems.append(f"types {types}")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from paperweave.session import build_session

    sf_dir = os.path.join(DATA, sys.argv[1])
    names = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, build in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            rows = df.collect()
            took = time.time() - start
            if name in oracles:
                problems = compare(df.columns, rows, con, oracles[name])
                note = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                problems, note = [], f"rows {len(rows)}"
        except Exception as error:
            problems = [str(error)]
            took = time.time() - start
            note = "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        bad += bool(problems)
        print(f"{name:32s} {took:6.1f}s {time.time() - start - took:6.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
