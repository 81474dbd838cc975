"""Run registered queries next to their SQL on DuckDB and report: python tests/check_queries.py [sf] [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

TEST_DATA = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{normal(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return normal(value.asDict(recursive=True))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


FAMILY = {"long": "int", "integer": "int", "bigint": "int", "string": "str", "varchar": "str", "double": "float",
          "boolean": "bool", "hugeint": "huge", "timestamp": "ts"}


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "rows only"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: FAMILY.get(str(d[1]).lower(), str(d[1]).lower()) for d in rel.description}
    mine = {n: FAMILY.get(t.replace("bigint", "long").replace("int", "integer") if t == "int" else t, t)
            for n, t in df.dtypes}
    expected_columns, expected = rows_of(names, rel.fetchall())
    if columns != expected_columns:
        return len(got), f"COLUMNS {columns} != {expected_columns}"
    odd = {n: (mine[n], kinds[n]) for n in columns if mine[n] != kinds[n]}
    if len(got) != len(expected):
        extra, missing = sorted(set(got) - set(expected))[:2], sorted(set(expected) - set(got))[:2]
        return len(got), f"ROWS {len(got)} != {len(expected)}; extra {extra} missing {missing}"
    if got != expected:
        bad = [(a, b) for a, b in zip(got, expected) if a != b]
        diff = [(c, x, y) for c, x, y in zip(columns, *bad[0]) if x != y]
        return len(got), f"VALUES {len(bad)}: {diff}"
    return len(got), "ok" + (f" types {odd}" if odd else "")


def main() -> None:
    from veilframe.session import build_session

    import __spark_entry__ as entry

    sf_dir = f"{TEST_DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        began = time.time()
        try:
            n, verdict = compare(spark, con, sf_dir, entry.queries()[name], oracles.get(name))
        except Exception as error:  # report and go on
            n, verdict = -1, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:32s} {n:8d} rows {time.time() - began:6.1f}s  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
