"""Run registered queries in Spark and their SQL in DuckDB, and compare whole results.

As a script: ``python -m tests.oracle [sf_dir] [name …] [--plain-session]``; the latter
uses a session with default settings.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _kinds(columns: dict[str, str]) -> dict[str, str]:
    groups = {
        "int": ("bigint", "integer", "int", "hugeint", "smallint", "tinyint"),
        "float": ("double", "float", "real"),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
        "time": ("timestamp", "timestamp_ntz"),
    }
    out = {}
    for name, kind in columns.items():
        out[name] = next((g for g, members in groups.items() if kind.lower() in members), kind.lower())
    return out


def compare(spark, con, folder: str, run, sql: str) -> tuple[int, list[str]]:
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(_plain(v) for v in row) for row in df.select(names).collect())
    rel = con.sql(sql)
    theirs_names = sorted(rel.columns)
    problems = []
    if names != theirs_names:
        return sum(ours.values()), [f"columns {names} != {theirs_names}"]
    a = _kinds({f.name: f.dataType.simpleString() for f in df.schema.fields})
    b = _kinds(dict(zip(rel.columns, map(str, rel.types), strict=True)))
    exact = {f.name: (f.dataType.simpleString(), str(t)) for f, t in zip(sorted(df.schema.fields, key=lambda f: f.name), [dict(zip(rel.columns, rel.types, strict=True))[n] for n in names], strict=True)}
    if a != b:
        problems.append(f"types {[(k, v) for k, v in exact.items() if a[k] != b[k]]}")
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = Counter(tuple(_plain(v) for v in row) for row in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    if ours != theirs:
        problems.append(
            f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}"
        )
    return sum(ours.values()), problems


def main(argv: list[str]) -> int:
    from pagesift.registry import ORACLES, QUERIES
    from pagesift.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    plain = "--plain-session" in argv
    names = [a for a in argv[1:] if not a.startswith("--")]
    spark = SparkSession.builder.master("local[8]").getOrCreate() if plain else build_session()
    con, bad = connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                n, problems = compare(spark, con, folder, QUERIES[name], ORACLES[name])
            else:
                n, problems = QUERIES[name](spark, folder).count(), []
        except Exception as error:
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {'' if name in ORACLES else '(no SQL)'}", *[p[:900] for p in problems], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
