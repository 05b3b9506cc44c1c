"""Run catalogue queries and compare them with their check SQL in DuckDB: schema, row count, exact values.

usage: check_catalog.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from plumbline.plans.catalog import load  # noqa: E402
from plumbline.session import get_session  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT"}


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql):
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    ours = sorted([tuple(r) for r in df.select(*cols).collect()], key=key)
    theirs_rel = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})")
    names = [x[0] for x in con.execute(f"describe {sql}").fetchall()]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}", len(ours)
    duck_types = {x[0]: x[1] for x in con.execute(f"describe {sql}").fetchall()}
    theirs_rel = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})")
    theirs = sorted([tuple(r) for r in theirs_rel.fetchall()], key=key)
    bad_types = {c: (types[c], duck_types[c]) for c in cols if SPARK_TO_DUCK.get(types[c]) != duck_types[c]}
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)} types {bad_types}", len(ours)
    diff = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if diff:
        return f"{len(diff)} rows differ; {cols} e.g. {diff[0]} types {bad_types}", len(ours)
    return (f"types {bad_types}" if bad_types else ""), len(ours)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    bad = 0
    for name, q in load().items():
        if args and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) or a in q.run.__module__.split(".") for a in args):
            continue
        t = time.time()
        try:
            df = q.run(spark, folder)
            problem, n = compare(df, con, q.sql) if q.sql else ("", df.count())
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__} {str(e)[:600]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} {n:7d} rows {time.time() - t:6.2f}s {'' if q.sql else '(rows only)'} {problem}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
