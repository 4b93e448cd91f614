"""Run registered queries against their SQL twins on DuckDB; also usable from the shell.

    python tests/compare.py [sf0.01] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ROOT = pathlib.Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, float):
        return v + 0.0
    return v


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when both sides agree, otherwise a short description of the difference."""
    got = fn(spark, sf_dir)
    a = _rows([tuple(r) for r in got.collect()], got.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = _rows(cur.fetchall(), names)
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            bad = sum(p != q for p, q in zip(a, b))
            return f"{sorted(names)}: {bad} rows differ, first {x} != {y}"
    return None


def main(argv):
    from spectraloom.plans.session import local_session
    import __spark_entry__ as entry

    sf = ROOT / (argv[0] if argv else "sf0.01")
    names = argv[1:]
    spark = local_session()
    con = connect(str(sf))
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(spark, con, name, fn, oracles[name], str(sf))
            else:
                n = len(fn(spark, str(sf)).collect())
                msg = None if n else "no rows"
        except Exception as e:  # report and go on to the next query
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if name in oracles else "rows"
        if msg:
            bad += 1
        print(f"{'FAIL' if msg else 'ok  '} {kind} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
