"""Run registered queries beside their check SQL and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float", "HUGEINT": "hugeint",
}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark, con, path: str, name: str, fn, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, path)
    cols = sorted(df.columns)
    left = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    kinds = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cur.description}
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = {c: (mine[c], kinds[c]) for c in cols if mine[c] != kinds[c]}
    idx = [names.index(c) for c in cols]
    right = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    if wrong:
        return f"types {wrong}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = sorted(left), sorted(right)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return f"values {[(c, p, r) for c, p, r in zip(cols, x, y) if p != r][:4]} in {x[:3]}"
    return None


def main(path: str, only: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from orgloom.session import local_session

    spark = local_session(cpus=8)
    import logging

    logging.disable(logging.CRITICAL)
    con = connect(path)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1]))
                            or fn.__module__.endswith("plans." + o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                msg, note = compare(spark, con, path, name, fn, sqls[name]), ""
            else:
                df = fn(spark, path)
                note, msg = f"rows only: {len(df.collect())}", None
        except Exception as e:  # noqa: BLE001
            msg, note = f"{type(e).__name__}: {str(e)[:300]}", ""
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - start:.1f}s {msg or note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
