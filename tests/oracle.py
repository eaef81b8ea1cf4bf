"""Run registered queries against their SQL on DuckDB.

``python tests/oracle.py SF_DIR [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", f"{v + 0.0:.6g}" if abs(v) >= 1e9 else f"{round(v, 6) + 0.0:.6f}")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if v is None:
        return None
    return (type(v).__name__, v)


def _near(left: Counter, right: Counter) -> bool:
    """Rows differ in the last rounded digit of a float at most (the engines round ties apart)."""
    if sum(left.values()) != sum(right.values()):
        return False

    def parts(row):
        exact = tuple(str(v) for v in row if not (v and v[0] == "f"))
        return exact, [float(v[1]) for v in row if v and v[0] == "f"]

    pairs = zip(sorted(map(parts, left.elements())), sorted(map(parts, right.elements())))
    return all(
        a[0] == b[0] and len(a[1]) == len(b[1])
        and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a[1], b[1]))
        for a, b in pairs
    )


def compare(df, con, sql: str, exact: bool = True) -> str | None:
    """None when both sides hold the same rows, else what differs.

    ``exact=False`` lets floats differ in their last rounded digit.
    """
    return compare_rows(*collected(df), con, sql, exact)


def collected(df) -> tuple[list[str], list]:
    """Column names in order and the rows."""
    cols = sorted(df.columns)
    return cols, df.select(*[f"`{c}`" for c in cols]).collect()


def compare_rows(cols: list[str], rows: list, con, sql: str, exact: bool = True) -> str | None:
    left = Counter(tuple(_norm(v) for v in row) for row in rows)
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    right = Counter(tuple(_norm(row[i]) for i in idx) for row in rel.fetchall())
    if left == right:
        return None
    only_l, only_r = left - right, right - left
    if not exact and _near(only_l, only_r):
        return None
    return (
        f"rows {sum(left.values())} vs {sum(right.values())}; only spark {sum(only_l.values())}, "
        f"only sql {sum(only_r.values())}\n  cols  {cols}\n  spark {list(only_l)[:2]}\n  sql   {list(only_r)[:2]}"
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tracemill.session import local_session

    spark = local_session()
    sf_dir, wanted = argv[0], argv[1:]
    con = duck(sf_dir)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                diff = compare(fn(spark, sf_dir), con, sqls[name])
                mark = "ok  " if diff is None else "FAIL"
            else:
                diff, mark = None, f"rows {fn(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            diff, mark = f"{type(exc).__name__}: {str(exc)[:1500]}", "ERR "
        bad += diff is not None
        print(f"{mark} {name} {time.time() - t:.1f}s" + (f" {diff}" if diff else ""), flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
