"""Run registered queries against their SQL: python tests/compare.py [sf] [name...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(d):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).iterdir():
        src = p if p.is_file() else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def compare(spark, con, d, f, sql):
    df = f(spark, d)
    a = rows_of(df.collect(), df.columns)
    cur = con.execute(sql)
    b = rows_of(cur.fetchall(), [c[0] for c in cur.description])
    return a, b


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidegauge.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    d = f"/root/testdata/{sf}"
    spark, con = local_session(), duck(d)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(qs)
    bad = []
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                (ca, a), (cb, b) = compare(spark, con, d, qs[n], sqls[n])
                ok = ca == cb and a == b
                note = f"{len(a)} rows"
                if not ok:
                    note += f" vs {len(b)}; {ca} {cb}; only spark {sorted(set(a) - set(b), key=repr)[:3]}; only sql {sorted(set(b) - set(a), key=repr)[:3]}"
            else:
                ok, note = True, f"{qs[n](spark, d).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            bad.append(n)
        print("ok  " if ok else "BAD ", n, f"{time.time() - t:.1f}s", note, flush=True)
    print("BAD:", bad)
