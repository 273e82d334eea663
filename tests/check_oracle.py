"""Run registered queries beside their SQL: ``python tests/check_oracle.py [sf] [prefix ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from pagescale.session import local_session  # noqa: E402

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple("~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else
                  (format(v, ".9g") if isinstance(v, float) else str(v)) for v in r)
            for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows)


def duck(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def main(sf="0.001", *prefixes):
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    con = duck(sf_dir)
    qs, sqls = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.toPandas()
            t1 = time.time()
            note = ""
            if name in sqls:
                rel = con.sql(sqls[name])
                want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
                want = rel.df()
                mine = {n: TYPES.get(t, t) for n, t in df.dtypes}
                if mine != want_types:
                    note = f"TYPES {mine} != {want_types}"
                    bad.append(name)
                g, w = canon(got), canon(want)
                if g != w:
                    bad.append(name)
                    gs, ws = set(g), set(w)
                    note += f" DIFF {len(g)} vs {len(w)}; only spark {sorted(gs - ws)[:3]}; only sql {sorted(ws - gs)[:3]}"
                elif not g:
                    note += " EMPTY"
            else:
                note = "no sql"
            print(f"{name:34s} {len(got):9d} rows spark {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {note}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name:34s} ERROR {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("FAILED", sorted(set(bad)) if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
