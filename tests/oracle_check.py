"""Run registered queries against their DuckDB oracle (what the driver does).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from keymerge.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in oracle:
            print(f"rows {name}: {len(srows)} rows ({dt:.1f}s), no oracle")
            continue
        try:
            res = con.execute(oracle[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        a, b = canon(scols, srows), canon(ocols, orows)
        if a == b:
            print(f"ok   {name}: {len(srows)} rows ({dt:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: spark {len(srows)} rows {a[0]} vs oracle {len(orows)} rows {b[0]}")
            sa, sb = set(a[1]), set(b[1])
            print("   spark-only:", sorted(sa - sb)[:3])
            print("   oracle-only:", sorted(sb - sa)[:3])
    print("failures:", bad)


if __name__ == "__main__":
    main()


def type_report(sf="/root/testdata/sf0.001"):
    """Print Spark vs DuckDB column types per query (coarse families)."""
    from keymerge.session import get_session
    import __spark_entry__ as E

    fam = {"bigint": "int64", "int": "int32", "integer": "int32", "double": "float64", "string": "str",
           "varchar": "str", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts", "date": "date",
           "hugeint": "int128", "smallint": "int16", "float": "float32"}
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, fn in E.queries().items():
        sql = E.oracle_sql().get(name)
        if not sql:
            continue
        st = {c: fam.get(t, t) for c, t in fn(spark, sf).dtypes}
        rel = con.sql(sql)
        dt = {c: fam.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            print("TYPES", name, diff)
