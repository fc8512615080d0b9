"""Compare registered queries with their SQL on a table folder.

Usage: python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from lingotide.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(pdf.columns):
        col = pdf[c]
        if pd.api.types.is_bool_dtype(col):
            out[c] = col.map(str)
        elif pd.api.types.is_numeric_dtype(col):
            out[c] = col.astype("float64").round(9).map(lambda x: "null" if pd.isna(x) else repr(x + 0.0))
        else:
            out[c] = col.map(
                lambda x: "null"
                if x is None or (not hasattr(x, "__len__") and pd.isna(x))
                else (str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x).split(" 00:00:00")[0])
            )
    frame = pd.DataFrame(out)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"row counts differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = (a != b).any(axis=1)
    if bad.any():
        first = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first: {a.loc[first].to_dict()} vs {b.loc[first].to_dict()}"
    return ""


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    names = [a for a in args if not a.startswith("/")]
    from __spark_entry__ import oracle_sql, queries

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(name == n or name.startswith(n + "_") for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                problem = compare(got, con.execute(oracles[name]).df())
                verdict = f"MISMATCH {problem}" if problem else f"ok (sql {time.time() - start:.2f}s)"
            else:
                verdict = "rows only"
        except Exception as e:  # noqa: BLE001
            took, verdict = time.time() - start, f"ERROR {type(e).__name__}: {str(e)[:600]}"
            got = pd.DataFrame()
        failed += verdict.startswith(("MISMATCH", "ERROR"))
        print(f"{name}: {len(got)} rows {took:.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
