"""Compare queries with their SQL on one data folder.

    python tests/check.py [folder] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple("∅" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
                          for v in row))
    return sorted(rows)


def differences(spark_frame, con, sql) -> str | None:
    mine, theirs = spark_frame.toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    for column in mine.columns:
        if mine[column].isna().any() and mine[column].dtype.kind == "f" and theirs[column].dtype.kind in "iu":
            mine[column] = mine[column].astype("Int64")  # pandas has no NULL among whole numbers otherwise
        a, b = mine[column].dtype.kind, theirs[column].dtype.kind
        if len(mine) and a != b and not {a, b} <= {"O", "U"}:
            return f"type of {column}: {mine[column].dtype} vs {theirs[column].dtype}"
    a, b = canonical(mine), canonical(theirs)
    if a != b:
        only_a, only_b = [r for r in a if r not in b][:3], [r for r in b if r not in a][:3]
        return f"{len(a)} vs {len(b)} rows; e.g. {only_a} / {only_b}"
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from retailstream.session import local_session
    from retailstream.catalog import QUERIES
    from retailstream.oracle import ORACLE_SQL

    spark, con = local_session("8"), connect(folder)
    failed = []
    for name in sys.argv[2:] or QUERIES:
        started = time.time()
        try:
            found = differences(QUERIES[name](spark, folder), con, ORACLE_SQL[name])
            rows = "" if found else f"{QUERIES[name](spark, folder).count()} rows"
        except Exception as e:  # report and go on with the next query
            found, rows = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if found else 'ok':5}{name:28}{time.time() - started:6.2f}s {rows} {found or ''}", flush=True)
        failed += [name] * bool(found)
    print(f"{len(failed)} of {len(sys.argv[2:] or QUERIES)} failed {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
