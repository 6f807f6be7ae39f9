"""python tests/verify.py SF_DIR [NAME...]: queries beside their SQL in DuckDB; not a pytest module."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

import __spark_entry__ as entry
from corpusloom.session import TABLES, local_session


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else round(float(v), 6) if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v) if not isinstance(v, (int, str)) and not hasattr(v, "dtype") else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(fix, r)) for r in df.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


def main(sf: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert TABLES
    sql, bad = entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = f(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(e)[:400]}")
            continue
        took = time.time() - t
        if name not in sql:
            print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL, distinct {len(got) == len(set(map(str, got.itertuples(index=False))))}")
            continue
        try:
            want = duck.execute(sql[name]).df()
        except duckdb.Error as e:
            bad += 1
            print(f"{name}: SQL FAILED {str(e)[:400]}")
            continue
        same = sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
        bad += not same
        print(f"{name}: {len(got)} rows, {took:.1f} s, {'same' if same else f'DIFFERS from {len(want)} rows; {got.columns.tolist()} {want.columns.tolist()}'}")
        if not same and len(got) == len(want):
            print("   ", [x for x in zip(plain(got), plain(want)) if x[0] != x[1]][:2])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
