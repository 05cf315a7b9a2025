"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare the results.

    python tools/compare.py [--sf DIR] [names or name prefixes ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from catalog import ORACLES, QUERIES  # noqa: E402
from sparkprep.session import build_session  # noqa: E402


def type_class(dtype) -> str:
    """Comparable class of an Arrow type."""
    text = str(dtype)
    for name in ("timestamp", "date", "bool", "double", "float", "string", "list"):
        if text.startswith(name) or text.startswith("large_" + name):
            return name
    return text


def canonical(table) -> pd.DataFrame:
    frame = table.to_pandas()
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(list(v)) if hasattr(v, "tolist") and not hasattr(v, "isoformat") and getattr(v, "shape", ()) != () else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text.columns) else text


def compare(spark, con, name: str, folder: str) -> str:
    started = time.time()
    result = QUERIES[name](spark, folder).toArrow()
    seconds = time.time() - started
    if name not in ORACLES:
        return f"rows  {name}: {result.num_rows} rows, no SQL ({seconds:.1f}s)"
    expected = con.sql(ORACLES[name]).arrow()
    expected = expected.read_all() if hasattr(expected, "read_all") else expected
    if sorted(result.column_names) != sorted(expected.column_names):
        return f"FAIL  {name}: columns {sorted(result.column_names)} <> {sorted(expected.column_names)}"
    types = [
        (c, str(result.schema.field(c).type), str(expected.schema.field(c).type))
        for c in result.column_names
        if type_class(result.schema.field(c).type) != type_class(expected.schema.field(c).type)
    ]
    if types:
        return f"FAIL  {name}: types {types}"
    if result.num_rows != expected.num_rows:
        return f"FAIL  {name}: {result.num_rows} rows <> {expected.num_rows}"
    got, want = canonical(result), canonical(expected)
    different = (got != want).any(axis=1) if len(got) else pd.Series(dtype=bool)
    if different.any():
        at = different.idxmax()
        return (
            f"FAIL  {name}: {int(different.sum())} of {len(got)} rows differ\n"
            f"   got  {got.loc[at].to_dict()}\n   want {want.loc[at].to_dict()}"
        )
    return f"ok    {name}: {result.num_rows} rows ({seconds:.1f}s)"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    failures = 0
    for name in names:
        try:
            line = compare(spark, con, name, args.sf)
        except Exception as error:
            line = f"FAIL  {name}: {type(error).__name__}: {str(error)[:600]}"
        failures += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(names)} queries, {failures} failures, {len([n for n in names if n not in ORACLES])} without SQL")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
