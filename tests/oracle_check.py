"""Runs registered queries and their DuckDB SQL side by side.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from factlake.fixtures import TABLES  # noqa: E402
from factlake.plans.oracles import ORACLES  # noqa: E402
from factlake.plans.queries import QUERIES  # noqa: E402


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _bag(names: list[str], rows) -> collections.Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(str(_plain(row[i])) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """NULL if the results are equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = _bag(df.columns, df.collect())
    result = con.sql(ORACLES[name].replace("/root/testdata/sf0.01", sf_dir))
    want = _bag(list(result.columns), result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} and {sorted(result.columns)}"
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"{sum(got.values())} rows and {sum(want.values())}; only here {sum(extra.values())}: "
            f"{list(extra)[:2]}; only there: {list(lacking)[:2]}"
        )
    if not got:
        return "no rows"
    return None


def main() -> int:
    from factlake.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in QUERIES if n in ORACLES]
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal; without SQL: {sorted(set(QUERIES) - set(ORACLES))}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
