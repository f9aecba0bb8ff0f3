"""Run the named queries next to their SQL in DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from tidemark.plans.inputs import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None when names and rows agree, else what differs."""
    got = df.collect()
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    mine, theirs = _rows(df.columns, got), _rows(names, relation.fetchall())
    if mine == theirs:
        return None
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} against {len(theirs)} rows; {sorted(names)}; only here {only_mine}; only there {only_theirs}"


if __name__ == "__main__":
    from tests.conftest import new_session

    import __spark_entry__ as entry

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con, bad = new_session(), connect(sf_dir), 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen or name not in entry.oracle_sql():
            continue
        start = time.time()
        try:
            found = compare(run(spark, sf_dir), con, entry.oracle_sql()[name])
        except Exception as e:
            found = "".join(traceback.format_exception_only(e))[:1500]
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print("bad:", bad)
