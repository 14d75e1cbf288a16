"""Compares a query's rows with its SQL's, column by column, without regard to order."""

from pathlib import Path

import duckdb


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    ours, theirs = query(spark, str(sf_dir)).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
