"""Comparison of a Spark result with SQL run by DuckDB."""

from pathlib import Path


def oracle(sf_dir):
    """DuckDB with the driver's tables as views."""
    import duckdb

    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def rows(df):
    """Rows as sorted tuples, columns by name."""
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark_df, db, sql):
    names, got = rows(spark_df)
    found = db.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert names == sorted(found.columns)
    near = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    assert [tuple(map(near, r)) for r in got] == [tuple(map(near, r)) for r in want]
