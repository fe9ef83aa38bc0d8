"""Compares a registered query with its SQL."""

from pathlib import Path

import duckdb


def differences(spark, folder, query, sql):
    """(rows that only the query has, rows that only the SQL has, number of rows)."""
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    want = db.sql(sql)
    columns = sorted(want.columns)
    got = query(spark, str(folder))
    assert sorted(got.columns) == columns
    listed = lambda rows: sorted(str(tuple(r)) for r in rows)
    have = listed(got.select(*[f"`{c}`" for c in columns]).collect())
    wanted = listed(want.select(*[f'"{c}"' for c in columns]).fetchall())
    return [x for x in have if x not in set(wanted)], [x for x in wanted if x not in set(have)], (len(have), len(wanted))
