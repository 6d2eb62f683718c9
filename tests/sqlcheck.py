"""Compare a query with its SQL on a data folder."""

import math
from collections import Counter
from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def connection(folder=FOLDER):
    import duckdb

    found = duckdb.connect()
    found.execute("set timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        found.execute(f"create view {path.stem} as select * from '{path}'")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (float,)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def differences(spark, query, sql, database, folder=FOLDER):
    """Rows of only one side, or the columns if they differ."""
    df = query(spark, str(folder))
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = database.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return columns, sorted(names)
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[k]) for k in at) for row in result.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
