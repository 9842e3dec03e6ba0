"""Compare a Spark result with the result of a SQL statement over the same tables."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame):
    """Columns by name, rows in a fixed order, times as text of one precision."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[c]):
            frame[c] = frame[c].astype("datetime64[us]")
        frame[c] = frame[c].map(lambda v: None if pd.isna(v) else v).astype(object)
    rows = [tuple(r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


def differences(spark_df, con, sql):
    columns, got = canonical(spark_df.toPandas())
    names, want = canonical(con.sql(sql).df())
    if columns != names:
        return f"columns {columns} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else None
