"""Compares a query with its SQL on the provided tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v.item() if hasattr(v, "item") else v

    columns = sorted(df.columns)
    return sorted((tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None. Column types must agree in kind, too."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and not {a, b} <= set("OSU") and len(got) and not got[c].isna().any() and not want[c].isna().any():
            return f"type of {c}: {got[c].dtype} and {want[c].dtype}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
