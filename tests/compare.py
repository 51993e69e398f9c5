"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


# how DuckDB's type names read in Spark
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "HUGEINT": "decimal(38,0)", "FLOAT": "float", "SMALLINT": "smallint", "TIMESTAMP": "timestamp_ntz",
}


def type_differences(df, relation) -> list[str]:
    """Columns whose type differs; nested types are left to the comparison of values."""
    mine = dict(df.dtypes)
    theirs = {n: TYPES.get(str(t), "") for n, t in zip(relation.columns, relation.types)}
    return [f"{n}: {mine[n]} != {t}" for n, t in theirs.items() if t and n in mine and mine[n] != t]


def differences(spark, db, sf_dir: str, name: str) -> list[str]:
    """Why a query and its SQL disagree; empty when they agree."""
    df = contract.queries()[name](spark, sf_dir)
    cursor = db.sql(contract.oracle_sql()[name])
    names = cursor.columns
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if wrong := type_differences(df, cursor):
        return wrong
    mine = rows_of(df.columns, df.collect())
    theirs = rows_of(names, cursor.fetchall())
    if len(mine) != len(theirs):
        only = sorted(set(mine) ^ set(theirs), key=str)[:4]
        return [f"{len(mine)} rows != {len(theirs)}", f"e.g. {only}"]
    return [f"{a} != {b}" for a, b in zip(mine, theirs) if a != b][:3]


if __name__ == "__main__":
    from shelfmark.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    db = duck(sf_dir)
    for name in sys.argv[2:] or list(contract.oracle_sql()):
        start = time.time()
        try:
            found = differences(session, db, sf_dir, name)
        except Exception as error:  # report and go on
            found = [f"error {str(error)[:500]}"]
        print(f"{name:24s} {time.time() - start:6.2f}s {'ok' if not found else found}", flush=True)
