"""Runs a registered query and its SQL, and says where they differ."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lotwise.plans.relations import TABLES  # noqa: E402


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE",
}


def differences(spark, build, sql: str, sf_dir: str, connection=None) -> str:
    """Empty when names, types and rows agree."""
    frame = build(spark, sf_dir)
    names = sorted(frame.columns)
    rows = Counter(tuple(cell(r[n]) for n in names) for r in frame.select(*names).collect())
    answer = (connection or database(sf_dir)).sql(sql)
    if sorted(answer.columns) != names:
        return f"columns {names} against {sorted(answer.columns)}"
    kinds = dict(zip(answer.columns, (str(t) for t in answer.types)))
    ours = dict(frame.dtypes)
    odd = [f"{n}: {ours[n]} / {kinds[n]}" for n in names if KINDS.get(ours[n], ours[n]) != kinds[n]]
    order = [answer.columns.index(n) for n in names]
    wanted = Counter(tuple(cell(r[i]) for i in order) for r in answer.fetchall())
    notes = []
    if rows != wanted:
        extra, missing = rows - wanted, wanted - rows
        notes.append(
            f"{sum(rows.values())} rows against {sum(wanted.values())}; {names}; "
            f"only ours {list(extra)[:4]}; only SQL {list(missing)[:4]}"
        )
    if odd:
        notes.append("types " + ", ".join(odd))
    if not rows:
        notes.append("no rows")
    return "; ".join(notes)


def main() -> None:
    import importlib
    import time

    from lotwise.session import local_session

    entry = importlib.import_module("__spark_entry__")
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    connection = database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            if name in oracles:
                note = differences(spark, build, oracles[name], sf_dir, connection)
            else:
                note = f"(no SQL, {build(spark, sf_dir).count()} rows)"
        except Exception as error:  # report and go on
            note = f"{type(error).__name__}: {str(error)[:700]}"
        good = not note or note.startswith("(")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
