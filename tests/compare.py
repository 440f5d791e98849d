"""Runs registered queries beside their SQL in DuckDB and compares names, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_by_name(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, folder: str, query, sql: str | None) -> dict:
    started = time.time()
    frame = query(spark, folder)
    found = frame.collect()
    seconds = time.time() - started
    plan = frame._jdf.queryExecution().executedPlan().toString()
    result = {"rows": len(found), "seconds": round(seconds, 2), "ok": True, "problem": ""}
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return {**result, "ok": False, "problem": "the plan joins without a key"}
    if sql is None:
        return result
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    expected = relation.fetchall()
    if sorted(names) != sorted(frame.columns):
        return {**result, "ok": False, "problem": f"columns {sorted(frame.columns)} but {sorted(names)}"}
    mine, theirs = rows_by_name(frame.columns, found), rows_by_name(names, expected)
    kinds = {d[0]: str(d[1]) for d in relation.description}
    loose = {"bigint": "int", "int": "int"}
    for name, kind in frame.dtypes:
        other = kinds[name].upper()
        if kind in loose and ("DOUBLE" in other or "DECIMAL" in other or "HUGE" in other):
            result["problem"] += f" type {name}: {kind}/{other}"
        if kind == "int" and "BIGINT" in other or kind == "bigint" and other == "INTEGER":
            result["problem"] += f" type {name}: {kind}/{other}"
        if kind == "double" and "DECIMAL" in other:
            result["problem"] += f" type {name}: {kind}/{other}"
    if mine != theirs:
        lost = [r for r in theirs if r not in mine][:3]
        extra = [r for r in mine if r not in theirs][:3]
        text = f"{len(mine)} rows but {len(theirs)}; only here {extra}; only there {lost}"
        return {**result, "ok": False, "problem": text[:1500]}
    return result


def main() -> None:
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from tallyfold.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, connection = local_session(), database(folder)
    registered, checks = queries(), oracle_sql()
    bad = 0
    for name, query in registered.items():
        if chosen and not any(c in name for c in chosen):
            continue
        try:
            result = compare(spark, connection, folder, query, checks.get(name))
        except Exception as error:  # noqa: BLE001
            result = {"rows": -1, "seconds": 0, "ok": False, "problem": f"{type(error).__name__}: {str(error)[:900]}"}
        bad += not result["ok"]
        mark = "ok  " if result["ok"] else "BAD "
        kind = "sql" if name in checks else "---"
        print(f"{mark}{kind} {name:34s} {result['rows']:7d} rows {result['seconds']:6.2f}s {result['problem']}", flush=True)
    print(f"{bad} bad of {len(registered)}")


if __name__ == "__main__":
    main()
