"""Cleaning steps, outliers, scan and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.base import DAMAGED_SQL, Registry, damaged_orders, rounded, table
from tallyfold.operators import clean, outliers, profile, roles, scan, validate
from tallyfold.plans.ordering import POSITION, with_position
from tallyfold.plans.scale import DEFAULT, Scale, row_count

REG = Registry()

D = f"t AS ({DAMAGED_SQL})"
TOKENS = "('', 'na', 'n/a', 'nan', 'null', 'none', '-', '--', '?')"


def norm(column: str) -> str:
    return f"regexp_replace(lower(trim({column})), '\\s+', ' ', 'g')"


def untokened(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN {TOKENS} THEN NULL ELSE {column} END"


@REG.add("clean_text", f"WITH {D} SELECT row_id, {norm('status')} AS status, {norm('priority')} AS priority FROM t")
def clean_text(spark, folder):
    return clean.clean_text(damaged_orders(spark, folder), standardize=True).select("row_id", "status", "priority")


@REG.add(
    "missing_tokens",
    f"""WITH {D}, c AS (SELECT 'status' AS "column", count(*) AS tokens FROM t WHERE lower(trim(status)) IN {TOKENS}
        UNION ALL SELECT 'priority', count(*) FROM t WHERE lower(trim(priority)) IN {TOKENS}) SELECT * FROM c WHERE tokens > 0""",
)
def missing_tokens(spark, folder):
    return clean.token_counts(damaged_orders(spark, folder))


@REG.add("null_tokens", f"WITH {D} SELECT row_id, {untokened('status')} AS status FROM t")
def null_tokens(spark, folder):
    rules = {"status": {"missing_tokens": [None]}}
    return clean.null_tokens(damaged_orders(spark, folder), rules).select("row_id", "status")


NUMBER_TEXTS = {
    "row_id": "o_orderkey",
    "a": (
        "CASE WHEN o_orderkey % 5 = 0 THEN '12d' WHEN o_orderkey % 5 = 1 THEN concat(' ', CAST(o_custkey AS STRING), ' ') "
        "ELSE CAST(o_custkey AS STRING) END"
    ),
    "b": "CASE WHEN o_orderkey % 4 = 0 THEN '1,5' ELSE CAST(o_custkey AS STRING) END",
}


def _expressions(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


@REG.add(
    "fix_types_numeric",
    f"""WITH t AS (SELECT {", ".join(_expressions(NUMBER_TEXTS))} FROM orders)
        SELECT row_id, CASE WHEN a = '12d' THEN NULL ELSE CAST(trim(a) AS DOUBLE) END AS a, b FROM t""",
)
def fix_types_numeric(spark, folder):
    texts = table(spark, folder, "orders").selectExpr(*_expressions(NUMBER_TEXTS))
    return clean.apply_types(texts, clean.fit_types(texts))


_Y, _M, _DAY = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"  # noqa: E501
DATE_TEXTS = {
    "row_id": "o_orderkey",
    "iso": f"concat({_Y}, '-', {_M}, '-', {_DAY})",
    "unclear": f"concat({_DAY}, '/', {_M}, '/', {_Y})",
    "sparse": f"CASE WHEN o_orderkey % 10 < 3 THEN concat({_Y}, '-', {_M}, '-', {_DAY}) ELSE concat('order ', CAST(o_orderkey AS STRING)) END",
}


@REG.add(
    "fix_types_dates",
    f"""WITH t AS (SELECT {", ".join(_expressions(DATE_TEXTS))} FROM orders)
        SELECT row_id, CAST(iso AS TIMESTAMP) AS iso, unclear, CASE WHEN row_id % 10 < 3 THEN CAST(sparse AS TIMESTAMP) END AS sparse FROM t""",
)
def fix_types_dates(spark, folder):
    texts = table(spark, folder, "orders").selectExpr(*_expressions(DATE_TEXTS))
    return clean.apply_types(texts, clean.fit_types(texts))


# Forms in which programs export dates; those that leave day and month open keep only days that cannot be months.
_DAY = "o_orderdate"
EXPORTED = {
    "zoned": (f"concat(date_format({_DAY}, 'yyyy-MM-dd'), 'T05:06:07+02:00')", "+ INTERVAL '3 hours 6 minutes 7 seconds'"),
    "bare_zone": (f"concat(date_format({_DAY}, 'yyyy-MM-dd'), ' 05:06:07 -0130')", "+ INTERVAL '6 hours 36 minutes 7 seconds'"),
    "universal": (f"concat(date_format({_DAY}, 'yyyy-MM-dd'), 'T05:06:07.25Z')", "+ INTERVAL '5 hours 6 minutes 7.25 seconds'"),
    "half_day": (f"concat(date_format({_DAY}, 'yyyy-MM-dd'), ' 03:04:05 PM')", "+ INTERVAL '15 hours 4 minutes 5 seconds'"),
    "named_month": (f"date_format({_DAY}, 'dd-MMM-yyyy')", ""),
    "compact": (f"concat(date_format({_DAY}, 'yyyyMMdd'), 'T050607')", "+ INTERVAL '5 hours 6 minutes 7 seconds'"),
    "nanoseconds": (f"concat(date_format({_DAY}, 'yyyy-MM-dd'), ' 05:06:07.123456789')", "+ INTERVAL '5 hours 6 minutes 7.123456 seconds'"),
    "month": (f"date_format({_DAY}, 'yyyy-MM')", None),
    "short_year": (f"CASE WHEN day({_DAY}) > 12 THEN date_format({_DAY}, 'M/d/yy') END", ""),
    "us_time": (f"CASE WHEN day({_DAY}) > 12 THEN concat(date_format({_DAY}, 'MM/dd/yyyy'), ' 3:04 AM') END", "+ INTERVAL '3 hours 4 minutes'"),
}


def _exported_sql(name: str, shift: str | None) -> str:
    base = "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)" if shift is None else f"CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) {shift}"
    return f"CASE WHEN day(o_orderdate) > 12 THEN {base} END AS {name}" if name in ("short_year", "us_time") else f"{base} AS {name}"


@REG.add("fix_types_dates_zoned", f"SELECT o_orderkey, {', '.join(_exported_sql(n, x) for n, (_, x) in EXPORTED.items())} FROM orders")
def fix_types_dates_zoned(spark, folder):
    texts = table(spark, folder, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, (e, _) in EXPORTED.items()])
    return clean.apply_types(texts, clean.fit_types(texts))


@REG.add(
    "missing_drop",
    f"WITH {D} SELECT row_id, status, amount, priority FROM t WHERE status IS NOT NULL AND amount IS NOT NULL AND priority IS NOT NULL",
)
def missing_drop(spark, folder):
    return clean.drop_missing(damaged_orders(spark, folder)).select("row_id", "status", "amount", "priority")


@REG.add("missing_drop_subset", f"WITH {D} SELECT row_id, status, amount FROM t WHERE amount IS NOT NULL")
def missing_drop_subset(spark, folder):
    return clean.drop_missing(damaged_orders(spark, folder), ["amount"]).select("row_id", "status", "amount")


def _mode(column: str, source: str = "t") -> str:
    return f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@REG.add(
    "missing_fill",
    f"""WITH {D} SELECT row_id, coalesce(status, {_mode("status")}) AS status, coalesce(priority, {_mode("priority")}) AS priority,
        round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM t)), 4) AS amount FROM t""",
)
def missing_fill(spark, folder):
    out = clean.fill_missing(damaged_orders(spark, folder))
    return rounded(out.select("row_id", "status", "priority", "amount"), amount=4)


@REG.add(
    "fill_values",
    f"""WITH {D} SELECT 'mean' AS strategy, 'amount' AS "column", CAST(round(avg(amount), 2) AS VARCHAR) AS value FROM t
        UNION ALL SELECT 'median', 'amount', CAST(round(quantile_cont(amount, 0.5), 2) AS VARCHAR) FROM t
        UNION ALL SELECT 'mode', 'amount', CAST({_mode("amount")} AS VARCHAR)
        UNION ALL SELECT 'mode', 'priority', {_mode("priority")}
        UNION ALL SELECT 'constant', 'amount', '0.0' UNION ALL SELECT 'constant', 'priority', 'Unknown'""",
)
def fill_values(spark, folder):
    orders = damaged_orders(spark, folder).select("amount", "priority")
    rows = []
    for how, columns in (("mean", ["amount"]), ("median", ["amount"]), ("mode", ["amount", "priority"]), ("constant", ["amount", "priority"])):
        for c, v in clean.fit_fill(orders, how, columns=columns).items():
            rows.append((how, c, str(round(v, 2)) if isinstance(v, float) else v))
    return spark.createDataFrame(rows, "strategy string, column string, value string")


TICKETS = {
    "ticket_id": "CASE WHEN o_orderkey % 100 = 5 THEN NULL ELSE o_orderkey END",
    "amount": "CASE WHEN o_orderkey % 50 = 9 THEN NULL ELSE o_totalprice END",
}


@REG.add(
    "missing_identifier_drop",
    f"""WITH t AS (SELECT {", ".join(_expressions(TICKETS))} FROM orders), k AS (SELECT * FROM t WHERE ticket_id IS NOT NULL)
        SELECT ticket_id, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM k)), 4) AS amount FROM k""",
)
def missing_identifier_drop(spark, folder):
    tickets = table(spark, folder, "orders").selectExpr(*_expressions(TICKETS))
    rules = clean.identifier_rules(tickets)
    return rounded(clean.fill_missing(tickets, column_rules=rules), amount=4)


GAPPED = "SELECT event_id, user_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events"  # noqa: E501


INTERPOLATED = (
    f"""WITH t AS ({GAPPED}), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM t),
        w AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
          first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np,
          last_value(event_type IGNORE NULLS) OVER b AS pe, first_value(event_type IGNORE NULLS) OVER a AS ne FROM p
          WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, user_id, round(coalesce(value, pv + (nv - pv) * (pos - pp) / (np - pp), pv, nv), 6) AS value,
          coalesce(event_type, pe, ne) AS event_type FROM w"""
)


@REG.add("interpolate_events", INTERPOLATED)
def interpolate_events(spark, folder):
    return _interpolated(spark, folder, DEFAULT)


@REG.add("interpolate_events_chunks", INTERPOLATED)
def interpolate_events_chunks(spark, folder):
    # Chunks of so few rows that any table has many: the plan that large tables get.
    return _interpolated(spark, folder, Scale(chunk_rows=250))


def _interpolated(spark, folder, scale):
    gapped = table(spark, folder, "events").selectExpr(
        "event_id", "user_id",
        "CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type",
    )
    return rounded(clean.interpolate(gapped, ["event_id"], ["user_id"], scale=scale), value=6)


@REG.add(
    "text_positions_chunks",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS position FROM customer",
)
def text_positions_chunks(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    placed = with_position(customers, ["c_name", "c_custkey"], row_count(customers), scale=Scale(chunk_rows=100))
    return placed.select("c_custkey", F.col(POSITION).alias("position"))


KEY = ["customer", "status", "amount", "priority", "placed"]
NORM_KEY = f"customer, {norm('status')}, amount, {norm('priority')}, placed"
FILLED = "(CASE WHEN status IS NULL THEN 0 ELSE 1 END + CASE WHEN amount IS NULL THEN 0 ELSE 1 END + CASE WHEN priority IS NULL THEN 0 ELSE 1 END)"


@REG.add(
    "dedup_best",
    f"""WITH {D}, k AS (SELECT *, row_number() OVER (PARTITION BY {NORM_KEY} ORDER BY {FILLED} DESC, row_id) AS rn FROM t)
        SELECT row_id, customer, status, amount, priority FROM k WHERE rn = 1""",
)
def dedup_best(spark, folder):
    out = clean.remove_duplicates(damaged_orders(spark, folder), ["row_id"], KEY)
    return out.select("row_id", "customer", "status", "amount", "priority")


@REG.add(
    "dedup_last",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       SELECT event_id, user_id, event_type, value FROM k WHERE rn = 1""",
)
def dedup_last(spark, folder):
    out = clean.remove_duplicates(table(spark, folder, "events"), ["ts", "event_id"], ["user_id", "event_type"], "last")
    return out.select("event_id", "user_id", "event_type", "value")


@REG.add(
    "duplicate_count",
    f"WITH {D} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM t GROUP BY customer, status, amount, priority, placed)",
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(damaged_orders(spark, folder), KEY)


@REG.add("standardize_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS o_orderdate FROM orders")
def standardize_dates(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return clean.standardize_dates(orders, "%d/%m/%Y %H:%M")


def _iqr(column: str, t: float, source: str, extra: str = "") -> str:
    return (
        f"SELECT quantile_cont({column}, 0.25) - {t} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS lo, "
        f"quantile_cont({column}, 0.75) + {t} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS hi FROM {source} {extra}"
    )


def _log_iqr(column: str, t: float, source: str) -> str:
    inner = _iqr("v", t, f"(SELECT ln(1 + {column}) AS v FROM {source})")
    return f"SELECT exp(lo) - 1 AS lo, exp(hi) - 1 AS hi FROM ({inner})"


@REG.add(
    "clean_orders",
    f"""WITH {D}, a AS (SELECT row_id, customer, {untokened("trim(status)")} AS status, amount, trim(priority) AS priority, placed FROM t),
        b AS ({_log_iqr("customer", 1.5, "a")}),
        f AS (SELECT a.*, customer < lo OR customer > hi AS customer_outlier, coalesce(amount < 0, false) AS amount_outlier FROM a, b),
        g AS (SELECT row_id, customer, coalesce(status, {_mode("status", "a")}) AS status,
          coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM f WHERE NOT amount_outlier)) AS amount,
          coalesce(priority, {_mode("priority", "a")}) AS priority, placed, customer_outlier, amount_outlier FROM f),
        k AS (SELECT *, row_number() OVER (PARTITION BY {NORM_KEY} ORDER BY row_id) AS rn FROM g)
        SELECT row_id, customer, status, round(amount, 4) AS amount, priority, strftime(placed, '%Y-%m-%d') AS placed,
          customer_outlier, amount_outlier FROM k WHERE rn = 1""",
)
def clean_orders(spark, folder):
    settings = clean.Profile(duplicate_subset=KEY, standardize_dates=True, target_date_format="%Y-%m-%d")
    cleaned, _ = clean.clean(damaged_orders(spark, folder), settings, ["row_id"])
    return rounded(cleaned, amount=4)


@REG.add(
    "apply_outlier_cap",
    f"""WITH {D}, b AS ({_iqr("amount", 1.5, "t")}) SELECT row_id, round(CASE WHEN amount < greatest(lo, 0) THEN greatest(lo, 0)
        WHEN amount > hi THEN hi ELSE amount END, 4) AS amount FROM t, b""",
)
def apply_outlier_cap(spark, folder):
    orders = damaged_orders(spark, folder).select("row_id", "amount")
    bounds = outliers.fit(orders, "iqr", 1.5, ["amount"])
    return rounded(outliers.apply_bounds(orders, bounds, "cap"), amount=4)


@REG.add(
    "apply_outlier_remove",
    f"""WITH {D}, b AS ({_iqr("amount", 1.5, "t")}) SELECT row_id, amount FROM t, b
        WHERE NOT (row_id % 3 = 0 AND coalesce(amount < greatest(lo, 0) OR amount > hi, false))""",
)
def apply_outlier_remove(spark, folder):
    orders = damaged_orders(spark, folder).select("row_id", "amount")
    bounds = outliers.fit(orders, "iqr", 1.5, ["amount"])
    selected = orders.filter("row_id % 3 = 0").select("row_id")
    return outliers.apply_bounds(orders, bounds, "remove", selected=selected, key=["row_id"])


def _cells(spark, folder, method: str, threshold: float = 1.5, column: str = "value"):
    """Flagged event values with their learned bounds."""
    events = table(spark, folder, "events")
    bounds = outliers.fit(events, method, threshold, [column])
    cells = outliers.outlier_cells(events, bounds, ["event_id"])
    return cells.select("event_id", "value", "lower_bound", "upper_bound")


@REG.add(
    "outlier_iqr",
    f"""WITH b AS ({_iqr("value", 1.5, "events")}) SELECT event_id, value, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
        FROM events, b WHERE value < lo OR value > hi""",
)
def outlier_iqr(spark, folder):
    return rounded(_cells(spark, folder, "iqr"), lower_bound=4, upper_bound=4)


@REG.add(
    "outlier_log_iqr",
    f"""WITH b AS ({_log_iqr("value", 1.5, "events")}) SELECT event_id, value, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
        FROM events, b WHERE value < lo OR value > hi""",
)
def outlier_log_iqr(spark, folder):
    return rounded(_cells(spark, folder, "log_iqr"), lower_bound=4, upper_bound=4)


@REG.add(
    "outlier_mad",
    """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m)
       SELECT event_id, value, round(med - 4.0 * mad / 0.6745, 4) AS lower_bound, round(med + 4.0 * mad / 0.6745, 4) AS upper_bound
       FROM events, m, d WHERE mad <> 0 AND 0.6745 * abs(value - med) / mad > 4.0""",
)
def outlier_mad(spark, folder):
    return rounded(_cells(spark, folder, "mad", 4.0), lower_bound=4, upper_bound=4)


@REG.add(
    "outlier_zscore",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
       SELECT event_id, value FROM events, s WHERE abs((value - m) / d) > 3.0""",
)
def outlier_zscore(spark, folder):
    return _cells(spark, folder, "zscore", 3.0).select("event_id", "value")


@REG.add("outlier_isolation_forest")
def outlier_isolation_forest(spark, folder):
    return _cells(spark, folder, "isolation_forest").select("event_id", "value")


LOF = """WITH p AS (SELECT value AS x, row_number() OVER (ORDER BY value, event_id) AS i FROM events WHERE value IS NOT NULL),
  g AS (SELECT a.i, b.i AS j, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x), b.i) AS r
        FROM p a JOIN p b ON b.i BETWEEN a.i - 20 AND a.i + 20 AND b.i <> a.i),
  n AS (SELECT * FROM g WHERE r <= 20), k AS (SELECT i, max(d) AS kd FROM n GROUP BY 1),
  l AS (SELECT n.i, 1 / (avg(greatest(n.d, k.kd)) + 1e-10) AS lrd FROM n JOIN k ON k.i = n.j GROUP BY 1),
  f AS (SELECT n.i, avg(o.lrd) / max(s.lrd) AS lof FROM n JOIN l o ON o.i = n.j JOIN l s ON s.i = n.i GROUP BY 1),
  v AS (SELECT p.x FROM f JOIN p ON p.i = f.i GROUP BY 1 HAVING avg(lof) > 1.5)
  SELECT event_id, value FROM events WHERE value IN (SELECT x FROM v)"""


@REG.add("outlier_lof", LOF)
def outlier_lof(spark, folder):
    return _cells(spark, folder, "lof").select("event_id", "value")


@REG.add(
    "outlier_domain",
    f"""WITH {D} SELECT 'amount' AS "column", 'money' AS role, 'skip' AS method, count(*) AS outliers, count(*) AS critical FROM t WHERE amount < 0""",
)
def outlier_domain(spark, folder):
    """Negative amounts forbid the log method, so only the domain rule of the role is left."""
    orders = damaged_orders(spark, folder)
    return outliers.outlier_counts(orders, outliers.fit(orders, "auto", 1.5, ["amount"]))


@REG.add(
    "outlier_method_auto",
    f"""WITH {D}, s AS (SELECT 'o_custkey' AS c, count(*) AS n, count(DISTINCT o_custkey) AS d, skewness(o_custkey) AS k, 1.0 AS i, 1.0 AS nn FROM orders
          UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), skewness(user_id), 1.0, 1.0 FROM events
          UNION ALL SELECT 'value', count(*), count(DISTINCT value), skewness(value), 0.0, avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0.0 END) FROM events
          UNION ALL SELECT 'c_acctbal', count(*), count(DISTINCT c_acctbal), skewness(c_acctbal), 0.0, avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END) FROM customer)
        SELECT c AS "column", CASE WHEN n < 8 OR d <= 2 THEN 'skip' WHEN 0.45 * i + 0.35 * nn + 0.2 * (1 - d / n) >= 0.75 AND d / n <= 0.7 THEN 'log_iqr'
          WHEN nn = 1 AND k > 1 THEN 'log_iqr' ELSE 'mad' END AS method FROM s""",
)
def outlier_method_auto(spark, folder):
    rows = []
    for name, columns in (("orders", ["o_custkey"]), ("events", ["user_id", "value"]), ("customer", ["c_acctbal"])):
        facts = roles.column_facts(table(spark, folder, name), columns=columns)
        rows += [(f.column, outliers.auto_method(f)) for f in facts]
    return spark.createDataFrame(rows, "column string, method string")


@REG.add(
    "outlier_flag",
    f"""WITH b AS ({_log_iqr("value", 1.5, "events")}), u AS ({_log_iqr("user_id", 1.5, "events")})
        SELECT event_id, (value < b.lo OR value > b.hi) AS value_outlier, (user_id < u.lo OR user_id > u.hi) AS user_id_outlier FROM events, b, u""",
)
def outlier_flag(spark, folder):
    events = table(spark, folder, "events")
    return outliers.flag(events, outliers.fit(events, "auto", 1.5)).select("event_id", "value_outlier", "user_id_outlier")


@REG.add(
    "outlier_remove",
    f"""WITH u AS ({_log_iqr("user_id", 1.5, "events")}), a AS (SELECT e.* FROM events e, u WHERE user_id >= lo AND user_id <= hi),
        b AS ({_log_iqr("value", 1.5, "a")}) SELECT event_id, user_id, value FROM a, b WHERE value >= lo AND value <= hi""",
)
def outlier_remove(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return outliers.remove(events, "auto", 1.5)


@REG.add(
    "outlier_cap",
    f"""WITH {D}, b AS ({_iqr("amount", 1.5, "t")}) SELECT row_id, round(CASE WHEN amount < 0 THEN greatest(lo, 0)
        WHEN amount > hi THEN hi ELSE amount END, 4) AS amount FROM t, b""",
)
def outlier_cap(spark, folder):
    orders = damaged_orders(spark, folder).select("row_id", "amount")
    return rounded(outliers.cap(orders, outliers.fit(orders, "iqr", 1.5, ["amount"])), amount=4)


@REG.add(
    "outlier_metadata",
    f"""WITH {D}, b AS ({_iqr("amount", 1.5, "t")}) SELECT 'amount' AS "column", 'iqr' AS requested_method, 'iqr' AS effective_method,
        CAST(1.5 AS DOUBLE) AS threshold, round(greatest(max(lo), 0), 4) AS lower_bound, round(max(hi), 4) AS upper_bound, 'money' AS column_role,
        CAST(0.95 AS DOUBLE) AS role_confidence, 'name: money' AS role_reason, 'critical' AS severity,
        'flag' AS suggested_action, count(*) AS outliers FROM t, b WHERE amount < greatest(lo, 0) OR amount > hi""",
)
def outlier_metadata(spark, folder):
    orders = damaged_orders(spark, folder)
    bounds = outliers.fit(orders, "iqr", 1.5, ["amount"])
    return rounded(outliers.bounds_table(orders, bounds), lower_bound=4, upper_bound=4)


MISSING = " UNION ALL ".join(
    f"""SELECT row_id AS row_key, '{c}' AS "column", 'missing' AS issue_type, 'Missing value in column {c}' AS description,
    CAST(NULL AS VARCHAR) AS current_value, 'error' AS severity FROM t WHERE {c} IS NULL"""
    for c in ("status", "amount", "priority")
)
PLACEHOLDERS = f"""SELECT row_id AS row_key, 'status' AS "column", 'missing_token' AS issue_type,
    'Placeholder ' || status || ' in column status counts as missing' AS description, status AS current_value, 'error' AS severity
    FROM t WHERE lower(trim(status)) IN {TOKENS}"""
OUTLIERS = f"""SELECT row_id AS row_key, 'customer' AS "column", 'outlier' AS issue_type,
      'Outlier in customer: outside the usual range [' || printf('%.2f', lo) || ' – ' || printf('%.2f', hi) || ']' AS description,
      CAST(CAST(customer AS DOUBLE) AS VARCHAR) AS current_value, 'warning' AS severity FROM t, ({_log_iqr("customer", 3.0, "t")}) b
      WHERE customer < lo OR customer > hi
    UNION ALL SELECT row_id, 'amount', 'outlier', 'Outlier in amount: outside its domain', CAST(amount AS VARCHAR), 'critical' FROM t WHERE amount < 0"""
COPIES = """SELECT row_id AS row_key, CAST(NULL AS VARCHAR) AS "column", 'duplicate' AS issue_type, 'Same as row ' || first AS description,
    CAST(NULL AS VARCHAR) AS current_value, 'warning' AS severity FROM
    (SELECT row_id, min(row_id) OVER (PARTITION BY customer, status, amount, priority, placed) AS first FROM t) WHERE row_id <> first"""


@REG.add("scan_missing", f"WITH {D} {MISSING}")
def scan_missing(spark, folder):
    return scan.missing_cells(damaged_orders(spark, folder), "row_id")


@REG.add("scan_tokens", f"WITH {D} {PLACEHOLDERS}")
def scan_tokens(spark, folder):
    return scan.token_cells(damaged_orders(spark, folder), "row_id")


@REG.add("scan_outliers", f"WITH {D} {OUTLIERS}")
def scan_outliers(spark, folder):
    return scan.outlier_issues(damaged_orders(spark, folder), "row_id").drop("metadata")


@REG.add("scan_duplicates", f"WITH {D} {COPIES}")
def scan_duplicates(spark, folder):
    return scan.duplicate_rows(damaged_orders(spark, folder), "row_id", KEY)


@REG.add(
    "scan_summary",
    f"WITH {D}, s AS ({MISSING} UNION ALL {PLACEHOLDERS} UNION ALL {OUTLIERS} UNION ALL {COPIES}) SELECT issue_type, count(*) AS issues FROM s GROUP BY 1",
)
def scan_summary(spark, folder):
    return scan.scan_summary(scan.scan(damaged_orders(spark, folder), "row_id"))


SPARSE = {
    "row_id": "o_orderkey",
    "rare": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END",
    "empty": "CASE WHEN o_orderkey < 0 THEN o_custkey END",
    "same": "CASE WHEN o_orderkey >= 0 THEN 'x' END",
}


@REG.add(
    "validate_missing",
    f"""WITH t AS (SELECT {", ".join(_expressions(SPARSE))} FROM orders)
        SELECT 'rare' AS "column", 'high_missing' AS finding, round((count(*) - count(rare)) / count(*) * 100, 1) AS missing_pct FROM t
        UNION ALL SELECT 'empty', 'all_missing', round((count(*) - count(empty)) / count(*) * 100, 1) FROM t""",
)
def validate_missing(spark, folder):
    return validate.missing_findings(table(spark, folder, "orders").selectExpr(*_expressions(SPARSE)))


@REG.add(
    "validate_single_value",
    f"""WITH t AS (SELECT {", ".join(_expressions(SPARSE))} FROM orders), c AS (SELECT 'row_id' AS c, count(DISTINCT row_id) AS d FROM t
        UNION ALL SELECT 'rare', count(DISTINCT rare) FROM t UNION ALL SELECT 'empty', count(DISTINCT empty) FROM t
        UNION ALL SELECT 'same', count(DISTINCT same) FROM t) SELECT c AS "column" FROM c WHERE d = 1""",
)
def validate_single_value(spark, folder):
    return validate.single_value_columns(table(spark, folder, "orders").selectExpr(*_expressions(SPARSE)))


@REG.add(
    "validate_ranges",
    f"""WITH {D} SELECT 'amount' AS "column", count(*) AS violations FROM t WHERE amount < 0 OR amount > 500000
        UNION ALL SELECT 'customer', count(*) FROM t WHERE customer < 10""",
)
def validate_ranges(spark, folder):
    return validate.range_violations(
        damaged_orders(spark, folder), {"amount": (0, 500000), "customer": (10, None), "absent": (0, 1)}
    )


MAIL = "concat(CASE WHEN c_custkey % 7 = 0 THEN '@' ELSE 'user' END, CAST(c_custkey AS STRING), CASE WHEN c_custkey % 5 = 0 THEN '@mail' ELSE '@mail.example.com' END)"  # noqa: E501
PHONE = "concat(CASE WHEN c_custkey % 3 = 0 THEN '+1 (' ELSE '(' END, '555) ', lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 7 END, '0'))"  # noqa: E501


@REG.add(
    "validate_email",
    f"""WITH t AS (SELECT {MAIL} AS mail FROM customer), v AS (SELECT sum(CASE WHEN regexp_matches(mail, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') THEN 1 ELSE 0 END) AS k, count(*) AS n FROM t)
        SELECT CAST(k AS BIGINT) AS valid, CAST(n - k AS BIGINT) AS invalid, round(k / n * 100, 2) AS validity_rate FROM v""",
)
def validate_email(spark, folder):
    return validate.email_validity(table(spark, folder, "customer").selectExpr(f"{MAIL} AS mail"), "mail")


@REG.add(
    "validate_phone",
    f"""WITH t AS (SELECT regexp_replace({PHONE}, '[^0-9+]', '', 'g') AS p FROM customer), v AS (SELECT sum(CASE WHEN regexp_matches(p, '^\\+?1?\\d{{9,15}}$') THEN 1 ELSE 0 END) AS k, count(*) AS n FROM t)
        SELECT CAST(k AS BIGINT) AS valid, CAST(n - k AS BIGINT) AS invalid, round(k / n * 100, 2) AS validity_rate FROM v""",
)
def validate_phone(spark, folder):
    return validate.phone_validity(table(spark, folder, "customer").selectExpr(f"{PHONE} AS phone"), "phone")


@REG.add(
    "scan_missing_key",
    """SELECT CAST(NULL AS BIGINT) AS row_key, 'id' AS "column", 'missing' AS issue_type FROM orders WHERE o_orderkey % 50 = 7
       UNION ALL SELECT o_orderkey, 'amount', 'missing' FROM orders WHERE o_orderkey % 50 = 9""",
)
def scan_missing_key(spark, folder):
    gaps = table(spark, folder, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 <> 7 THEN o_orderkey END AS id", "CASE WHEN o_orderkey % 50 <> 9 THEN o_totalprice END AS amount"
    )
    return scan.missing_cells(gaps, "id").select("row_key", "column", "issue_type")


@REG.add(
    "apply_outlier_selected_zscore",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
       SELECT o_orderkey, o_totalprice FROM orders, s WHERE abs(o_totalprice - m) / d <= 1.5""",
)
def apply_outlier_selected_zscore(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    bounds = outliers.fit(orders, "zscore", 1.5, ["o_totalprice"])
    found = outliers.outlier_cells(orders, bounds, ["o_orderkey"])
    return outliers.apply_bounds(orders, bounds, "remove", selected=found, key=["o_orderkey"])
