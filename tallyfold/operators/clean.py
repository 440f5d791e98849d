"""The cleaning pipeline: text, missing tokens, types, outliers, missing values, duplicates, dates.

Each step is fit (one aggregate over all columns, giving a small plan) and transform (a projection). Once texts are
cleaned and typed, which is dear, the table is stored, and the later steps, which read it several times, start from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.dates import LONGEST, date_facts, java_pattern, parse_date, parse_with
from tallyfold.functions.numbers import number, text_to_number, without_nan
from tallyfold.functions.text import is_missing_token, match_key, tidy
from tallyfold.operators import outliers
from tallyfold.operators.profile import (
    FLAG_SUFFIX,
    date_columns,
    default_key,
    missing_count,
    numeric_columns,
    text_columns,
)
from tallyfold.operators.roles import column_facts, is_identifier
from tallyfold.plans.freq import modes, text_key
from tallyfold.plans.ordering import POSITION, carried, with_position
from tallyfold.plans.quantiles import quantiles
from tallyfold.plans.scale import DEFAULT, Scale, row_count
from tallyfold.session import stored

NUMBER_RATE = 0.8
DATE_RATE = 0.3
AMBIGUOUS_RATE = 0.05


@dataclass(frozen=True)
class Profile:
    """Settings of one cleaning run. ``column_rules`` maps a column to ``impute``, ``fill_value`` and
    ``missing_tokens``."""

    strip_whitespace: bool = True
    standardize_text: bool = False
    fix_types: bool = True
    number_rate: float = NUMBER_RATE
    date_format: str | None = None
    detect_outliers: bool = True
    outlier_method: str = "auto"
    outlier_threshold: float = 1.5
    outlier_action: str = "flag"
    outlier_columns: list[str] | None = None
    outlier_max_rows: int | None = None
    strict_percent: bool = False
    missing: str = "fill"
    fill_strategy: str = "auto"
    fill_value: str | float | None = None
    identifier_rule: str = "drop"
    remove_duplicates: bool = True
    duplicate_subset: list[str] | None = None
    duplicate_keep: str = "best"
    standardize_dates: bool = False
    target_date_format: str | None = None
    column_rules: dict[str, dict] = field(default_factory=dict)


def clean_text(df: DataFrame, standardize: bool = False) -> DataFrame:
    return df.withColumns({c: tidy(F.col(f"`{c}`"), standardize) for c in text_columns(df)})


def null_tokens(df: DataFrame, column_rules: dict[str, dict] | None = None) -> DataFrame:
    """Placeholder texts become null."""
    return df.withColumns({c: F.when(~_token(c, column_rules), F.col(f"`{c}`")) for c in text_columns(df)})


def token_counts(df: DataFrame, column_rules: dict[str, dict] | None = None) -> DataFrame:
    """Placeholder cells per column, columns without any left out."""
    columns = text_columns(df)
    wide = df.agg(*[F.count_if(_token(c, column_rules)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("tokens")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows)).filter("tokens > 0")


def _token(column: str, column_rules: dict[str, dict] | None) -> Column:
    extra = (column_rules or {}).get(column, {}).get("missing_tokens") or []
    return is_missing_token(F.col(f"`{column}`"), tuple(str(t) for t in extra if t is not None))


@dataclass(frozen=True)
class TypePlan:
    """Text columns to convert: to numbers, to timestamps, and those whose day/month order is unclear."""

    numbers: list[str]
    dates: list[str]
    ambiguous: list[str]
    date_format: str | None = None


def fit_types(
    df: DataFrame, number_rate: float = NUMBER_RATE, date_rate: float = DATE_RATE, date_format: str | None = None
) -> TypePlan:
    """Measures, in one scan of the text columns, how many cells parse as numbers and as dates."""
    columns = [c for c in text_columns(df) if not c.endswith(FLAG_SUFFIX)]
    if not columns:
        return TypePlan([], [], [], date_format)
    found = {r["i"]: r for r in _type_rates(df, columns, date_format).collect()}
    return _type_plan([found.get(i) for i in range(len(columns))], columns, number_rate, date_rate, date_format)


def _type_rates(df: DataFrame, columns: list[str], date_format: str | None) -> DataFrame:
    """Per column (its number is ``i``) with a cell: shares of numbers and of dates, and how often the day/month order matters. Texts that may be
    dates are counted first, so that each is parsed once."""

    def cell(i: int, c: str) -> Column:
        text = F.col(f"`{c}`")
        short = text if date_format else F.when(F.length(text) <= LONGEST, text)
        return F.struct(F.lit(i).alias("i"), text.isNotNull().alias("filled"), text_to_number(text).isNotNull().alias("number"), short.alias("text"))

    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).filter("filled")
    counted = cells.groupBy("i", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    text = F.col("text")
    given = F.struct(parse_with(text, date_format).isNotNull().alias("dated"), F.lit(False).alias("differs")) if date_format else date_facts(text)
    times = lambda test: F.sum(F.when(F.col(test), F.col("n")).otherwise(0))
    return (
        counted.withColumn("date", given)
        .groupBy("i")
        .agg(
            (times("number") / F.sum("n")).alias("num"),
            (times("date.dated") / F.sum("n")).alias("date"),
            (times("date.differs") / F.nullif(times("date.dated"), F.lit(0))).alias("diff"),
        )
    )


def _type_plan(rates: list, columns: list[str], number_rate: float, date_rate: float, date_format: str | None) -> TypePlan:
    numbers, dates, ambiguous = [], [], []
    for c, row in zip(columns, rates):
        if (row["num"] if row else 0) >= number_rate:
            numbers.append(c)
        elif (row["date"] if row else 0) >= date_rate:
            unclear = not date_format and row is not None and (row["diff"] or 0) > AMBIGUOUS_RATE
            (ambiguous if unclear else dates).append(c)
    return TypePlan(numbers, dates, ambiguous, date_format)


def apply_types(df: DataFrame, plan: TypePlan) -> DataFrame:
    """Converts the planned columns; cells that do not parse become null."""
    out = {c: text_to_number(F.col(f"`{c}`")) for c in plan.numbers}
    for c in plan.dates:
        cell = F.col(f"`{c}`")
        out[c] = parse_with(cell, plan.date_format) if plan.date_format else parse_date(cell)
    return df.withColumns(out)


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return without_nan(df).dropna("any", subset=subset)


def fit_fill(
    df: DataFrame,
    strategy: str = "auto",
    fill_value=None,
    column_rules: dict[str, dict] | None = None,
    columns: list[str] | None = None,
    gaps: list[str] | None = None,
    scale: Scale = DEFAULT,
    rows: int | None = None,
) -> dict[str, object]:
    """Fill value per column with missing cells (``gaps``, counted here when not given). ``rows`` may be any
    known upper bound of the row count. Statistics leave out rows flagged as outliers of the same
    column. Means come from one aggregate, medians from one rank search, modes from one value count."""
    rules = column_rules or {}
    wanted = [c for c in (columns or df.columns) if not c.endswith(FLAG_SUFFIX)]
    numbers, dates = numeric_columns(df), date_columns(df)
    if not wanted:
        return {}
    gaps = [c for c in wanted if c in gaps] if gaps is not None else [c for c in missing_cells(df) if c in wanted]
    values: dict[str, object] = {}
    means, medians, commonest = [], [], []
    for c in gaps:
        rule = rules.get(c, {})
        how = rule.get("impute") or strategy
        given = rule.get("fill_value") if rule.get("fill_value") is not None else fill_value
        if how == "drop":
            continue
        if how == "constant":
            values[c] = _constant(c in numbers, c in dates, given)
        elif c in numbers and how == "mean":
            means.append(c)
        elif c in numbers and how != "mode":
            medians.append(c)
        else:
            commonest.append(c)
    trusted = {c: _trusted(df, c) for c in gaps}
    if means:
        row = df.agg(
            *[F.coalesce(F.avg(trusted[c]), F.avg(number(df, c))).alias(f"v{i}") for i, c in enumerate(means)]
        ).first()
        values.update({c: row[f"v{i}"] for i, c in enumerate(means)})
    if medians:
        found = quantiles(df, {c: trusted[c] for c in medians}, [0.5], rows, scale)
        bare = {c: number(df, c) for c in medians if found[c][0] is None}
        found.update(quantiles(df, bare, [0.5], rows, scale))
        values.update({c: found[c][0] for c in medians})
    if commonest:
        picked = df.select(*[trusted[c].alias(c) for c in commonest])
        found = {r["column"]: r["mode"] for r in modes(picked, commonest).collect()}
        for c in commonest:
            mode = found.get(c)
            values[c] = float(mode) if mode is not None and c in numbers else mode
    return {c: v for c, v in values.items() if v is not None}


def _trusted(df: DataFrame, column: str) -> Column:
    cell = number(df, column) if column in numeric_columns(df) else F.col(f"`{column}`")
    flag_column = f"{column}{FLAG_SUFFIX}"
    if flag_column not in df.columns:
        return cell
    return F.when(~F.coalesce(F.col(f"`{flag_column}`").cast("boolean"), F.lit(False)), cell)


def _constant(is_number: bool, is_date: bool, given):
    if is_number:
        try:
            return 0.0 if given is None else float(given)
        except (TypeError, ValueError):
            return 0.0
    return "Unknown" if given is None and not is_date else given


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    numbers, dates = numeric_columns(df), date_columns(df)
    out = {}
    for c, value in values.items():
        if c in numbers:
            out[c] = F.coalesce(number(df, c), F.lit(float(value)))
        elif c in dates:
            kind = df.schema[c].dataType.simpleString()
            out[c] = F.coalesce(F.col(f"`{c}`"), F.lit(str(value)).try_cast(kind))
        else:
            out[c] = F.coalesce(F.col(f"`{c}`"), F.lit(str(value)).cast(df.schema[c].dataType))
    return df.withColumns(out)


def missing_cells(df: DataFrame) -> dict[str, int]:
    """Missing cells of the columns that have any."""
    row = df.agg(*[missing_count(df, c).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(df.columns) if row[f"m{i}"]}


def fill_missing(
    df: DataFrame,
    strategy: str = "auto",
    fill_value=None,
    column_rules: dict[str, dict] | None = None,
    gaps: list[str] | None = None,
    scale: Scale = DEFAULT,
    rows: int | None = None,
) -> DataFrame:
    """Fills column after column in schema order. A ``drop`` rule removes rows first, so statistics of the
    later columns are fitted on what remains; runs of plain columns between drops are fitted together."""
    rules = column_rules or {}
    gaps = list(missing_cells(df)) if gaps is None else gaps
    run: list[str] = []
    for c in [c for c in df.columns if c in gaps]:
        if rules.get(c, {}).get("impute", strategy) == "drop":
            if run:
                df = apply_fill(df, fit_fill(df, strategy, fill_value, rules, run, run, scale, rows))
            df, run = drop_missing(df, [c]), []
        else:
            run.append(c)
    return apply_fill(df, fit_fill(df, strategy, fill_value, rules, run, run, scale, rows)) if run else df


def identifier_rules(df: DataFrame, mode: str = "drop", facts=None) -> dict[str, dict]:
    """Rules for identifier columns: drop rows without one, or fill in a fixed word."""
    found = [f.column for f in (facts or column_facts(df, with_dates=False)) if is_identifier(f)]
    rule = {"impute": "drop"} if mode == "drop" else {"impute": "constant", "fill_value": "Inconnu"}
    return {c: rule for c in found}


def interpolate(
    df: DataFrame, order_by: list[str], partition_by: list[str] | None = None, scale: Scale = DEFAULT
) -> DataFrame:
    """Linear interpolation of numeric columns by row position, then carry forward, then carry backward.

    Values are carried inside bounded chunks of the order and across chunks by their edge values, so
    neither the whole table nor a hot partition key is ordered by one task."""
    keys = partition_by or []
    rows = row_count(df)
    columns = [c for c in df.columns if c not in keys and c not in order_by]
    numbers = [c for c in numeric_columns(df) if c in columns]
    placed = with_position(without_nan(df), order_by, rows, keys, scale)
    marks = {
        c: F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(f"`{c}`").alias("v"), F.col(POSITION).alias("p")))
        for c in columns
    }
    both = carried(
        placed,
        {f"_b{i}": marks[c] for i, c in enumerate(columns)},
        order_by,
        rows,
        keys,
        scale,
        backward={f"_a{i}": marks[c] for i, c in enumerate(columns)},
    )
    out = {}
    for i, c in enumerate(columns):
        cell, low, high = F.col(f"`{c}`"), F.col(f"_b{i}"), F.col(f"_a{i}")
        if c in numbers:
            share = (F.col(POSITION) - low["p"]) / (high["p"] - low["p"])
            between = low["v"].cast("double") + (high["v"].cast("double") - low["v"].cast("double")) * share
            out[c] = F.coalesce(cell.cast("double"), between, low["v"].cast("double"), high["v"].cast("double"))
        else:
            out[c] = F.coalesce(cell, low["v"], high["v"])
    return both.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_duplicates(
    df: DataFrame,
    order_by: list[str],
    subset: list[str] | None = None,
    keep: str = "best",
    normalize_text: bool = True,
) -> DataFrame:
    """One row per group of equal rows: the ``first``, the ``last`` or the ``best`` (most filled) one.

    Texts are compared trimmed, lower-case and with single spaces, but kept as they are. Null equals null.
    The rank limit of one is also applied before the shuffle, so a group of copies however large sends at
    most one row per task."""
    keys = subset or default_key(df)
    texts = text_columns(df)
    table = without_nan(df)
    compared = [
        (text_key(match_key(F.col(f"`{c}`")) if normalize_text else F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`")).alias(f"_key{i}")
        for i, c in enumerate(keys)
    ]
    names = [f"_key{i}" for i in range(len(keys))]
    position = [F.col(f"`{c}`") for c in order_by]
    if keep == "best":
        filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
        order = [filled.desc(), *position]
    else:
        order = [c.desc() for c in position] if keep == "last" else position
    ranked = table.select("*", *compared).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    )
    return ranked.filter("_rn = 1").drop("_rn", *names)


def standardize_dates(df: DataFrame, target_format: str | None = None) -> DataFrame:
    """Dates as text in a strftime format; without a format they stay timestamps."""
    if not target_format:
        return df
    pattern = java_pattern(target_format)
    return df.withColumns({c: F.date_format(F.col(f"`{c}`"), pattern) for c in date_columns(df)})


def clean(
    df: DataFrame,
    profile: Profile = Profile(),
    order_by: list[str] | None = None,
    scale: Scale = DEFAULT,
    count_result: bool = True,
) -> tuple[DataFrame, dict]:
    """Runs the steps in their fixed order and returns the table with a report of what each step did.

    ``count_result=False`` leaves the counts after duplicate removal out of the report, and with them a
    second run of the largest shuffle; a caller who writes the table can count it while writing."""
    order_by = order_by or df.columns[:1]
    operations: list[str] = []
    changes: dict[str, object] = {}
    columns_before = list(df.columns)
    out = without_nan(df)
    if profile.strip_whitespace:
        out = clean_text(out, profile.standardize_text)
        operations.append("clean_text")
    texts = text_columns(out)
    found = out.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_token(c, profile.column_rules)).alias(f"tok{i}") for i, c in enumerate(texts)],
    ).first()
    rows_before = found["rows"]
    if texts:
        changes["missing_tokens"] = {c: found[f"tok{i}"] for i, c in enumerate(texts) if found[f"tok{i}"]}
        out = null_tokens(out, profile.column_rules)
        operations.append("missing_tokens")
    if profile.fix_types:
        plan = fit_types(out, profile.number_rate, DATE_RATE, profile.date_format)
        out = apply_types(out, plan)
        changes["types"] = {"numbers": plan.numbers, "dates": plan.dates, "ambiguous": plan.ambiguous}
        operations.append("fix_types")
    # The steps below read the table several times: from here on without parsing texts anew.
    out = _kept(out)
    if profile.detect_outliers:
        out, changes["outliers"] = _clean_outliers(out, profile, scale)
        operations.append("outliers")
    rules = dict(profile.column_rules)
    gaps = missing_cells(out)
    missing_before = sum(gaps.values())
    if profile.missing == "fill" and profile.identifier_rule != "none" and gaps:
        # Only columns with missing cells can be touched by the rule, so only they are examined.
        examined = column_facts(out, columns=list(gaps), with_dates=False)
        rules = {**identifier_rules(out, profile.identifier_rule, examined), **rules}
    if profile.missing == "drop":
        out = drop_missing(out)
    elif profile.missing == "fill":
        out = fill_missing(out, profile.fill_strategy, profile.fill_value, rules, list(gaps), scale, rows_before)
    elif profile.missing == "interpolate":
        out = interpolate(out, order_by, scale=scale)
    if profile.missing != "none":
        operations.append("missing")
    rows_kept, missing_after = _size_and_missing(out)
    changes["missing"] = {"strategy": profile.missing, "before": missing_before, "after": missing_after}
    duplicates = 0
    rows_after = rows_kept
    if profile.remove_duplicates:
        out = remove_duplicates(out, order_by, profile.duplicate_subset, profile.duplicate_keep)
        rows_after = out.count() if count_result else None
        duplicates = rows_kept - rows_after if count_result else None
        operations.append("duplicates")
    if profile.standardize_dates:
        out = standardize_dates(out, profile.target_date_format)
        operations.append("standardize_dates")
    report = {
        "rows_before": rows_before,
        "rows_after": rows_after,
        "duplicates_removed": duplicates,
        "operations": operations,
        "changes": changes,
        "columns_added": [c for c in out.columns if c not in columns_before],
    }
    return out, report


def _kept(df: DataFrame) -> DataFrame:
    """The table as stored once in the shared folder, whatever its columns are called; one with a column of no type stays a plan."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df
    return stored(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)


def _clean_outliers(df: DataFrame, profile: Profile, scale: Scale) -> tuple[DataFrame, dict]:
    method, threshold = profile.outlier_method, profile.outlier_threshold
    if profile.outlier_action == "remove":
        return outliers.remove(df, method, threshold, profile.outlier_columns, scale=scale), {"action": "remove"}
    bounds = outliers.fit(
        df, method, threshold, profile.outlier_columns, max_rows=profile.outlier_max_rows, scale=scale
    )
    if not bounds:
        return df, {"action": profile.outlier_action, "by_column": {}}
    counts = {r["column"]: r["outliers"] for r in outliers.outlier_counts(df, bounds, scale).collect()}
    hit = [b for b in bounds if b.column in counts]
    if profile.outlier_action == "cap":
        out = outliers.cap(df, hit, profile.strict_percent, scale)
    else:
        out = outliers.flag(df, hit, scale, keep_all=True)
    return out, {"action": profile.outlier_action, "by_column": counts}


def _size_and_missing(df: DataFrame) -> tuple[int, int]:
    total = sum((missing_count(df, c) for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing")).first()
    return row["rows"], row["missing"]
