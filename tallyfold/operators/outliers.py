"""Outlier detection as fit and transform.

``fit`` needs a fixed number of aggregate passes for all columns and yields one small bound record per
column. Applying the records is a projection, so flags, caps and removals run inside one scan, and the
records can be stored and applied again later.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.operators.isolation import StepScore, fit_isolation
from tallyfold.operators.neighbours import density_flags
from tallyfold.operators.profile import FLAG_SUFFIX, numeric_columns
from tallyfold.operators.roles import ColumnFacts, column_facts, is_outlier_excluded, numeric_role
from tallyfold.plans.quantiles import quantiles
from tallyfold.plans.scale import DEFAULT, Scale

# Fixed values of the detection rules.
MIN_TABLE_ROWS = 5
MAD_FACTOR = 0.6745
MAD_CUTOFF = 3.5
NON_NEGATIVE_ROLES = ("quantity", "count_like", "money")
PERCENT_ROLES = ("percentage", "percentage_like")
LOG_ROLES = ("quantity", "count_like", "money", "positive_skewed")
MIN_VALUES = {"iqr": 4, "log_iqr": 4, "mad": 4, "zscore": 2, "isolation_forest": 10, "lof": 10}


@dataclass(frozen=True)
class Bounds:
    """What was learned about one column."""

    column: str
    role: str
    confidence: float
    reason: str
    requested: str
    method: str
    threshold: float
    lower: float | None = None
    upper: float | None = None
    centre: float | None = None
    spread: float | None = None
    cap_lower: float | None = None
    cap_upper: float | None = None
    cutoff: float | None = None
    steps: StepScore | None = None
    mostly_non_negative: bool = False

    @property
    def non_negative_role(self) -> bool:
        return self.role in NON_NEGATIVE_ROLES


def auto_method(facts: ColumnFacts, requested: str = "auto") -> str:
    """Detector for a column: log-IQR for skewed positive roles, MAD for the rest."""
    if requested != "auto":
        return requested
    if facts.n < 8 or facts.distinct <= 2:
        return "skip"
    return "log_iqr" if numeric_role(facts).role in LOG_ROLES else "mad"


def checked_method(facts: ColumnFacts, requested: str) -> str:
    """The method after the validity guards; ``skip`` leaves only the domain rule."""
    method = auto_method(facts, requested)
    if method != "skip" and facts.n < MIN_VALUES[method]:
        return "skip"
    if method == "log_iqr" and facts.non_negative_rate < 1.0:
        return "skip"
    return method


def candidate_facts(
    df: DataFrame, target_columns: list[str] | None = None, facts: list[ColumnFacts] | None = None
) -> list[ColumnFacts]:
    """Facts of the numeric columns that may be tested; only these columns are read."""
    wanted = [
        c
        for c in numeric_columns(df)
        if not c.endswith(FLAG_SUFFIX) and (not target_columns or c in target_columns)
    ]
    if not wanted:
        return []
    known = [f for f in (facts or column_facts(df, columns=wanted)) if f.column in wanted]
    return [f for f in known if not is_outlier_excluded(f)]


def fit(
    df: DataFrame,
    method: str = "auto",
    threshold: float = 1.5,
    target_columns: list[str] | None = None,
    facts: list[ColumnFacts] | None = None,
    max_rows: int | None = None,
    scale: Scale = DEFAULT,
) -> list[Bounds]:
    """Bounds of every column worth testing. ``max_rows`` is off by default."""
    return fit_columns(df, candidate_facts(df, target_columns, facts), method, threshold, max_rows, scale)


def fit_columns(
    df: DataFrame,
    usable: list[ColumnFacts],
    method: str,
    threshold: float,
    max_rows: int | None = None,
    scale: Scale = DEFAULT,
) -> list[Bounds]:
    """``fit`` for columns that are already chosen."""
    if not usable:
        return []
    rows = usable[0].rows
    if rows < MIN_TABLE_ROWS or (max_rows is not None and rows > max_rows):
        return []
    plans = []
    for f in usable:
        role = numeric_role(f)
        plans.append(
            Bounds(f.column, role.role, role.confidence, role.reason, method, checked_method(f, method), threshold)
        )
    cells = {p.column: number(df, p.column) for p in plans}
    by = lambda m: [p.column for p in plans if p.method == m]
    # Quartiles of plain and log values share one search; the log is taken before the quantile.
    wanted = {
        **{c: cells[c] for c in by("iqr")},
        **{c: F.log1p(cells[c]) for c in by("log_iqr")},
    }
    quarters = quantiles(df, wanted, [0.25, 0.75], rows, scale)
    middles = {c: q[0] for c, q in quantiles(df, {c: cells[c] for c in by("mad")}, [0.5], rows, scale).items()}
    spreads = {
        c: q[0]
        for c, q in quantiles(
            df, {c: F.abs(cells[c] - F.lit(middles[c])) for c in middles}, [0.5], rows, scale
        ).items()
    }
    moments = {}
    if by("zscore"):
        row = df.agg(
            *[
                g(cells[c]).alias(f"{k}|{c}")
                for c in by("zscore")
                for k, g in (("mean", F.avg), ("pop", F.stddev_pop), ("samp", F.stddev_samp))
            ]
        ).first()
        moments = {c: (row[f"mean|{c}"], row[f"pop|{c}"], row[f"samp|{c}"]) for c in by("zscore")}
    return [_bounded(p, df, cells[p.column], quarters, middles, spreads, moments) for p in plans]


def _bounded(p: Bounds, df: DataFrame, cell: Column, quarters, middles, spreads, moments) -> Bounds:
    c, t = p.column, p.threshold
    if p.method in ("iqr", "log_iqr"):
        low, high = quarters[c]
        width = high - low
        if width == 0:
            return p
        lower, upper = low - t * width, high + t * width
        if p.method == "log_iqr":
            lower, upper = math.expm1(lower), math.expm1(upper)
        elif p.non_negative_role:
            lower = max(lower, 0.0)
        return replace(p, lower=lower, upper=upper, cap_lower=lower, cap_upper=upper)
    if p.method == "mad":
        if not spreads[c]:
            return p
        cutoff = t if t > 3.0 else MAD_CUTOFF
        reach = cutoff * spreads[c] / MAD_FACTOR
        lower, upper = middles[c] - reach, middles[c] + reach
        if p.non_negative_role:
            lower = max(lower, 0.0)
        return replace(
            p, lower=lower, upper=upper, cap_lower=lower, cap_upper=upper,
            centre=middles[c], spread=spreads[c], cutoff=cutoff,
        )
    if p.method == "zscore":
        mean, population, sample = moments[c]
        lower, upper = mean - t * sample, mean + t * sample
        if p.non_negative_role:
            lower = max(lower, 0.0)
        return replace(p, centre=mean, spread=population, cutoff=t, cap_lower=lower, cap_upper=upper)
    if p.method == "isolation_forest":
        return replace(p, steps=fit_isolation(df, cell))
    return p


def domain_mask(df: DataFrame, b: Bounds) -> Column:
    """Values a role forbids: negatives, and percentages outside 0-100."""
    cell = number(df, b.column)
    if b.non_negative_role:
        broken = cell < 0
    elif b.role in PERCENT_ROLES:
        broken = (cell < 0) | (cell > 100)
    else:
        return F.lit(False)
    return F.coalesce(broken, F.lit(False))


def statistical_mask(df: DataFrame, b: Bounds) -> Column:
    cell = number(df, b.column)
    if b.method in ("iqr", "log_iqr") and b.lower is not None:
        hit = (cell < b.lower) | (cell > b.upper)
    elif b.method == "mad" and b.spread:
        hit = F.lit(MAD_FACTOR) * F.abs(cell - b.centre) / b.spread > b.cutoff
    elif b.method == "zscore" and b.spread:
        hit = F.abs((cell - b.centre) / b.spread) > b.cutoff
    elif b.method == "isolation_forest" and b.steps is not None:
        hit = b.steps.score(cell) > 0.5
    elif b.method == "lof":
        hit = F.col(f"`{lof_column(b.column)}`")
    else:
        return F.lit(False)
    return F.coalesce(hit, F.lit(False))


def lof_column(column: str) -> str:
    return f"_lof_{column}"


def mask(df: DataFrame, b: Bounds) -> Column:
    return statistical_mask(df, b) | domain_mask(df, b)


def prepared(df: DataFrame, bounds: list[Bounds], scale: Scale = DEFAULT) -> DataFrame:
    """Adds the one kind of mask that is not a plain expression: neighbour density."""
    wanted = {b.column: lof_column(b.column) for b in bounds if b.method == "lof"}
    return density_flags(df, wanted, scale=scale) if wanted else df


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_lof_")])


def flag(df: DataFrame, bounds: list[Bounds], scale: Scale = DEFAULT, keep_all: bool = False) -> DataFrame:
    """Adds ``<column>_outlier`` for every column in which something was found; ``keep_all`` spares that
    look and flags all given columns."""
    ready = prepared(df, bounds, scale)
    hit = {b.column for b in bounds} if keep_all else _columns_with_hits(ready, bounds)
    return _without_helpers(
        ready.withColumns({f"{b.column}{FLAG_SUFFIX}": mask(ready, b) for b in bounds if b.column in hit})
    )


def _columns_with_hits(ready: DataFrame, bounds: list[Bounds]) -> set[str]:
    if not bounds:
        return set()
    row = ready.agg(*[F.max(mask(ready, b)).alias(f"h{i}") for i, b in enumerate(bounds)]).first()
    return {b.column for i, b in enumerate(bounds) if row[f"h{i}"]}


def outlier_counts(df: DataFrame, bounds: list[Bounds], scale: Scale = DEFAULT) -> DataFrame:
    """``(column, outliers, critical)`` of columns with a hit."""
    ready = prepared(df, bounds, scale)
    wide = ready.agg(
        *[x for i, b in enumerate(bounds) for x in (
            F.count_if(mask(ready, b)).alias(f"n{i}"),
            F.count_if(domain_mask(ready, b)).alias(f"d{i}"),
        )]
    )
    rows = [
        F.struct(
            F.lit(b.column).alias("column"),
            F.lit(b.role).alias("role"),
            F.lit(b.method).alias("method"),
            F.col(f"n{i}").alias("outliers"),
            F.col(f"d{i}").alias("critical"),
        )
        for i, b in enumerate(bounds)
    ]
    return wide.select(F.inline(F.array(*rows))).filter("outliers > 0")


def remove(
    df: DataFrame,
    method: str = "iqr",
    threshold: float = 1.5,
    target_columns: list[str] | None = None,
    joint: bool = False,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Drops outlier rows. By default column after column, each fitted on what the earlier ones left;
    ``joint=True`` fits all columns on the whole table and drops once.

    Filters of fitted literals stack up in one projection, so no intermediate copy is needed."""
    if joint:
        return drop_rows(df, fit(df, method, threshold, target_columns, scale=scale), scale)
    for f in candidate_facts(df, target_columns):
        current = column_facts(df, columns=[f.column])
        df = drop_rows(df, fit_columns(df, current, method, threshold, scale=scale), scale)
    return df


def drop_rows(df: DataFrame, bounds: list[Bounds], scale: Scale = DEFAULT) -> DataFrame:
    ready = prepared(df, bounds, scale)
    keep = F.lit(True)
    for b in bounds:
        keep = keep & ~mask(ready, b)
    return _without_helpers(ready.filter(keep))


def cap(df: DataFrame, bounds: list[Bounds], strict_percent: bool = False, scale: Scale = DEFAULT) -> DataFrame:
    """Pulls outliers to the bounds (isolation forest and LOF: to null), then mends impossible values.

    By default a percentage column that is at least 90 % non-negative only has negatives mended; with
    ``strict_percent`` it is also cut at 100."""
    if not bounds:
        return df
    ready = prepared(df, bounds, scale)
    share = ready.agg(
        *[
            F.avg(F.when(~mask(ready, b), (number(ready, b.column) >= 0).cast("int"))).alias(f"s{i}")
            for i, b in enumerate(bounds)
        ],
        *[F.max(mask(ready, b)).alias(f"h{i}") for i, b in enumerate(bounds)],
    ).first()
    out = {}
    for i, b in enumerate(bounds):
        if share[f"h{i}"]:
            positive = b.non_negative_role or (share[f"s{i}"] is not None and share[f"s{i}"] >= 0.90)
            out[b.column] = _capped(ready, b, positive, strict_percent)
    return _without_helpers(ready.withColumns(out))


def _capped(df: DataFrame, b: Bounds, positive: bool, strict_percent: bool) -> Column:
    cell = number(df, b.column)
    hit, value = mask(df, b), cell
    if b.method in ("iqr", "log_iqr", "mad", "zscore") and b.cap_lower is not None:
        value = F.when(hit, F.least(F.greatest(cell, F.lit(b.cap_lower)), F.lit(b.cap_upper))).otherwise(cell)
    elif b.method in ("isolation_forest", "lof", "skip"):
        value = F.when(hit & ~domain_mask(df, b), F.lit(None)).otherwise(cell)
    percent = b.role in PERCENT_ROLES
    if positive or percent:
        value = F.when(value < 0, F.lit(0.0)).otherwise(value)
    if percent and (strict_percent or not positive):
        value = F.when(value > 100, F.lit(100.0)).otherwise(value)
    return value


def bounds_table(df: DataFrame, bounds: list[Bounds], action: str = "flag", scale: Scale = DEFAULT) -> DataFrame:
    """One row per column with hits: method, bounds, role, severity, suggested action, count."""
    counts = outlier_counts(df, bounds, scale)
    rows = [
        (b.column, b.requested, float(b.threshold), b.lower, b.upper, float(b.confidence), b.reason) for b in bounds
    ]
    learned = df.sparkSession.createDataFrame(
        rows,
        "column string, requested_method string, threshold double, lower_bound double, upper_bound double, "
        "role_confidence double, role_reason string",
    )
    severity = F.when(F.col("critical") > 0, "critical").otherwise("warning")
    return counts.join(F.broadcast(learned), "column").select(
        "column", "requested_method", F.col("method").alias("effective_method"), "threshold",
        "lower_bound", "upper_bound", F.col("role").alias("column_role"), "role_confidence", "role_reason",
        severity.alias("severity"),
        F.when(severity == "warning", "review").otherwise(action).alias("suggested_action"),
        "outliers",
    )


def outlier_cells(df: DataFrame, bounds: list[Bounds], key: list[str], scale: Scale = DEFAULT) -> DataFrame:
    """One row per flagged cell with its key, value and the facts of its column."""
    ready = prepared(df, bounds, scale)
    cells = [
        F.when(
            mask(ready, b),
            F.struct(
                F.lit(b.column).alias("column"),
                number(ready, b.column).alias("value"),
                domain_mask(ready, b).alias("breaks_domain"),
                F.lit(b.method).alias("effective_method"),
                F.lit(b.role).alias("column_role"),
                F.lit(b.lower).cast("double").alias("lower_bound"),
                F.lit(b.upper).cast("double").alias("upper_bound"),
            ),
        )
        for b in bounds
    ]
    hits = F.filter(F.array(*cells), lambda c: c.isNotNull())
    return ready.select(*[F.col(f"`{k}`") for k in key], F.inline(hits))


def apply_bounds(
    df: DataFrame,
    bounds: list[Bounds],
    action: str,
    target_columns: list[str] | None = None,
    selected: DataFrame | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Applies stored bounds after review: ``cap`` or ``remove``.

    Without ``selected`` every row is tested against the bounds again. With ``selected`` (a frame of
    keys) only those rows are touched, found by a left semi / left join on the key. Methods without bounds (z-score, isolation
    forest, local outlier factor) cannot be tested again: their findings are removed by the recorded keys."""
    wanted = [b for b in bounds if not target_columns or b.column in target_columns]
    chosen = [b for b in wanted if b.lower is not None]
    if len(chosen) < len(wanted):
        if action != "remove" or selected is None:
            raise ValueError("findings without bounds can only be removed, by their recorded keys")
        return df.join(selected.select(*[F.col(f"`{k}`") for k in key]).distinct(), key, "left_anti").select(
            *[F.col(f"`{c}`") for c in df.columns]
        )
    if not chosen:
        return df
    outside = {
        b.column: F.coalesce((number(df, b.column) < b.lower) | (number(df, b.column) > b.upper), F.lit(False))
        for b in chosen
    }
    picked = F.lit(True)
    base = df
    if selected is not None:
        keys = [F.col(f"`{k}`") for k in key]
        base = df.join(selected.select(*keys).distinct().withColumn("_picked", F.lit(True)), key, "left")
        picked = F.coalesce(F.col("_picked"), F.lit(False))
    if action == "remove":
        broken = F.lit(False)
        for b in chosen:
            broken = broken | outside[b.column]
        return base.filter(~(picked & broken)).select(*[F.col(f"`{c}`") for c in df.columns])
    capped = {
        b.column: F.when(
            picked & outside[b.column],
            F.least(F.greatest(number(df, b.column), F.lit(b.lower)), F.lit(b.upper)),
        ).otherwise(F.col(f"`{b.column}`"))
        for b in chosen
    }
    return base.withColumns(capped).select(*[F.col(f"`{c}`") for c in df.columns])
