"""The full column analysis: categories, relationships, dashboard columns, primary metric, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyfold.operators.pps import pps_matrix, pps_relationships
from tallyfold.operators.relations import NAMES, analysis_confidence, hierarchies, merge_relationships
from tallyfold.operators.roles import (
    ColumnFacts,
    categories,
    category,
    column_facts,
    dashboard_columns,
    is_identifier,
    is_noise,
    primary_metric,
)
from tallyfold.operators.stats import pearson_candidates, pearson_pairs


@dataclass(frozen=True)
class Analysis:
    """``relationships`` and ``confidence`` are lazy frames; the rest is one record per column."""

    facts: list[ColumnFacts]
    categories: dict[str, list[str]]
    dashboard_columns: list[str]
    primary_metric: str | None
    relationships: DataFrame
    confidence: DataFrame


def analyze(df: DataFrame, order_by: list[str] | None = None) -> Analysis:
    """Predictive scores and correlations are merged and rated; hierarchies are added afterwards, so they
    change neither the order nor the confidence."""
    facts = column_facts(df, order_by)
    useful = [f.column for f in facts if category(f) != "identifiers" and not is_noise(f)]
    numbers = pearson_candidates(facts)
    parts = []
    if len(useful) > 1:
        parts.append(pps_relationships(pps_matrix(df, useful)))
    if len(numbers) > 1:
        parts.append(pearson_pairs(df, numbers))
    texts = [f.column for f in facts if f.kind == "text" and not is_identifier(f)]
    levels = hierarchies(df, texts)
    merged = merge_relationships(*parts) if parts else levels.limit(0)
    return Analysis(
        facts,
        categories(facts),
        dashboard_columns(facts),
        primary_metric(facts),
        merged.select(*NAMES).unionByName(levels.select(*NAMES)),
        analysis_confidence(df, merged),
    )
