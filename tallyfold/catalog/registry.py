"""All registered queries in one place."""

from __future__ import annotations

from tallyfold.catalog import cleaning, figures, profiles, relationships, tables, texts
from tallyfold.catalog.base import Query

MODULES = (figures, profiles, cleaning, tables, relationships, texts)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.REG.queries.items()}


def checks() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.REG.sql.items()}
