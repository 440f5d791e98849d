"""Text expressions: normal forms, tokens, versions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing", compared after trim and lower-casing.
MISSING_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "--", "?"]

TRIM_SET = " \t\n\r\u000b\f"


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(TRIM_SET))


def tidy(column: Column, standardize: bool = False) -> Column:
    """Trim; with ``standardize`` also lower-case and make each run of blanks one space."""
    out = strip(column)
    return F.regexp_replace(F.lower(out), r"\s+", " ") if standardize else out


def match_key(column: Column) -> Column:
    """Text form under which two cells count as the same value."""
    return tidy(column, standardize=True)


def is_missing_token(column: Column, extra: tuple[str, ...] = ()) -> Column:
    tokens = sorted({*MISSING_TOKENS, *[t.strip().lower() for t in extra]})
    return F.coalesce(F.lower(strip(column)).isin(tokens), F.lit(False))


def tokens(column: Column) -> Column:
    """Distinct lower-case words of letters a-z, digits and underscore."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9_]+)"), F.lit(1)))


def clip_text(column: Column, length: int) -> Column:
    return F.when(F.length(column) > length, F.concat(F.left(column, F.lit(length)), F.lit("…"))).otherwise(column)


def one_line(column: Column) -> Column:
    return F.translate(strip(column), "\n", " ")


def source_version(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts joined by colons."""
    return F.left(F.sha1(F.concat_ws(":", *parts)), F.lit(12))


def folded_name(name: str) -> str:
    """Column name without accents, lower-case, anything else as single underscores."""
    decomposed = unicodedata.normalize("NFKD", name)
    plain = "".join(c for c in decomposed if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")
