"""Date parsing over a fixed list of formats, and date text."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date texts. ISO texts, with a zone or fractions of a second or without, take Spark's own cast.
ISO_TEXT = r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?)?$"
#: Of other texts the shape, digits as 9 and letters as a, says which one format fits, so that each is parsed once.
PLAIN_FORMATS = [
    "yyyy/M/d",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy/M",
    "yyyyMMdd",
    "yyyyMMdd'T'HHmmss",
    "yyyyMMdd'T'HHmmssX",
    "yyyy-M-d h:mm a",
    "yyyy-M-d h:mm:ss a",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d MMM yyyy H:mm",
    "d MMM yyyy H:mm:ss",
    "d-MMM-yyyy",
    "d-MMM-yyyy H:mm:ss",
    "d/MMM/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM yyyy",
    "MMMM yyyy",
]
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
#: How a text begins whose day and month stand in either order, by separator.
MONTH_FIRST = {x: rf"^{_MONTH}{re.escape(x)}{_DAY}{re.escape(x)}" for x in "/-."}
DAY_FIRST = {x: rf"^{_DAY}{re.escape(x)}{_MONTH}{re.escape(x)}" for x in "/-."}
#: Separator and what follows the day and month.
SWAPPED_REST = [("/", "yyyy"), ("-", "yyyy"), (".", "yyyy"), *[("/", f"yyyy {t}") for t in ("H:mm", "H:mm:ss", "h:mm a", "h:mm:ss a")]]

# How texts begin whose day and month may be mistaken, and where a year of two digits stands. Years up to 68 are in this
# century.
SWAPPED_START = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
SHORT_YEAR = r"^\d{1,2}[/.-](\d{1,2}|[A-Za-z]{3})[/.-]\d{2}($| )"
_BEFORE_YEAR = r"(?<=^\d{1,2}[/.-]([0-9]{1,2}|[A-Za-z]{3})[/.-])"
# Fixed value: what all dates hold, looked for before anything else is tried.
DIGIT = "[0-9]"
LONGEST = 64

# Strftime letters and the matching date_format letters.
STRFTIME = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
    "%%": "%",
}


def parse_date(column: Column, day_first: bool = False) -> Column:
    """Text to timestamp; the preferred day/month order is tried first, the other one next. Texts with a zone become the instant they name."""
    return _read(column, lambda text, kind: _parsed(text, kind, day_first))


def date_facts(column: Column) -> Column:
    """``dated``, whether the text is a date, and ``differs``, whether the order of day and month matters for it (null if it
    has no such order), from one parsing."""

    def facts(text: Column, kind: Column) -> Column:
        differs = lambda month_first: F.when(text.rlike(SWAPPED_START), _swapped(text, kind, True) != month_first)
        return _once(_parsed(text, kind, False), lambda d: F.struct(d.isNotNull().alias("dated"), differs(d).alias("differs")))

    return _read(column, facts)


def _read(column: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the date text of a column and of its shape."""
    return _once(date_text(column), lambda text: _once(_kind(text), lambda kind: use(text, kind)))


def _parsed(text: Column, kind: Column, day_first: bool) -> Column:
    return (
        F.when(kind.startswith("9999-"), F.when(text.rlike(ISO_TEXT), _zoned(text).try_cast("timestamp")).otherwise(_fit(text, kind, "9999-")))
        .when(kind.startswith("9999"), _fit(text, kind, "9999"))
        .when(text.rlike(SWAPPED_START), _swapped(text, kind, day_first))
        .otherwise(_fit(text, kind, ""))
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def date_text(column: Column) -> Column:
    """The text without blanks around it, a year of two digits written out; null if it is too long for a date or has no digit."""

    def full(text: Column) -> Column:
        late = F.regexp_replace(text, rf"{_BEFORE_YEAR}(?=([0-5]\d|6[0-8])($| ))", "20")
        return F.when(text.rlike(SHORT_YEAR), F.regexp_replace(late, rf"{_BEFORE_YEAR}(?=\d\d($| ))", "19")).otherwise(text)

    return _once(F.trim(F.when((F.length(column) <= LONGEST) & column.rlike(DIGIT), column)), full)


def _zoned(text: Column) -> Column:
    """An ISO text with its zone, if it has one, as Spark's cast reads it: no blank before it, a colon inside."""

    def joined(t: Column) -> Column:
        at = lambda n: t.substr(F.lit(-n), F.lit(1)).isin("+", "-")
        before = lambda n: F.rtrim(t.substr(F.lit(1), F.length(t) - n))
        last = lambda n, size: t.substr(F.lit(-n), F.lit(size))
        return (
            F.when(t.endswith("Z"), F.concat(before(1), F.lit("Z")))
            .when(at(5), F.concat(before(5), last(5, 3), F.lit(":"), last(2, 2)))
            .when(at(6), F.concat(before(6), last(6, 6)))
            .otherwise(t)
        )

    return F.when(text.contains(":"), _once(F.rtrim(text, F.lit("\r\n")), joined)).otherwise(text)


def _fit(text: Column, kind: Column, start: str) -> Column:
    """The text, whose shape begins like this, parsed by the one format whose shapes hold its own."""
    chain = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for pattern, own in _SHAPES[start].items():
        chain = chain.when(kind.isin(own), F.try_to_timestamp(text, F.lit(pattern)))
    return chain


_WIDTHS = {
    "yyyy": ["9999"], "MMMM": ["a" * n for n in range(4, 10)], "MMM": ["aaa"], "MM": ["99"], "dd": ["99"], "HH": ["99"], "mm": ["99"], "ss": ["99"],
    "M": ["9", "99"], "d": ["9", "99"], "H": ["9", "99"], "h": ["9", "99"], "a": ["aa"], "X": ["a"], "'T'": ["a"],
}


def _kind(text: Column) -> Column:
    """The shape of a text, digits as 9 and letters as a."""
    return F.mask(text, F.lit("a"), F.lit("a"), F.lit("9"), F.lit(None))


def shapes(pattern: str) -> list[str]:
    """The shapes of all texts that a format can fit."""
    tokens = re.findall(r"'T'|y+|M+|d+|H+|h+|m+|s+|a|X|[^A-Za-z]", pattern)
    return ["".join(x) for x in product(*[_WIDTHS.get(t, [t]) for t in tokens])]


# By how they begin, the longest fitting beginning first.
_SHAPES: dict[str, dict[str, list[str]]] = {"9999-": {}, "9999": {}, "": {}}
for _pattern in PLAIN_FORMATS:
    _own = shapes(_pattern)
    _SHAPES[next(x for x in _SHAPES if _own[0].startswith(x))][_pattern] = _own
# A day and a month are of one or two digits each, whichever comes first.
_SWAPPED_SHAPES = {(x, rest): shapes(f"M{x}d{x}{rest}") for x, rest in SWAPPED_REST}


def _swapped(text: Column, kind: Column, day_first: bool) -> Column:
    """Texts like 03/04/2024, as ``date_text`` gives them."""
    chain = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for (x, rest), own in _SWAPPED_SHAPES.items():
        orders = [(DAY_FIRST[x], f"d{x}M{x}{rest}"), (MONTH_FIRST[x], f"M{x}d{x}{rest}")]
        (one, first), (other, second) = orders if day_first else orders[::-1]
        parsed = lambda pattern: F.try_to_timestamp(text, F.lit(pattern))
        chain = chain.when(kind.isin(own), F.when(text.rlike(one), parsed(first)).when(text.rlike(other), parsed(second)))
    return chain


def parse_with(column: Column, strftime_format: str) -> Column:
    return F.try_to_timestamp(F.trim(column), F.lit(java_pattern(strftime_format)))


def java_pattern(strftime_format: str) -> str:
    out, i = [], 0
    while i < len(strftime_format):
        pair = strftime_format[i : i + 2]
        if pair in STRFTIME:
            out.append(STRFTIME[pair])
            i += 2
        else:
            letter = strftime_format[i]
            out.append(f"'{letter}'" if letter.isalpha() else letter)
            i += 1
    return "".join(out)


def month_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")
