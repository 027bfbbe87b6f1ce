"""Dates in many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_YEAR = r"((?:19|20)\d\d)"


def _month(name: Column) -> Column:
    names = {m: i for i, m in enumerate(_MONTHS, 1)} | {m[:3]: i for i, m in enumerate(_MONTHS, 1)} | {"sept": 9}
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), name)


def _iso(text: Column, pattern: str, order: str, named: bool = False) -> Column:
    """'YYYY-MM-DD' where the pattern's three groups, in the order of `order`, are a year, a month and a day; else null."""
    g = {c: F.regexp_extract(text, pattern, i) for i, c in enumerate(order, 1)}
    month = F.lpad(_month(g["m"]).cast("string"), 2, "0") if named else F.lpad(g["m"], 2, "0")
    year = F.when(F.length(g["y"]) == 2, F.concat(F.lit("20"), g["y"])).otherwise(g["y"])
    return F.when((g["y"] != "") & month.isNotNull(), F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(g["d"], 2, "0")))


def loose_date(text: Column) -> Column:
    """The first spelling that holds, as YYYY-MM-DD; '' if none. RFC 2822 goes first; day first with dots, month first with slashes."""
    low = F.lower(F.trim(text))
    return F.coalesce(
        _iso(low, r"^(?:[a-z]{3},?\s+)?(\d{1,2})\s+([a-z]{3})\s+(\d{4}|\d\d)\s+\d{1,2}:\d\d", "dmy", named=True),
        _iso(low, rf"{_YEAR}년\s*(\d{{1,2}})월\s*(\d{{1,2}})일", "ymd"),
        _iso(low, rf"\b{_YEAR}[-/.](\d{{1,2}})[-/.](\d{{1,2}})\b", "ymd"),
        _iso(low, rf"\b([a-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+{_YEAR}\b", "mdy", named=True),
        _iso(low, rf"\b(\d{{1,2}})\.?\s+([a-z]{{3,9}})\.?,?\s+{_YEAR}\b", "dmy", named=True),
        _iso(low, rf"\b(\d{{1,2}})\.(\d{{1,2}})\.{_YEAR}\b", "dmy"),
        _iso(low, rf"\b(\d{{1,2}})/(\d{{1,2}})/{_YEAR}\b", "mdy"),
        _iso(low, r"\b(\d{1,2})/(\d{1,2})/(\d\d)\b", "mdy"),
        F.lit(""),
    )


def human_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def spellings(day: Column) -> Column:
    """The ways in which a question may name a day, in lower case."""
    month, dom, m = F.lower(F.date_format(day, "MMMM")), F.dayofmonth(day).cast("string"), F.month(day).cast("string")
    short = F.left(month, F.lit(3))
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    return F.array(
        F.date_format(day, "yyyy-MM-dd"), c(month, " ", dom), c(short, " ", dom), *(c(month, " ", dom, end) for end in ("th", "st", "nd", "rd")),
        c(dom, " ", month), c(dom, " ", short), c(m, "/", dom), c(m, "/", dom, "/", F.year(day).cast("string")), c(m, "월 ", dom, "일"),
    )
