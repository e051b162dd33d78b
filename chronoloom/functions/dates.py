"""Temporal expressions in text, as one array column of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_FIRSTS = "janfebmaraprmayjunjulaugsepoctnovdec"
REFERENCE = "array<struct<kind:string,start:date,end:date,days:int,months:int,label:string>>"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _part(match: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(match, pattern, group)


def _count(match: Column, pattern: str) -> Column:
    """The number in a match; one of over 300 million, seven times which no int holds, is the highest that is."""
    n = F.coalesce(_part(match, pattern, 1).try_cast("bigint"), F.lit(300_000_000))
    return F.least(n, F.lit(300_000_000)).cast("int")


def _month(name: Column) -> Column:
    return ((F.instr(F.lit(_FIRSTS), F.substring(F.lower(name), 1, 3)) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _made(kind: str, start: Column, end: Column, label: Column, days: Column | None = None, months: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (none if days is None else days.cast("int")).alias("days"), (none if months is None else months.cast("int")).alias("months"), label.alias("label"))


def _dated(found: Column, kind: str, date) -> Column:
    return F.filter(F.transform(found, lambda m: _made(kind, date(m), date(m), m)), lambda x: x["start"].isNotNull())


def iso_dates(text: Column) -> Column:
    """Full dates; one that is not in the calendar is dropped."""
    return _dated(_found(text, r"\b\d{4}-\d{2}-\d{2}\b"), "date", lambda m: m.try_cast("date"))


def iso_months(text: Column) -> Column:
    """``2026-03`` as its first day, unless it begins a full date, valid or not."""
    return _dated(_found(text, r"\b\d{4}-\d{2}\b(?!-\d{2}\b)"), "date", lambda m: F.concat(m, F.lit("-01")).try_cast("date"))


def written_dates(text: Column) -> Column:
    """``March 11, 2026``, then ``11 March 2026``, then ``March 2026`` as its first day."""
    a, b = rf"(?i)\b({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", rf"(?i)\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b"
    c = rf"(?i)(?<!\b\d{{1,2}}\s)\b({_MONTH})\s+(\d{{4}})\b"
    first = _dated(_found(text, a), "date", lambda m: _date(_part(m, a, 3), _month(_part(m, a, 1)), _part(m, a, 2)))
    second = _dated(_found(text, b), "date", lambda m: _date(_part(m, b, 3), _month(_part(m, b, 2)), _part(m, b, 1)))
    d = rf"(?i)({_MONTH})\s+(\d{{4}})"
    third = _dated(_found(text, c), "date", lambda m: _date(_part(m, d, 2), _month(_part(m, d, 1)), F.lit(1)))
    return F.concat(first, second, third)


def relative_dates(text: Column, day: Column) -> Column:
    """today, yesterday and tomorrow once each; every ``N days|weeks ago``; last week and last month (30 days)."""
    none = F.array().cast(REFERENCE)
    once = lambda word, n: F.when(text.rlike(rf"(?i)\b{word}\b"), F.array(_made("relative", F.date_add(day, n), F.date_add(day, n), F.lit(word), F.lit(n)))).otherwise(none)
    ago = r"(?i)\b(\d+)\s+(day|week)s?\s+ago\b"

    def back(m: Column) -> Column:
        n = -_count(m, ago) * F.when(F.lower(_part(m, ago, 2)) == "week", 7).otherwise(1)
        # before the calendar begins there is an offset and no date
        at = F.when(F.datediff(day, F.lit("0001-01-01").cast("date")) + n >= 0, F.date_add(day, n))
        return _made("relative", at, at, m, n)

    return F.concat(once("today", 0), once("yesterday", -1), once("tomorrow", 1), F.transform(_found(text, ago), back), once("last week", -7), once("last month", -30))


def fiscal_dates(text: Column) -> Column:
    """``Q2 2026`` as its quarter, ``FY2026`` and ``FY26`` as calendar years; a short year that a long one names is dropped."""
    q, long, short = r"\bQ([1-4])\s+(\d{4})\b", r"\bFY(\d{4})\b", r"\bFY(\d{2})\b"

    def quarter(m: Column) -> Column:
        month = (_part(m, q, 1).cast("int") - 1) * 3 + 1
        return _made("range", _date(_part(m, q, 2), month, F.lit(1)), F.last_day(_date(_part(m, q, 2), month + 2, F.lit(1))), m)

    year = lambda y, m: _made("range", _date(y, F.lit(1), F.lit(1)), _date(y, F.lit(12), F.lit(31)), m)
    longs = _found(text, long)
    shorts = F.filter(_found(text, short), lambda m: ~F.array_contains(longs, F.concat(F.lit("FY20"), F.substring(m, 3, 2))))
    return F.concat(F.transform(_found(text, q), quarter), F.transform(longs, lambda m: year(_part(m, long, 1), m)), F.transform(shorts, lambda m: year(F.concat(F.lit("20"), _part(m, short, 1)), m)))


def durations(text: Column) -> Column:
    """``for|over N months|weeks|days``."""
    p = r"(?i)\b(?:for|over)\s+(\d+)\s+(month|week|day)s?\b"
    none = F.lit(None).cast("date")

    def made(m: Column) -> Column:
        n, unit = _count(m, p), F.lower(_part(m, p, 2))
        return _made("duration", none, none, m, F.when(unit == "week", n * 7).when(unit == "day", n), F.when(unit == "month", n))

    return F.transform(_found(text, p), made)


#: What a text must hold for a layer to find anything in it: one cheap search instead of many.
_HINTS = {
    "date": r"(?i)\b\d{4}-\d{2}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d", "relative": r"(?i)today|yesterday|tomorrow|ago\b|last\s", "range": r"\bQ[1-4]\s|\bFY\d", "duration": r"(?i)\b(for|over)\s+\d",
}


def references(df: DataFrame, text: str, moment: str, kinds: tuple[str, ...] = tuple(_HINTS)) -> DataFrame:
    """All rows, one a reference, in the order of the layers; ``moment`` is what relative words are counted from.

    Only layers of ``kinds`` (date, relative, range, duration) are evaluated, each only on texts that may hold any.
    """
    t, day = F.col(text), F.to_date(F.col(moment))
    layers = {"date": lambda: F.concat(iso_dates(t), iso_months(t), written_dates(t)), "relative": lambda: relative_dates(t, day), "range": lambda: fiscal_dates(t), "duration": lambda: durations(t)}
    none = F.array().cast(REFERENCE)
    every = [F.when(t.rlike(_HINTS[k]), layers[k]()).otherwise(none) for k in layers if k in kinds]
    return df.withColumn("ref", F.explode(F.concat(*every))).select(*[c for c in df.columns], "ref.*")
