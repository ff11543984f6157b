"""Dates and times in text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_iso_utc(text: Column) -> Column:
    """Timestamps YYYY-MM-DD, YYYY.MM.DD or YYYYMMDD with an optional time and zone, in UTC; else null.

    One separator throughout, real dates and times (the basic form has none), zones as Z or
    offsets up to 23:59 without a blank before them; at most 6 digits of a second are kept, and
    no zone is UTC.
    """
    date = r"(\d{4})([-.])(\d{2})\2(\d{2})"
    clock = r"(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?)?"
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")  # the basic form has no time
    pattern = rf"^{date}{clock}\z"
    y, mo, d = (_number(text, pattern, g) for g in (1, 3, 4))
    h, mi, s = (F.coalesce(_number(text, pattern, g), F.lit(0)) for g in (5, 6, 7))
    micro = F.rpad(F.substring(F.regexp_extract(text, pattern, 8), 1, 6), 6, "0").cast("int")
    zone = F.regexp_replace(F.regexp_extract(text, pattern, 9), ":", "")
    off_h, off_m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    offset = F.when(zone.rlike(r"^[+-]"), (off_h * 60 + off_m) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    fine = text.rlike(pattern) & (h < 24) & (mi < 60) & (s < 60) & (~zone.rlike(r"^[+-]") | ((off_h < 24) & (off_m < 60)))
    stamp = F.try_make_timestamp(y, mo, d, h, mi, (s + micro / 1e6).cast("decimal(16,6)"))
    return F.when(fine, F.timestamp_micros(F.unix_micros(stamp) - offset.cast("long") * 60_000_000))


def normalize_date(text: Column, today: Column) -> Column:
    """YYYY-MM-DD of six spellings (parts joined by -, . or /; with - or . also with a time), else the first ten characters; today where empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")
    head = F.substring(t, 1, 19)
    day, clock = r"(\d{4})([-./])(\d{1,2})\2(\d{1,2})", r"\d{1,2}:\d{1,2}:\d{1,2}"
    spelled = rf"^{day}(?:(?<=^\d{{4}}-\d{{1,2}}-\d{{1,2}})[T ]{clock}|(?<=^\d{{4}}\.\d{{1,2}}\.\d{{1,2}}) {clock})?\z"
    part = lambda i: F.lpad(F.regexp_extract(head, spelled, i), 2, "0")
    made = F.try_to_date(F.concat_ws("-", F.regexp_extract(head, spelled, 1), part(3), part(4)))
    return F.when(t == "", today).otherwise(F.coalesce(F.when(head.rlike(spelled), made.cast("string")), F.substring(t, 1, 10)))


def first_long(columns: Sequence[Column]) -> Column:
    """The first column of eight characters or more, its first ten."""
    return F.coalesce(*[F.when(F.length(c) >= 8, F.substring(c, 1, 10)) for c in columns])


def month_days(text: Column) -> Column:
    """Dates 'M월 D일' and 'M.D' of a text as MM-DD, in order, each once; impossible ones left out."""
    pattern = r"(?<![\d.])(\d{1,2})(?:월\s*|\.)(\d{1,2})(?:일|(?![\d.]))"
    months = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    days = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    both = F.zip_with(months, days, lambda m, d: F.struct(m.cast("int").alias("m"), d.cast("int").alias("d")))
    real = F.filter(both, lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    return F.array_distinct(F.transform(real, lambda x: F.concat(F.lpad(x["m"].cast("string"), 2, "0"), F.lit("-"), F.lpad(x["d"].cast("string"), 2, "0"))))


def relative_date(word: Column, ref: Column) -> Column:
    """today, tomorrow, this Friday, next Monday from a reference date; else null."""
    day = F.weekday(ref)  # Monday is 0
    return (
        F.when(word == "today", ref).when(word == "tomorrow", F.date_add(ref, 1))
        .when(word == "this friday", F.date_add(ref, 4 - day)).when(word == "next monday", F.date_add(ref, 7 - day))
    )


def infer_year(year: Column, month: Column, day: Column, weekday: Column, paired_year: Column, paired_month: Column, text_year: Column, ref_year: Column) -> Column:
    """Year of a date without one: its own, its range's start (one more if the month wraps), the text's, the one of
    ref, ref + 1, ref - 1 whose weekday fits, else ref's."""
    fits = [F.when(F.weekday(F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day))) == weekday, y) for y in (ref_year, ref_year + 1, ref_year - 1)]
    paired = F.when(paired_year.isNotNull(), F.when(month < paired_month, paired_year + 1).otherwise(paired_year))
    return F.coalesce(year, paired, text_year, *fits, ref_year)


# Names of the days of a week, and how a date is written.
WEEKDAYS = "월화수목금토일"
DATE_TOKEN = r"(?:(\d{4})[.\-년/\s]+)?(\d{1,2})[.\-월/]\s*(\d{1,2})\.?(?:\s*일)?(?:\s*\(([월화수목금토일])\))?(?:\s*(\d{1,2}):(\d{2}))?(?:\s*(까지|에))?"


def date_token(text: Column) -> Column:
    """struct of the first date of a text: raw, year, month, day, weekday (Monday 0), hour, minute, suffix; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(text, DATE_TOKEN, i), F.lit(""))
    number = lambda i: part(i).cast("int")
    weekday = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), part(4)).cast("int") - 1
    token = F.struct(
        part(0).alias("raw"), number(1).alias("year"), number(2).alias("month"), number(3).alias("day"), weekday.alias("weekday"),
        number(5).alias("hour"), number(6).alias("minute"), part(7).alias("suffix"),
    )
    return F.when(text.rlike(DATE_TOKEN), token)


def document_subject(text: Column) -> Column:
    """What a document is about: its labelled line among the first 25, else the first of its first five lines that is a
    name and no greeting or date, without words like 'notice' at its end; else its first line."""
    # Labels of names, calls and greetings.
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")
    named = r"(?:프로그램명|사업명|행사명|공지명|과정명)\s*:\s*(\S[^\n]*)"
    calls = r"^([^\n]+?)\s*(?:참가자를?\s*)?모집합니다"
    untermed = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d{4}학년도\s*\d학기\s*", ""))
    labels = F.filter(F.slice(lines, 1, 25), lambda x: x.rlike(named))

    def usable(x: Column) -> Column:
        greeting = x.rlike("안녕하세요|선발|모집합니다|안내하오니")
        called = F.when(x.rlike(calls), untermed(F.regexp_extract(x, calls, 1)))
        clean = F.trim(F.regexp_replace(F.regexp_replace(x, r"^[<>\[\]★ \t]+|[<>\[\]★ \t]+\z", ""), r"\s*(?:안내|시행\s*안내|모집|선발|공고|계획)\z", ""))
        plain = F.when(~clean.rlike(r"[~∼:：]|\d{1,2}[./월-]\s*\d{1,2}") & (F.length(clean) >= 2) & ~clean.startswith("http"), clean)
        return F.when(greeting, called).otherwise(plain)

    found = F.filter(F.transform(F.slice(lines, 1, 5), usable), lambda x: x.isNotNull())
    label = F.transform(F.slice(labels, 1, 1), lambda x: untermed(F.regexp_extract(x, named, 1)))
    return F.coalesce(F.get(F.concat(label, found, F.slice(lines, 1, 1)), F.lit(0)), F.lit(""))


def dates_conflict(headline: Column, start_month: Column, start_day: Column, end_month: Column, end_day: Column) -> Column:
    """Whether a headline names a day that is neither end of a range: such a range must be looked at again."""
    pattern = F.lit(DATE_TOKEN)
    months, days = F.regexp_extract_all(headline, pattern, F.lit(2)), F.regexp_extract_all(headline, pattern, F.lit(3))
    named = F.filter(F.zip_with(months, days, lambda m, d: F.struct(m.cast("int").alias("m"), d.cast("int").alias("d"))), lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    at = lambda x, m, d: (x["m"] == m) & (x["d"] == d)
    return F.exists(named, lambda x: ~(at(x, start_month, start_day) | at(x, end_month, end_day)))


def utc_of(text: Column) -> Column:
    """A timestamp with a zone as UTC; null for one without zone or time, and for plain numbers."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})\s*$"), parse_iso_utc(text))


def on_local_date(text: Column, day: Column, zone: Column) -> Column:
    """Whether a timestamp falls on a day in a zone; null where the timestamp is not acceptable."""
    return F.to_date(F.from_utc_timestamp(utc_of(text), zone)) == day
