"""Schedules out of notices: ordered rules on sentences, else dates and ranges with what stands around them.

Every rule names a pattern and which of its groups make up the two ends of a schedule. The first
rule that matches a text gives its candidates; all candidates pass the same checks. Everything
is an expression over the text and the day that relative words refer to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dates import DATE_TOKEN, dates_conflict, document_subject
from corpusloom.session import once, spread

DAY = r"(?:(\d{4})년\s*)?(\d{1,2})월\s*(\d{1,2})일(?:\s*\([월화수목금토일]\))?"
CLOCK = r"(\d{1,2}):(\d{2})"
REST = r"[^.\n]*\.?"
MOMENT = "struct<y:int,m:int,d:int,h:int,mi:int>"
HIT = f"struct<rule:string,quote:string,start:{MOMENT},end:{MOMENT},title:string,conflict:boolean>"


@dataclass(frozen=True)
class Hit:
    """A pattern and the groups of year, month, day, hour and minute of its ends; 0 where it has none."""

    pattern: str
    start: tuple[int, ...] = ()
    end: tuple[int, ...] = ()


@dataclass(frozen=True)
class Rule:
    """needs: patterns that must all occur. all_day, confirmed, unconfirmed and reason say what is sure of its candidates."""

    name: str
    kind: str
    hits: tuple[Hit, ...]
    needs: tuple[str, ...] = ()
    unconfirmed: tuple[str, ...] = ()
    reason: str | None = None
    confirmed: bool = False
    all_day: bool = False
    action: str | None = None
    dated: bool = True  # whether its days may be written down as such


# The rules in the order in which they are tried.
RULES: tuple[Rule, ...] = (
    Rule("cancelled", "event", (Hit(rf"{DAY}(?:\s*{CLOCK})?[^.\n]*취소{REST}", (1, 2, 3, 4, 5)),), ("취소",), confirmed=True, action="cancel"),
    Rule("midnight", "deadline", (Hit(rf"{DAY}\s*자정까지{REST}", end=(1, 2, 3)),), unconfirmed=("time", "exact_boundary"), reason="midnight may begin or end the day", dated=False),
    Rule("split_sentence", "period", (Hit(rf"{DAY}부터\s*{DAY}까지(?=[\s\S]*?마감일\s*{CLOCK})", (1, 2, 3), (4, 5, 6, 7, 8)),), unconfirmed=("start_time",), confirmed=True),
    Rule("first_come", "period", (Hit(rf"{DAY}\s*{CLOCK}\s*오픈\s*~\s*{DAY}\s*{CLOCK}\s*마감", (1, 2, 3, 4, 5), (6, 7, 8, 9, 10)),), ("선착순", "조기"), reason="may close early", confirmed=True),
    Rule("daily", "period", (Hit(rf"{DAY}\s*~\s*{DAY}\s*매일\s*{CLOCK}\s*~\s*{CLOCK}", (1, 2, 3, 7, 8), (4, 5, 6, 9, 10)),), unconfirmed=("daily_recurrence_pattern",), reason="hours of every day", confirmed=True),
    Rule("rounds", "event", (Hit(rf"1차\s*{DAY}\s*{CLOCK}", (1, 2, 3, 4, 5)), Hit(rf"2차\s*{DAY}\s*{CLOCK}", (1, 2, 3, 4, 5))), ("1시간 진행",), confirmed=True),
    Rule("staged", "deadline", (Hit(rf"{DAY}\s*{CLOCK}까지(?=[\s\S]*?{DAY}\s*{CLOCK}까지)", end=(1, 2, 3, 4, 5)), Hit(rf"(?<=까지)[^.\n]*?{DAY}\s*{CLOCK}까지", end=(1, 2, 3, 4, 5))), confirmed=True),
    Rule("extended", "deadline", (Hit(rf"당초\s*{DAY}에서\s*{DAY}(?:\s*{CLOCK})?로\s*연장", end=(4, 5, 6, 7, 8)),), reason="an earlier deadline is named too", confirmed=True),
    Rule("vague", "period", (Hit(rf"\d{{1,2}}월\s*말경{REST}"),), unconfirmed=("start_date", "end_date", "time"), reason="no day is named", all_day=True),
    Rule("past_and_future", "deadline", (Hit(rf"{DAY}\s*{CLOCK}까지", end=(1, 2, 3, 4, 5)),), (rf"지난\s*{DAY}",), confirmed=True),
    Rule("urgent", "deadline", (Hit(rf"금일\s*\({DAY}\)\s*{CLOCK}\s*까지", end=(0, 0, 0, 4, 5)),), confirmed=True),
    Rule("today", "deadline", (Hit(r"오늘\s*(\d{1,2})시\s*까지", end=(0, 0, 0, 1, 0)),), confirmed=True),
    Rule("tomorrow", "event", (Hit(r"내일\s*(?:(오전|오후)\s*)?(\d{1,2})(?:시(?:\s*(\d{1,2})분)?|:(\d{2}))에?"),), unconfirmed=("end_time",), reason="no end is named", confirmed=True),
    Rule("next_monday", "deadline", (Hit(rf"다음\s*주\s*월요일까지{REST}"),), unconfirmed=("time", "exact_boundary"), reason="no hour is named", all_day=True),
    Rule("this_friday", "deadline", (Hit(r"이번\s*주\s*금요일까지"),), unconfirmed=("time",), reason="no hour is named", all_day=True),
    Rule("range_with_times", "period", (Hit(rf"{DAY}\s*{CLOCK}부터\s*{DAY}\s*{CLOCK}까지", (1, 2, 3, 4, 5), (6, 7, 8, 9, 10)),), confirmed=True),
    Rule("range", "period", (Hit(rf"{DAY}부터\s*{DAY}까지{REST}", (1, 2, 3), (4, 5, 6)),), unconfirmed=("time",), reason="no hours are named", all_day=True),
    Rule("holiday", "all_day", (Hit(rf"{DAY}[은는]?[^.\n]*(?:휴업|휴일|공휴일){REST}", (1, 2, 3), (1, 2, 3)),), unconfirmed=("time",), reason="a whole day", all_day=True),
    Rule("deadline", "deadline", (Hit(rf"{DAY}\s*{CLOCK}까지", end=(1, 2, 3, 4, 5)),), confirmed=True),
)
RELATIVE = ("urgent", "today", "tomorrow", "next_monday", "this_friday")
# Kinds of what is found around dates when no rule matches; their reasons follow from what a date lacks.
AROUND = {"dated_range": "period", "hours": "event", "dated": "deadline"}


def _of_day(day: Column, h: Column | None = None, mi: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), (none if h is None else h).alias("h"), (none if mi is None else mi).alias("mi")).cast(MOMENT)


def _first_rule(text: Column) -> Column:
    """Number of the first rule whose patterns all occur, from 1; null without one."""
    every = lambda r: reduce(lambda a, b: a & b, [text.rlike(p) for p in (*r.needs, *(h.pattern for h in r.hits))])
    return F.coalesce(*[F.when(every(r), F.lit(i)) for i, r in enumerate(RULES, 1)])


def _specs() -> Column:
    """The rules' patterns and groups as one array, so that a text reads those of its rule alone."""
    whole = lambda groups: F.array(*[F.lit(g) for g in (*groups, 0, 0, 0, 0, 0)[:5]])
    hit = lambda r, h: F.struct(F.lit(r.name).alias("rule"), F.lit(h.pattern).alias("pattern"), whole(h.start).alias("start"), whole(h.end).alias("end"), F.lit(len(h.start) > 0).alias("starts"), F.lit(len(h.end) > 0).alias("ends"))
    return F.array(*[F.array(*[hit(r, h) for h in r.hits]) for r in RULES])


def _ruled(text: Column, ref: Column, specs: Column) -> Column:
    """array of hits of a rule's specs in a text. A year that is not written is the other end's, one more if the month wraps, or the reference's."""
    group = lambda spec, i: F.call_function("regexp_extract", text, spec["pattern"], i)
    number = lambda spec, i: F.when(i > 0, group(spec, i).try_cast("int"))

    def moment(spec: Column, side: str, given: Column) -> Column:
        # An hour of the reference day; but a day that is written beside it and does not exist is kept, so that it shows as such.
        written = F.when((spec["rule"] == "urgent") & F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(ref), number(spec, F.lit(2)), number(spec, F.lit(3)))).isNull(), True)
        today = (F.get(spec[side], F.lit(1)) == 0) & written.isNull()
        at = lambda k: number(spec, F.when(written & F.lit(k in (1, 2)), F.lit(k + 1)).otherwise(F.get(spec[side], F.lit(k))))
        made = F.struct(
            F.when(today, F.year(ref)).otherwise(at(0)).alias("y"), F.when(today, F.month(ref)).otherwise(at(1)).alias("m"), F.when(today, F.dayofmonth(ref)).otherwise(at(2)).alias("d"),
            at(3).alias("h"), F.coalesce(at(4), F.when(at(3).isNotNull(), 0)).alias("mi"),
        ).cast(MOMENT)
        return F.when(given, made)

    def read(spec: Column) -> Column:
        return F.struct(
            spec["rule"].alias("rule"), F.trim(group(spec, F.lit(0))).alias("quote"), moment(spec, "start", spec["starts"]).alias("start"), moment(spec, "end", spec["ends"]).alias("end"),
            number(spec, F.when(spec["rule"] == "tomorrow", 2).otherwise(0)).alias("hour"), F.when(spec["rule"] == "tomorrow", group(spec, F.lit(1))).alias("half"),
            F.when(spec["rule"] == "tomorrow", F.coalesce(number(spec, F.lit(3)), number(spec, F.lit(4)), F.lit(0))).alias("minute"),
        )

    def finish(x: Column) -> Column:
        year = lambda m: F.struct(F.coalesce(m["y"], F.year(ref)).alias("y"), m["m"].alias("m"), m["d"].alias("d"), m["h"].alias("h"), m["mi"].alias("mi")).cast(MOMENT)
        after = F.when(x["start"].isNotNull(), F.coalesce(x["start"]["y"], F.year(ref)) + F.when(x["end"]["m"] < x["start"]["m"], 1).otherwise(0))
        end = F.when(x["end"].isNotNull(), year(F.struct(F.coalesce(x["end"]["y"], after).alias("y"), x["end"]["m"].alias("m"), x["end"]["d"].alias("d"), x["end"]["h"].alias("h"), x["end"]["mi"].alias("mi"))))
        start = F.when(x["start"].isNotNull(), year(x["start"]))
        hour = x["hour"] + F.when((x["half"] == "오후") & (x["hour"] < 12), 12).otherwise(0)
        later = F.when(x["start"].isNotNull(), _hour_later(start))
        return F.struct(
            x["rule"].alias("rule"), x["quote"].alias("quote"), F.when(x["rule"] == "tomorrow", _of_day(F.date_add(ref, 1), hour, x["minute"])).otherwise(start).alias("start"),
            F.when(x["rule"] == "next_monday", _of_day(F.date_add(ref, 7 - F.weekday(ref)))).when(x["rule"] == "this_friday", _of_day(F.date_add(ref, 4 - F.weekday(ref)))).when(x["rule"] == "rounds", later).otherwise(end).alias("end"),
            _titled(text, x["rule"], x["quote"]).alias("title"), F.lit(False).alias("conflict"),
        ).cast(HIT)

    return F.transform(F.transform(specs, read), finish)


def _hour_later(m: Column) -> Column:
    """A moment an hour on, also over midnight and the end of a month or year; one that does not exist stays as it is."""
    at = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d", m["y"], m["m"], m["d"], m["h"], m["mi"]), F.lit("yyyy-MM-dd HH:mm")) + F.expr("INTERVAL 1 HOUR")
    return F.when(at.isNotNull(), F.struct(F.year(at).alias("y"), F.month(at).alias("m"), F.dayofmonth(at).alias("d"), F.hour(at).alias("h"), F.minute(at).alias("mi")).cast(MOMENT)).otherwise(m)


# What a deadline of today asks for, and what of a title says nothing.
URGENT_TASK = r"([^\n,]+?)(?:오류자\s*)?(정보\s*수정|신청서\s*제출|서류\s*제출|제출|마감|접수)"
TODAY_TASK = r"([^\n,.]+?(?:신청서|신청|보고서|과제|서류|제출서|계획서|원서))(?:\s*를|\s*을)?(?:\s*[^\n,.]+?)?\s*(제출|접수|등록)"
URGENT_END, TODAY_END = r"(?:필수|요망|바랍니다|합니다|\.|\s)+$", r"(?:합니다|하세요|바랍니다|필수|요망|\.|,|\s)+$"


def _titled(text: Column, rule: Column, quote: Column) -> Column:
    """A hit's title: rounds by what stands before the first and their number, deadlines of today by the task they name, others by _title()."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    at = F.position(quote, text)
    before, after = strip(F.substring(text, F.lit(1), at - 1)), strip(F.substring(text, at + F.length(quote), F.length(text)))
    first = F.regexp_extract(text, rf"^([\s\S]*?)1차\s*{DAY}\s*{CLOCK}", 1)
    prefix = F.coalesce(F.nullif(strip(F.regexp_replace(F.replace(first, F.lit(" 일정:"), F.lit("")), ":+$", "")), F.lit("")), F.lit("설명회"))
    or_before = lambda b: F.when(after != "", after).otherwise(b)
    ended = lambda c: F.when(c.endswith("마감"), c).otherwise(F.concat(c, F.lit(" 마감")))

    target = or_before(strip(F.replace(before, F.lit("[긴급]"), F.lit(""))))
    task = lambda pattern, i: strip(F.regexp_extract(target, pattern, i))
    urgent = F.when(target.rlike(URGENT_TASK), squeeze(ended(F.concat(task(URGENT_TASK, 1), F.lit(" "), task(URGENT_TASK, 2)))))
    urgent = urgent.otherwise(ended(F.coalesce(F.nullif(strip(F.regexp_replace(target, URGENT_END, "")), F.lit("")), F.lit("긴급 마감 일정"))))

    today_target = or_before(before)
    named, doing = F.regexp_extract(before, r"([^\n\s]+?)(?:은|는)", 1), F.regexp_extract(after, "(제출|접수|등록|마감)", 1)
    rest = strip(F.regexp_replace(today_target, TODAY_END, ""))
    part = lambda i: strip(F.regexp_extract(today_target, TODAY_TASK, i))
    today = (
        F.when(today_target.rlike(TODAY_TASK), F.concat(part(1), F.lit(" "), part(2)))
        .when(named != "", F.concat(named, F.lit(" "), F.when(doing != "", doing).otherwise("제출")))
        .when(rest != "", F.concat(rest, F.lit(" 마감"))).otherwise("일정 마감")
    )
    rounds = F.concat(prefix, F.lit(" "), F.substring(quote, 1, 2))
    return F.when(rule == "rounds", rounds).when(rule == "urgent", urgent).when(rule == "today", today).otherwise(_title(text, quote))


def _title(text: Column, quote: Column) -> Column:
    """What stands before a quote in its sentence, without brackets, term and particles; else what follows it."""
    at = F.position(quote, text)
    before = F.substring_index(F.substring(text, F.lit(1), at - 1), ".", -1)
    bare = F.regexp_replace(before, r"\[[^\]]*\]|\([^)]*\)|^\s*\d{4}학년도\s*\d학기|^\s*\d{4}-\d학기", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"(?:은|는|이|가|을|를)?\s*[:：,]?\s*$", ""))
    after = F.trim(F.regexp_replace(F.substring(text, at + F.length(quote), F.lit(40)), r"^\s*(?:은|는|까지|에)?\s*|[.\n][\s\S]*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(after, F.lit("")), F.lit("일정"))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,raw>> of a pattern's matches, places from 0, one after the other."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,raw:string>>")

    def add(acc: Column, raw: Column) -> Column:
        at = F.position(raw, text, acc["free"])
        span = F.struct((at - 1).alias("start"), (at - 1 + F.length(raw)).alias("end"), raw.alias("raw"))
        return F.struct(F.array_append(acc["spans"], span).alias("spans"), (at + F.length(raw)).alias("free"))

    return F.aggregate(found, F.struct(empty.alias("spans"), F.lit(1).alias("free")), add, lambda acc: acc["spans"])


def suppress_overlaps(weak: Column, strong: Column) -> Column:
    """Spans of weak that overlap none of strong."""
    return F.filter(weak, lambda w: ~F.exists(strong, lambda s: F.greatest(w["start"], s["start"]) < F.least(w["end"], s["end"])))


# How single dates, ranges, hours of a day and labels are written, and words that stand near dates.
_D = r"(?:\d{4}[.\-년/\s]+)?\d{1,2}[.\-월/]\s*\d{1,2}\.?(?:\s*일)?(?:\s*\([월화수목금토일]\))?"
RANGE = rf"({_D}(?:\s*\d{{1,2}}:\d{{2}})?)(?:\s*(?:~|∼|-)\s*)({_D}(?:\s*\d{{1,2}}:\d{{2}})?(?:\s*까지)?)"
HOURS = rf"({_D})[\s/]+(\d{{1,2}}:\d{{2}})\s*(?:~|∼|-)\s*(\d{{1,2}}:\d{{2}})"
SINGLE = rf"(?<!\d){_D}(?:\s*\d{{1,2}}:\d{{2}})?(?:\s*(?:까지|에))?(?!\d)"
LABEL = r"^(?:[0-9]+[.)\s]+|[가-하ㄱ-ㅎ][.)]\s*|[-*•]\s+)?([^\n:：]+?)\s*[:：]\s*$"
NEAR_DATES = "마감|제출|접수|등록|일시|면접|행사|시험|개최|특강|진행"
GENERAL = "기간|일정|신청|접수|등록|납부|제출|운영"


def _part(raw: Column, i: int) -> Column:
    return F.regexp_extract(raw, DATE_TOKEN, i).try_cast("int")


def _token(raw: Column, other: Column | None, text_year: Column, ref: Column) -> Column:
    """A date as a moment: its year, else its range's (one more if the month wraps), the text's, the one whose weekday fits, the reference's."""
    y, m, d = _part(raw, 1), _part(raw, 2), _part(raw, 3)
    day = F.array_position(F.array(*[F.lit(c) for c in "월화수목금토일"]), F.regexp_extract(raw, DATE_TOKEN, 4)).cast("int") - 1
    paired = F.lit(None).cast("int") if other is None else _part(other, 1) + F.when(m < _part(other, 2), 1).otherwise(0)
    fits = [F.when((day >= 0) & (F.weekday(F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(ref) + k, m, d))) == day), F.year(ref) + k) for k in (0, 1, -1)]
    year = F.coalesce(y, paired, text_year, *fits, F.year(ref))
    return F.struct(year.alias("y"), m.alias("m"), d.alias("d"), _part(raw, 5).alias("h"), _part(raw, 6).alias("mi")).cast(MOMENT)


def _lines(part: Column) -> Column:
    return F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _with_dates(rows: DataFrame) -> DataFrame:
    """Adds _around: hits of ranges, hours of a day and single dates of `text`, weaker ones only where no stronger one stands.

    Every step is a column of its own, so that none is worked out twice.
    """
    text, ref = F.col("text"), F.col("ref")
    first = F.substring_index(text, "\n", 1)
    year = F.coalesce(F.regexp_extract(text, r"(\d{4})학년도", 1).try_cast("int"), F.regexp_extract(F.substring(text, 1, 300), r"(\d{4})년", 1).try_cast("int"))
    out = rows.withColumns({"_year": year, "_headline": F.when(first.rlike("안내|모집|공고|선발|계획") & (F.length(F.trim(first)) > 10), F.trim(first)), "_from": F.length(first), "_subject": document_subject(text)})
    below = lambda spans: F.filter(spans, lambda s: F.col("_headline").isNull() | (s["start"] >= F.col("_from")))
    for name, pattern, stronger in (("_ranges", RANGE, ()), ("_hours", HOURS, ("_ranges",)), ("_singles", SINGLE, ("_ranges", "_hours"))):
        out = out.withColumn(name, below(match_spans(text, pattern)))
        if stronger:
            out = out.withColumn(name, suppress_overlaps(F.col(name), F.concat(*stronger)))

    def context(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 199, F.lit(1)), F.least(s["start"], F.lit(200)))
        return F.struct(s["raw"].alias("raw"), F.trim(F.substring_index(before, "\n", -1)).alias("prefix"), _lines(before).alias("above"), _lines(F.substring(text, s["end"] + 1, F.lit(200))).alias("under"),
                        F.substring(text, F.greatest(s["start"] - 49, F.lit(1)), s["end"] - s["start"] + 100).alias("near"))

    def parts(c: Column) -> Column:
        next_ = F.get(F.filter(c["under"], lambda x: ~x.rlike(r"^(?:-|\*|①|1\)|※|http|202|~)")), F.lit(0))
        last = F.get(F.reverse(c["above"]), F.lit(0))
        step = F.get(F.reverse(F.filter(c["above"], lambda x: x.rlike(r"^\d+단계"))), F.lit(0))
        return F.struct(
            c["raw"].alias("raw"), c["near"].alias("near"), F.nullif(F.trim(F.regexp_extract(c["prefix"], LABEL, 1)), F.lit("")).alias("label"),
            F.when(c["prefix"].contains("\t"), F.nullif(F.trim(F.substring_index(c["prefix"], "\t", 1)), F.lit(""))).alias("cell"), step.alias("step"),
            F.coalesce(F.nullif(F.regexp_extract(next_, r"^\[([^\n\]]+)\]", 1), F.lit("")), next_).alias("next"), F.when(step.isNull() & ~last.rlike("구 분|기간|대상|일정"), last).alias("row"),
        )

    def named(p: Column) -> Column:
        staged = F.concat(p["step"], F.lit(" ["), p["next"], F.lit("]"))
        item = F.coalesce(p["label"], p["cell"], staged, p["row"], p["next"], p["step"], F.lit("일정"))
        return F.struct(p["raw"].alias("raw"), p["near"].alias("near"), p["label"].alias("label"), item.alias("item"), F.coalesce(staged, p["next"], p["step"], F.lit("일정")).alias("hour_item"))

    for name in ("_ranges", "_hours", "_singles"):
        for step in (context, parts, named):
            out = out.withColumn(name, F.transform(name, step))
    none, no, subject = F.lit(None).cast(MOMENT), F.lit(False), F.col("_subject")
    token = lambda raw, other=None: _token(raw, other, F.col("_year"), ref)
    hit = lambda rule, s, start, end, title, conflict: F.struct(F.lit(rule).alias("rule"), F.trim(s["raw"]).alias("quote"), start.alias("start"), end.alias("end"), title.alias("title"), conflict.alias("conflict")).cast(HIT)

    def of_range(s: Column) -> Column:
        a, b, item = F.regexp_extract(s["raw"], RANGE, 1), F.regexp_extract(s["raw"], RANGE, 2), s["item"]
        joined = F.when(subject.endswith("신청") & item.startswith("신청"), F.concat(subject, F.lit(" "), F.trim(F.substring(item, F.lit(3), F.length(item))))).otherwise(F.concat(subject, F.lit(" "), item))
        whole = F.when(item == "일정", subject).otherwise(joined)
        title = F.when((subject != "") & item.rlike(GENERAL) & ~F.contains(item, subject) & ~item.contains("단계"), whole).otherwise(item)
        differs = item.rlike("신청|접수|모집|등록") & dates_conflict(F.coalesce("_headline", F.lit("")), _part(a, 2), _part(a, 3), _part(b, 2), _part(b, 3))
        return hit("dated_range", s, token(a, b), token(b, a), F.trim(F.regexp_replace(title, r"\s+", " ")), F.coalesce(differs, no))

    def of_hours(s: Column) -> Column:
        day = token(F.regexp_extract(s["raw"], HOURS, 1))
        at = lambda i, k: F.regexp_extract(F.regexp_extract(s["raw"], HOURS, i), CLOCK, k).try_cast("int")
        moment = lambda i: F.struct(day["y"].alias("y"), day["m"].alias("m"), day["d"].alias("d"), at(i, 1).alias("h"), at(i, 2).alias("mi")).cast(MOMENT)
        return hit("hours", s, moment(2), moment(3), F.trim(F.regexp_replace(s["hour_item"], r"\s+", " ")), no)

    def of_single(s: Column) -> Column:
        suffix, title = F.regexp_extract(s["raw"], DATE_TOKEN, 7), F.coalesce(s["label"], F.nullif(subject, F.lit("")), F.lit("일정 마감"))
        due = (suffix == "까지") | title.rlike("마감|제출|접수|등록|납부|까지") | (s["near"].contains("까지") & ~title.rlike("일시|면접|행사"))
        counts = (_part(s["raw"], 5).isNotNull() | (suffix != "") | s["near"].rlike(NEAR_DATES)) & _part(s["raw"], 2).between(1, 12) & _part(s["raw"], 3).between(1, 31)
        at = token(s["raw"])
        made = hit("dated", s, F.when(~due, at).otherwise(none), F.when(due, at).otherwise(none), title, no)
        return F.when(counts, F.struct(s["label"].isNotNull().alias("labelled"), made.alias("hit")))

    out = out.withColumns({"_strong": F.concat(F.transform("_ranges", of_range), F.transform("_hours", of_hours)), "_weak": F.array_compact(F.transform("_singles", of_single))})
    # Dates without a label of their own count only where nothing else was found, and then the first alone.
    labelled = F.filter("_weak", lambda x: x["labelled"])
    chosen = F.when((F.size("_strong") > 0) | (F.size(labelled) > 0), labelled).otherwise(F.slice("_weak", 1, 1))
    return out.withColumn("_around", F.concat("_strong", F.transform(chosen, lambda x: x["hit"])))


def extract_schedules(docs: DataFrame, zone: str = "+09:00") -> DataFrame:
    """doc_id, place, rule, kind, title, start_date, end_date, start_at, end_at, all_day, confirmed, unconfirmed, ambiguous,
    reason, action, options, quote of every schedule of docs (doc_id, content, ref).

    ref: the day that relative words refer to. Null and empty texts have none. The checks are
    those of checked().
    """
    rows = spread(docs.select("doc_id", "ref", F.coalesce("content", F.lit("")).alias("text")))
    rows = once(once(rows, "text", F.col("text")), "_rule", _first_rule(F.col("text")))
    # The rules' table is a column, which keeps the expression over it small.
    by_rule = rows.filter("_rule IS NOT NULL").withColumn("_specs", F.element_at(_specs(), F.col("_rule"))).withColumn("_hits", _ruled(F.col("text"), F.col("ref"), F.col("_specs")))
    around = _with_dates(rows.filter("_rule IS NULL")).withColumn("_hits", F.col("_around"))
    hits = by_rule.select("doc_id", "text", "_hits").unionByName(around.select("doc_id", "text", "_hits"))
    # An outer one, because the filter on empty arrays that the optimizer puts below another would work out all hits twice.
    placed = hits.select("doc_id", "text", F.posexplode_outer("_hits").alias("place", "hit")).filter("place IS NOT NULL")
    return checked(placed.select("doc_id", "text", "place", "hit.*"), zone)


def checked(hits: DataFrame, zone: str = "+09:00") -> DataFrame:
    """Candidates from hits (doc_id, text, place, rule, quote, start, end, title, conflict) after the common checks.

    A day or time that does not exist and ends in the wrong order leave no date and are named in
    `unconfirmed`; 24:00 is left open; a time counts as confirmed only if the text holds one.
    """
    of = {r.name: r for r in RULES}

    def by_rule(value, other):
        out = other
        for name in of:
            given = value(of[name])
            out = F.when(F.col("rule") == name, F.lit(given) if not isinstance(given, Column) else given).otherwise(out)
        return out

    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    day = lambda p: F.format_string("%04d-%02d-%02d", F.col(f"{p}.y"), F.col(f"{p}.m"), F.col(f"{p}.d"))
    has = lambda p: F.col(f"{p}.m").isNotNull()
    timed = lambda p: F.col(f"{p}.h").isNotNull()
    midnight = lambda p: timed(p) & (F.col(f"{p}.h") == 24) & (F.col(f"{p}.mi") == 0)
    real_time = lambda p: F.col(f"{p}.h").between(0, 23) & F.col(f"{p}.mi").between(0, 59)
    no_day = lambda p: has(p) & F.try_to_date(day(p), "yyyy-MM-dd").isNull()
    no_time = lambda p: timed(p) & ~real_time(p) & ~midnight(p)
    at = lambda p: F.when(has(p) & timed(p) & ~midnight(p), F.concat(day(p), F.format_string("T%02d:%02d:00", F.col(f"{p}.h"), F.col(f"{p}.mi")), F.lit(zone)))
    rows = hits.withColumns({
        "_day_error": F.coalesce(no_day("start"), F.lit(False)) | F.coalesce(no_day("end"), F.lit(False)),
        "_start_error": F.coalesce(no_time("start"), F.lit(False)), "_end_error": F.coalesce(no_time("end"), F.lit(False)),
        "_open": F.coalesce(midnight("start"), F.lit(False)) | F.coalesce(midnight("end"), F.lit(False)),
    })
    moment = lambda p: F.concat(day(p), F.format_string("T%02d:%02d", F.coalesce(f"{p}.h", F.lit(0)), F.coalesce(f"{p}.mi", F.lit(0))))
    fine = ~F.col("_day_error") & ~F.col("_start_error") & ~F.col("_end_error")
    rows = rows.withColumn("_order_error", F.coalesce(fine & has("start") & has("end") & (moment("start") > moment("end")), F.lit(False)))
    ruled = F.col("rule").isin(*of)
    due, event = (F.col("rule") == "dated") & has("end"), (F.col("rule") == "dated") & has("start")
    grounded = F.col("text").rlike(r"(?:^|\D)\d{1,2}:\d{2}(?:\D|$)|\d{1,2}시|자정|오전|오후")
    any_time = (timed("start") & real_time("start") & ~midnight("start")) | (timed("end") & real_time("end") & ~midnight("end"))
    any_time = F.coalesce(any_time, F.lit(False))
    lost = F.col("_day_error") | F.col("_order_error")
    dated = by_rule(lambda r: r.dated, F.lit(True))
    keep_start, keep_end = ~lost & ~F.col("_start_error") & dated, ~lost & ~F.col("_end_error") & dated
    lacks = F.array_compact(F.array(
        F.when(~ruled & (F.col("rule") == "dated_range") & ~timed("start"), "start_time"), F.when(~ruled & ((((F.col("rule") == "dated_range") | due) & ~timed("end")) | (event & ~timed("start"))), "time"),
        F.when(event & timed("start"), "end_time"),
    ))
    errors = F.array_compact(F.array(
        F.when(F.col("_day_error"), "exact_date"), F.when(F.col("_start_error") | F.col("_end_error") | F.col("_open"), "time"), F.when(F.col("_open"), "exact_boundary"), F.when(F.col("_order_error"), "period_order"),
    ))
    reasons = F.array_compact(F.array(
        by_rule(lambda r: F.lit(r.reason).cast("string"), F.when((F.col("rule") == "dated") & ~any_time, "no hour is named").when(event, "no end is named")),
        F.when(F.col("_day_error"), "no such day"), F.when(F.col("_start_error") | F.col("_end_error"), "no such time"), F.when(F.col("_open"), "24:00 may end or begin a day"),
        F.when(F.col("_order_error"), "start after end"), F.when(F.col("conflict"), "headline names other days"),
    ))
    bad = lost | F.col("_start_error") | F.col("_end_error")
    ambiguous = F.size(reasons) > 0
    around = F.create_map(*[F.lit(x) for pair in AROUND.items() for x in pair])
    kind = F.coalesce(by_rule(lambda r: r.kind, F.lit(None).cast("string")), F.when(event, F.when(timed("start"), "event").otherwise("all_day")).otherwise(around[F.col("rule")]))
    sure = F.when(ruled, by_rule(lambda r: r.confirmed, F.lit(False))).otherwise(any_time & (~ambiguous | event)) & any_time & grounded & ~bad & ~F.col("_open")
    options = F.when(F.col("rule") == "midnight", F.array(F.concat(day("end"), F.lit(f"T23:59:59{zone}")), F.concat(day("end"), F.lit(f"T00:00:00{zone}"))))
    end_day = F.when(event & ~timed("start"), day("start")).otherwise(F.when(has("end"), day("end")))
    return rows.select(
        "doc_id", "place", "rule", kind.alias("kind"), "title", F.when(keep_start & has("start"), day("start")).alias("start_date"), F.when(keep_end, end_day).alias("end_date"),
        F.when(keep_start & grounded, at("start")).alias("start_at"), F.when(keep_end & grounded, at("end")).alias("end_at"),
        F.when(ruled, by_rule(lambda r: r.all_day, F.lit(False))).otherwise(~any_time).alias("all_day"), F.coalesce(sure, F.lit(False)).alias("confirmed"),
        F.array_distinct(F.concat(by_rule(lambda r: names(r.unconfirmed), lacks), errors)).alias("unconfirmed"), ambiguous.alias("ambiguous"), F.nullif(F.array_join(reasons, ", "), F.lit("")).alias("reason"),
        by_rule(lambda r: F.lit(r.action).cast("string"), F.lit(None).cast("string")).alias("action"), options.alias("options"), "quote",
    )
