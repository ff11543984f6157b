"""Schedules: overlap, listing, validation, sessions, and dates out of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.dates import on_local_date, utc_of

# The kinds of a schedule and what each needs.
NEEDS = {"event": ("start",), "period": ("start", "end"), "deadline": ("end",), "all_day": ("start",), "undated": ()}


def overlapping(schedules: DataFrame, since: Column, until: Column) -> DataFrame:
    """Schedules that touch a range; one end alone stands for both."""
    return schedules.filter((F.coalesce("start", "end") <= until) & (F.coalesce("end", "start") >= since))


def overlap_pairs(a: DataFrame, b: DataFrame, by: str, bucket_days: int = 7) -> DataFrame:
    """(a_id, b_id) of schedules of the same `by` that overlap. Days are cut into buckets, so that the join is on equal
    keys; a pair counts in the bucket where its overlap begins."""
    def bucketed(df: DataFrame, p: str) -> DataFrame:
        s, e = F.coalesce("start", "end"), F.coalesce("end", "start")
        n = lambda d: F.floor(F.unix_date(d) / bucket_days)
        rows = df.select(F.col("id").alias(f"{p}_id"), F.col(by), s.alias(f"{p}_s"), e.alias(f"{p}_e")).filter(F.col(f"{p}_s") <= F.col(f"{p}_e"))
        return rows.withColumn("bucket", F.explode(F.sequence(n(F.col(f"{p}_s")), n(F.col(f"{p}_e")))))

    j = bucketed(a, "a").join(bucketed(b, "b"), [by, "bucket"])
    begins = F.greatest("a_s", "b_s")
    return j.filter((F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")) & (F.col("bucket") == F.floor(F.unix_date(begins) / bucket_days))).select("a_id", "b_id")


def page(schedules: DataFrame, by: str, limit: int, offset: int, wanted: Column | None = None) -> DataFrame:
    """A page of each user's wanted schedules by start, else end, and id, with the number of all that are wanted.

    wanted: any condition on range, completion and priority; see wanted_schedules().
    """
    rows = schedules if wanted is None else schedules.filter(wanted)
    w = Window.partitionBy(by).orderBy(F.coalesce("start", "end"), "id")
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    n = F.row_number().over(w)
    return rows.withColumn("place", n).filter((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(totals, by)


def wanted_schedules(since: Column | None = None, until: Column | None = None, completed: bool | None = None, priority: str | None = None) -> Column:
    """Schedules that touch a range, that are completed or not, and of a priority; what is None does not count."""
    out = F.lit(True)
    if until is not None:
        out = out & (F.coalesce("start", "end") <= until)
    if since is not None:
        out = out & (F.coalesce("end", "start") >= since)
    if completed is not None:
        out = out & (F.col("completed") == completed)
    return out & (F.col("priority") == priority) if priority else out


def violations(zone: str = "Asia/Seoul") -> Column:
    """What breaks the contract of a schedule's kind, as an array: kind, priority, zone, title, ends that lack or are
    forbidden, their order, and times that do not fall on their days in the zone.

    Columns: kind, priority, start, end (dates), and, where a schedule has times, start_at, end_at (texts with an offset), zone, title.
    """
    checks = [
        F.when(~F.col("kind").isin(*NEEDS), "unknown_kind"), F.when(~F.coalesce(F.col("priority"), F.lit("")).isin("HIGH", "MEDIUM", "LOW"), "bad_priority"),
        F.when(F.coalesce("zone", F.lit(zone)) != zone, "unknown_zone"), F.when(~F.length(F.trim(F.coalesce("title", F.lit("")))).between(1, 200), "bad_title"),
        F.when(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") < F.col("start")), "end_before_start"),
        F.when((F.col("kind") == "undated") & (F.col("start").isNotNull() | F.col("end").isNotNull()), "date_forbidden"),
        F.when((F.col("kind") == "deadline") & F.col("start").isNotNull(), "start_forbidden"),
        F.when((F.col("kind") == "all_day") & (F.col("start_at").isNotNull() | F.col("end_at").isNotNull()), "time_forbidden"),
        F.when(utc_of(F.col("end_at")) < utc_of(F.col("start_at")), "end_time_before_start_time"),
    ]
    for end in ("start", "end"):
        at = F.col(f"{end}_at")
        checks += [F.when(at.isNotNull() & utc_of(at).isNull(), f"bad_{end}_time"), F.when(~on_local_date(at, F.col(end), F.lit(zone)), f"{end}_time_on_another_day")]
    checks += [F.when((F.col("kind") == kind) & F.col(end).isNull(), f"{end}_required") for kind, ends in NEEDS.items() for end in ends]
    return F.array_sort(F.array_compact(F.array(*checks)))


def validate(schedules: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """id, violations and the row in its normal form: title trimmed, times in UTC. Columns that lack are null."""
    held = set(schedules.columns)
    rows = schedules.withColumns({c: F.lit(None).cast("string") for c in ("start_at", "end_at", "zone") if c not in held} | ({} if "title" in held else {"title": F.lit("-")}))
    return rows.select("id", violations(zone).alias("violations"), F.trim("title").alias("title"), utc_of(F.col("start_at")).alias("start_utc"), utc_of(F.col("end_at")).alias("end_utc"))


def patched(schedules: DataFrame, patches: DataFrame, fields: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """Rows with the fields that a patch sends (listed in `sent`) laid over; refused, and left as it was, is one that sends a
    required field as null. What then breaks the contract is for validate()."""
    j = schedules.alias("s").join(patches.alias("p"), "id", "left")
    sent = lambda f: F.coalesce(F.array_contains("p.sent", f), F.lit(False))
    refused = F.lit(False)
    for f in required:
        refused = refused | (sent(f) & F.col(f"p.{f}").isNull())
    others = [F.col(f"s.{c}").alias(c) for c in schedules.columns if c not in (*fields, "id")]
    cols = [F.when(sent(f) & ~refused, F.col(f"p.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields]
    return j.select("id", *cols, *others, refused.alias("refused"))


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return live.join(users, "user_id")


def calendar_events(docs: DataFrame) -> DataFrame:
    """doc_id, place, span, name, start, end of the events in calendars that give dates and names on lines of their own.

    Lines are trimmed and empty ones left out. A line that begins with a date (YYYY.MM.DD and
    whatever stands behind it, as a weekday) takes the next line for its name; if that is a lone
    `~` and another date follows, the three lines are the span and the fourth the name. Lines once
    taken begin no other event, so that a date in a name's place is a name. Events without a name,
    or whose lines hold runs of blanks, give none; one that a document repeats counts where it is
    first. `place` counts a document's events from 0; `start` and `end` are null where a span
    names a day that does not exist. Null and empty contents have no events.
    """
    trimmed = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")
    # A cursor that consumes: matches do not overlap, and each takes the most lines that it can.
    date = r"\d{4}\.\d{2}\.\d{2}[^\n]*"
    taken = F.regexp_extract_all(lines, F.lit(rf"(?<![^\n]){date}(?:\n~\n{date})?(?:\n[^\n]*)?"), F.lit(0))
    parts = F.transform(taken, lambda t: F.split(t, "\n"))
    ranged = lambda p: F.coalesce((F.get(p, F.lit(1)) == "~") & F.get(p, F.lit(2)).rlike(r"^\d{4}\.\d{2}\.\d{2}"), F.lit(False))
    span = lambda p: F.when(ranged(p), F.concat(F.get(p, F.lit(0)), F.lit(" ~ "), F.get(p, F.lit(2)))).otherwise(F.get(p, F.lit(0)))
    name = lambda p: F.when(ranged(p), F.get(p, F.lit(3))).otherwise(F.get(p, F.lit(1)))
    targets = F.array_distinct(F.array_compact(F.transform(parts, lambda p: F.concat(span(p), F.lit("\n"), name(p)))))
    plain = F.filter(targets, lambda t: ~t.rlike(r"(?U)[^\S\n ]|  "))
    events = docs.select("doc_id", F.explode(F.transform(plain, lambda t, i: F.struct(i.alias("place"), t.alias("t")))).alias("e"))
    found = events.select("doc_id", F.col("e.place").alias("place"), F.split_part("e.t", F.lit("\n"), F.lit(1)).alias("span"), F.split_part("e.t", F.lit("\n"), F.lit(2)).alias("name"))
    day = lambda pattern: F.try_to_date(F.regexp_extract("span", pattern, 1), "yyyy.MM.dd")
    start, end = day(r"^(\d{4}\.\d{2}\.\d{2})"), day(r"^[^~]* ~ (\d{4}\.\d{2}\.\d{2})")
    return found.select("doc_id", "place", "span", "name", start.alias("start"), F.when(F.col("span").rlike(r" ~ \d{4}\.\d{2}\.\d{2}"), end).otherwise(start).alias("end"))


def date_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end, title of lines 'date[ ~ date] title', or a date line and the title in the next.

    Dates are YYYY.MM.DD or YYYY-MM-DD, also with a weekday in brackets behind; impossible ones
    give no row. Spans over several lines are for calendar_events().
    """
    day = r"((?:19|20)\d{2})[.-](\d{1,2})[.-](\d{1,2})(?:\s*\([^()\n]{1,3}\))?"
    pattern = rf"^\s*{day}(?:\s*~\s*{day})?\s*(.*?)\s*$"
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    w = Window.partitionBy("doc_id").orderBy("line")
    g = lambda i: F.regexp_extract("text", pattern, i)
    made = lambda a: F.try_to_date(F.concat_ws("-", g(a), F.lpad(g(a + 1), 2, "0"), F.lpad(g(a + 2), 2, "0")))
    rows = lines.withColumn("next", F.lead("text").over(w)).filter(F.col("text").rlike(pattern))
    title = F.when(g(7) != "", g(7)).when(~F.col("next").rlike(pattern), F.trim("next"))
    found = rows.select("doc_id", "line", made(1).alias("start"), F.when(g(4) != "", made(4)).otherwise(made(1)).alias("end"), title.alias("title"))
    return found.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end")) & (F.coalesce("title", F.lit("")) != ""))
