"""Tags, dates in text, schedules and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.functions import text as T
from corpusloom.operators import extraction, reports
from corpusloom.operators import schedules as S
from corpusloom.operators import tagging
from corpusloom.plans import Registry
from corpusloom.plans.corpus import DOCUMENTS_SQL, documents
from corpusloom.session import table

R = Registry()

TITLES = (("THE", "[Tt]he "), ("ION", "ion[ .,]"), ("AUX", "aux"), ("VER", "ver"))
BODIES = (("OF", " of "), ("LA", " la "), ("DER", " der "))
OTHERS = " que | und "
# Titles and what each says about its notice, its term and its readers, written down by hand.
_NOTICES = (
    ("[정정] 2026학년도 1학기 수강신청 안내", "correction", 2026, "1", ["재학생"]), ("수강신청 정정 안내", "announcement", None, None, []), ("장학금 신청 기간 연장", "extension", None, None, []),
    ("2025-2학기 폐강 과목", "cancellation", 2025, "2", []), ("최종 합격 공지 신입생", "result", None, None, ["신입생"]), ("2026 하계 계절학기 학부생 모집", "announcement", 2026, "summer", ["학부생"]),
    ("(수정) 2026년도 동계 계절 수업", "correction", 2026, "winter", []), ("예비군 외국인 유학생 공지", "announcement", None, None, ["외국인 유학생", "예비군"]),
)


def tagged(spark, sf_dir):
    return tagging.tag_topics(documents(spark, sf_dir), TITLES, BODIES, OTHERS)


def _sql_matches(text, rules):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN {{'topic': '{t}', 'quote': regexp_extract({text}, '{p}')}} END" for t, p in rules) + "], lambda x: x IS NOT NULL)"


TAGGED_SQL = DOCUMENTS_SQL + f""", m AS (
  SELECT *, {_sql_matches('title', TITLES)} AS bt, {_sql_matches('substr(content, 1, 1500)', BODIES)} AS bb, title || ' ' || substr(content, 1, 1000) AS head FROM base
), hits AS (
  SELECT *, CASE WHEN len(bt) > 0 THEN bt[1:2] WHEN len(bb) > 0 THEN bb[1:2] WHEN regexp_matches(head, '{OTHERS}') THEN [{{'topic': 'OTHER', 'quote': regexp_extract(head, '{OTHERS}')}}]
    ELSE [{{'topic': 'UNCLASSIFIED', 'quote': ''}}] END AS hit FROM m
), tagged AS (SELECT doc_id, title, list_transform(hit, lambda x: x.topic) AS topics, list_filter(list_transform(hit, lambda x: x.quote), lambda q: q <> '') AS evidence FROM hits)"""


@R.add("tag_topics", f"WITH {TAGGED_SQL} SELECT doc_id, topics, evidence FROM tagged")
def tag_topics(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", "topics", "evidence")


@R.add("topic_counts", f"WITH {TAGGED_SQL} SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM tagged) GROUP BY topic")
def topic_counts(spark, sf_dir):
    return tagging.topic_counts(tagged(spark, sf_dir))


def _notices(spark, sf_dir):
    n = F.pmod(F.col("doc_id"), F.lit(len(_NOTICES)))
    title = F.element_at(F.array(*[F.lit(t[0]) for t in _NOTICES]), (n + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", title.alias("title"), F.when(F.col("doc_id") % 3 == 0, "재학생 대상").otherwise(F.col("content")).alias("content"))


_NOTICE_SQL = f"""notices AS (SELECT doc_id, doc_id % {len(_NOTICES)} + 1 AS i, doc_id % 3 = 0 AS addressed FROM documents)"""
_LISTS = "[" + ", ".join("[" + ", ".join(f"'{a}'" for a in t[4]) + "]::VARCHAR[]" for t in _NOTICES) + "]"
_GROUPS = "[" + ", ".join(f"'{a}'" for a in tagging.AUDIENCES) + "]"


@R.add("notice_kind", f"WITH {_NOTICE_SQL} SELECT [{', '.join(f"'{t[1]}'" for t in _NOTICES)}][i] AS kind, count(*) AS n FROM notices GROUP BY 1")
def notice_kind(spark, sf_dir):
    return _notices(spark, sf_dir).groupBy(tagging.notice_kind(F.col("title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add("tag_terms", f"""WITH {_NOTICE_SQL} SELECT doc_id, [{', '.join('NULL' if t[2] is None else str(t[2]) for t in _NOTICES)}][i]::INT AS year, [{', '.join('NULL' if t[3] is None else f"'{t[3]}'" for t in _NOTICES)}][i] AS semester FROM notices""")
def tag_terms(spark, sf_dir):
    return _notices(spark, sf_dir).select("doc_id", tagging.term_of(F.col("title"), F.col("content")).alias("t")).select("doc_id", "t.year", "t.semester")


@R.add("tag_audience", f"""WITH {_NOTICE_SQL} SELECT doc_id, list_filter({_GROUPS}, lambda g: list_contains({_LISTS}[i], g) OR (addressed AND g = '재학생')) AS audience FROM notices""")
def tag_audience(spark, sf_dir):
    # The first title addresses students by its text alone where doc_id divides by 3.
    n = _notices(spark, sf_dir).withColumn("title", F.when(F.col("title").startswith("[정정]"), F.concat("title", F.lit(" 재학생"))).otherwise(F.col("title")))
    return n.select("doc_id", tagging.audience(F.col("title"), F.col("content")).alias("audience"))


@R.add("tag_status_counts", f"""WITH {TAGGED_SQL} SELECT CASE WHEN list_contains(topics, 'UNCLASSIFIED') THEN 'unclassified' WHEN list_contains(topics, 'OTHER') THEN 'other' ELSE 'tagged' END AS status, count(*) AS n FROM tagged GROUP BY 1""")
def tag_status_counts(spark, sf_dir):
    return tagging.status_counts(tagged(spark, sf_dir))


@R.add("validate_tags", f"""WITH {TAGGED_SQL}, broken AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN list_append(topics, 'OTHER') ELSE topics END AS topics, CASE WHEN doc_id % 7 = 0 THEN ['nowhere in it'] ELSE evidence END AS evidence FROM tagged
), r AS (
  SELECT b.doc_id, list_filter([CASE WHEN d.doc_id IS NULL THEN 'unknown_document' END, CASE WHEN len(topics) NOT BETWEEN 1 AND 3 THEN 'topic_count' END,
    CASE WHEN list_has_any(topics, ['OTHER', 'UNCLASSIFIED']) AND len(topics) > 1 THEN 'not_alone' END,
    CASE WHEN d.doc_id IS NOT NULL AND len(list_filter(evidence, lambda q: NOT contains(d.title || ' ' || d.content, q))) > 0 THEN 'quote_missing' END], lambda x: x IS NOT NULL) AS reasons
  FROM broken b LEFT JOIN (SELECT * FROM base WHERE doc_id % 11 <> 0) d USING (doc_id))
SELECT doc_id, reasons FROM r WHERE len(reasons) > 0""")
def validate_tags(spark, sf_dir):
    n = F.col("doc_id")
    t = tagged(spark, sf_dir)
    broken = t.select("doc_id", F.when(n % 5 == 0, F.array_append("topics", "OTHER")).otherwise(F.col("topics")).alias("topics"), F.when(n % 7 == 0, F.array(F.lit("nowhere in it"))).otherwise(F.col("evidence")).alias("evidence"))
    return tagging.violations(broken, documents(spark, sf_dir).filter(n % 11 != 0))


@R.add("keyword_coverage", f"""WITH {DOCUMENTS_SQL}, h AS (
  SELECT source_type, list_filter([{', '.join(f"CASE WHEN regexp_matches(title || ' ' || content, '{p}') THEN '{t}' END" for t, p in BODIES)}], lambda x: x IS NOT NULL) AS hits FROM base
), e AS (SELECT source_type, unnest(CASE WHEN len(hits) > 0 THEN hits ELSE ['none'] END) AS rule FROM h)
SELECT rule, source_type, count(*) AS n FROM e GROUP BY ALL""")
def keyword_coverage(spark, sf_dir):
    return tagging.keyword_coverage(documents(spark, sf_dir), BODIES)


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
# Spellings of a timestamp after its day, and what each is in UTC: seconds to add, or null where it is refused.
_TAILS = (
    ("", 0), ("T10:20:30.25+09:00", 4830.25), (" 23:59Z", 86340), ("T10:20:30+24:00", None), (" later", None), ("T25:00", None), ("T00:00:00-0130", 5400), ("T00:00+09:60", None),
    ("T00:00z", None), ("T00:00 +09:00", None), ("T01:02:03.1234567Z", 3723.123456), ("T01:02.5", 3720.5),
)


def _stamps(spark, sf_dir):
    k, day = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    tail = F.element_at(F.array(*[F.lit(t) for t, _ in _TAILS]), (k % len(_TAILS) + 1).cast("int"))
    form = F.floor(k / len(_TAILS)) % 4
    head = F.when(form == 0, day("yyyy-MM-dd")).when(form == 1, day("yyyy.MM.dd")).when(form == 2, day("yyyyMMdd")).otherwise(day("yyyy-MM.dd"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(head, tail).alias("s"))


_STAMPS = f"""stamps AS (
  SELECT o_orderkey AS k, {_DAY} AS d, o_orderkey % {len(_TAILS)} AS tail, (o_orderkey // {len(_TAILS)}) % 4 AS form,
    [{', '.join(f"'{t}'" for t, _ in _TAILS)}][o_orderkey % {len(_TAILS)} + 1] AS after,
    [{', '.join('NULL' if n is None else str(int(n * 1_000_000)) for _, n in _TAILS)}]::BIGINT[] AS micros FROM orders)"""


@R.add("parse_iso_utc", f"""WITH {_STAMPS} SELECT k, CASE WHEN form < 2 OR (form = 2 AND tail = 0) THEN d::TIMESTAMP + to_microseconds(micros[tail + 1]) END AS at FROM stamps""")
def parse_iso_utc(spark, sf_dir):
    return _stamps(spark, sf_dir).select("k", D.parse_iso_utc(F.col("s")).cast("timestamp_ntz").alias("at"))


@R.add("normalize_date", """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 11 AS form FROM orders)
SELECT k, CASE WHEN form < 6 THEN d WHEN form = 6 THEN replace(d, '-', '/') WHEN form = 7 THEN substr(d, 3, 2) || '.' || substr(d, 6, 2)::INT || '.' || substr(d, 9, 2)::INT WHEN form = 8 THEN substr(d, 1, 4) || '-02-30' WHEN form = 9 THEN '2030-01-01' ELSE substr('notice ' || k, 1, 10) END AS day FROM o""")
def normalize_date(spark, sf_dir):
    k, day = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    forms = [
        day("yyyy-MM-dd"), day("yyyy.M.d"), day("yyyy/MM/dd"), F.concat(day("yyyy-MM-dd"), F.lit("T03:04:05")), F.concat(day("yyyy-M-d"), F.lit(" 3:4:5")), F.concat(day("yyyy.MM.dd"), F.lit(" 03:04:05")),
        F.concat(day("yyyy/MM/dd"), F.lit(" 03:04:05")), day("yy.M.d"), F.concat(day("yyyy"), F.lit("-02-30")), F.lit(" "), F.concat(F.lit("notice "), k.cast("string")),
    ]
    s = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.normalize_date(s, F.lit("2030-01-01")).alias("day"))


@R.add("title_terms", """WITH o AS (SELECT o_orderkey AS k, 2020 + o_orderkey % 10 AS y, (o_orderkey // 10 % 2 + 1)::VARCHAR AS t, o_orderkey // 20 % 6 AS form FROM orders)
SELECT k, y::INTEGER AS year, CASE form WHEN 1 THEN 'summer' WHEN 2 THEN 'winter' ELSE t END AS semester,
  CASE form WHEN 0 THEN y || '학년도 ' || t || '학기' WHEN 1 THEN y || '년도 하계 계절학기' WHEN 2 THEN y || ' 동계 ' WHEN 3 THEN y || '-' || t || '학기' WHEN 4 THEN y || '년 ' || t || '학기' ELSE y || t || '학기' END AS quote FROM o""")
def title_terms(spark, sf_dir):
    k = F.col("o_orderkey")
    y, t, form = (2020 + k % 10).cast("string"), (F.floor(k / 10) % 2 + 1).cast("string"), F.floor(k / 20) % 6
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    title = F.when(form == 0, say(y, "학년도 ", t, "학기 ", F.col("o_orderpriority"))).when(form == 1, say("[", y, "년도 하계 계절학기] 안내")).when(form == 2, say(y, " 동계 수강")).when(form == 3, say("공지 ", y, "-", t, "학기")).otherwise("공지")
    content = F.when(form == 4, say("신청은 ", y, "년 ", t, "학기에")).when(form == 5, say("1", y, t, "학기")).otherwise(say("2019학년도 1학기"))
    terms = table(spark, sf_dir, "orders").select(k.alias("k"), tagging.term_of(title, content).alias("t"))
    return terms.select("k", "t.year", "t.semester", "t.quote")


_ASKED = """asked AS (
  SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y, substr(year(o_orderdate)::VARCHAR, 3, 2) AS yy, month(o_orderdate) AS m, day(o_orderdate) AS dd, (o_orderkey % 2 + 1)::VARCHAR AS t, o_orderkey % 8 AS form FROM orders)"""


def _asked(spark, sf_dir):
    k = F.col("o_orderkey")
    y, m, d, t = (f.cast("string") for f in (F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), k % 2 + 1))
    yy, say = F.substring(y, 3, 2), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        say(y, "학년도 ", t, "학기 등록금은 ", m, "월 ", d, "일 2차 납부 SAT"), say(yy, "년 ", t, "학기 장학금을 ", m, ".", d, " 까지"), say(m, "월 ", d, "일 수강신청은 언제"), F.lit("휴학 안내를 찾기"),
        say("'", yy, " ", t, "학기 공지"), say(yy, "-", t, "학기 수강"), say(y, "년 졸업"), say(y, " 학사일정 TOPCIT 특강"),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("q"))


@R.add("query_entities", f"""WITH {_ASKED} SELECT k, CASE WHEN form IN (0, 6, 7) THEN y WHEN form IN (1, 4, 5) THEN '20' || yy END AS year, CASE WHEN form NOT IN (2, 3) THEN chr(39) || yy END AS short_year,
  CASE WHEN form IN (0, 1, 4, 5) THEN t || '학기' END AS semester, CASE WHEN form = 0 THEN '2차' END AS round, CASE WHEN form IN (0, 2) THEN m END::INT AS month, CASE WHEN form IN (0, 2) THEN dd END::INT AS day FROM asked""")
def query_entities(spark, sf_dir):
    return _asked(spark, sf_dir).select("k", T.entities(F.col("q")).alias("e")).select("k", "e.*")


@R.add("question_terms", f"""WITH {_ASKED} SELECT k, CASE form WHEN 0 THEN [y || '-' || t] WHEN 1 THEN ['20' || yy || '-' || t] WHEN 5 THEN ['20' || yy || '-' || t] ELSE [] END AS pairs,
  CASE form WHEN 0 THEN ['학년', '등록금', '납부'] WHEN 1 THEN ['까지'] WHEN 2 THEN ['수강신청'] WHEN 3 THEN ['휴학', '찾기'] WHEN 4 THEN ['공지'] WHEN 5 THEN ['수강'] WHEN 6 THEN ['졸업'] ELSE ['학사일정', '특강'] END AS terms,
  CASE form WHEN 0 THEN ['sat'] WHEN 7 THEN ['topcit'] ELSE [] END AS distinctive FROM asked""")
def question_terms(spark, sf_dir):
    q = F.col("q")
    return _asked(spark, sf_dir).select("k", T.term_pairs(q).alias("pairs"), T.subject_terms(q).alias("terms"), T.distinctive_terms(q).alias("distinctive"))


@R.add("month_days", f"""WITH {_ASKED} SELECT k, CASE WHEN form < 3 THEN [lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0')] ELSE [] END AS days FROM asked""")
def month_days(spark, sf_dir):
    return _asked(spark, sf_dir).select("k", D.month_days(F.col("q")).alias("days"))


@R.add("relative_dates", """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE + 1 WHEN 2 THEN o_orderdate::DATE + (4 - (isodow(o_orderdate) - 1))::INT
  WHEN 3 THEN o_orderdate::DATE + (7 - (isodow(o_orderdate) - 1))::INT END AS day FROM orders""")
def relative_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("today", "tomorrow", "this friday", "next monday", "some day")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.relative_date(word, F.col("o_orderdate").cast("date")).alias("day"))


@R.add("infer_year", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 1990 WHEN 1 THEN CASE WHEN month(o_orderdate) < 6 THEN 1996 ELSE 1995 END WHEN 2 THEN 1994 ELSE year(o_orderdate) END::INT AS y FROM orders""")
def infer_year(spark, sf_dir):
    k, m, d = F.col("o_orderkey"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    only = lambda r, v: F.when(k % 4 == r, F.lit(v).cast("int"))
    y = D.infer_year(only(0, 1990), m, d, F.weekday("o_orderdate"), only(1, 1995), F.lit(6), only(2, 1994), F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), y.cast("int").alias("y"))


def schedules(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ship = i.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("ship"))
    k = F.col("o_orderkey")
    j = o.join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 6 != 0, F.col("o_orderdate").cast("date")).alias("start"), F.when(k % 7 != 0, F.col("ship")).alias("end"),
        F.element_at(F.array(*[F.lit(x) for x in ("event", "period", "deadline", "all_day", "undated", "odd")]), (k % 6 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "NONE")]), (k % 4 + 1).cast("int")).alias("priority"),
    )


_SCHEDULES = """schedules AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE END AS "start", CASE WHEN o_orderkey % 7 <> 0 THEN ship END AS "end",
    ['event','period','deadline','all_day','undated','odd'][(o_orderkey % 6 + 1)::INT] AS kind, ['HIGH','MEDIUM','LOW','NONE'][(o_orderkey % 4 + 1)::INT] AS priority
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


@R.add("schedule_overlap", f"""WITH {_SCHEDULES} SELECT id FROM schedules WHERE coalesce("start", "end") <= DATE '1996-03-31' AND coalesce("end", "start") >= DATE '1996-03-01'""")
def schedule_overlap(spark, sf_dir):
    return S.overlapping(schedules(spark, sf_dir), F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date")).select("id")


@R.add("schedule_conflicts", f"""WITH {_SCHEDULES}, s AS (SELECT id, user_id, coalesce("start", "end") AS s, coalesce("end", "start") AS e, kind FROM schedules)
SELECT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e WHERE a.kind = 'period' AND b.kind = 'event' AND a.s <= a.e AND b.s <= b.e""")
def schedule_conflicts(spark, sf_dir):
    s = schedules(spark, sf_dir)
    return S.overlap_pairs(s.filter("kind = 'period'"), s.filter("kind = 'event'"), "user_id")


@R.add("list_schedules", f"""WITH {_SCHEDULES} SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce("start", "end") NULLS FIRST, id) AS place, count(*) OVER (PARTITION BY user_id) AS total
FROM schedules QUALIFY place BETWEEN 4 AND 8""")
def list_schedules(spark, sf_dir):
    return S.page(schedules(spark, sf_dir), "user_id", 5, 3).select("id", "user_id", "place", "total")


@R.add("validate_schedule", f"""WITH {_SCHEDULES} SELECT id, list_sort(list_filter([CASE WHEN kind = 'odd' THEN 'unknown_kind' END, CASE WHEN priority = 'NONE' THEN 'bad_priority' END,
  CASE WHEN "end" < "start" THEN 'end_before_start' END, CASE WHEN kind = 'undated' AND ("start" IS NOT NULL OR "end" IS NOT NULL) THEN 'date_forbidden' END,
  CASE WHEN kind = 'deadline' AND "start" IS NOT NULL THEN 'start_forbidden' END, CASE WHEN kind IN ('event', 'period', 'all_day') AND "start" IS NULL THEN 'start_required' END,
  CASE WHEN kind IN ('period', 'deadline') AND "end" IS NULL THEN 'end_required' END], lambda x: x IS NOT NULL)) AS violations FROM schedules""")
def validate_schedule(spark, sf_dir):
    return S.validate(schedules(spark, sf_dir)).select("id", "violations")


@R.add("validate_schedule_times", f"""WITH {_SCHEDULES}, t AS (SELECT *, id % 5 AS f FROM schedules WHERE kind = 'period' AND priority <> 'NONE')
SELECT id, list_sort(list_filter([CASE WHEN "end" < "start" THEN 'end_before_start' END, CASE WHEN "start" IS NULL THEN 'start_required' END, CASE WHEN "end" IS NULL THEN 'end_required' END, CASE WHEN f = 1 THEN 'start_time_on_another_day' END,
  CASE WHEN f = 2 THEN 'bad_start_time' END, CASE WHEN f = 3 THEN 'unknown_zone' END, CASE WHEN f = 4 THEN 'bad_title' END], lambda x: x IS NOT NULL)) AS violations FROM t""")
def validate_schedule_times(spark, sf_dir):
    f = F.col("id") % 5
    s = schedules(spark, sf_dir).filter("kind = 'period' AND priority <> 'NONE'")
    at = F.concat(F.date_format("start", "yyyy-MM-dd"), F.when(f == 1, "T20:00:00Z").when(f == 2, "T08:00:00").otherwise("T08:00:00+09:00"))
    s = s.withColumns({"start_at": at, "end_at": F.lit(None).cast("string"), "zone": F.when(f == 3, "UTC").otherwise("Asia/Seoul"), "title": F.when(f == 4, " ").otherwise(" t ")})
    return S.validate(s).select("id", "violations")


@R.add("filtered_schedules", f"""WITH {_SCHEDULES} SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce("start", "end") NULLS FIRST, id) AS place, count(*) OVER (PARTITION BY user_id) AS total
FROM schedules WHERE coalesce("start", "end") <= DATE '1999-12-31' AND coalesce("end", "start") >= DATE '1996-01-01' AND id % 3 <> 0 AND priority = 'HIGH' QUALIFY place <= 5""")
def filtered_schedules(spark, sf_dir):
    wanted = S.wanted_schedules(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"), False, "HIGH")
    return S.page(schedules(spark, sf_dir).withColumn("completed", F.col("id") % 3 == 0), "user_id", 5, 0, wanted).select("id", "user_id", "place", "total")


@R.add("patch_state", f"""WITH {_SCHEDULES} SELECT id, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'event' ELSE kind END AS kind,
  CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN DATE '2000-01-01' ELSE "end" END AS "end", id % 10 = 0 AS refused FROM schedules""")
def patch_state(spark, sf_dir):
    s = schedules(spark, sf_dir)
    p = s.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 != 0, "event").alias("kind"), F.lit("2000-01-01").cast("date").alias("end"), F.array(F.lit("kind"), F.lit("end")).alias("sent"))
    return S.patched(s, p, ("kind", "end"), ("kind",)).select("id", "kind", "end", "refused")


@R.add("patched_violations", f"""WITH {_SCHEDULES}, p AS (SELECT *, id % 5 = 0 AND id % 10 <> 0 AS laid FROM schedules), q AS (SELECT id, priority, "start", CASE WHEN laid THEN 'event' ELSE kind END AS kind, CASE WHEN laid THEN DATE '2000-01-01' ELSE "end" END AS "end" FROM p)
SELECT id, len(list_filter([CASE WHEN kind = 'odd' THEN 1 END, CASE WHEN priority = 'NONE' THEN 1 END, CASE WHEN "end" < "start" THEN 1 END, CASE WHEN kind = 'undated' AND ("start" IS NOT NULL OR "end" IS NOT NULL) THEN 1 END,
  CASE WHEN kind = 'deadline' AND "start" IS NOT NULL THEN 1 END, CASE WHEN kind IN ('event', 'period', 'all_day') AND "start" IS NULL THEN 1 END, CASE WHEN kind IN ('period', 'deadline') AND "end" IS NULL THEN 1 END], lambda x: x IS NOT NULL))::INT AS n FROM q""")
def patched_violations(spark, sf_dir):
    s = schedules(spark, sf_dir)
    p = s.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 != 0, "event").alias("kind"), F.lit("2000-01-01").cast("date").alias("end"), F.array(F.lit("kind"), F.lit("end")).alias("sent"))
    return S.validate(S.patched(s, p, ("kind", "end"), ("kind",))).select("id", F.size("violations").alias("n"))


@R.add("valid_sessions", """SELECT event_id, c_custkey AS user_id, c_name AS name FROM events JOIN customer ON user_id = c_custkey
WHERE event_type = 'signup' AND event_id % 7 <> 0 AND ts + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 5 DAY FROM events)""")
def valid_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("now"))
    s = e.filter("event_type = 'signup'").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return S.valid_sessions(s.join(F.broadcast(now)), users, F.col("now")).select("event_id", "user_id", "name")


# Calendars of the customers, a line or several for each order: a span over four lines, a day and a name, the same between other
# lines and blanks, and an event that stands there twice. A day has its weekday behind it.
_WEEKDAYS = ("월", "화", "수", "목", "금", "토", "일")
_CALENDAR = f"""days AS (
  SELECT o_custkey, o_orderkey, o_orderdate AS d1, (o_orderdate + to_days((o_orderkey % 9)::INT))::DATE AS d2, o_orderpriority || ' ' || o_orderstatus || o_orderkey % 50 AS name FROM orders
), shown AS (
  SELECT *, strftime(d1, '%Y.%m.%d') || '(' || {list(_WEEKDAYS)}[isodow(d1)] || ')' AS t1, strftime(d2, '%Y.%m.%d') || '(' || {list(_WEEKDAYS)}[isodow(d2)] || ')' AS t2 FROM days
), firsts AS (
  SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN t1 || ' ~ ' || t2 ELSE t1 END AS span, name, d1::DATE AS "start", (CASE WHEN o_orderkey % 4 = 0 THEN d2 ELSE d1 END)::DATE AS "end", min(o_orderkey) AS k
  FROM shown GROUP BY ALL
), calendar AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS place, span, name, "start", "end" FROM firsts)"""


def calendar_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    shown = lambda d: F.concat(F.date_format(d, "yyyy.MM.dd"), F.lit("("), F.element_at(F.array(*map(F.lit, _WEEKDAYS)), F.weekday(d) + 1), F.lit(")"))
    day, later = F.col("o_orderdate"), F.date_add("o_orderdate", (k % 9).cast("int"))
    name = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", (k % 50).cast("string"))
    line = (
        F.when(k % 4 == 0, F.concat_ws("\n", shown(day), F.lit("~"), shown(later), name)).when(k % 4 == 1, F.concat_ws("\n", shown(day), name))
        .when(k % 4 == 2, F.concat_ws("\n", F.lit("안내 ~ 2026년"), F.concat(F.lit("  "), shown(day)), F.lit(" "), F.concat(F.lit("\t"), name, F.lit(" "))))
        .otherwise(F.concat_ws("\n", shown(day), name, shown(day), name))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"])
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(lines, "\n").alias("content"))


@R.add("calendar_lines", f'WITH {_CALENDAR} SELECT doc_id, place, span, name, "start", "end" FROM calendar')
def calendar_lines(spark, sf_dir):
    return S.calendar_events(calendar_documents(spark, sf_dir))


@R.add("event_questions", f"""WITH {_CALENDAR} SELECT doc_id, place, CASE WHEN place < 5 THEN 'dev' ELSE 'test' END AS split, '학사일정 중 ' || month("start") || '월에 진행되는 ''' || name || ''' 일정은 언제야?' AS question,
  '학사일정상 ' || month("start") || '월의 ''' || name || ''' 일정은 ' || span || '이다.' AS answer, span || ' ' || name AS quote FROM calendar""")
def event_questions(spark, sf_dir):
    return reports.event_questions(S.calendar_events(calendar_documents(spark, sf_dir)), "학사일정", 5, "doc_id")


@R.add("calendar_events", """WITH d AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS day, strftime(o_orderdate + INTERVAL 2 DAY, '%Y.%m.%d') AS later, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 2 THEN 'name ' ELSE 'event ' END || o_orderkey AS title, strptime(day, '%Y.%m.%d')::DATE AS "start",
  CASE WHEN o_orderkey % 3 = 1 THEN strptime(later, '%Y.%m.%d') ELSE strptime(day, '%Y.%m.%d') END::DATE AS "end" FROM d""")
def calendar_events(spark, sf_dir):
    k = F.col("o_orderkey")
    day, later = F.date_format("o_orderdate", "yyyy.MM.dd"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"), "yyyy.MM.dd")
    name = k.cast("string")
    line = (
        F.when(k % 3 == 0, F.concat(day, F.lit(" event "), name)).when(k % 3 == 1, F.concat(day, F.lit(" ~ "), later, F.lit(" event "), name))
        .otherwise(F.concat(day, F.lit("\n  name "), name))
    )
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return S.date_lines(docs).select("doc_id", "title", "start", "end")


# Notices about a day ({d}: month and day of the order) with the schedules that they hold, written down by hand:
# rule, kind, start and end (day: 0 for the order's, 1 for the next, 7 and 5 for the Monday and Friday meant; time), confirmed, ambiguous, unconfirmed.
_TEXTS = (
    ("[취소] {d} 14:00 행사는 취소되었습니다.", [("cancelled", "event", (0, "14:00"), None, True, False, [])]),
    ("보고서 제출은 {d} 자정까지입니다.", [("midnight", "deadline", None, None, False, True, ["time", "exact_boundary"])]),
    ("등록은 {d}부터 {d}까지입니다. 모든 접수는 마감일 17:30에 끝납니다.", [("split_sentence", "period", (0, None), (0, "17:30"), True, False, ["start_time"])]),
    ("부스 신청: {d} 09:00 오픈 ~ {d} 18:00 마감 (선착순, 조기 마감)", [("first_come", "period", (0, "09:00"), (0, "18:00"), True, True, [])]),
    ("정정 기간: {d} ~ {d} 매일 10:00~17:00", [("daily", "period", (0, "10:00"), (0, "17:00"), True, True, ["daily_recurrence_pattern"])]),
    ("설명회: 1차 {d} 11:00, 2차 {d} 16:00 (각 1시간 진행)", [("rounds", "event", (0, "11:00"), (0, "12:00"), True, False, []), ("rounds", "event", (0, "16:00"), (0, "17:00"), True, False, [])]),
    ("접수는 {d} 13:00까지이며, 납부는 {d} 15:00까지입니다.", [("staged", "deadline", None, (0, "13:00"), True, False, []), ("staged", "deadline", None, (0, "15:00"), True, False, [])]),
    ("마감이 당초 {d}에서 {d} 15:00로 연장되었습니다.", [("extended", "deadline", None, (0, "15:00"), True, True, [])]),
    ("신청은 10월 말경 시작됩니다.", [("vague", "period", None, None, False, True, ["start_date", "end_date", "time"])]),
    ("지난 {d} 시작되었고 과제는 {d} 23:59까지 냅니다.", [("past_and_future", "deadline", None, (0, "23:59"), True, False, [])]),
    ("금일(1월 1일) 17:00까지 수정", [("urgent", "deadline", None, (0, "17:00"), True, False, [])]), ("오늘 18시까지 제출", [("today", "deadline", None, (0, "18:00"), True, False, [])]),
    ("내일 오후 2시 30분에 모임", [("tomorrow", "event", (1, "14:30"), None, True, True, ["end_time"])]), ("과제는 다음 주 월요일까지입니다.", [("next_monday", "deadline", None, (7, None), False, True, ["time", "exact_boundary"])]),
    ("이번 주 금요일까지 제출", [("this_friday", "deadline", None, (5, None), False, True, ["time"])]), ("조사는 {d} 10:00부터 {d} 17:00까지", [("range_with_times", "period", (0, "10:00"), (0, "17:00"), True, False, [])]),
    ("시험은 {d}부터 {d}까지입니다.", [("range", "period", (0, None), (0, None), False, True, ["time"])]), ("{d}은 기념일로 휴업일입니다.", [("holiday", "all_day", (0, None), (0, None), False, True, ["time"])]),
    ("대여 신청은 {d} 18:00까지 받습니다.", [("deadline", "deadline", None, (0, "18:00"), True, False, [])]), ("송부는 2월 31일 18:00까지", [("deadline", "deadline", None, None, False, True, ["exact_date"])]),
    ("독서 대회\n신청: {s} ~ {s}", [("dated_range", "period", (0, None), (0, None), False, False, ["start_time", "time"])]), ("3단계\n{s} 9:30 ~ 12:00\n시험 응시", [("hours", "event", (0, "09:30"), (0, "12:00"), True, False, [])]),
    ("보고서\n제출: {s} 18:00까지", [("dated", "deadline", None, (0, "18:00"), True, False, [])]), ("자료실은 늘 열려 있습니다", []), ("마감은 {d} 25:00까지", [("deadline", "deadline", None, None, False, True, ["time"])]),
)


def _expected():
    day = {0: "o_orderdate::DATE", 1: "(o_orderdate::DATE + 1)", 7: "(o_orderdate::DATE + (8 - isodow(o_orderdate))::INT)", 5: "(o_orderdate::DATE + (5 - isodow(o_orderdate))::INT)"}
    date = lambda x: "NULL::VARCHAR" if x is None else f"strftime({day[x[0]]}, '%Y-%m-%d')"
    at = lambda x: "NULL::VARCHAR" if x is None or x[1] is None else f"strftime({day[x[0]]}, '%Y-%m-%d') || 'T{x[1]}:00+09:00'"
    rows = [
        f"SELECT o_orderkey AS doc_id, {place} AS place, '{rule}' AS rule, '{kind}' AS kind, {date(start)} AS start_date, {date(end)} AS end_date, {at(start)} AS start_at, {at(end)} AS end_at, {str(sure).lower()} AS confirmed, "
        f"{str(unsure).lower()} AS ambiguous, [{', '.join(f"'{u}'" for u in lacks)}]::VARCHAR[] AS unconfirmed FROM orders WHERE o_orderkey % {len(_TEXTS)} = {i}"
        for i, (_, found) in enumerate(_TEXTS) for place, (rule, kind, start, end, sure, unsure, lacks) in enumerate(found)
    ]
    return " UNION ALL ".join(rows)


@R.add("extract_schedules", _expected())
def extract_schedules(spark, sf_dir):
    k, m, d = F.col("o_orderkey"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _TEXTS]), (k % len(_TEXTS) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{d}"), F.concat(m, F.lit("월 "), d, F.lit("일"))), F.lit("{s}"), F.concat(m, F.lit("."), d))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("content"), F.col("o_orderdate").cast("date").alias("ref"))
    return extraction.extract_schedules(docs).select("doc_id", "place", "rule", "kind", "start_date", "end_date", "start_at", "end_at", "confirmed", "ambiguous", "unconfirmed")


@R.add("schedule_hours", """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 24 AS h, o_orderkey % 60 AS mi, o_orderkey % 3 AS form, o_orderpriority AS name, month(o_orderdate) || '월 ' || day(o_orderdate) || '일' AS said FROM orders
), r AS (
  SELECT k, 0 AS place, 'rounds' AS rule, name || ' 1차' AS title, d + to_hours(h::INT) + to_minutes(mi::INT) AS s FROM o WHERE form = 0
  UNION ALL SELECT k, 1, 'rounds', name || ' 2차', d + to_hours(((h + 7) % 24)::INT) FROM o WHERE form = 0
), f AS (
  SELECT k, place, rule, title, s, s + INTERVAL 1 HOUR AS e FROM r
  UNION ALL SELECT k, 0, 'urgent', name || ' 서류 제출 마감', NULL, d + to_hours(h::INT) + to_minutes(mi::INT) FROM o WHERE form = 1
  UNION ALL SELECT k, 0, 'today', name || ' 보고서 제출', NULL, d + to_hours(h::INT) FROM o WHERE form = 2)
SELECT k AS doc_id, place, rule, title, strftime(s, '%Y-%m-%dT%H:%M:%S+09:00') AS start_at, strftime(e, '%Y-%m-%dT%H:%M:%S+09:00') AS end_at FROM f""")
def schedule_hours(spark, sf_dir):
    # Two rounds of an hour each, also over midnight; deadlines of the day that a notice was written on, which stands beside it or not.
    k, say = F.col("o_orderkey"), lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    day = say(F.month("o_orderdate").cast("string"), "월 ", F.dayofmonth("o_orderdate").cast("string"), "일")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hour, clock = (k % 24).cast("string"), say(two(k % 24), ":", two(k % 60))
    first = say(F.year("o_orderdate").cast("string"), "년 ", day)
    text = (
        F.when(k % 3 == 0, say(F.col("o_orderpriority"), " 일정: 1차 ", first, " ", clock, ", 2차 ", first, " ", two((k + 7) % 24), ":00 (각 1시간 진행)"))
        .when(k % 3 == 1, say("[긴급] 금일(", day, ") ", clock, " 까지 ", F.col("o_orderpriority"), " 서류 제출 요망")).otherwise(say("오늘 ", hour, "시 까지 ", F.col("o_orderpriority"), " 보고서를 꼭 제출하세요"))
    )
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("content"), F.col("o_orderdate").cast("date").alias("ref"))
    return extraction.extract_schedules(docs).select("doc_id", "place", "rule", "title", "start_at", "end_at")


@R.add("suppressed_spans", """WITH s AS (SELECT l_orderkey AS k, list(struct_pack(s := l_partkey % 50, e := l_partkey % 50 + 5) ORDER BY l_linenumber) FILTER (l_linenumber % 2 = 0) AS strong,
    list(struct_pack(s := l_suppkey % 60, e := l_suppkey % 60 + 4) ORDER BY l_linenumber) FILTER (l_linenumber % 2 = 1) AS weak FROM lineitem GROUP BY 1)
SELECT k, list_transform(list_filter(coalesce(weak, []), lambda w: len(list_filter(coalesce(strong, []), lambda t: greatest(w.s, t.s) < least(w.e, t.e))) = 0), lambda w: w.s::BIGINT).list_sort() AS starts FROM s""")
def suppressed_spans(spark, sf_dir):
    i, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    span = lambda at, size: F.struct(at.alias("start"), (at + size).alias("end"))
    of = lambda odd, s: F.transform(F.array_sort(F.collect_list(F.when(n % 2 == odd, F.struct(n.alias("n"), s.alias("s"))))), lambda x: x["s"])
    g = i.groupBy(F.col("l_orderkey").alias("k")).agg(of(0, span(F.col("l_partkey") % 50, 5)).alias("strong"), of(1, span(F.col("l_suppkey") % 60, 4)).alias("weak"))
    return g.select("k", F.array_sort(F.transform(extraction.suppress_overlaps(F.col("weak"), F.col("strong")), lambda w: w["start"])).alias("starts"))
