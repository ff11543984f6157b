"""Evaluation reports over the runs, answers and judgments that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.plans import Registry
from corpusloom.plans.corpus import DOCUMENTS_SQL, documents
from corpusloom.session import table

R = Registry()


def runs(spark, sf_dir):
    """A retrieval run: five URLs that each document's number leads to, and those expected."""
    n = F.col("doc_id")
    url = lambda x: F.concat(F.lit("https://h/"), (x).cast("string"))
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("case"), "source_type", "site", F.when(n % 10 < 8, "dev").otherwise("test").alias("split"),
        F.array(*[url((n * (3 + k) + k * k) % 10) for k in range(5)]).alias("got"), F.array(url(n % 10), url((n + 1) % 10)).alias("expected"),
        (n % 9 == 0).alias("should_abstain"), (n % 6 == 0).alias("abstained"), ((n * 37 % 101) / 10.0).alias("seconds"),
        F.when(n % 23 == 0, "NOT_RUN").when(n % 17 == 0, "ERROR").when(n % 3 == 0, "FAIL").when(n % 7 == 0, "REVIEW").otherwise("PASS").alias("verdict"),
    )


_GOT = ", ".join(f"'https://h/' || ((doc_id * {3 + k} + {k * k}) % 10)" for k in range(5))
RUNS_SQL = DOCUMENTS_SQL + f""", runs AS (
  SELECT doc_id AS "case", source_type, site, CASE WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split, [{_GOT}] AS got,
    ['https://h/' || (doc_id % 10), 'https://h/' || ((doc_id + 1) % 10)] AS expected, doc_id % 9 = 0 AS should_abstain, doc_id % 6 = 0 AS abstained, (doc_id * 37 % 101) / 10.0::DOUBLE AS seconds,
    CASE WHEN doc_id % 23 = 0 THEN 'NOT_RUN' WHEN doc_id % 17 = 0 THEN 'ERROR' WHEN doc_id % 3 = 0 THEN 'FAIL' WHEN doc_id % 7 = 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM base
), marks AS (
  SELECT *, list_has_any(got[1:1], expected) AS hit1, list_has_any(got[1:3], expected) AS hit3, list_has_any(got[1:5], expected) AS hit5, list_has_all(got[1:5], expected) AS all_found,
    CASE WHEN should_abstain THEN CASE WHEN abstained THEN 1.0 ELSE 0.0 END WHEN list_has_any(got[1:1], expected) THEN 1.0 WHEN list_has_any(got[1:3], expected) THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM runs)"""


@R.add("eval_retrieval", f'WITH {RUNS_SQL} SELECT "case", hit1, hit3, hit5, all_found, score FROM marks')
def eval_retrieval(spark, sf_dir):
    return E.retrieval_marks(runs(spark, sf_dir)).select("case", "hit1", "hit3", "hit5", "all_found", "score")


_RATE = "round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 2)"


_SETS = """SELECT CASE grouping(category, split, case_type) WHEN 3 THEN 'category' WHEN 5 THEN 'split' WHEN 6 THEN 'case_type' WHEN 0 THEN 'slice' ELSE 'all' END AS level, category, split, case_type,
  count(*) AS total, count(*) FILTER (asked) AS n, count(*) FILTER (case_type = 'abstain') AS abstain, {rates} FROM cases GROUP BY GROUPING SETS ((category), (split), (case_type), (category, split, case_type), ())"""
_PART = "round(100.0::DOUBLE * count(*) FILTER ({c}) / nullif(count(*) FILTER (asked), 0), 2)"
_TOPS = ", ".join([f"{_PART.format(c=f'asked AND list_has_all(got[1:{k}], wanted)')} AS top{k}" for k in (1, 3, 5)] + [
    _PART.format(c="asked AND case_type = 'multi' AND list_has_any(got[1:5], wanted) AND NOT list_has_all(got[1:5], wanted)") + " AS partial"])


@R.add("retrieval_breakdown", f"""WITH {RUNS_SQL}, cases AS (
  SELECT source_type AS category, split, CASE WHEN should_abstain THEN 'abstain' WHEN "case" % 4 = 0 THEN 'multi' ELSE 'single' END AS case_type, got,
    CASE WHEN should_abstain THEN [] WHEN "case" % 4 = 0 THEN expected ELSE expected[1:1] END AS wanted, NOT should_abstain AS asked FROM runs
) {_SETS.format(rates=_TOPS)}""")
def retrieval_breakdown(spark, sf_dir):
    kind = F.when(F.col("should_abstain"), "abstain").when(F.col("case") % 4 == 0, "multi").otherwise("single")
    r = runs(spark, sf_dir).withColumns({"category": F.col("source_type"), "case_type": kind})
    wanted = F.when(kind == "abstain", F.array().cast("array<string>")).when(kind == "multi", F.col("expected")).otherwise(F.slice("expected", 1, 1))
    return E.breakdown(r.withColumn("expected", wanted))


_V = "round(100.0::DOUBLE * count(*) FILTER (verdict = '{v}') / nullif(count(*) FILTER (verdict <> 'NOT_RUN'), 0), 2)"


_H = "round(100.0::DOUBLE * count(*) FILTER (verdict <> 'NOT_RUN' AND {w} AND {c}) / nullif(count(*) FILTER (verdict <> 'NOT_RUN' AND {w}), 0), 2)"


@R.add("run_metrics", f"""WITH {RUNS_SQL} SELECT split, count(*) AS n, count(*) FILTER (verdict = 'NOT_RUN') AS not_run, {_V.format(v='PASS')} AS pass_rate,
  {_V.format(v='FAIL')} AS fail_rate, {_V.format(v='REVIEW')} AS review_rate, {_V.format(v='ERROR')} AS error_rate,
  {_H.format(c='hit1', w='NOT should_abstain')} AS hit_at_1, {_H.format(c='hit3', w='NOT should_abstain')} AS hit_at_3, {_H.format(c='abstained', w='should_abstain')} AS abstain_rate FROM marks GROUP BY split""")
def run_metrics(spark, sf_dir):
    return E.run_metrics(E.retrieval_marks(runs(spark, sf_dir)), "split")


_Q = ", ".join(f"quantile_cont(seconds, {q}) FILTER ({c}) AS {n}p{int(q * 100)}" for n, c in (("", "verdict <> 'NOT_RUN'"), ("ok_", "verdict IN ('PASS', 'FAIL', 'REVIEW')")) for q in (0.5, 0.95))


@R.add("latency_stats", f"""WITH {RUNS_SQL} SELECT split, {_Q}, avg(seconds) FILTER (verdict <> 'NOT_RUN') AS mean, avg(seconds) FILTER (verdict IN ('PASS', 'FAIL', 'REVIEW')) AS ok_mean, avg(seconds) FILTER (verdict = 'ERROR') AS error_mean FROM runs GROUP BY split""")
def latency_stats(spark, sf_dir):
    return E.latency(runs(spark, sf_dir), "split")


@R.add("hit_positions", f"""WITH {RUNS_SQL} SELECT "case", unnest(expected) AS url, coalesce(list_position(got, unnest(expected)), 0)::BIGINT AS place FROM runs""")
def hit_positions(spark, sf_dir):
    return E.positions(runs(spark, sf_dir))


@R.add("clause_bindings", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS form, month(o_orderdate) || '월 ' || day(o_orderdate) || '일' AS a, month(o_orderdate::DATE + 7) || '월 ' || day(o_orderdate::DATE + 7) || '일' AS b FROM orders)
SELECT k, CASE form WHEN 0 THEN [a || '=apply'] WHEN 1 THEN [a || '=consent'] WHEN 2 THEN [a || '=apply', b || '=consent'] WHEN 3 THEN [a || '=none'] ELSE [] END AS bindings FROM o""")
def clause_bindings(spark, sf_dir):
    k = F.col("o_orderkey")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    day = lambda d: say(F.month(d).cast("string"), "월 ", F.dayofmonth(d).cast("string"), "일")
    a, b = day(F.col("o_orderdate")), day(F.date_add("o_orderdate", 7))
    forms = [say("신청은 ", a), say("서류는 ", F.date_format("o_orderdate", "MM월 d일까지")), say("신청은 ", a, ", 가구원 동의는 ", b), say("개강 ", a), say(F.month("o_orderdate").cast("string"), "월 40일 신청")]
    said = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.transform(E.dated_clauses(said), lambda x: F.concat(x["day"], F.lit("="), x["of"])).alias("bindings"))


# Answers with what is known of their questions, and the verdict that the rules ask for, written down by hand:
# answer, quotes, negatives, facts, should_abstain, category, situation, status; verdict.
_ANSWERS = (
    ("관련 공지를 찾지 못했습니다", [], [], "", True, "x", "", "OK", "PASS"), ("내일입니다", [], [], "", True, "x", "", "OK", "FAIL"),
    ("제목만 있어 원문 확인이 필요", [], [], "", False, "title_only_notice", "", "OK", "PASS"), ("9월 9일입니다", [], [], "", False, "title_only_notice", "", "OK", "FAIL"),
    ("그 정보는 없습니다", [], [], "", False, "missing_time", "", "OK", "PASS"), ("세 시", [], [], "", False, "missing_time", "", "OK", "FAIL"),
    ("신청은 9월 9일 까지", [], [], "", False, "period_apply", "", "OK", "PASS"), ("신청은 9월 16일 까지", [], [], "", False, "period_apply", "", "OK", "FAIL"), ("9월 중순", [], [], "", False, "period_apply", "", "OK", "REVIEW"),
    ("신청 9월 9일, 서류 9월 16일", [], [], "", False, "period_distinction", "", "OK", "PASS"), ("두 마감은 같습니다", [], [], "", False, "period_distinction", "", "OK", "FAIL"),
    ("서류 제출은 9월 16일", [], [], "서류 제출", False, "period_distinction", "", "OK", "PASS"), ("3월 17일", [], [], "", False, "other_year_distinction", "", "OK", "PASS"),
    ("9월 9일", [], [], "", False, "other_year_distinction", "", "OK", "FAIL"), ("곧", [], [], "", False, "other_semester_distinction", "", "OK", "REVIEW"),
    ("재학생과 신입생", [], [], "", False, "target_audience", "", "OK", "PASS"), ("재학생", [], [], "", False, "target_audience", "", "OK", "REVIEW"), ("재학생과 신입생 모두 금지", [], ["금지"], "", False, "target_audience", "", "OK", "FAIL"),
    ("한국장학재단 누리집", [], [], "", False, "apply_method", "", "OK", "PASS"), ("학교", [], [], "", False, "apply_method", "", "OK", "REVIEW"),
    ("도서관 삼층 열람실 이용", ["열람실 이용 안내"], [], "", False, "x", "", "OK", "PASS"), ("도서관", ["열람실 이용 안내", "도서관", "셋째 인용 문구"], [], "", False, "x", "", "OK", "REVIEW"), ("아무 말", ["열람실 이용 안내"], [], "", False, "x", "", "OK", "FAIL"),
    ("확인할 수 없습니다", ["도서관"], [], "", False, "x", "", "OK", "FAIL"), ("무엇", [], [], "", False, "x", "", "NOT_RUN", "NOT_RUN"), ("무엇", [], [], "", False, "x", "", "503", "ERROR"),
)


@R.add("eval_answer", f"""WITH turns AS (
  SELECT a.conv_id, a.turn, [{', '.join(f"'{a[8]}'" for a in _ANSWERS)}][(a.conv_id * 7 + a.turn) % {len(_ANSWERS)} + 1] AS verdict
  FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, verdict, CASE verdict WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM turns""")
def eval_answer(spark, sf_dir):
    return _judged(spark, sf_dir).select("conv_id", "turn", F.col("v.status").alias("verdict"), "v.score")


def _judged(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    a = c.filter("role = 'assistant'").join(q, ["conv_id", "turn"])
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    rows = F.array(*[
        F.struct(F.lit(x[0]).alias("answer"), strings(x[1]).alias("quotes"), strings(x[2]).alias("negatives"), *[F.lit(v).alias(n) for n, v in zip(("facts", "abstain", "category", "situation", "status"), x[3:8], strict=True)])
        for x in _ANSWERS
    ])
    x = a.withColumn("x", F.element_at(rows, ((F.col("conv_id") * 7 + F.col("turn")) % len(_ANSWERS) + 1).cast("int")))
    return x.withColumn("v", E.answer_verdict(*[F.col(f"x.{n}") for n in ("answer", "facts", "quotes", "negatives", "abstain", "category", "situation", "status")]))


@R.add("quota_report", """WITH items AS (
  SELECT lang AS category, source AS kind, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'dev' END AS split FROM documents
), have AS (SELECT category, kind, split, count(*) AS have FROM items GROUP BY ALL
), want AS (SELECT DISTINCT lang AS category, source AS kind, 'test' AS split, 3::BIGINT AS want FROM documents UNION ALL SELECT 'ko', 'none', 'dev', 5
), j AS (SELECT coalesce(h.category, w.category) AS category, coalesce(h.kind, w.kind) AS kind, coalesce(h.split, w.split) AS split, coalesce(have, 0) AS have, coalesce(want, 0) AS want
  FROM have h FULL JOIN want w ON h.category = w.category AND h.kind = w.kind AND h.split = w.split)
SELECT category, kind, split, sum(have)::BIGINT AS have, sum(want)::BIGINT AS want, sum(greatest(0, want - have))::BIGINT AS deficit FROM j GROUP BY ROLLUP (category, kind, split)""")
def quota_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("lang").alias("category"), F.col("source").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("dev").alias("split"))
    want = items.select("category", "kind").distinct().select("category", "kind", F.lit("test").alias("split"), F.lit(3).cast("long").alias("want"))
    extra = spark.createDataFrame([("ko", "none", "dev", 5)], "category string, kind string, split string, want long")
    return E.quota_report(items, want.unionByName(extra))


@R.add("review_summary", """WITH j AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL AND lang <> 'fr' THEN 'open' ELSE lang END AS team, ['success', 'no_context', 'title_only_notice'][doc_id % 3 + 1] AS status, d.doc_id % 4 <> 0 AS referred,
    quality = 1 AS answer, CASE WHEN d.doc_id % 4 <> 0 THEN toxic = 0 END AS link, CASE WHEN d.doc_id % 3 = 0 THEN ['wrong', 'link'] ELSE ['outdated'] END AS reasons, d.doc_id % 2 = 0 AS retrieved, d.doc_id % 6 = 0 AS cited
  FROM documents d LEFT JOIN labels l USING (doc_id)
), r AS (SELECT team, reason, count(*) AS n FROM (SELECT team, unnest(reasons) AS reason FROM j WHERE NOT answer OR NOT link) GROUP BY ALL
), f AS (SELECT team, list(reason || '=' || n ORDER BY reason) AS failures FROM r GROUP BY team
), s AS (SELECT team, list(status || '=' || n ORDER BY status) AS statuses FROM (SELECT team, status, count(*) AS n FROM j GROUP BY ALL) GROUP BY team)
SELECT team, count(*) AS cases, count(answer) AS answer_reviewed, count(link) AS link_reviewed, CASE WHEN count(answer) = count(*) THEN round(100.0::DOUBLE * count(*) FILTER (answer) / count(*), 2) END AS answer_accuracy,
  CASE WHEN count(link) = count(*) FILTER (referred) THEN round(100.0::DOUBLE * count(*) FILTER (link) / nullif(count(*) FILTER (referred), 0), 2) END AS link_accuracy,
  round(100.0::DOUBLE * count(*) FILTER (referred AND retrieved) / nullif(count(*) FILTER (referred), 0), 2) AS retrieval_coverage, round(100.0::DOUBLE * count(*) FILTER (referred AND cited) / nullif(count(*) FILTER (referred), 0), 2) AS citation_coverage,
  coalesce(any_value(failures), []) AS failures, any_value(statuses) AS statuses FROM j LEFT JOIN f USING (team) LEFT JOIN s USING (team) GROUP BY team""")
def review_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    reasons = F.when(n % 3 == 0, F.array(F.lit("wrong"), F.lit("link"))).otherwise(F.array(F.lit("outdated")))
    rows = d.select(
        F.when(F.col("quality").isNull() & (F.col("lang") != "fr"), "open").otherwise(F.col("lang")).alias("team"), F.element_at(F.array(*map(F.lit, ("success", "no_context", "title_only_notice"))), (n % 3 + 1).cast("int")).alias("status"),
        (n % 4 != 0).alias("has_references"), (F.col("quality") == 1).alias("answer"), F.when(n % 4 != 0, F.col("toxic") == 0).alias("link"), reasons.alias("reasons"), (n % 2 == 0).alias("retrieved"), (n % 6 == 0).alias("cited"))
    shown = lambda c: F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string")))
    return E.review_summary(rows, "team").withColumns({"failures": shown("failures"), "statuses": shown("statuses")})


@R.add("review_violations", """WITH j AS (SELECT doc_id AS "case", doc_id % 2 = 0 AS answer, CASE WHEN doc_id % 3 = 0 THEN true END AS link, CASE WHEN doc_id % 5 = 0 THEN ['odd'] WHEN doc_id % 5 = 1 THEN [] ELSE ['wrong'] END AS reasons FROM labels
), c AS (SELECT doc_id AS "case", doc_id % 4 <> 0 AS refs, CASE WHEN doc_id % 7 = 0 THEN 'NOT_RUN' ELSE 'OK' END AS status FROM documents WHERE lang <> 'es'
), v AS (SELECT "case", list_filter([CASE WHEN status IS NULL THEN 'unknown_case' END, CASE WHEN NOT answer AND len(reasons) = 0 THEN 'reason_lacks' END, CASE WHEN list_contains(reasons, 'odd') THEN 'unknown_reason' END,
  CASE WHEN link IS NOT NULL AND NOT coalesce(refs, false) THEN 'link_without_references' END, CASE WHEN status = 'NOT_RUN' THEN 'did_not_answer' END], lambda x: x IS NOT NULL) AS violations FROM j LEFT JOIN c USING ("case"))
SELECT "case", violations FROM v WHERE len(violations) > 0""")
def review_violations(spark, sf_dir):
    n = F.col("doc_id")
    reasons = F.when(n % 5 == 0, F.array(F.lit("odd"))).when(n % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("wrong")))
    j = table(spark, sf_dir, "labels").select(n.alias("case"), (n % 2 == 0).alias("answer"), F.when(n % 3 == 0, True).alias("link"), reasons.alias("reasons"), F.lit("note").alias("note"))
    c = table(spark, sf_dir, "documents").filter("lang <> 'es'").select(n.alias("case"), (n % 4 != 0).alias("has_references"), F.when(n % 7 == 0, "NOT_RUN").otherwise("OK").alias("status"))
    return E.review_violations(j, c)


@R.add("unlike_runs", """WITH d AS (SELECT doc_id FROM documents) SELECT 'cases' AS reason, count(*) AS n FROM d WHERE doc_id % 10 IN (0, 1) UNION ALL SELECT 'config', count(*) FROM d WHERE doc_id % 10 NOT IN (0, 1) AND doc_id % 3 = 0""")
def unlike_runs(spark, sf_dir):
    n = F.col("case")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case"), F.lit("h").alias("dataset"), F.lit("dev").alias("split"), F.lit("s").alias("snapshot"))
    return E.unlike_runs(d.filter(n % 10 != 0).withColumn("config", F.lit("a")), d.filter(n % 10 != 1).withColumn("config", F.when(n % 3 == 0, "b").otherwise("a")))


@R.add("compare_runs", f"""WITH {RUNS_SQL} SELECT source_type, count(*) AS cases, round(100 * (avg(CASE WHEN verdict = 'PASS' THEN 1.0 ELSE score END) - avg(score)), 2) AS delta_pp FROM marks
WHERE "case" % 4 <> 0 GROUP BY source_type""")
def compare_runs(spark, sf_dir):
    before = E.retrieval_marks(runs(spark, sf_dir)).select("case", "source_type", "score", "verdict")
    after = before.filter(F.col("case") % 4 != 0).select("case", F.when(F.col("verdict") == "PASS", 1.0).otherwise(F.col("score")).alias("score"))
    return E.compare_runs(before, after, "source_type")


@R.add("unknown_judgments", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')")
def unknown_judgments(spark, sf_dir):
    known = table(spark, sf_dir, "documents").filter("lang <> 'es'")
    return table(spark, sf_dir, "labels").join(known, "doc_id", "left_anti").select("doc_id")


@R.add("resume_plan", f"""WITH {RUNS_SQL} SELECT d.doc_id AS "case", CASE WHEN r.verdict IS NULL OR r.verdict = 'NOT_RUN' THEN 'run' WHEN r.verdict = 'ERROR' THEN 'retry' ELSE 'reuse' END AS plan
FROM base d LEFT JOIN runs r ON d.doc_id = r."case" AND r."case" % 3 <> 1""")
def resume_plan(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("case"))
    return E.resume_plan(d, runs(spark, sf_dir).filter(F.col("case") % 3 != 1)).select("case", "plan")


@R.add("stop_after_rate_limit", """SELECT event_id, user_id, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS not_run FROM events""")
def stop_after_rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return E.stop_after(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "not_run")


# Messages of failed calls and their kinds, in the order of the rules.
_FAILURES = (
    (504, "x", "timeout"), (0, "Request timed out", "timeout"), (0, "504 from the gateway", "timeout"), (503, "x", "service_unavailable"), (0, "error 503", "service_unavailable"), (0, "model overloaded", "service_unavailable"),
    (429, "x", "rate_limit"), (0, "Quota is used up", "rate_limit"), (500, "got 429", "rate_limit"), (401, "x", "auth_error"), (0, "API_KEY_INVALID", "auth_error"), (500, "x", "internal_api_error"), (0, "Overloaded", "internal_api_error"),
)


@R.add("error_classes", f"SELECT [{', '.join(f"'{k}'" for _, _, k in _FAILURES)}][event_id % {len(_FAILURES)} + 1] AS kind, count(*) AS n FROM events GROUP BY 1")
def error_classes(spark, sf_dir):
    i = (F.col("event_id") % len(_FAILURES) + 1).cast("int")
    status, message = (F.element_at(F.array(*[F.lit(x[k]) for x in _FAILURES]), i) for k in (0, 1))
    return table(spark, sf_dir, "events").groupBy(T.error_class(status, message).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add("verify_evidence", rf"""WITH {DOCUMENTS_SQL}, ev AS (
  SELECT doc_id // 3 AS item, CASE WHEN doc_id % 31 = 0 THEN 'gone' ELSE id END AS doc, CASE WHEN doc_id % 7 = 0 THEN 'https://other' ELSE url END AS url,
    CASE WHEN doc_id % 5 = 0 THEN 'never said' ELSE substr(content, 11, 40) END AS quote FROM base
), j AS (
  SELECT e.item, e.doc, CASE WHEN d.id IS NULL THEN 'unknown_document' WHEN e.url <> d.url THEN 'other_url'
    WHEN NOT contains(regexp_replace(d.title || ' ' || d.content, '\s+', '', 'g'), regexp_replace(e.quote, '\s+', '', 'g')) THEN 'quote_not_found' END AS reason FROM ev e LEFT JOIN base d ON e.doc = d.id)
SELECT item, list_sort(coalesce(list(DISTINCT reason) FILTER (reason IS NOT NULL), [])) AS reasons, list_sort(coalesce(list(DISTINCT doc) FILTER (reason IS NULL), [])) AS checked,
  CASE WHEN count(reason) = 0 THEN 'verified' ELSE 'rejected' END AS verdict FROM j GROUP BY item""")
def verify_evidence(spark, sf_dir):
    d, n = documents(spark, sf_dir), F.col("doc_id")
    e = d.select(F.floor(n / 3).alias("item"), F.struct(
        F.when(n % 31 == 0, "gone").otherwise(F.col("id")).alias("doc"), F.when(n % 7 == 0, "https://other").otherwise(F.col("url")).alias("url"),
        F.when(n % 5 == 0, "never said").otherwise(F.substring("content", 11, 40)).alias("quote")).alias("e"))
    return E.verify_evidence(e.groupBy("item").agg(F.collect_list("e").alias("evidence")), d)


@R.add("duplicate_texts", "SELECT md5(lower(regexp_replace(text, '[^a-zA-Z]+', '', 'g'))) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return E.duplicates(table(spark, sf_dir, "documents"), F.md5(F.lower(F.regexp_replace("text", "[^a-zA-Z]+", ""))))


@R.add("split_leakage", "SELECT DISTINCT source AS family FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 5 <> 0")
def split_leakage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter("doc_id % 5 = 0").select(F.col("source").alias("family")).intersect(d.filter("doc_id % 5 <> 0").select("source"))


@R.add("superseded_by", f"""WITH {DOCUMENTS_SQL}, k AS (SELECT *, lower(regexp_replace(title, '[^a-zA-Z]+', '', 'g')) AS clean FROM base)
SELECT a.id, b.id AS newer FROM k a JOIN k b ON a.clean = b.clean AND a.id <> b.id AND b.date > a.date AND b.doc_id % 4 = 0 AND a.doc_id % 4 <> 0 AND a.clean <> ''""")
def superseded_by(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "date", F.lower(F.regexp_replace("title", "[^a-zA-Z]+", "")).alias("clean"), (F.col("doc_id") % 4 == 0).alias("corrected"))
    return E.superseding_pairs(d)
