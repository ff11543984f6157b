"""Nearest chunks, re-ranking, context selection and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, retrieval
from corpusloom.plans import Registry
from corpusloom.plans.corpus import CHUNKS_SQL, DOCUMENTS_SQL, documents, version_stream
from corpusloom.plans.corpus import chunks as plain_chunks

R = Registry()
K = 5
MANY = max(15 * K, 60)
# The vectors of these tables are nearly at right angles, so the bounds lie lower than an index's usual 0.25 and 0.15.
LEAST, RESCUE = 0.0, -0.1

# No table holds questions or notices of a school, so that titles, bodies and questions go round by number.
TITLES = (
    "2024학년도 1학기 국가장학금 신청 안내", "2025학년도 2학기 국가장학금 2차 신청", "(정정) 수강신청 일정 공지", "수강신청 일정 공지", "수강신청", "학부 학사일정",
    "휴학", "TOPCIT 특강 모집", "휴학 신청서", "국가고시 안내 2024", "가구원 동의 대상", "식단",
)
BODIES = (
    "신청 기간은 2024.03.02 부터 입니다", "대상자 가구원 동의 1학기", "2025.9.9(화) 개강 2차 접수", "짧다", "~ 2024.3.2 까지", "'24 국가장학금 신청자", "수강신청 장바구니 어디서",
)
QUESTIONS = (
    "수강신청 방법은 어디서 확인하나요", "2024학년도 1학기 국가장학금 신청 기간", "국가장학금 2차 신청 대상은 누구", "TOPCIT 특강 일정", "휴학 신청서 제출",
    "2024년 3월 2일 학사일정", "코드 짜줘", "아이폰 스펙", "가구원 동의는 언제까지", "정정 전 수강신청 공지 알려줘",
)


def _pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def chunks(spark, sf_dir):
    n = F.col("doc_id")
    c = plain_chunks(spark, sf_dir).withColumn("title", _pick(TITLES, n))
    content = F.concat("title", F.lit("\n"), _pick(BODIES, n), F.when(n % 7 != 3, F.concat(F.lit(" "), F.col("content"))).otherwise(F.lit("")))
    return c.select(
        "doc_id", "chunk_id", "embedding", "title", content.alias("content"), "date", "source_type", F.when(n % 5 == 0, "title_only").otherwise("text").alias("status"),
        (n % 3).cast("int").alias("chunk_index"), F.concat(F.lit("https://h/p"), (n % 6).cast("string")).alias("url"),
    )


def questions(spark, sf_dir):
    """Every chunk whose number divides by 20 asks for its likes, with a question in words."""
    c = plain_chunks(spark, sf_dir).filter(F.col("doc_id") % 20 == 0)
    return c.select(F.col("doc_id").alias("query_id"), "embedding", _pick(QUESTIONS, F.floor(F.col("doc_id") / 20)).alias("q"))


# What each question asks for, written down by hand: entities, terms, acronyms, pairs, guides, page, off topic, schedule, target.
_ASKED = """asked(i, q, year, semester, round, month, day, terms, acronyms, pairs, guides, page, off_topic, schedule, target) AS (VALUES
  (0, '수강신청 방법은 어디서 확인하나요', NULL, NULL, NULL, NULL::INT, NULL::INT, ['수강신청', '어디서'], []::VARCHAR[], []::VARCHAR[], ['수강신청'], NULL, false, false, false),
  (1, '2024학년도 1학기 국가장학금 신청 기간', '2024', '1학기', NULL, NULL, NULL, ['학년', '국가장학금'], [], ['2024-1'], [], NULL, false, true, false),
  (2, '국가장학금 2차 신청 대상은 누구', NULL, NULL, '2차', NULL, NULL, ['국가장학금', '누구'], [], [], [], NULL, false, false, true),
  (3, 'TOPCIT 특강 일정', NULL, NULL, NULL, NULL, NULL, ['특강'], ['topcit'], [], [], NULL, false, true, false),
  (4, '휴학 신청서 제출', NULL, NULL, NULL, NULL, NULL, ['휴학'], [], [], ['휴학'], NULL, false, false, false),
  (5, '2024년 3월 2일 학사일정', '2024', NULL, NULL, 3, 2, ['학사일정'], [], [], [], '학부학사일정', false, true, false),
  (6, '코드 짜줘', NULL, NULL, NULL, NULL, NULL, ['코드', '짜줘'], [], [], [], NULL, true, false, false),
  (7, '아이폰 스펙', NULL, NULL, NULL, NULL, NULL, ['아이폰', '스펙'], [], [], [], NULL, true, false, false),
  (8, '가구원 동의는 언제까지', NULL, NULL, NULL, NULL, NULL, ['가구원', '동의'], [], [], [], NULL, false, true, false),
  (9, '정정 전 수강신청 공지 알려줘', NULL, NULL, NULL, NULL, NULL, ['정정', '수강신청', '공지'], [], [], [], NULL, false, false, false)
)"""
_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

_KNN = CHUNKS_SQL.replace("), chunks AS (", "), vectors AS (") + f""", {_ASKED}, chunks AS (
  SELECT doc_id, chunk_id, embedding, {_LIST(TITLES)}[doc_id % 12 + 1] AS title, {_LIST(TITLES)}[doc_id % 12 + 1] || chr(10) || {_LIST(BODIES)}[doc_id % 7 + 1]
      || CASE WHEN doc_id % 7 <> 3 THEN ' ' || content ELSE '' END AS content, date, source_type, CASE WHEN doc_id % 5 = 0 THEN 'title_only' ELSE 'text' END AS status,
    (doc_id % 3)::INT AS chunk_index, 'https://h/p' || (doc_id % 6) AS url FROM vectors
), questions AS (
  SELECT v.doc_id AS query_id, embedding, a.* FROM vectors v JOIN asked a ON a.i = (v.doc_id // 20) % 10 WHERE v.doc_id % 20 = 0
), scored AS (
  SELECT query_id, chunk_id, round(1 - (2 - 2 * list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) / sqrt(2), 6) AS raw_score FROM questions q, chunks c
), knn AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS raw_rank FROM scored QUALIFY raw_rank <= {MANY})"""


@R.add("knn_topk", f"WITH {_KNN} SELECT query_id, chunk_id, raw_score, raw_rank FROM knn")
def knn_topk(spark, sf_dir):
    return retrieval.knn(questions(spark, sf_dir), chunks(spark, sf_dir), MANY)


@R.add("question_understanding", f"""WITH {_KNN} SELECT query_id, year, CASE WHEN year IS NOT NULL THEN chr(39) || substr(year, 3, 2) END AS short_year, semester, round, month, day, terms, acronyms, pairs, guides, page AS guide, off_topic FROM questions""")
def question_understanding(spark, sf_dir):
    q = retrieval.understood(questions(spark, sf_dir))
    return q.select("query_id", "e.*", "terms", "acronyms", "pairs", "guides", "guide", "off_topic")


_CAND = _KNN + f""", first AS (
  SELECT k.query_id, k.raw_score, k.raw_rank, c.* EXCLUDE (embedding), q.* EXCLUDE (query_id, embedding, i) FROM knn k JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE NOT off_topic
), lacking AS (
  SELECT q.query_id, unnest(list_filter(list_concat(q.guides, CASE WHEN q.month IS NOT NULL AND bool_or(f.source_type = 'guidance' AND replace(f.title, ' ', '') = q.page) THEN [q.page] ELSE [] END),
    lambda t: NOT list_contains(coalesce(list(f.title) FILTER (f.source_type = 'guidance' AND f.raw_score >= {LEAST}), []), t) OR t = q.page)) AS title
  FROM questions q JOIN first f USING (query_id) GROUP BY q.query_id, q.guides, q.page, q.month
), more AS (
  SELECT query_id, s.raw_score, {MANY} + row_number() OVER (PARTITION BY query_id ORDER BY s.raw_score DESC, chunk_id) AS raw_rank, chunk_id
  FROM lacking l JOIN chunks c ON c.title = l.title AND c.source_type = 'guidance' JOIN scored s USING (query_id, chunk_id) QUALIFY raw_rank <= {2 * MANY}
), cand AS (
  SELECT * FROM first UNION ALL
  SELECT m.query_id, m.raw_score, m.raw_rank, c.* EXCLUDE (embedding), q.* EXCLUDE (query_id, embedding, i) FROM more m JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id)
  WHERE (m.query_id, m.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM knn)
)"""


def candidates(spark, sf_dir):
    return retrieval.candidates_of(questions(spark, sf_dir), chunks(spark, sf_dir), K, LEAST)


@R.add("filtered_knn", f"WITH {_CAND} SELECT query_id, chunk_id, raw_score, raw_rank FROM cand WHERE raw_rank > {MANY}")
def filtered_knn(spark, sf_dir):
    return candidates(spark, sf_dir).filter(F.col("raw_rank") > MANY).select("query_id", "chunk_id", "raw_score", "raw_rank")


_KEPT = _CAND + f""", kept AS (
  SELECT *, round(CASE WHEN list_bool_or(list_transform(acronyms, lambda a: contains(lower(title), a))) AND raw_score >= {RESCUE} THEN raw_score + 0.08 ELSE raw_score END, 6) AS score,
    CASE WHEN starts_with(title, '2024학년도 1학기') THEN '2024-1' WHEN starts_with(title, '2025학년도 2학기') THEN '2025-2' END AS own_pair
  FROM cand WHERE round(CASE WHEN list_bool_or(list_transform(acronyms, lambda a: contains(lower(title), a))) AND raw_score >= {RESCUE} THEN raw_score + 0.08 ELSE raw_score END, 6) >= {LEAST}
    AND NOT (len(pairs) > 0 AND source_type = 'notice' AND own_pair IS NOT NULL AND NOT list_contains(pairs, own_pair))
)"""


@R.add("threshold_rescue", f"WITH {_KEPT} SELECT query_id, chunk_id, score FROM kept")
def threshold_rescue(spark, sf_dir):
    return retrieval.thresholded(candidates(spark, sf_dir), LEAST, RESCUE).select("query_id", "chunk_id", "score")


_FRESH = _KEPT + """, marked AS (
  SELECT *, max(CASE WHEN source_type = 'notice' AND contains(title, '(정정)') THEN date END) OVER (PARTITION BY query_id, replace(replace(title, ' ', ''), '(정정)', '')) AS newest FROM kept
), fresh AS (SELECT * FROM marked WHERE contains(q, '정정 전') OR source_type <> 'notice' OR newest IS NULL OR newest <= date)"""


@R.add("latest_correction", f"WITH {_FRESH} SELECT query_id, chunk_id FROM fresh")
def latest_correction(spark, sf_dir):
    return retrieval.latest_correction(retrieval.thresholded(candidates(spark, sf_dir), LEAST, RESCUE)).select("query_id", "chunk_id")


_LEFT = _FRESH + r""", bodied AS (
  SELECT *, CASE WHEN starts_with(content, '[') AND contains(content, chr(10) || chr(10)) THEN substr(content, strpos(content, chr(10) || chr(10)) + 2) ELSE substr(content, len(title) + 2) END AS body FROM fresh
), yeared AS (
  SELECT * FROM bodied WHERE NOT (year IS NOT NULL AND coalesce(page, '') = '학부학사일정') OR regexp_matches(body, '(?:^|[^0-9])' || year || '\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}') OR (source_type = 'notice' AND contains(title, year))
), forms AS (
  SELECT *, CASE WHEN page IS NOT NULL THEN max(CASE WHEN source_type = 'guidance' AND replace(title, ' ', '') = page THEN page END) OVER (PARTITION BY query_id)
    ELSE substr(max(CASE WHEN source_type = 'form' AND len(replace(title, ' ', '')) >= 2 AND contains(replace(q, ' ', ''), replace(title, ' ', '')) THEN chr((40 + len(replace(title, ' ', '')))::INT) || replace(title, ' ', '') END) OVER (PARTITION BY query_id), 2) END AS official
  FROM yeared
), guided0 AS (
  SELECT *, coalesce(bool_or(source_type = 'guidance' AND list_contains(guides, title)) OVER (PARTITION BY query_id), false) AND official IS NULL AS guided FROM forms
), left_over AS (SELECT * FROM guided0 WHERE NOT guided OR (source_type = 'guidance' AND list_contains(guides, title)))"""


def filtered(spark, sf_dir):
    return retrieval.filtered(candidates(spark, sf_dir), LEAST, RESCUE)


@R.add("official_subject", f"WITH {_LEFT} SELECT query_id, chunk_id, official AS title, CASE WHEN official IS NOT NULL THEN CASE WHEN page IS NULL THEN 'form' ELSE 'guidance' END END AS kind, guided FROM left_over")
def official_subject(spark, sf_dir):
    return filtered(spark, sf_dir).select("query_id", "chunk_id", "official.title", "official.kind", "guided")


_N = lambda column: f"len(list_filter(terms, lambda t: contains({column}, t)))"
_HAS = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
_D = lambda x: f"{x}::DOUBLE"
_TERMS = {
    "by_title": f"least({_N('title')} * 0.12::DOUBLE, 0.24::DOUBLE)", "by_body": f"least({_N('body')} * 0.05::DOUBLE, 0.10::DOUBLE)",
    "by_official": """CASE WHEN source_type = CASE WHEN page IS NULL THEN 'form' ELSE 'guidance' END AND replace(title, ' ', '') = official THEN 0.40::DOUBLE
      + CASE WHEN month IS NULL THEN 0 WHEN starts_with(body, '~ 2024.3.2') THEN 0.26::DOUBLE WHEN contains(body, '2024.03.02') OR contains(body, '2024.3.2') THEN 0.26::DOUBLE
             WHEN contains(body, '2025.9.9') THEN -0.10::DOUBLE ELSE 0 END ELSE 0 END""",
    "by_status": "CASE WHEN status = 'title_only' THEN -0.15::DOUBLE ELSE 0 END",
    "by_year": """CASE WHEN NOT plain OR year IS NULL THEN 0 WHEN contains(title, year) OR starts_with(date, year) OR contains(content, chr(39) || substr(year, 3, 2)) THEN 0.30::DOUBLE
      WHEN date[1:4] <> year OR regexp_matches(title, '20[0-9]{2}') THEN -0.40::DOUBLE ELSE 0 END""",
    "by_age": "CASE WHEN NOT plain OR year IS NOT NULL THEN 0 WHEN age <= 90 THEN 0.22::DOUBLE WHEN age <= 180 THEN 0.05::DOUBLE WHEN age <= 365 THEN -0.10::DOUBLE ELSE -0.18::DOUBLE END",
    "by_semester": "CASE WHEN NOT plain OR semester IS NULL THEN 0 ELSE CASE WHEN contains(title, '1학기') OR contains(content, '1학기') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN contains(title, '2학기') THEN -0.15::DOUBLE ELSE 0 END END",
    "by_round": "CASE WHEN NOT plain OR round IS NULL THEN 0 ELSE CASE WHEN contains(title, '2차') THEN 0.22::DOUBLE WHEN contains(content, '2차') THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN contains(title, '1차') THEN -0.18::DOUBLE ELSE 0 END END",
    "by_length": "CASE WHEN len(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) < 80 THEN -0.25::DOUBLE ELSE 0 END",
    "by_schedule": rf"CASE WHEN schedule AND ({_HAS('body', retrieval.SCHEDULE_ANSWERS)} OR regexp_matches(body, '(?:19|20)[0-9]{{2}}\s*[.\-/]\s*[0-9]{{1,2}}\s*[.\-/]\s*[0-9]{{1,2}}')) THEN 0.12::DOUBLE ELSE 0 END",
    "by_target": f"CASE WHEN target AND {_HAS('content', retrieval.TARGET_ANSWERS)} THEN 0.12::DOUBLE ELSE 0 END",
    "by_place": "CASE WHEN chunk_index = 0 THEN 0.05::DOUBLE ELSE 0 END",
    "by_acronym": "len(list_filter(acronyms, lambda a: contains(lower(title), a))) * 0.08::DOUBLE",
    "by_grant": """CASE WHEN NOT contains(q, '국가장학금') THEN 0 ELSE CASE WHEN contains(title, '국가장학금') THEN 0.18::DOUBLE WHEN contains(content, '국가장학금') THEN 0.10::DOUBLE ELSE -0.20::DOUBLE END
      + CASE WHEN contains(title, '국가고시') THEN -0.20::DOUBLE ELSE 0 END END""",
    "by_applies": "CASE WHEN contains(q, '신청') AND contains(title, '신청') THEN 0.08::DOUBLE ELSE 0 END",
    "by_household": "CASE WHEN contains(q, '가구원') AND (contains(content, '가구원') OR contains(title, '가구원')) THEN 0.12::DOUBLE ELSE 0 END",
}
_RANKED = _LEFT + f""", aged AS (
  SELECT *, date_diff('day', date::DATE, (max(date) OVER (PARTITION BY query_id))::DATE) AS age, official IS NULL AND source_type = 'notice' AS plain FROM left_over
), termed AS (SELECT *, {', '.join(f'({sql})::DOUBLE AS {name}' for name, sql in _TERMS.items())} FROM aged
), scored2 AS (SELECT *, round(score + {' + '.join(_TERMS)}, 6) AS final_score FROM termed
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, raw_rank) AS final_rank FROM scored2
), led AS (SELECT *, guided AND row_number() OVER (PARTITION BY query_id, title ORDER BY final_rank) = 1 AS lead FROM ranked
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT lead, final_rank) AS place FROM led)"""


def ranked(spark, sf_dir):
    return retrieval.rerank(filtered(spark, sf_dir))


@R.add("rerank", f"WITH {_RANKED} SELECT query_id, chunk_id, final_score, final_rank FROM ranked")
def rerank(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "chunk_id", "final_score", "final_rank")


@R.add("rerank_breakdown", f"WITH {_RANKED} SELECT query_id, chunk_id, {', '.join(_TERMS)} FROM ranked")
def rerank_breakdown(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in retrieval.score_terms()])


@R.add("guide_interleave", f"WITH {_RANKED} SELECT query_id, chunk_id, lead, place FROM placed")
def guide_interleave(spark, sf_dir):
    return retrieval.guides_first(ranked(spark, sf_dir)).select("query_id", "chunk_id", "lead", "place")


_SELECTED = _RANKED + f""", topped AS (
  SELECT *, first_value(url) OVER w AS top_url, first_value(final_score) OVER w AS top FROM placed WINDOW w AS (PARTITION BY query_id ORDER BY place)
), near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY place) AS n FROM topped WHERE url = top_url OR top < 0.7 OR round(top - final_score, 6) <= 0.12 OR guided
), selected AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS context_rank FROM near WHERE n <= CASE WHEN url = top_url AND top >= 0.7 THEN 3 ELSE 2 END
  QUALIFY context_rank <= {K}
)"""


def selected(spark, sf_dir):
    return retrieval.batch_retrieve(questions(spark, sf_dir), chunks(spark, sf_dir), K, LEAST, RESCUE)


@R.add("select_context", f"WITH {_SELECTED} SELECT query_id, chunk_id, context_rank FROM selected")
def select_context(spark, sf_dir):
    return selected(spark, sf_dir).select("query_id", "chunk_id", "context_rank")


@R.add("context_pack", f"""WITH {_SELECTED} SELECT query_id, string_agg('[' || context_rank || '] ' || title || chr(10) || CASE WHEN len(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END,
  chr(10) || chr(10) ORDER BY context_rank) AS context FROM selected GROUP BY query_id""")
def context_pack(spark, sf_dir):
    return retrieval.context_block(selected(spark, sf_dir))


@R.add("source_cards", f"""WITH {_SELECTED} SELECT query_id, context_rank, title, date, url, substr(content, 1, 2000) AS content FROM selected
WHERE context_rank IN (1, 2 + query_id % 3, 9) QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY context_rank) = 1""")
def source_cards(spark, sf_dir):
    answers = questions(spark, sf_dir).select("query_id", F.concat(F.lit("so it is [1, "), (2 + F.col("query_id") % 3).cast("string"), F.lit("] and [9].")).alias("answer"))
    return retrieval.source_cards(selected(spark, sf_dir), answers)


@R.add("batch_retrieve", f"WITH {_SELECTED} SELECT query_id, list(url ORDER BY context_rank) AS urls, max(final_score) AS best FROM selected GROUP BY query_id")
def batch_retrieve(spark, sf_dir):
    rows = selected(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("context_rank", "url"))).alias("rows"), F.max("final_score").alias("best"))
    return rows.select("query_id", F.transform("rows", lambda r: r["url"]).alias("urls"), "best")


@R.add("chunk_bodies", rf"""WITH {_KNN} SELECT doc_id, substr(content, len(title) + 2) AS body, CASE WHEN contains(title, '(정정)') THEN '수강신청일정공지' ELSE replace(title, ' ', '') END AS revision,
  CASE WHEN doc_id % 7 IN (0, 4) THEN 0.26 WHEN doc_id % 7 = 2 THEN -0.1 ELSE 0.0 END::DOUBLE AS bonus FROM chunks""")
def chunk_bodies(spark, sf_dir):
    body = T.chunk_body(F.col("content"), F.col("title"))
    bonus = T.date_bonus(body, F.lit(None).cast("string"), F.lit(3), F.lit(2))
    return chunks(spark, sf_dir).select("doc_id", body.alias("body"), T.notice_revision(F.col("title"))["key"].alias("revision"), bonus.alias("bonus"))


@R.add("chunk_documents")
def chunk_documents(spark, sf_dir):
    # No SQL: the recursive splitter; tests compare every chunk with a plain splitter.
    d = version_stream(spark, sf_dir).filter("seq = 1").withColumn("category", F.col("source_type"))
    return chunking.chunk_documents(d)


_STRIP = lambda c: f"trim({c}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@R.add("single_chunks", f"""WITH {DOCUMENTS_SQL}, s AS (SELECT id, {_STRIP('title')} || chr(10) || {_STRIP('content')} AS whole FROM base)
SELECT id || '_c0' AS chunk_id, id AS parent_id, 1 AS total_chunks, md5(whole) AS body FROM s WHERE len(whole) <= 500""")
def single_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("status", F.lit("text"))
    c = chunking.chunk_documents(d).filter((F.col("total_chunks") == 1) & (F.length("page_content") <= 500))
    return c.select("chunk_id", "parent_id", "total_chunks", F.md5("page_content").alias("body"))
