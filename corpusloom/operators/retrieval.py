"""Exact nearest chunks for many questions at once, and rule-based re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

QUESTIONS_SENT, CHUNKS_SCANNED = 2048, 1024  # questions that every task may hold, and chunks that they are compared with at once
QUESTIONS_AT_ONCE, CHUNKS_AT_ONCE = 1024, 8192  # about the sides of a group
SCORED_AT_ONCE = 64  # questions of a group in one matrix product, which is all that a task holds beside the group
DIGITS = 6


def relevance(distance: Column) -> Column:
    """1 - d / sqrt(2) of a squared distance, as an index reports it."""
    return F.lit(1.0) - distance / F.lit(2.0**0.5)


def knn(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, raw_score, raw_rank: the k chunks of the best relevance for each question.

    Up to QUESTIONS_SENT questions are sent to every task, which scans the chunks where they lie
    and keeps k a question; only these are shuffled. More questions are dealt into blocks and
    chunks into parts by hash, both sized by their counts; each block meets each part in a group
    of its own, by shuffle, which keeps k a question by one matrix product. Scores have DIGITS
    decimals; equal ones go by chunk_id. Vectors: `embedding`, unit length.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    few = queries.select("query_id", "embedding").limit(QUESTIONS_SENT + 1).collect()
    if len(few) <= QUESTIONS_SENT:
        found = chunks.select("chunk_id", "embedding").mapInPandas(_scanned(chunks.sparkSession, few, k), f"query_id {kind}, chunk_id string, raw_score double")
    else:
        blocks, parts = max(1, -(-queries.count() // QUESTIONS_AT_ONCE)), max(1, -(-chunks.count() // CHUNKS_AT_ONCE))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = queries.select("query_id", "embedding", dealt("query_id", blocks).alias("_block"), each(parts).alias("_part"))
        c = chunks.select("chunk_id", "embedding", each(blocks).alias("_block"), dealt("chunk_id", parts).alias("_part"))
        found = q.groupBy("_block", "_part").cogroup(c.groupBy("_block", "_part")).applyInPandas(_nearest(k), f"query_id {kind}, chunk_id string, raw_score double")
    w = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), "chunk_id")
    return found.withColumn("raw_rank", F.row_number().over(w)).filter(F.col("raw_rank") <= k)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """round(1 - (2 - 2 q x) / sqrt(2)) in the one array of the product."""
    s = q @ x.T
    np.multiply(s, 2, out=s)
    np.subtract(2, s, out=s)
    np.divide(s, 2**0.5, out=s)
    np.subtract(1, s, out=s)
    return np.round(s, DIGITS, out=s)


def _scanned(spark: SparkSession, questions: list[Row], k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A scan of chunks that keeps the k best of each question, and gives them at the end of a task."""
    shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in questions]), np.array([r["embedding"] for r in questions], np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        asks, names, scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, len(batch) if len(ids) else 0, CHUNKS_SCANNED):
                part = batch.iloc[at : at + CHUNKS_SCANNED]
                score = _scores(q, np.array(part["embedding"].tolist(), np.float64))
                here = np.partition(score, -k, axis=1)[:, -k] if len(part) > k else np.full(len(ids), -np.inf)
                i, j = np.nonzero(score >= np.maximum(least, here)[:, None])
                asks, names, scores = np.r_[asks, i], np.r_[names, part["chunk_id"].to_numpy()[j]], np.r_[scores, score[i, j]]
                order = np.lexsort((names, -scores, asks))
                first = np.searchsorted(asks[order], np.arange(len(ids)))
                order = order[np.arange(len(order)) - first[asks[order]] < k]
                asks, names, scores = asks[order], names[order], scores[order]
                full = np.flatnonzero(np.bincount(asks, minlength=len(ids)) == k)
                least[full] = scores[np.searchsorted(asks, full, "right") - 1]
        yield pd.DataFrame({"query_id": ids[asks], "chunk_id": names, "raw_score": scores})

    return scan


def _nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def local(questions: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(chunks):
            return pd.DataFrame({"query_id": questions["query_id"][:0], "chunk_id": chunks["chunk_id"][:0], "raw_score": np.zeros(0)})
        q, x = (np.array(side["embedding"].tolist(), np.float64) for side in (questions, chunks))
        ids, names = questions["query_id"].to_numpy(), chunks["chunk_id"].to_numpy()
        asks, found, scores = [], [], []
        for first in range(0, len(ids), SCORED_AT_ONCE):
            score = _scores(q[first : first + SCORED_AT_ONCE], x)
            for i, row in enumerate(score, first):
                bound = np.partition(row, -k)[-k] if len(names) > k else -np.inf
                at = np.flatnonzero(row >= bound)
                at = at[np.lexsort((names[at], -row[at]))[:k]]
                asks.append(np.full(len(at), i))
                found.append(at)
                scores.append(row[at])
        return pd.DataFrame({"query_id": ids[np.concatenate(asks)], "chunk_id": names[np.concatenate(found)], "raw_score": np.concatenate(scores)})

    return local


def knn_of_titles(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, raw_score, raw_rank as knn() gives, among guides whose titles a question lacks.

    queries: query_id, embedding, missing (array of titles). Guides are joined on their title,
    so that only they are scored.
    """
    q = queries.select("query_id", "embedding", F.explode("missing").alias("title"))
    c = chunks.filter("source_type = 'guidance'").select("chunk_id", "title", F.col("embedding").alias("_other"))
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(double("embedding"), double("_other"), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = q.join(c, "title").select("query_id", "chunk_id", F.round(relevance(2 - 2 * dot), DIGITS).alias("raw_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), "chunk_id")
    return scored.withColumn("raw_rank", F.row_number().over(w)).filter(F.col("raw_rank") <= k)


@dataclass(frozen=True)
class Weights:
    """Terms of the re-ranking score."""

    title_term: float = 0.12
    title_most: float = 0.24
    body_term: float = 0.05
    body_most: float = 0.10
    official: float = 0.40
    bare_title: float = -0.15
    year: float = 0.30
    other_year: float = -0.40
    recent: tuple[tuple[int, float], ...] = ((90, 0.22), (180, 0.05), (365, -0.10))
    old: float = -0.18
    semester: float = 0.12
    other_semester: float = -0.15
    round_title: float = 0.22
    round_body: float = 0.06
    other_round: float = -0.18
    short_body: float = -0.25
    intent: float = 0.12
    first_chunk: float = 0.05
    acronym: float = 0.08
    grant_title: float = 0.18
    grant_body: float = 0.10
    other_grant: float = -0.20
    applies: float = 0.08
    household: float = 0.12


# Words by which a question shows what it is after, and words of chunks that answer it.
SCHEDULE_WORDS = ("기간", "마감", "언제", "일정", "일시", "시간", "접수", "날짜")
SCHEDULE_ANSWERS = ("신청 기간", "신청기간", "접수 기간", "마감", "접수", "15:00", "18:00", "17:00", "까지", "부터")
TARGET_WORDS = ("대상", "자격", "누구", "제외", "조건", "신청자")
TARGET_ANSWERS = ("대상자", "지원자격", "신청대상", "제외", "외국인", "자격", "신청자")
CALENDARS = ("학부학사일정", "대학원학사일정")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def understood(questions: DataFrame, q: str = "q") -> DataFrame:
    """questions with what their text asks for: entities (e), terms, acronyms, pairs, guides, guide (the standing page it
    names) and off_topic."""
    text = F.col(q)
    c = T.compact(text)
    notice = _any_of(c, ("공지", "중단", "시행", "변경"))
    guide = (
        F.when(notice, None).when(c.rlike("학사일정|학사달력"), F.when(c.contains("대학원"), CALENDARS[1]).otherwise(CALENDARS[0]))
        .when(c.rlike("천원(?:의)?아침밥"), "천원의아침밥").when(c.rlike("교직원(?:식당|식단)"), "교직원식당").when(_any_of(c, ("식단", "학식", "학생식당")), "식단")
    )
    return questions.withColumns({
        "e": T.entities(text), "terms": T.subject_terms(text), "acronyms": T.distinctive_terms(text), "pairs": T.term_pairs(text),
        "guides": T.guide_titles(text), "guide": guide, "off_topic": T.off_topic(text),
    })


def with_official(candidates: DataFrame) -> DataFrame:
    """Adds official (struct<kind, title>): the standing page that a question names, if it is among its candidates, else the
    longest form title that the question holds. A question that names a calendar, breakfast or menu page names no form."""
    w = Window.partitionBy("query_id")
    t = T.compact(F.coalesce("title", F.lit("")))
    page = F.max(F.when((F.col("source_type") == "guidance") & (t == F.col("guide")), t)).over(w)
    form = F.max(F.when((F.col("source_type") == "form") & (F.length(t) >= 2) & T.compact(F.col("q")).contains(t), F.struct(F.length(t).alias("n"), t.alias("title")))).over(w)
    named = lambda kind, title: F.when(title.isNotNull(), F.struct(F.lit(kind).alias("kind"), title.alias("title")))
    return candidates.withColumn("official", F.when(F.col("guide").isNotNull(), named("guidance", page)).otherwise(named("form", form["title"])))


def missing_guides(candidates: DataFrame, questions: DataFrame, least: float) -> DataFrame:
    """query_id, embedding, missing: guide titles that a question asks for and no candidate of `least` or more has, and the
    calendar page of a question about a month, where it is among the candidates."""
    seen = with_official(candidates).groupBy("query_id").agg(
        F.collect_set(F.when((F.col("source_type") == "guidance") & (F.col("raw_score") >= least), F.col("title"))).alias("have"),
        F.max(F.when((F.col("official.kind") == "guidance") & F.col("official.title").isin(*CALENDARS) & F.col("e.month").isNotNull(), F.col("official.title"))).alias("calendar"),
    )
    rest = F.array_except("guides", "have")
    missing = F.when(F.col("calendar").isNotNull(), F.array_union(rest, F.array("calendar"))).otherwise(rest)
    return questions.join(seen, "query_id").select("query_id", "embedding", missing.alias("missing")).filter(F.size("missing") > 0)


def thresholded(candidates: DataFrame, least: float = 0.25, rescue: float = 0.15, bonus: float = 0.08) -> DataFrame:
    """Candidates of at least `least`; one with an acronym of the question in its title is raised first, from `rescue` on.
    Notices whose titles name other terms than the question does are dropped."""
    named = F.exists("acronyms", lambda a: F.lower("title").contains(a))
    score = F.when(named & (F.col("raw_score") >= rescue), F.col("raw_score") + bonus).otherwise(F.col("raw_score"))
    own = T.term_pairs(F.coalesce("title", F.lit("")))
    other = (F.size("pairs") > 0) & (F.col("source_type") == "notice") & (F.size(own) > 0) & ~F.arrays_overlap("pairs", own)
    return candidates.withColumn("score", F.round(score, DIGITS)).filter((F.col("score") >= least) & ~other)


def latest_correction(candidates: DataFrame) -> DataFrame:
    """Notices that a later correction of the same title replaces are dropped, unless the question asks for what stood before."""
    r = T.notice_revision(F.col("title"))
    keyed = candidates.withColumns({"_key": r["key"], "_mark": r["corrected"]})
    notice, date = F.col("source_type") == "notice", F.coalesce("date", F.lit(""))
    newest = F.max(F.when(notice & F.col("_mark"), date)).over(Window.partitionBy("query_id", "_key"))
    kept = keyed.withColumn("_newest", newest).filter(F.col("q").contains("정정 전") | F.col("q").contains("정정전") | ~notice | F.col("_newest").isNull() | (F.col("_newest") <= date))
    return kept.drop("_key", "_mark", "_newest")


def of_calendar_year(candidates: DataFrame) -> DataFrame:
    """For a question about a year's calendar, the candidates whose body holds a date of that year, or notices that name it."""
    asks = F.col("e.year").isNotNull() & T.compact(F.col("q")).rlike("학사일정|학사달력")
    body = T.chunk_body(F.col("content"), F.col("title"))
    dated = F.regexp_like(body, F.concat(F.lit(r"(?<!\d)"), F.col("e.year"), F.lit(r"\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}")))
    named = (F.col("source_type") == "notice") & F.col("title").contains(F.col("e.year"))
    return candidates.filter(~asks | F.coalesce(dated, F.lit(False)) | named)


def guides_only(candidates: DataFrame) -> DataFrame:
    """Adds guided: whether the question has hits among its guides and names no official page; only these hits stay then."""
    hit = (F.col("source_type") == "guidance") & F.array_contains("guides", F.col("title"))
    guided = F.coalesce(F.max(hit).over(Window.partitionBy("query_id")), F.lit(False)) & F.col("official").isNull()
    return candidates.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "guided": guided}).filter(~F.col("guided") | F.col("_hit")).drop("_hit")


def score_terms(w: Weights = Weights()) -> dict[str, Column]:
    """The terms that rerank() adds to a candidate's score, each by name. Year, age, semester and round concern notices of
    questions that name no official page."""
    q, title, content, date = F.col("q"), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("date", F.lit(""))
    body, squeezed = T.chunk_body(content, title), T.compact(F.col("q"))
    e = lambda name: F.col(f"e.{name}")
    times = lambda where: F.size(F.filter("terms", lambda t: F.contains(where, t)))
    either = lambda yes, value, no=0.0: F.when(F.coalesce(yes, F.lit(False)), value).otherwise(no)
    official = (F.col("source_type") == F.col("official.kind")) & (T.compact(title) == F.col("official.title"))
    notice = F.col("official").isNull() & ~F.col("source_type").isin("guidance", "faq", "form")
    of = lambda value: F.when(notice, value).otherwise(0.0)
    newest = F.max(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")).over(Window.partitionBy("query_id"))
    age = F.datediff(newest, F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd"))
    recency = F.when(age.isNull(), 0.0)
    for days, value in w.recent:
        recency = recency.when(age <= days, value)
    years = F.array_union(F.regexp_extract_all(title, F.lit(r"(?:^|[^\d])(20\d{2})(?=[^\d]|$)"), F.lit(1)), F.when(F.substring(date, 1, 4).rlike(r"^\d{4}$"), F.array(F.substring(date, 1, 4))).otherwise(F.array().cast("array<string>")))
    named_year = F.contains(title, e("year")) | F.startswith(date, e("year")) | content.contains(e("short_year"))
    by_year = F.when(named_year, w.year).when(F.size(F.filter(years, lambda y: y != e("year"))) > 0, w.other_year).otherwise(0.0)
    other_semester = F.when(e("semester") == "2학기", "1학기").otherwise("2학기")
    other_round = F.when(e("round") == "2차", "1차").otherwise("2차")
    programme = F.trim(F.when(title.startswith("국가장학금"), F.substring(title, 6, 10_000)).otherwise(title))
    schedule = _any_of(body, SCHEDULE_ANSWERS) | body.rlike(r"(?:19|20)\d{2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}")
    grant = F.when((title == "국가장학금") | programme.contains("국가장학금"), w.grant_title).when(content.contains("국가장학금"), w.grant_body).otherwise(w.other_grant)
    return {
        "by_title": F.least(times(title) * w.title_term, F.lit(w.title_most)),
        "by_body": F.least(times(body) * w.body_term, F.lit(w.body_most)),
        "by_official": either(official, w.official + T.date_bonus(body, e("year"), e("month"), e("day"))),
        "by_status": either(F.col("status") == "title_only", w.bare_title),
        "by_year": of(F.when(e("year").isNotNull(), by_year).otherwise(0.0)),
        "by_age": of(F.when(e("year").isNull(), recency.otherwise(w.old)).otherwise(0.0)),
        "by_semester": of(either(title.contains(e("semester")) | content.contains(e("semester")), w.semester) + either(e("semester").isNotNull() & title.contains(other_semester), w.other_semester)),
        "by_round": of(F.when(title.contains(e("round")), w.round_title).when(content.contains(e("round")), w.round_body).otherwise(0.0) + either(e("round").isNotNull() & title.contains(other_round), w.other_round)),
        "by_length": either(F.length(F.regexp_replace(content, r"(?U)^\s+|\s+\z", "")) < 80, w.short_body),
        "by_schedule": either(_any_of(q, SCHEDULE_WORDS) & schedule, w.intent),
        "by_target": either(_any_of(q, TARGET_WORDS) & _any_of(content, TARGET_ANSWERS), w.intent),
        "by_place": either(F.col("chunk_index") == 0, w.first_chunk),
        "by_acronym": F.size(F.filter("acronyms", lambda a: F.lower(title).contains(a))) * w.acronym,
        "by_grant": either(squeezed.contains("국가장학금"), grant + either(title.contains("국가고시"), w.other_grant)),
        "by_applies": either(q.contains("신청") & title.contains("신청"), w.applies),
        "by_household": either(q.contains("가구원") & (content.contains("가구원") | title.contains("가구원")), w.household),
    }


def rerank(candidates: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adds a column for each of score_terms(), final_score and final_rank: the score plus its terms, ties in raw order.

    candidates: query_id, chunk_id, score, raw_rank, q, e, terms, acronyms, official, title,
    content, status, source_type, date, chunk_index.
    """
    terms = score_terms(weights)
    scored = candidates.withColumns(terms)
    total = reduce(lambda a, b: a + b, [F.col(name) for name in terms], F.col("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "raw_rank")
    return scored.withColumn("final_score", F.round(total, DIGITS)).withColumn("final_rank", F.row_number().over(w))


def guides_first(ranked: DataFrame) -> DataFrame:
    """Of guided questions, the first chunk of each title before all others; the order is else kept."""
    first = F.row_number().over(Window.partitionBy("query_id", "title").orderBy("final_rank")) == 1
    lead = F.col("guided") & first
    w = Window.partitionBy("query_id").orderBy(F.when(lead, 0).otherwise(1), "final_rank")
    return ranked.withColumn("lead", lead).withColumn("place", F.row_number().over(w))


def select_context(ranked: DataFrame, k: int, sure: float = 0.70, gap: float = 0.12, least: float = 0.25) -> DataFrame:
    """At most k chunks a question, in the order of `place`: up to 3 of the first one's URL if that is sure, else 2, and 2 of
    every other. Others far behind a sure first are dropped, but not for guided questions nor where any score is enough."""
    q = Window.partitionBy("query_id").orderBy("place")
    top_url, top = F.first("url").over(q), F.first("final_score").over(q)
    marked = ranked.withColumns({"_best": F.col("url") == top_url, "_top": top})
    behind = ~F.col("_best") & (F.col("_top") >= sure) & (F.round(F.col("_top") - F.col("final_score"), DIGITS) > gap)
    near = marked.filter(~behind | F.col("guided") | F.lit(least < 0))
    of_url = F.row_number().over(Window.partitionBy("query_id", "url").orderBy("place"))
    capped = near.withColumn("_n", of_url).filter(F.col("_n") <= F.when(F.col("_best") & (F.col("_top") >= sure), 3).otherwise(2))
    return capped.withColumn("context_rank", F.row_number().over(q)).filter(F.col("context_rank") <= k).drop("_best", "_top", "_n")


def candidates_of(questions: DataFrame, chunks: DataFrame, k: int, least: float = 0.25) -> DataFrame:
    """Candidates of every question on topic: its max(15 k, 60) nearest chunks, and those of guides that it asks for and that are not among them.

    questions: query_id, q, embedding; chunks: chunk_id, embedding and what rerank() reads.
    Each stage joins, filters or ranks within a question, whose candidates are so many at most.
    """
    asked = understood(questions).filter("NOT off_topic")
    many = max(15 * k, 60)
    of_chunk = chunks.drop("embedding")
    about = asked.drop("embedding")
    first = knn(asked.select("query_id", "embedding"), chunks, many).join(of_chunk, "chunk_id").join(about, "query_id")
    lacking = missing_guides(first, asked, least)
    more = knn_of_titles(lacking, chunks, many).join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    more = more.withColumn("raw_rank", F.col("raw_rank") + many).join(of_chunk, "chunk_id").join(about, "query_id")
    return first.unionByName(more)


def filtered(candidates: DataFrame, least: float = 0.25, rescue: float = 0.15) -> DataFrame:
    """Candidates after all rules that drop some: threshold and terms, corrections, calendar year, guides."""
    return guides_only(with_official(of_calendar_year(latest_correction(thresholded(candidates, least, rescue)))))


def batch_retrieve(questions: DataFrame, chunks: DataFrame, k: int, least: float = 0.25, rescue: float = 0.15) -> DataFrame:
    """The context chunks of every question: candidates_of(), filtered(), rerank(), guides_first(), select_context()."""
    return select_context(guides_first(rerank(filtered(candidates_of(questions, chunks, k, least), least, rescue))), k, least=least)


def context_block(selected: DataFrame, most: int = 200) -> DataFrame:
    """The chosen chunks of a question in one numbered text, each cut with '...'."""
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    rows = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("context_rank", F.col("title").alias("t"), cut.alias("c")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["context_rank"].cast("string"), F.lit("] "), r["t"], F.lit("\n"), r["c"])), "\n\n").alias("context"))


def source_cards(selected: DataFrame, answers: DataFrame, most: int = 2000) -> DataFrame:
    """Cards of the chunks that an answer cites ('[1, 2]'), the first a URL, texts cut."""
    numbers = F.flatten(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([\d,\s]+)\]"), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))))
    cited = answers.select("query_id", F.array_distinct(F.transform(numbers, lambda x: x.cast("int"))).alias("cited"))
    used = selected.join(cited, "query_id").filter(F.array_contains("cited", F.col("context_rank")))
    w = Window.partitionBy("query_id", "url").orderBy("context_rank")
    return used.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "context_rank", "title", "date", "url", F.substring("content", 1, most).alias("content"))
