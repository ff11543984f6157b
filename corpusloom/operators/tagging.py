"""Topic, kind and term tags from rule tables: rules are data, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]  # topic and pattern, in order of priority


def _matches(text: Column, rules: Rules) -> Column:
    found = [F.when(text.rlike(p), F.struct(F.lit(t).alias("topic"), F.regexp_extract(text, p, 0).alias("quote"))) for t, p in rules]
    return F.array_compact(F.array(*found))


def tag_topics(docs: DataFrame, titles: Rules, bodies: Rules, others: str, most: int = 2) -> DataFrame:
    """Adds topics and evidence: the first title rules that match, else body rules on 1,500 characters, else OTHER, else UNCLASSIFIED."""
    by_title, by_body = _matches(F.col("title"), titles), _matches(F.substring("content", 1, 1500), bodies)
    head = F.concat(F.col("title"), F.lit(" "), F.substring("content", 1, 1000))
    lone = lambda name, quote: F.array(F.struct(F.lit(name).alias("topic"), quote.alias("quote")))
    hit = (
        F.when(F.size(by_title) > 0, F.slice(by_title, 1, most)).when(F.size(by_body) > 0, F.slice(by_body, 1, most))
        .when(head.rlike(others), lone("OTHER", F.regexp_extract(head, others, 0))).otherwise(lone("UNCLASSIFIED", F.lit("")))
    )
    tagged = docs.withColumn("_hit", hit)
    return tagged.withColumns({"topics": F.transform("_hit", lambda x: x["topic"]), "evidence": F.filter(F.transform("_hit", lambda x: x["quote"]), lambda q: q != "")}).drop("_hit")


# What a title says about a notice. A change of courses is no correction unless brackets say so.
BRACKETED = r"\[[^\]]*(?:수정|정정)[^\]]*\]"
CORRECTED = rf"{BRACKETED}|\((?:수정|정정)\)|수정\s*안내|정정\s*공고|정정\s*안내|수정\s*공지"
COURSE_CHANGE = r"수강(?:\s*신청)?\s*정정"
KINDS: Rules = (
    ("extension", r"\[[^\]]*연장[^\]]*\]|\(연장\)|기간\s*연장|추가\s*접수|추가\s*모집|추가\s*신청|일정\s*연장|마감\s*연장"),
    ("cancellation", r"\[[^\]]*취소[^\]]*\]|\(취소\)|폐강|행사\s*취소|선발\s*취소|운영\s*취소"),
    ("result", r"선발\s*결과|합격자\s*발표|최종\s*합격|선정\s*결과|수상자\s*발표|장학생\s*선발\s*결과"),
)


def notice_kind(title: Column, kinds: Rules = KINDS, default: str = "announcement") -> Column:
    """correction, else the first kind whose pattern the title matches, else the default."""
    out = F.lit(default)
    for kind, pattern in reversed(list(kinds)):
        out = F.when(title.rlike(pattern), kind).otherwise(out)
    return F.when(title.rlike(CORRECTED) & (~title.rlike(COURSE_CHANGE) | title.rlike(BRACKETED)), "correction").otherwise(out)


def term_of(title: Column, content: Column) -> Column:
    """struct(year, semester, quote) of the first term that a title, else its content, names: 1, 2, summer or winter."""
    year = r"(202[0-9])(?:학년도|-|년도|\s*년)?\s*"
    forms = ((year + r"([12])학기", None), (year + r"(?:여름|하계)\s*(?:계절)?\s*(?:학기|수업)?", "summer"), (year + r"(?:겨울|동계)\s*(?:계절)?\s*(?:학기|수업)?", "winter"))
    found = []
    for text in (F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))):
        for pattern, name in forms:
            part = lambda i, text=text, pattern=pattern: F.regexp_extract(text, pattern, i)
            semester = F.lit(name) if name else part(2)
            found.append(F.when(text.rlike(pattern), F.struct(part(1).cast("int").alias("year"), semester.alias("semester"), part(0).alias("quote"))))
    return F.coalesce(*found)


# Groups of readers that a notice may address.
AUDIENCES = ("학부생", "재학생", "신입생", "편입생", "졸업예정자", "휴학생", "복학생", "대학원생", "학기초과자", "외국인 유학생", "장애학생", "예비군")


def audience(title: Column, content: Column, groups: Sequence[str] = AUDIENCES) -> Column:
    """The groups that a title or the first 300 characters of its text name, in the order of the list."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 300))
    return F.array_compact(F.array(*[F.when(text.contains(g), g) for g in groups]))


def status_counts(tagged: DataFrame) -> DataFrame:
    """Documents by whether their topics are certain: tagged, other or unclassified."""
    status = F.when(F.array_contains("topics", "UNCLASSIFIED"), "unclassified").when(F.array_contains("topics", "OTHER"), "other").otherwise("tagged")
    return tagged.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def topic_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def violations(tagged: DataFrame, docs: DataFrame) -> DataFrame:
    """Tags that break a rule: one to three topics, OTHER and UNCLASSIFIED alone, quotes literally in the document, and,
    where tags carry a source_hash, the document unchanged since (docs: hash)."""
    hashed = "source_hash" in tagged.columns and "hash" in docs.columns
    body = docs.select("doc_id", F.concat("title", F.lit(" "), "content").alias("body"), *(["hash"] if hashed else []))
    j = tagged.select("doc_id", "topics", "evidence", *(["source_hash"] if hashed else [])).join(body, "doc_id", "left")
    changed = F.when(F.col("body").isNotNull() & ~F.col("source_hash").eqNullSafe(F.col("hash")), "source_changed") if hashed else F.lit(None).cast("string")
    alone = F.exists("topics", lambda t: t.isin("OTHER", "UNCLASSIFIED")) & (F.size("topics") > 1)
    reasons = F.array_compact(F.array(
        F.when(F.col("body").isNull(), "unknown_document"), F.when(~F.size("topics").between(1, 3), "topic_count"), F.when(alone, "not_alone"),
        F.when(F.exists("evidence", lambda q: ~F.col("body").contains(q)), "quote_missing"), changed))
    return j.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select("doc_id", "reasons")


def keyword_coverage(docs: DataFrame, rules: Rules) -> DataFrame:
    """Documents a rule matches, by source type; one pass for all rules."""
    text = F.concat_ws(" ", "title", "content")
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), t) for t, p in rules]))
    named = docs.select("source_type", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("none")))).alias("rule"))
    return named.groupBy("rule", "source_type").agg(F.count(F.lit(1)).alias("n"))
