"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def normalize_url(url: Column) -> Column:
    """Without fragment and outer blanks; null becomes ''."""
    return F.trim(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)))


def canonical_url(url: Column, host_pattern: str, path_pattern: str = ".*", site: str | None = None) -> Column:
    """scheme://host/path for http(s) URLs of allowed hosts without credentials or odd ports, and of a path that matches as a whole; else null.

    Scheme and host count in any case and are lower-cased. With `site` it stands for both, so that all of a site's hosts are one.
    """
    pattern = rf"^(?i:(https?)://({host_pattern}))(?::(?:80|443)?)?(/[^?#]*)?(?:[?#][\s\S]*)?\z"
    scheme, host, given = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    path = F.when(given == "", "/").otherwise(given)
    origin = F.lower(F.concat(scheme, F.lit("://"), host)) if site is None else F.lit(site)
    return F.when(url.rlike(pattern) & path.rlike(rf"^(?:{path_pattern})\z"), F.concat(origin, path))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """The parameter replaced where it stands, else added; a fragment is dropped."""
    plain = F.split_part(url, F.lit("#"), F.lit(1))
    held = plain.rlike(rf"[?&]{name}=")
    given = F.concat(F.lit(f"$1{name}="), value.cast("string"))
    added = F.concat(plain, F.when(plain.contains("?"), "&").otherwise("?"), F.lit(f"{name}="), value.cast("string"))
    return F.when(held, F.regexp_replace(plain, F.lit(rf"([?&]){name}=[^&]*"), given)).otherwise(added)


def content_hash(title: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), 256), 1, 16)


def content_status(title: Column, content: Column, status: Column) -> Column:
    """A body that is empty or only repeats the title, or a failed fetch, leaves the title alone."""
    failed = F.coalesce(status, F.lit("")).isin("empty", "fetch_failed", "failed", "title_only")
    bare = (F.trim(F.coalesce(content, F.lit(""))) == "") | (F.trim(content) == F.trim(title))
    return F.when(failed | bare, "title_only").otherwise(F.coalesce(status, F.lit("text")))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals; null where the whole is 0."""
    return F.round(F.lit(100.0) * F.try_divide(part.cast("double"), whole.cast("double")), 2)


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def scrub(text: Column) -> Column:
    """Halves of surrogate pairs and bytes that are not UTF-8 as U+FFFD, and NUL dropped, so that every writer accepts the text."""
    return F.regexp_replace(F.make_valid_utf8(F.replace(text, F.lit("\x00"), F.lit(""))), r"[\x{D800}-\x{DFFF}]", "\ufffd")


def error_class(status: Column, message: Column, kind: Column | None = None) -> Column:
    """Kind of a failed call: a deadline, then an unavailable or exhausted service, then a refused key.

    Codes count as a status and within the message; kind is the name of the exception, if known.
    """
    m = F.coalesce(message, F.lit(""))
    has = lambda text, *words: F.array_contains(F.array(*[text.contains(w) for w in words]), True)
    upper, lower = F.upper(m), F.lower(m)
    waited = has(upper, "504", "DEADLINE_EXCEEDED", "DEADLINE EXCEEDED", "TIMED OUT")
    if kind is not None:
        waited = waited | F.coalesce(kind.isin("TimeoutError", "TimeoutException", "ReadTimeout", "ConnectTimeout", "WriteTimeout", "PoolTimeout"), F.lit(False))
    status = F.coalesce(status, F.lit(0))
    return (
        F.when((status == 504) | waited, "timeout")
        .when((status == 503) | has(m, "503", "Service Unavailable", "temporarily unavailable", "overloaded"), "service_unavailable")
        .when((status == 429) | has(m, "429", "ResourceExhausted") | has(lower, "quota", "rate limit"), "rate_limit")
        .when(status.isin(401, 403) | has(m, "401", "403", "PermissionDenied", "API_KEY_INVALID", "Unauthenticated"), "auth_error")
        .otherwise("internal_api_error")
    )


# Before a number that is no part of a word or of a longer number.
_FREE = r"(?<![\p{L}\p{N}_])"


def entities(q: Column) -> Column:
    """Year (four digits, else two), its short form, semester, round, month and day of a question; null where absent."""
    four = F.regexp_extract(q, rf"{_FREE}((?:19|20)\d{{2}})", 1)
    two = rf"(?:'(\d{{2}})|{_FREE}(\d{{2}})\s*(?:년|학년도|-))"
    short = F.concat(F.regexp_extract(q, two, 1), F.regexp_extract(q, two, 2))
    year = F.when(four != "", four).when(short != "", F.concat(F.lit("20"), short))
    part = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit(""))
    return F.struct(
        year.alias("year"), F.concat(F.lit("'"), F.substring(year, 3, 2)).alias("short_year"), part(r"([12]학기)").alias("semester"), part(r"([12]차)").alias("round"),
        part(r"(?<!\d)(1[0-2]|0?[1-9])\s*월").cast("int").alias("month"), part(r"(?<!\d)(3[01]|[12]\d|0?[1-9])\s*일").cast("int").alias("day"),
    )


def term_pairs(text: Column) -> Column:
    """The set of (year, semester) named in a text, as '2026-1', in order."""
    pattern = r"(?<!\d)((?:19|20)\d{2}|\d{2})\s*(?:학년도|년도|년|-)\s*([12])\s*학기"
    years, terms = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    whole = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.array_sort(F.array_distinct(F.zip_with(years, terms, lambda y, t: F.concat(whole(y), F.lit("-"), t))))


# Endings of Korean words, in the order in which they are tried, and words that any question may hold.
SUFFIXES = ("인가요", "하나요", "할까요", "하세요", "하고", "에서", "에게", "으로", "까지", "부터", "은", "는", "을", "를", "과", "와", "도", "에")
GENERIC = (
    "안내", "신청", "신청서", "장학", "장학생", "장학금", "모집", "서류", "기간", "마감", "대상", "일정", "언제", "어디", "제출", "방법", "절차", "학년도", "학기",
    "필요", "확인", "처리", "알려줘", "운영시간", "메뉴", "목요일", "월요일", "화요일", "수요일", "금요일", "토요일", "일요일",
)


def subject_terms(q: Column, suffixes: Sequence[str] = SUFFIXES, stop: Sequence[str] = GENERIC) -> Column:
    """Hangul words of two letters or more, one ending off where two letters remain, without stop words, first places kept."""
    words = F.regexp_extract_all(q, F.lit("([가-힣]{2,})"), F.lit(1))

    def bare(w: Column) -> Column:
        out = w
        for s in reversed(suffixes):
            out = F.when(w.endswith(s) & (F.length(w) - len(s) >= 2), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(words, bare), lambda w: ~w.isin(*stop)))


# Names that count as distinctive in any case, and capitals that do not.
ACRONYMS = ("topcit", "toeic", "toefl", "cpa", "aicpa", "k-mooc", "kmooc", "ipp", "rotc")
COMMON_CAPITALS = ("FOR", "THE", "AND", "NOT")


def distinctive_terms(q: Column) -> Column:
    """Known acronyms, and words in capitals of three letters or more, in lower case and in order."""
    words = F.regexp_extract_all(q, F.lit(r"([a-zA-Z0-9\-_]{2,})"), F.lit(1))
    capital = lambda w: w.rlike("[A-Z]") & ~w.rlike("[a-z]") & (F.length(w) >= 3) & ~w.isin(*COMMON_CAPITALS)
    return F.transform(F.filter(words, lambda w: F.lower(w).isin(*ACRONYMS) | capital(w)), F.lower)


# Which words of a question call for which standing guide, on the question without white space.
TERM_SPECIFIC = r"(?:\d{2,4}(?:학년도|년)|[12]학기|\d{1,2}월|공지|폐강|가수요)"
GUIDES = (
    ("장바구니", "수강신청 장바구니"),
    (r"수강신청(?:은|을)?(?:종합정보시스템)?(?:어디|어느|메뉴|방법)|어떻게수강신청", "수강신청"),
    (r"일반휴학|군휴학|휴학(?:을|은)?(?:신청|기간|하려|몇)", "휴학"),
    (r"복학(?:을|은)?(?:신청|등록|절차|어디|하면)", "복학"),
)


def guide_titles(q: Column) -> Column:
    """Titles of the standing guides that answer a question; none where it asks for a term or a notice."""
    c = compact(q)
    graduation = (
        F.when(c.contains("졸업사정"), F.array(F.lit("졸업사정절차")))
        .when(c.contains("조기졸업") & c.contains("일반졸업"), F.array(F.lit("조기졸업"), F.lit("졸업 및 학위"))).when(c.contains("조기졸업"), F.array(F.lit("조기졸업")))
        .when(c.contains("졸업") & c.rlike("학점|포인트|요건|기준|평점"), F.array(F.lit("졸업 및 학위"))).otherwise(F.array().cast("array<string>"))
    )
    grant = F.when(c.contains("총장특별장학금") & ~c.contains("신입생"), "교내장학(재학생)")
    found = F.array_compact(F.array(*[F.when(c.rlike(p), t) for p, t in GUIDES], grant))
    return F.when(c.rlike(TERM_SPECIFIC), F.array().cast("array<string>")).otherwise(F.array_sort(F.concat(found, graduation)))


def notice_revision(title: Column) -> Column:
    """struct(key, corrected): a title without white space and its first mark of correction, and whether it has one."""
    t = compact(F.coalesce(title, F.lit("")))
    return F.struct(F.regexp_replace(t, r"^(.*?)\(정정\)", "$1").alias("key"), t.contains("(정정)").alias("corrected"))


def chunk_header(category: Column, title: Column, date: Column, source: Column) -> Column:
    """The line that stands before every part of a document that was split."""
    c, t, d, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (category, title, date, source))
    return F.concat(F.lit("["), c, F.lit("] "), t, F.lit(" (등록일: "), d, F.lit(", 출처: "), s, F.lit(")"))


def chunk_metadata(menu_path: Column, fields: Mapping[str, Column]) -> Column:
    """map of where a document's chunks come from: what of the named fields is known, as text, and the menu path joined by ' / '."""
    path = F.array_join(F.coalesce(menu_path, F.array().cast("array<string>")), " / ")
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {**fields, "menu_path": path}.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def chunk_body(content: Column, title: Column) -> Column:
    """A chunk without the header, or the title line, before it."""
    at = F.locate("\n\n", content)
    line = F.concat(title, F.lit("\n"))
    return (
        F.when(content.startswith("[") & (at > 0), F.substring(content, at + 2, F.length(content)))
        .when((F.coalesce(title, F.lit("")) != "") & content.startswith(line), F.substring(content, F.length(line) + 1, F.length(content))).otherwise(content)
    )


def date_bonus(body: Column, year: Column, month: Column, day: Column) -> Column:
    """How well the dates of a chunk's body fit a requested month: -0.10, 0, 0.02, 0.18 or 0.26."""
    pattern = F.lit(r"((?:19|20)\d{2})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{1,2})")
    y, m, d = (F.regexp_extract_all(body, pattern, F.lit(i)) for i in (1, 2, 3))
    dates = F.transform(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: F.struct(x["y"].alias("y"), x["m"].cast("int").alias("m"), x["d"].cast("int").alias("d")))
    fits = lambda x: (x["m"] == month) & (year.isNull() | (x["y"] == year))
    starts_mid = F.regexp_replace(body, r"(?U)^\s+", "").startswith("~") & F.exists(F.slice(dates, 1, 1), fits)
    return (
        F.when(month.isNull(), 0.0).when(~F.exists(dates, fits), F.when(F.size(dates) > 0, -0.10).otherwise(0.0))
        .when(day.isNotNull() & F.exists(dates, lambda x: fits(x) & (x["d"] == day)), 0.26).when(starts_mid, 0.02).otherwise(0.18)
    )


# Words that show what concerns the campus, a request for code, other topics, and questions about live or own data.
CAMPUS = "교내|대학|학교|학사|수강|교육|특강|신청|접수|방법|일정|기간|대상|모집|선발|장학|학점|이수|대회|공모전|경진대회|프로그램|캠프|센터|동아리|설명회|특화|지원|학생"
CODE = r"코드\s*(?:짜줘|작성|구현|만들어|출력)|소스코드|알고리즘\s*(?:짜줘|구현)|구현해줘|코딩해줘|트리\s*구현|구현하는\s*코드"
OUTSIDE = r"아이폰|갤럭시|스마트폰\s*스펙|노트북\s*추천|그래픽카드|cpu|gpu|날씨|기온|미세먼지|주식|코인|비트코인|부동산|영화\s*추천|맛집\s*추천|이진\s*탐색|이진\s*트리|자료구조"
NOW, SEATS = "지금|현재|실시간", "빈자리|잔여석"
OWN_DATA = "(?:내|제)(?:성적표|성적내역|장바구니|통장).*(?:판정|입금|남았|확인해|조회해)"
OWN_REQUEST = "(?:내|제)(?:일반|군)?(?:휴학|복학|장학금)신청.*(?:승인했|승인됐|승인되었|승인여부|승인상태)"
WHERE_TO_LOOK = "어디서|어느메뉴|확인방법|조회방법"


def off_topic(q: Column) -> Column:
    """Whether a question asks for code, or for something outside without any intent that concerns the campus."""
    return q.rlike(f"(?i){CODE}") | (q.rlike(f"(?i){OUTSIDE}") & ~q.rlike(f"(?i){CAMPUS}"))


def needs_live_lookup(q: Column) -> Column:
    """Whether a question asks for one's own account or for live data, which no public index holds."""
    c = compact(q)
    return ~c.rlike(WHERE_TO_LOOK) & ((c.rlike(NOW) & c.rlike(SEATS)) | c.rlike(OWN_DATA) | c.rlike(OWN_REQUEST))


def calendar_ranges(text: Column) -> Column:
    """Dates that stand on a line of their own, or on three as a range, put on the line of the name that follows them."""
    day = r"(\d{4}\.\d{1,2}\.\d{1,2}\([^\n)]+\))"
    joined = F.regexp_replace(text, rf"(?m)^{day}(?:\n~\n{day})?\n([^~\n][^\n]*)", "$1\u0001$2\u0002$3")
    return F.replace(F.replace(F.replace(joined, F.lit("\u0001\u0002"), F.lit(" ")), F.lit("\u0001"), F.lit(" ~ ")), F.lit("\u0002"), F.lit(" "))


def media_signature(assets: Column) -> Column:
    """Normalised URLs of an array of assets, sorted; an empty array for null."""
    return F.array_sort(F.coalesce(F.transform(assets, lambda a: normalize_url(a["url"])), F.array().cast("array<string>")))


def revision_signature(title: Column, html: Column, content: Column, status: Column, images: Column, attachments: Column) -> Column:
    """What tells two revisions of a page apart: title, html (the text where there is none) and its media; null for a text
    that was enriched without keeping its html. Html that is there but empty counts as such."""
    t, h, c = (F.trim(F.coalesce(x, F.lit(""))) for x in (title, html, content))
    body = F.when(html.isNotNull(), h).when(~F.coalesce(status, F.lit("text")).isin("mixed", "ocr", "ocr_enhanced", "attachment"), c)
    return F.when(body.isNotNull(), F.struct(t.alias("title"), body.alias("body"), media_signature(images).alias("images"), media_signature(attachments).alias("attachments")))


def revision_hash(revision: Column) -> Column:
    """Hash of a revision_signature(); null where the revision is not known."""
    joined = lambda f: F.array_join(revision[f], " ")
    return F.when(revision.isNotNull(), F.sha2(F.concat_ws("\u0001", revision["title"], revision["body"], joined("images"), joined("attachments")), 256))


def extraction_summary(images: Column, attachments: Column) -> Column:
    """struct(summary, has_ocr, has_attachment) of extracted assets: how many of each kind gave text."""
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    read = lambda a, states: F.coalesce(F.size(F.filter(a, lambda x: x["status"].isin(*states) & (F.coalesce(x["text"], F.lit("")) != ""))), F.lit(0))
    seen, files = read(images, ("success",)), read(attachments, ("success", "partial"))
    text = lambda c: c.cast("string")
    summary = F.concat(F.lit("images: "), text(seen), F.lit("/"), text(size(images)), F.lit(" ok, attachments: "), text(files), F.lit("/"), text(size(attachments)), F.lit(" ok"))
    return F.struct(summary.alias("summary"), (seen > 0).alias("has_ocr"), (files > 0).alias("has_attachment"))


def assets_json(images: Column, attachments: Column) -> Column:
    """Both arrays of assets in one JSON string; '' where a document has neither."""
    none = lambda a: F.coalesce(a, F.array().cast("array<struct<url:string,name:string,text:string,status:string>>"))
    return F.when(images.isNull() & attachments.isNull(), "").otherwise(F.to_json(F.struct(none(images).alias("images"), none(attachments).alias("attachments"))))


def derived_source_type(own: Column, default: Column) -> Column:
    """A document's own type, else its source's; rows of a source of forms are forms whatever they say."""
    return F.when(default == "form", "form").otherwise(F.coalesce(F.nullif(F.trim(own), F.lit("")), default))
