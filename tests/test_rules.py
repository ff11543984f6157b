"""Rule by rule: version resolution, dates, chunking, tables, sources and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import io
import re
import time
import zipfile
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.functions import text as T
from corpusloom.operators import chunking, evaluation, extraction, freshness, indexing, media, reports, retrieval, schedules, versions
from corpusloom.plans import corpus, source_queries, upkeep_queries
from corpusloom.sources import files, pages
from corpusloom.streaming import upserts
from tests.compare import spark_rows, sql_rows

BASE = {"seq": 1, "source": "a", "rank": 2, "id": "x", "title": "t", "content": "long body", "status": "text", "date": "2026-01-02", "updated_at": None, "checked_at": None, "signature": None, "media": "", "hash": "h1", "failed": False, "attached": None}
BARE = {"status": "title_only", "content": "", "attached": "pending"}

T1, T2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 5)


def decide(spark, old, new):
    rows = [{**BASE, **old, "seq": 1}, {**BASE, "source": "b", **new, "seq": 2}]
    schema = "key string, " + ", ".join(f"`{f.split(':')[0]}` {f.split(':')[1]}" for f in versions.VERSION[7:-1].split(","))
    names = [f.split(":")[0] for f in versions.VERSION[7:-1].split(",")]
    df = spark.createDataFrame([("k", *[r[n] for n in names]) for r in rows], schema)
    out = versions.resolve(df).first()
    return out["log"][0]["decision"], out["log"][0]["reason"], out["current"]["source"], out["current"]["checked_at"]


@pytest.mark.parametrize(("old", "new", "want"), [
    ({}, {"status": "title_only", "content": "t"}, ("skipped", "keep_valid", "a")),
    ({"media": "old.png", "status": "ocr"}, {**BARE, "media": "new.png", "checked_at": T2}, ("overwritten", "source_emptied", "b")),
    ({"media": "old.png", "status": "ocr", "checked_at": T1, "signature": "s1"}, {**BARE, "media": "new.png", "checked_at": T2, "signature": "s2"}, ("overwritten", "source_emptied", "b")),
    ({"checked_at": T1, "signature": "s1"}, {**BARE, "attached": "not_applicable", "checked_at": T2, "signature": "s2"}, ("overwritten", "source_emptied", "b")),
    ({"media": "old.png"}, {**BARE, "media": "new.png"}, ("skipped", "keep_valid", "a")),
    ({"media": "old.png", "checked_at": T2}, {**BARE, "media": "new.png", "checked_at": T2}, ("skipped", "keep_valid", "a")),
    ({"media": "old.png"}, {**BARE, "media": "new.png", "checked_at": T2, "date": "2026-01-01"}, ("skipped", "keep_valid", "a")),
    ({"media": "old.png"}, {**BARE, "media": "new.png", "checked_at": T2, "failed": True}, ("skipped", "keep_valid", "a")),
    ({"media": "old.png"}, {**BARE, "media": "new.png", "checked_at": T2, "attached": None}, ("skipped", "keep_valid", "a")),
    ({"media": "a.png", "signature": "s"}, {**BARE, "media": "a.png", "checked_at": T2, "signature": "s"}, ("skipped", "keep_valid", "a")),
    ({"media": "a.png", "signature": None}, {**BARE, "media": "a.png", "checked_at": T2, "signature": "s"}, ("skipped", "keep_valid", "a")),
    ({"date": ""}, {"date": "2026-01-03"}, ("skipped", "not_longer", "a")),
    ({"status": "title_only", "content": "t"}, {}, ("overwritten", "first_valid", "b")),
    ({"updated_at": T1}, {"updated_at": T2}, ("overwritten", "newer_update", "b")),
    ({"updated_at": T2}, {"updated_at": T1}, ("skipped", "older_update", "a")),
    ({"updated_at": T1}, {}, ("skipped", "update_known", "a")),
    ({}, {"updated_at": T1}, ("overwritten", "update_known", "b")),
    ({}, {"date": "2026-01-03"}, ("overwritten", "newer_date", "b")),
    ({}, {"date": "2026-01-01"}, ("skipped", "stale_date", "a")),
    ({"checked_at": T1}, {"checked_at": T2, "hash": "h2"}, ("overwritten", "newer_check", "b")),
    ({"checked_at": T2}, {"checked_at": T1, "hash": "h2"}, ("skipped", "stale_check", "a")),
    ({"status": "ocr"}, {}, ("skipped", "keep_enriched", "a")),
    ({}, {"status": "ocr"}, ("overwritten", "enriched", "b")),
    ({}, {"rank": 1, "hash": "h2"}, ("overwritten", "rank_content_differs", "b")),
    ({}, {"rank": 3}, ("skipped", "rank", "a")),
    ({}, {"content": "a longer body"}, ("overwritten", "longer", "b")),
    ({}, {}, ("skipped", "not_longer", "a")),
])
def test_decision(spark, old, new, want):
    assert decide(spark, old, new)[:3] == want


def test_check_time_moves_up_on_a_skip_of_the_same_revision(spark):
    got = decide(spark, {"signature": "s", "checked_at": T1}, {"signature": "s", "checked_at": T2})
    assert got[0] == "skipped" and got[3] == T2


@pytest.mark.parametrize(("text", "want"), [
    ("2026-01-02", "2026-01-02 00:00:00"), ("2026.01.02 03:04", "2026-01-02 03:04:00"), ("20260102", "2026-01-02 00:00:00"), ("2026-01-02T00:00:00+09:00", "2026-01-01 15:00:00"),
    ("2026-01-02T00:00:00.1234567Z", "2026-01-02 00:00:00.123456"), ("2026-01-02T00:00:00-0130", "2026-01-02 01:30:00"), ("2026-02-30", None), ("2026-01.02", None),
    ("2026-01-02 00:00 +09:00", None), ("2026-01-02T00:00z", None), ("20260102T03:04", None), ("2026.01-02", None), ("2026-1-2", None), (" 2026-01-02 ", "2026-01-02 00:00:00"), ("2026-01-02T03:04.5", "2026-01-02 03:04:00.5"),
    ("2026-01-02T00:00+24:00", None), ("2026-01-02T00:00+09:60", None), ("2026-01-02T25:00", None), ("2026-01-02 x", None), ("", None), (None, None),
])
def test_parse_iso_utc(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(D.parse_iso_utc(F.col("s")).cast("string")).first()[0]
    assert got == want


def test_scalars(spark):
    row = spark.range(1).select(
        T.collapse_space(F.lit(" a  b\n")), T.redact(F.lit("key=abc"), "abc"), T.percent(F.lit(1), F.lit(3)), T.percent(F.lit(1), F.lit(0)), T.content_status(F.lit("t"), F.lit(" t "), F.lit("text")),
        T.scrub(F.lit("a\x00b")), D.normalize_date(F.lit("2026.1.2"), F.lit("x")), D.first_long([F.lit("short"), F.lit("2026-01-02T00")]),
    ).first()
    assert tuple(row) == ("a b", "key=***", 33.33, None, "title_only", "ab", "2026-01-02", "2026-01-02")


def plain_merge(pieces, size, overlap):
    out, window, total = [], [], 0
    for piece in pieces:
        if total + len(piece) > size and window:
            out.append("".join(window).strip())
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    return [x for x in [*out, "".join(window).strip()] if x]


def plain_split(text, size, overlap, separators=chunking.SEPARATORS):
    """Piece by piece: the first separator that occurs, kept at the start of the part that follows it."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    raw = text.split(separator) if separator else []
    parts = [raw[0], *(separator + p for p in raw[1:])] if separator else list(text)
    out, short = [], []
    for part in (p for p in parts if p):
        if len(part) < size:
            short.append(part)
            continue
        out += plain_merge(short, size, overlap) if short else []
        short = []
        out += plain_split(part, size, overlap, rest) if rest else [part.strip()]
    return [x for x in out + (plain_merge(short, size, overlap) if short else []) if x]


def test_splitter_equals_a_plain_one(spark):
    random = np.random.default_rng(4)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    marks = ["\n\n", "\n", ". ", " ", "a", "bb ", "  ", "\n\n\n", "c" * 90]
    texts += ["".join(marks[i] for i in random.integers(0, len(marks), 60)) for _ in range(300)] + ["", " ", "\n\n", "y" * 1300, "x" * 50]
    for size, overlap in ((500, 80), (60, 10), (20, 0), (7, 3)):
        for t in texts if size > 100 else texts[-305:]:
            assert chunking.split_text(t, size, overlap) == (plain_split(t, size, overlap) if t else [])


def test_chunks_have_headers_and_lose_no_document(spark):
    body = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(120)) for i in range(5)) + "\n" + "y" * 1300
    rows = [("a", "u", "T", "short", "text"), ("b", "u", "T", body, "text"), ("c", "u", "T", body, "title_only"), ("d", None, "T", body, None), ("e", None, None, None, None), ("f", "u", "T", "T", "text")]
    df = spark.createDataFrame(rows, "id string, url string, title string, content string, status string").withColumns({"category": F.lit("C"), "date": F.lit("2026-01-01"), "source": F.lit(None).cast("string")})
    out = chunking.chunk_documents(df).collect()
    of = lambda i: sorted((r for r in out if r["parent_id"] == i), key=lambda r: r["chunk_index"])
    assert [len(of(i)) for i in "acef"] == [1, 1, 1, 1] and of("a")[0]["page_content"] == "T\nshort" and of("e")[0]["page_content"] == "\n"
    for i in "bd":
        assert [r["page_content"] for r in of(i)] == [f"[C] T (등록일: 2026-01-01, 출처: )\n\n{c}" for c in plain_split(body, 500, 80)]
        assert {r["total_chunks"] for r in of(i)} == {len(of(i))}
    assert chunking.chunk_documents(df.limit(0)).count() == 0


def test_table_spans():
    table = lambda html: pages.grid(pages.cells_of(pages.read(html).all("table")[0]))
    assert table("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>") == ["a | b | b", "a | c | d"]
    assert table("<table><tr><td>a<td></td><td rowspan=3>c</td></tr><tr><td>d</td></tr></table>") == ["a |  | c", "d |  | c", " |  | c"]
    assert table("<table><tr><td rowspan=x colspan=0>a</td></tr></table>") == ["a"] and table("<table></table>") == []


def test_inventory_keeps_the_deepest_path(spark):
    menu = "<nav><ul><li><a href='/hub/1/v.do'>Study</a><ul><li><a href='/hub/2/v.do'>학사일정</a></li></ul></li><li><a href='/hub/2/v.do'>Dates</a></li><li><a href='http://x.org/'>Out</a></li></ul></nav><a href='/hub/9/v.do'>No menu</a>"
    df = spark.createDataFrame([(1, "https://h.example.com/", menu), (2, "https://h.example.com/a", menu)], "page_id long, url string, html string")
    got = {r["url"]: (r["title"], r["menu_path"], r["interval_days"], r["status"]) for r in pages.discover(df, lambda u: T.canonical_url(u, r"h\.example\.com")).collect()}
    assert got == {
        "https://h.example.com/hub/1/v.do": ("Study", ["Study"], 14, "pending"), "https://h.example.com/hub/2/v.do": ("학사일정", ["Study", "학사일정"], 1, "pending"),
        "http://x.org/": ("Out", ["Out"], 14, "external_or_dynamic_review"),
    }


def test_guidance_page(spark):
    html_ = """<h1>Rules</h1><div id=menuUItab><a href='/p/1'>One</a><a href='/p/2'>Two</a></div><div id=_contentBuilder><nav>menu</nav><p>Text <b>bold</b></p><script>x</script><p class='hidden'>no</p>
      <table><tr><td rowspan=2>g</td><td>a</td></tr><tr><td>b</td></tr></table><a href='/f/download.do?1'>File</a><a href='http://o/'>Other</a><a href='/bbs/n/7/99/artclView.do'>Row</a><img src=i.png alt=pic></div>
      <div class='wrap-contact'>Office 최종 수정일 : 2026.03.04</div>"""
    r = pages.extract_page(spark.createDataFrame([(1, "https://h/p/2", html_), (2, "https://h/", None)], "page_id long, url string, html string")).collect()
    a, b = sorted(r, key=lambda x: x["page_id"])
    assert a["title"] == "Two" and a["content"] == "Text bold\ng | a\ng | b\nFileOtherRow" and a["updated"] == "2026-03-04" and a["coverage"] == "html_text_with_unextracted_media"
    assert [x["url"] for x in a["attachments"]] == ["https://h/f/download.do?1"] and a["boards"] == ["https://h/bbs/n/7/artclList.do"] and [tuple(x) for x in a["images"]] == [("https://h/p/i.png", "pic")]
    assert [x["url"] for x in a["related"]] == ["https://h/f/download.do?1", "http://o/", "https://h/bbs/n/7/99/artclView.do"] and len(a["tabs"]) == 2
    assert (b["content"], b["content_status"], b["coverage"]) == ("", "empty", "content_missing")
    view = "<div class='view viewCont'><div class=txt>Body\n</div><img src='/a.png'><img src='data:x'></div><a href='/x/download.do'>F  1</a><a href='/y/download.do'>바로보기</a>"
    x = pages.extract_links(spark.createDataFrame([(1, "https://h/q", view)], "page_id long, url string, html string")).first()
    assert (x["body"], x["images"], [tuple(f) for f in x["attachments"]]) == ("Body", ["https://h/a.png"], [("https://h/x/download.do", "F 1")])


def test_page_trees_of_any_depth_take_linear_time(spark):
    deep = "<div><b>" * 60_000 + "x" + "</b></div>" * 60_000 + "<p>end</p>"
    unmatched = "<div></zz></q>" * 75_000 + "<p>end</p>"
    mixed = "<table><tr><td>" * 20_000 + "in" + "<ul><li><a href='/l'>l</a>" * 20_000 + "<p>end</p>"
    for page, words in ((deep, ["x", "end"]), (unmatched, ["end"])):
        began = time.process_time()
        root = pages.read(page)
        assert time.process_time() - began < 4 and root.text().split() == "".join(root.text()).split() and all(w in root.text() for w in words)
        assert [n.depth for n in root.walk() if n.tag == "p"] == [1] or page is unmatched
        assert pages._visible_lines(root, pages.Layout()) == words
    df = spark.createDataFrame([(1, "https://h/", deep), (2, "https://h/", unmatched), (3, "https://h/", mixed)], "page_id long, url string, html string")
    got = {r["page_id"]: r["content"] for r in pages.extract_page(df).collect()}
    assert got[1] == "x\nend" and got[2] == "end" and got[3].endswith("end")
    assert pages.fields(df).count() == 3 and pages.links(df.filter("page_id < 3")).count() == 0
    flat = pages.read("<div>" * 700 + "a</div>b" + "</div>" * 699 + "<p>c</p>")
    assert flat.text() == "abc" and max(n.depth for n in flat.walk()) == pages.MOST_DEEP
    odd = pages.read("<ul><li>a<ul><li>b</ul><li>c</ul></b><td>d<a href=1>e<a href=2>f")
    assert [(n.tag, n.text()) for n in odd.all("li")] == [("li", "ab"), ("li", "b"), ("li", "c")] and [n.text() for n in odd.all("a")] == ["e", "f"]


def test_faq_lists(spark):
    item = lambda q, a: f"<li><div class='question'>{q}</div><div class='answer'>{a}</div></li>"
    page = "<span class=_totPage> 7 </span><div class='faq-list'><ul>" + item("<span class='cate-name'>학적</span><b>Q one</b>", " line  one\n<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>\nlast") + item("Q two", "A two") + item("no answer", " ") + "<li>other</li></ul></div><dl><dt>x</dt><dd>y</dd></dl>"
    df = spark.createDataFrame([(1, "https://h/1", page), (2, "https://h/2", "<dl><dt>Q</dt><dd>A</dd><dt>lone</dt></dl>"), (3, None, None)], "page_id long, url string, html string")
    rows = sorted(pages.faq(df, "p:").collect(), key=lambda r: (r["page_id"], r["question"]))
    assert [(r["page_id"], r["question"], r["answer"], r["category"], r["total"]) for r in rows] == [
        (1, "Q two", "A two", "학사 FAQ", 7), (1, "학적 Q one", "line one\na | b\na | c\nlast", "학적", 7), (2, "Q", "A", "학사 FAQ", 1)]
    assert rows[2]["id"] == hashlib.sha256(b"p:Q").hexdigest() and rows[2]["content_hash"] == hashlib.sha256(b"Q\nA").hexdigest()


def test_pages(spark):
    html = "<h1>H</h1><nav><a href='/x'>Ex</a></nav><a href='f.pdf'>file</a><img src=i.png><table><tr><th>n</th><th>title</th><th>d</th></tr><tr><td>notice</td><td>P</td><td>2026.01.09</td></tr><tr><td>1</td><td>Q</td><td>2025.12.01</td></tr></table><dl><dt>Why?</dt><dd>So.</dd></dl>"
    df = spark.createDataFrame([(1, "https://h/a/", html), (2, None, None)], "page_id long, url string, html string")
    f = {r["page_id"]: r for r in pages.fields(df).collect()}
    assert f[1]["heading"] == "H" and f[1]["n_images"] == 1 and f[1]["attachments"] == ["https://h/a/f.pdf"] and f[1]["date"] == "2026-01-09" and f[2]["coverage"] == "empty"
    rows = pages.listing(df, "2026-01-01")
    assert [(r["title"], r["pinned"], r["wanted"]) for r in rows.orderBy("place").collect()] == [("P", True, True), ("Q", False, False)]
    assert pages.reached(rows, "2026-01-01").first()["reached"]
    assert [(r["question"], r["answer"], r["total"]) for r in pages.faq(df, "p:").collect()] == [("Why?", "So.", 1)]
    assert {(r["target"], r["in_menu"]) for r in pages.links(df).collect()} == {("https://h/x", True), ("https://h/a/f.pdf", False)}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "t", "content": "", "url": "u"}, {"id": "2", "title": "s", "source_type": "form"}]')
    one = {"name": "a", "path": str(tmp_path / "a.json"), "default_type": "notice", "priority": 1, "required": True}
    gone = {"name": "b", "path": str(tmp_path / "b.json"), "default_type": "faq", "priority": 2, "required": False}
    rows = {r["id"]: r for r in files.read_sources(spark, [one, gone]).collect()}
    assert rows["1"]["content"] == "" and rows["2"]["content"] is None and rows["1"]["source_type"] == "notice" and rows["2"]["source_type"] == "form"
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, [{**gone, "required": True}])
    assert files.fingerprint(spark, [str(tmp_path / "a.json")]).first()["bytes"] == (tmp_path / "a.json").stat().st_size
    files.write_snapshot(spark.range(3), str(tmp_path / "new"))
    with pytest.raises(FileExistsError):
        files.write_snapshot(spark.range(3), str(tmp_path / "new"))
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link><description></description><pubDate>d</pubDate></item><item><title> </title></item></channel></rss>")
    assert [tuple(r) for r in files.read_rss(spark, str(tmp_path / "f.xml"), 9).collect()] == [("A", "l", "A", "d")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.jsonl", "1\n2\n")
        z.writestr("a.jsonl", "x\n")
    assert [(r["member"], r["place"], r["line"]) for r in files.read_zip_lines(spark, str(tmp_path / "z.zip")).collect()] == [("a.jsonl", 0, "x"), ("b.jsonl", 0, "1"), ("b.jsonl", 1, "2")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/content.hpf", "")
        z.writestr("Contents/section1.xml", "<s><p><t>c</t></p></s>")
        z.writestr("Contents/section0.xml", "<s xmlns:h='u'><h:p><h:t>a</h:t><h:t>b</h:t></h:p><h:p/></s>")
    heads = [("a", b"%PDF-1.4"), ("b", b"PK\x03\x04rest"), ("c", b"text"), ("d.do", buffer.getvalue()), ("e.hwpx", b"PK\x03\x04rest"), ("f", bytes.fromhex("d0cf11e0a1b11ae1")), ("g", b"RIFFxxxxWEBP"), ("h", b""), ("i", None)]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in heads], "path string, content binary")
    assert {r["path"]: r["format"] for r in files.file_format(df).collect()} == {
        "a": "pdf", "b": "unsupported", "c": "unsupported", "d.do": "hwpx", "e.hwpx": "hwpx", "f": "hwp", "g": "image", "h": "unsupported", "i": "unsupported"}
    texts = {r["path"]: (r["text"], r["status"], r["sections"]) for r in files.hwpx_text(df).collect()}
    assert texts["d.do"] == ("ab\n\nc", "success", 2) and texts["b"][1] == "failed" and texts["i"][1] == "failed" and len(texts) == 9
    assert files.fingerprint(spark, [str(tmp_path / "a.json")]).first()["rows"] == 2
    files.write_documents(spark.createDataFrame([("a\x00b", 1)], "t string, n int"), str(tmp_path / "lines"))
    assert [tuple(r) for r in files.read_lines(spark, str(tmp_path / "lines"), "t string, n int").collect()] == [("ab", 1)]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(4, "doc_id").write.parquet(str(tmp_path / "docs"))
    want = versions.resolve(corpus.version_rows(docs)).select("key", "current.hash", "current.source")
    # Every batch sends one source of all its documents, so a key's versions come in several batches.
    parts = corpus.version_rows(docs)
    for seq in (1, 2, 3):
        parts.filter(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(str(tmp_path / "versions"))
    state, log = upserts.upsert(upserts.open_stream(spark, str(tmp_path / "versions")), lambda b: b)
    got = state.select("key", "current.hash", "current.source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert log.filter("decision = 'skipped'").count() > 0


def test_streams_go_on_after_a_failure_and_a_restart(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts, rows = corpus.version_rows(docs), str(tmp_path / "versions")
    for seq in (1, 2):
        parts.filter(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(rows)
    broken = {"left": 1}

    def fails_in_the_second_batch(batch):
        if batch.filter("seq = 2").limit(1).count() and broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("lost")
        return batch

    at = str(tmp_path / "checkpoint")
    open_ = lambda: upserts.open_stream(spark, rows)
    with pytest.raises(Exception, match="lost"):
        upserts.upsert(open_(), fails_in_the_second_batch, at)
    upserts.upsert(open_(), fails_in_the_second_batch, at)
    parts.filter("seq = 3").coalesce(1).write.mode("append").parquet(rows)
    upserts.upsert(open_(), fails_in_the_second_batch, at)
    state, log = upserts.upsert(open_(), fails_in_the_second_batch, at)  # nothing new
    want = versions.resolve(parts)
    names = ["key", "current.hash", "current.source", "current.checked_at"]
    assert sorted(map(str, state.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    assert log.count() == versions.log_rows(want).count()
    (tmp_path / "none").mkdir()
    parts.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none"))
    empty, none = upserts.upsert(upserts.open_stream(spark, str(tmp_path / "none")), lambda b: b, str(tmp_path / "c2"))
    assert empty.count() == 0 and none.count() == 0

    seen = []

    def work(batch):
        first = batch.agg(F.min("seq")).first()[0]
        if first == 2 and 2 not in seen:
            seen.append(2)
            raise RuntimeError("lost")
        return batch.select("doc_id", "seq")

    with pytest.raises(Exception, match="lost"):
        upserts.backfill(open_(), work, str(tmp_path / "c3"))
    assert sorted(map(tuple, upserts.backfill(open_(), work, str(tmp_path / "c3")).collect())) == sorted(map(tuple, parts.select("doc_id", "seq").collect()))


def test_a_batch_of_one_key_reads_and_writes_one_bucket(spark, tmp_path):
    parts, rows, at = corpus.version_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), str(tmp_path / "versions"), str(tmp_path / "checkpoint")
    parts.filter("seq = 1").coalesce(1).write.parquet(rows)
    upserts.upsert(upserts.open_stream(spark, rows), lambda b: b, at, buckets=8)
    one = parts.filter("seq = 2").orderBy("doc_id").limit(1)
    one.coalesce(1).write.mode("append").parquet(rows)
    read, held = [], upserts._held
    upserts._held = lambda spark, states, places, buckets: read.append(list(buckets)) or held(spark, states, places, buckets)
    try:
        state, _ = upserts.upsert(upserts.open_stream(spark, rows), lambda b: b, at, buckets=8)
    finally:
        upserts._held = held
    assert len(read[0]) == 1 and len(read[1]) == 8
    assert [p.name for p in (tmp_path / "checkpoint/versions/batch-1").glob("bucket=*")] == [f"bucket={read[0][0]}"]
    want = versions.resolve(parts.filter("seq = 1").unionByName(one))
    names = ["key", "current.hash", "current.source"]
    assert sorted(map(str, state.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_window_counts_of_many_batches(spark, tmp_path):
    for day in range(4):  # each batch brings a day, and a row of the day before that is still in time
        at = [dt.datetime(2026, 1, 1 + day, 12)] * 3 + [dt.datetime(2026, 1, max(1, day), 23)]
        spark.createDataFrame([(t, "k") for t in at], "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    got = upserts.windowed(upserts.open_stream(spark, str(tmp_path / "rows")), "ts", "1 day", "kind", "2 days").collect()
    assert sorted((r["start"].day, r["n"]) for r in got) == [(1, 5), (2, 4), (3, 4), (4, 3)]


def test_upsert_is_idempotent_and_keeps_untouched_parents(spark):
    c = "chunk_id string, parent_id string, url string, chunk_index int, page_content string"
    old = spark.createDataFrame([("a_c0", "a", "u1", 0, "x"), ("a_c1", "a", "u1", 1, "y"), ("b_c0", "b", "u2", 0, "z")], c)
    new = spark.createDataFrame([("a_c0", "a", "u1", 0, "new")], c)
    once = indexing.upsert_chunks(old, new)
    want = [("a_c0", "new"), ("b_c0", "z")]
    assert sorted((r["chunk_id"], r["page_content"]) for r in once.collect()) == want
    assert sorted((r["chunk_id"], r["page_content"]) for r in indexing.upsert_chunks(once, new).collect()) == want
    with pytest.raises(ValueError, match="no chunks"):
        indexing.upsert_chunks(old, new.limit(0))


def test_page_headings_keep_pages_whose_heading_breaks_off(spark, tmp_path):
    heads = ["Fish &amp; chips", "Fish &am", "Fish &amp", "a &quot b  c", "&", ""]
    rows = [(i, "https://h/", f"<h1>{h}</h1><p>x</p><a href='f.pdf'>f</a>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["heading"], r["n_files"]) for r in source_queries.page_headings(spark, str(tmp_path)).collect()}
    assert got == {i: (" ".join(html.unescape(h).split()), 1) for i, h in enumerate(heads)}


def test_greedy_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 1, 5), ("g", 2, 2, 9), ("g", 3, 3, 4), ("g", 4, 4, 1)], "by string, priority long, doc_id long, assets long")
    got = {r["doc_id"]: r["taken"] for r in freshness.greedy_budget(rows, "by", 3, 10).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_greedy_budget_equals_a_fold_over_few_candidates(spark):
    random = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", int(random.integers(0, 40)), i // 2, int(random.integers(0, 7))) for i in range(300)] + [("g1", 3, 5, 2)] * 3
    df = spark.createDataFrame(rows, "by string, priority long, doc_id long, assets long")
    want = []
    for g in {r[0] for r in rows}:
        docs = used = 0
        for _, d, a in sorted(r[1:] for r in rows if r[0] == g):
            fits = a > 0 and docs < 8 and used + a <= 20
            docs, used = docs + fits, used + a * fits
            want.append((str(g), d, fits))
    found = freshness.greedy_budget(df, "by", 8, 20)
    assert sorted((str(r["by"]), r["doc_id"], r["taken"]) for r in found.collect()) == sorted(want)
    assert not any(r["taken"] for r in freshness.greedy_budget(df, "by", 0, 20).collect())
    many = spark.range(50_000).select(F.lit("g").alias("by"), F.col("id").alias("priority"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("assets"))
    taken = freshness.greedy_budget(many, "by", 5, 7)
    assert sorted(r["doc_id"] for r in taken.filter("taken").collect()) == [1, 2, 4, 5, 7]
    # Of 50,000 rows in a group the array that is folded holds at most max_docs of each number of assets.
    assert "WindowGroupLimit" in taken._jdf.queryExecution().executedPlan().toString()


def test_greedy_budget_passes_over_rows_without_assets(spark):
    rows = spark.createDataFrame([("g", i, i, a) for i, a in enumerate([0, 0, 5, None, 3])], "by string, priority long, doc_id long, assets long")
    assert sorted(r["doc_id"] for r in freshness.greedy_budget(rows, "by", 2, 10).filter("taken").collect()) == [2, 4]


def test_newest_first_ranks_by_days(spark):
    rows = [(i, None if i % 13 == 0 else "s", None if i % 17 == 0 else f"2026-01-{1 + i % 5:02d} {i % 3:02d}:00", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, site string, date string, w int")
    found = freshness.newest_first(df, F.col("w") == 1, 10, "site")
    got = {r["doc_id"]: (r["rank"], r["selected"]) for r in found.collect()}
    want = {}
    for site in ("s", None):
        ordered = sorted((r for r in rows if r[1] == site and r[3]), key=lambda r: r[0])
        ordered.sort(key=lambda r: r[2] or "", reverse=True)
        want |= {r[0]: (n + 1, n < 10) for n, r in enumerate(ordered)}
    assert got == want
    assert "windowspecdefinition(site#" not in re.sub(r"(site#\d+), _day#\d+", "day", found._jdf.queryExecution().analyzed().toString())


@pytest.mark.parametrize("sent", [2048, 3])
def test_knn_scans_chunks_where_they_lie_or_meets_in_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "QUESTIONS_SENT", sent)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 3)
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 10)
    monkeypatch.setattr(retrieval, "CHUNKS_SCANNED", 17)
    random = np.random.default_rng(3)
    x = random.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]
    c = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").coalesce(2)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)], "query_id long, embedding array<double>")
    found = retrieval.knn(q, c, 15)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("embedding" not in line for line in plan.split("\n") if "Exchange" in line) and ("FlatMapCoGroups" in plan) == (sent == 3)
    got = {(r["query_id"], r["raw_rank"]): r["chunk_id"] for r in found.collect()}
    score = np.round(1 - (2 - 2 * (x[:10] @ x.T)) / 2**0.5, 6)
    want = {(i, n + 1): f"c{j}" for i in range(10) for n, j in enumerate(sorted(range(40), key=lambda j: (-score[i, j], f"c{j}"))[:15])}
    assert got == want
    assert not retrieval.knn(q.limit(0), c, 15).collect() and not retrieval.knn(q, c.limit(0), 15).collect()


def test_select_context_caps_a_url_and_drops_what_is_far_behind(spark):
    rows = [(1, f"c{i}", u, s, i, False) for i, (u, s) in enumerate([("a", .9), ("a", .88), ("b", .85), ("a", .84), ("a", .83), ("c", .7)], 1)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, url string, final_score double, place int, guided boolean")
    for spared in (df.withColumn("guided", F.lit(True)), None):
        kept = retrieval.select_context(df if spared is None else spared, 9, least=-1 if spared is None else 0.25)
        assert "c6" in {r["chunk_id"] for r in kept.collect()}
    assert [r["chunk_id"] for r in retrieval.select_context(df, 5).orderBy("context_rank").collect()] == ["c1", "c2", "c3", "c4"]


def test_page_headings_equal_the_standard_parser(spark):
    class Head(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.text = False, ""

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "h1"

        def handle_endtag(self, tag):
            self.inside &= tag != "h1"

        def handle_data(self, data):
            self.text += data if self.inside else ""

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").join(source_queries.page_headings(spark, "/root/testdata/sf0.01"), "page_id").collect():
        h = Head()
        h.feed(r["html"])
        assert r["heading"] == " ".join(h.text.split())


SCHEDULES = [  # shapes of sentences and what they hold: rule, start, end, unconfirmed
    ("3월 2일 14:00 예정된 강연은 취소되었습니다.", [("cancelled", "2026-03-02T14:00:00+09:00", None, [])]), ("과제는 3월 2일 자정까지입니다.", [("midnight", None, None, ["time", "exact_boundary"])]),
    ("조사는 12월 30일부터 1월 2일까지입니다.", [("range", "2026-12-30", "2027-01-02", ["time"])]), ("조사는 2027년 1월 2일 09:00부터 1월 3일 18:00까지", [("range_with_times", "2027-01-02T09:00:00+09:00", "2027-01-03T18:00:00+09:00", [])]),
    ("조사는 3월 9일 09:00부터 3월 2일 18:00까지", [("range_with_times", None, None, ["period_order"])]), ("내일 오전 9시에 모임", [("tomorrow", "2026-03-05T09:00:00+09:00", None, ["end_time"])]),
    ("2026학년도 장학 안내문입니다 3.1\n신청 기간: 3.2(월) 10:00 ~ 3.9 24:00", [("dated_range", "2026-03-02T10:00:00+09:00", "2026-03-09", ["time", "exact_boundary"])]),
    ("면접 일시: 2026.3.7(토) 14:00", [("dated", "2026-03-07T14:00:00+09:00", None, ["end_time"])]), ("행사 3.7", [("dated", "2026-03-07", "2026-03-07", ["time"])]), ("값은 3.7 배", []), (None, []), ("", []),
]


def test_schedules(spark):
    df = spark.createDataFrame([(i, t, dt.date(2026, 3, 4)) for i, (t, _) in enumerate(SCHEDULES)], "doc_id long, content string, ref date")
    got: dict = {}
    for r in extraction.extract_schedules(df).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["rule"], r["start_at"] or r["start_date"], r["end_at"] or r["end_date"], r["unconfirmed"]))
    assert got == {i: want for i, (_, want) in enumerate(SCHEDULES) if want}
    conflict = extraction.extract_schedules(df.filter("doc_id = 6")).first()
    assert "headline names other days" in conflict["reason"] and not conflict["confirmed"] and extraction.extract_schedules(df.limit(0)).count() == 0


def test_schedule_titles_and_hours_over_midnight(spark):
    texts = [
        "오늘 18시까지 지도교수 면담 신청서를 학과 사무실로 제출해야 합니다.", "공학교육인증 설명회 일정: 1차 10월 6일 11:00, 2차 10월 8일 16:00 (각 1시간 진행)",
        "[긴급] 금일(9월 23일) 17:00까지 국가장학금 지급 계좌 오류자 정보 수정 필수", "오늘 18시 까지 과제 제출", "금일(2월 31일) 17:00까지 서류 제출", "1차 12월 31일 23:30, 2차 2월 28일 23:00 (1시간 진행)",
        "보고서는 오늘 25시까지 제출하세요", "1차 10월 6일 11:00, 2차 10월 8일 16:00 각 1시간", "1차 2월 30일 11:00, 2차 10월 8일 16:00 (1시간 진행)",
    ]
    df = spark.createDataFrame([(i, t, dt.date(2026, 9, 23)) for i, t in enumerate(texts)], "doc_id long, content string, ref date")
    got: dict = {}
    for r in extraction.extract_schedules(df).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["rule"], r["title"], r["start_at"], r["end_at"], r["confirmed"], r["ambiguous"], r["quote"]))
    t = lambda s: f"2026-{s}:00+09:00"
    assert got[0] == [("today", "지도교수 면담 신청서 제출", None, t("09-23T18:00"), True, False, "오늘 18시까지")]
    assert got[1] == [("rounds", "공학교육인증 설명회 1차", t("10-06T11:00"), t("10-06T12:00"), True, False, "1차 10월 6일 11:00"), ("rounds", "공학교육인증 설명회 2차", t("10-08T16:00"), t("10-08T17:00"), True, False, "2차 10월 8일 16:00")]
    assert got[2] == [("urgent", "국가장학금 지급 계좌 정보 수정 마감", None, t("09-23T17:00"), True, False, "금일(9월 23일) 17:00까지")]
    assert got[3] == [("today", "과제 제출 마감", None, t("09-23T18:00"), True, False, "오늘 18시 까지")]
    assert [x[:6] for x in got[4]] == [("urgent", "서류 제출 마감", None, None, False, True)]
    assert [x[1:4] for x in got[5]] == [("설명회 1차", t("12-31T23:30"), "2027-01-01T00:30:00+09:00"), ("설명회 2차", t("02-28T23:00"), t("03-01T00:00"))]
    assert [x[:6] for x in got[6]] == [("today", "보고서 제출", None, None, False, True)]
    assert all(x[0] != "rounds" for x in got.get(7, []))
    assert [(x[2], x[3], x[4]) for x in got[8]] == [(None, None, False), (t("10-08T16:00"), t("10-08T17:00"), True)]


def test_media_are_kept_only_for_the_same_revision(spark):
    asset = "array<struct<url:string,name:string,text:string,status:string>>"
    schema = f"url string, title string, html_content string, content string, content_status string, images {asset}, attachments {asset}, media_status string, attempted_at string"
    image = [("https://m/i#1", "i", "seen", "success")]
    new = [("a", "T", None, "body", "text", image, None, "partial", "2"), ("b", "T", None, "body", "text", image, None, "partial", "2"), ("c", "T", "", "body", "text", None, None, "failed_or_unsupported", "2"), ("d", "T", None, "body", "text", image, [], "complete", "2")]
    old = [("a", "T", "body", "body seen", "mixed", [("https://m/i", "j", "seen", "success")], [], "complete", "1"), ("b", "T", "other", "other seen", "mixed", image, [], "complete", "1"), ("c", "T", None, "body", "mixed", None, None, "complete", "1")]
    got = {r["url"]: (r["content"], r["media_status"], r["media_refresh_status"]) for r in media.retain_previous(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == {"a": ("body seen", "complete", "partial"), "b": ("body", "partial", None), "c": ("body", "failed_or_unsupported", None), "d": ("body", "complete", None)}


def test_overlap_pairs_equal_a_plain_join(spark):
    d = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    rows = [(i, i % 2, d(i * 3 % 40), d(i * 3 % 40 + i % 17)) for i in range(60)]
    s = spark.createDataFrame(rows, "id long, who long, start date, end date")
    got = sorted(map(tuple, schedules.overlap_pairs(s.filter("id < 30"), s.filter("id >= 30"), "who").collect()))
    assert got == sorted((a[0], b[0]) for a in rows[:30] for b in rows[30:] if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_run_metrics_leave_out_what_did_not_run(spark):
    rows = [("a", "PASS", False, True, True, False), ("a", "FAIL", False, False, True, False), ("a", "NOT_RUN", False, True, True, False), ("a", "PASS", True, False, False, True)]
    r = evaluation.run_metrics(spark.createDataFrame(rows, "g string, verdict string, should_abstain boolean, hit1 boolean, hit3 boolean, abstained boolean"), "g").first()
    assert (r["n"], r["not_run"], r["pass_rate"], r["hit_at_1"], r["hit_at_3"], r["abstain_rate"]) == (4, 1, 66.67, 50.0, 100.0, 100.0)


VERDICTS = [
    # answer, facts, quotes, negatives, abstain, category, situation, status, verdict, score
    ("x", "", [], [], False, "", "", "NOT_RUN", "NOT_RUN", 0.0),
    ("x", "", [], [], False, "", "", "FAILED", "ERROR", 0.0),
    ("관련 공지를 찾지 못했습니다", "", [], [], True, "", "", "OK", "PASS", 1.0),
    ("그렇습니다", "", [], [], False, "", "irrelevant_query", "OK", "FAIL", 0.0),
    ("제목만 있습니다", "", [], [], False, "title_only_notice", "", "OK", "PASS", 1.0),
    ("3만원입니다", "", [], [], False, "missing_fee", "", "OK", "FAIL", 0.0),
    ("금액은 명시되어 있지 않습니다", "", [], [], False, "", "missing_info_in_notice", "OK", "PASS", 1.0),
    ("신청은 9월 9일까지, 서류 제출은 9월 16일까지", "", [], [], False, "period_apply", "", "OK", "PASS", 1.0),
    ("신청은 09월 16일까지", "", [], [], False, "period_apply", "", "OK", "FAIL", 0.0),
    ("9월 중순", "", [], [], False, "period_apply", "", "OK", "REVIEW", 0.5),
    ("동의 마감은 9월 9일, 신청 마감은 9월 16일", "", [], [], False, "period_distinction", "", "OK", "FAIL", 0.0),
    ("신청은 9월 9일, 동의는 9월 16일", "", [], [], False, "period_distinction", "", "OK", "PASS", 1.0),
    ("9월 9일입니다", "서류 제출 9월 16일", [], [], False, "period_distinction", "", "OK", "FAIL", 0.0),
    ("3월 17일 마감", "", [], [], False, "other_year_distinction", "", "OK", "PASS", 1.0),
    ("5월 1일 마감", "", [], [], False, "other_semester_distinction", "", "OK", "FAIL", 0.0),
    ("재학생과 신입생", "", [], [], False, "target_audience", "", "OK", "PASS", 1.0),
    ("재학생과 신입생", "", [], ["신입생"], False, "freshman_rule", "", "OK", "FAIL", 0.0),
    ("한국장학재단 누리집", "", [], [], False, "apply_method", "", "OK", "PASS", 1.0),
    ("누리집", "", [], [], False, "apply_method_auth", "", "OK", "REVIEW", 0.5),
    ("beta first, alpha then", "", ["alpha (gamma) beta"], [], False, "", "", "OK", "PASS", 1.0),
    ("alpha", "", ["alpha gamma beta"], [], False, "", "", "OK", "FAIL", 0.0),
    ("alpha beta", "", ["alpha, beta", "none at all", "nor this"], [], False, "", "", "OK", "REVIEW", 0.5),
    ("alpha beta", "", ["alpha beta"], ["beta"], False, "", "", "OK", "FAIL", 0.0),
    ("alpha를 찾을 수 없습니다", "", ["alpha"], [], False, "", "", "OK", "FAIL", 0.0),
    (" ab ", None, ["ab"], None, None, None, None, "OK", "PASS", 1.0),
    (None, "", None, [], False, "", "", "OK", "FAIL", 0.0),
]


def test_answer_verdict_follows_the_whole_cascade(spark):
    names = "answer facts quotes negatives abstain category situation status".split()
    kinds = "string string array<string> array<string> boolean string string string".split()
    df = spark.createDataFrame([(i, *v[:8]) for i, v in enumerate(VERDICTS)], "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    got = {r["i"]: (r["status"], r["score"]) for r in df.select("i", evaluation.answer_verdict(*map(F.col, names)).alias("v")).select("i", "v.*").collect()}
    assert got == {i: v[8:] for i, v in enumerate(VERDICTS)}


def plain_calendar(content):
    """Events by a cursor over the lines, as the rules say."""
    lines = [x.strip() for x in (content or "").split("\n") if x.strip()]
    dated = lambda i: i < len(lines) and re.match(r"\d{4}\.\d{2}\.\d{2}", lines[i]) is not None
    found, i = [], 0
    while i < len(lines):
        if not dated(i):
            i += 1
            continue
        ranged = i + 2 < len(lines) and lines[i + 1] == "~" and dated(i + 2)
        span = f"{lines[i]} ~ {lines[i + 2]}" if ranged else lines[i]
        at = i + 3 if ranged else i + 1
        name = lines[at] if at < len(lines) else ""
        if name and (span, name) not in found and " ".join(f"{span} {name}".split()) == f"{span} {name}":
            found.append((span, name))
        i = at + 1
    return found


def test_calendar_events_equal_a_cursor_over_lines(spark):
    random = np.random.default_rng(8)
    lines = ["2026.03.02(월)", "2026.03.06(금)", "~", "개강", " 수강 신청 ", "", "2026.02.31", "a  b", "2026.04.01 ~ 2026.04.03", "글 2026.01.01"]
    texts = ["\n".join(random.choice(lines, 25)) for _ in range(60)] + [None, "", "2026.03.02(월)", "2026.03.02(월)\n~\n2026.03.06(금)", "2026.03.02(월)\n~\n2026.03.06(금)\n개강", "2026.03.02\n" * 3 + "끝" + "\nx" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    got = {}
    for r in schedules.calendar_events(df).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["span"], r["name"]))
        assert r["place"] == len(got[r["doc_id"]]) - 1
        if r["span"] == "2026.03.02(월) ~ 2026.03.06(금)":
            assert (r["start"], r["end"]) == (dt.date(2026, 3, 2), dt.date(2026, 3, 6))
        if r["span"] == "2026.02.31":
            assert r["start"] is None and r["end"] is None
    assert got == {i: plain_calendar(t) for i, t in enumerate(texts) if plain_calendar(t)}
    one = schedules.date_lines(spark.createDataFrame([(1, "2026.03.02(월) ~ 2026.03.06(금) 개강\n2026-03-09 (수)\n 입학식")], "doc_id int, content string")).collect()
    assert [(r["title"], str(r["start"]), str(r["end"])) for r in one] == [("개강", "2026-03-02", "2026-03-06"), ("입학식", "2026-03-09", "2026-03-09")]


def test_latency_quantiles_of_continuous_values_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BINS", 16)
    random = np.random.default_rng(2)
    rows = [(f"g{i % 3}" if i % 7 else None, ["PASS", "FAIL", "ERROR", "NOT_RUN"][i % 4], float(random.gamma(2.0, 3.0))) for i in range(3000)]
    rows += [("one", "PASS", 2.5), ("same", "PASS", 4.0), ("same", "PASS", 4.0), ("none", "NOT_RUN", 1.0), ("null", "PASS", None)]
    got = {r["by"]: r for r in evaluation.latency(spark.createDataFrame(rows, "by string, verdict string, seconds double"), "by").collect()}
    assert len(got) == 8
    for g, r in got.items():
        for name, kinds in (("", ("PASS", "FAIL", "ERROR")), ("ok_", ("PASS", "FAIL"))):
            v = [s for b, k, s in rows if b == g and k in kinds and s is not None]
            for q in (50, 95):
                assert r[f"{name}p{q}"] == (pytest.approx(np.percentile(v, q), rel=1e-12) if v else None)
            assert r[f"{name}mean"] == (pytest.approx(np.mean(v)) if v else None)


def test_breakdown_by_every_grouping(spark):
    rows = [("a", "dev", "single", ["u1"], ["u1", "x"]), ("a", "dev", "multi", ["u1", "u2"], ["u2", "x", "u1"]), ("a", "test", "multi", ["u1", "u2"], ["u1"]), ("b", "dev", "abstain", [], ["u1"]), ("b", "dev", "single", ["u9"], ["a", "b", "c", "u9"])]
    got = {(r["level"], r["category"], r["split"], r["case_type"]): (r["total"], r["n"], r["abstain"], r["top1"], r["top3"], r["top5"], r["partial"]) for r in evaluation.breakdown(
        spark.createDataFrame(rows, "category string, split string, case_type string, expected array<string>, got array<string>")).collect()}
    assert got["all", None, None, None] == (5, 4, 1, 25.0, 50.0, 75.0, 25.0)
    assert got["category", "b", None, None] == (2, 1, 1, 0.0, 0.0, 100.0, 0.0) and got["split", None, "test", None] == (1, 1, 0, 0.0, 0.0, 0.0, 100.0)
    assert got["case_type", None, None, "abstain"] == (1, 0, 1, None, None, None, None) and got["slice", "a", "dev", "multi"] == (1, 1, 0, 0.0, 100.0, 100.0, 0.0)
    assert len(got) == 1 + 2 + 2 + 3 + 5


def test_canonical_urls_of_any_case_and_of_one_path(spark):
    urls = ["HTTPS://WWW.H.kr/hub/12/v.do?x=1#y", "http://h.kr:80/hub/3/v.do", "http://h.kr:8080/hub/3/v.do", "https://u@h.kr/hub/3/v.do", "https://evil.kr/hub/3/v.do", "https://h.kr/login.do", "javascript:alert(1)", None, "https://h.kr/hub/12/v.do\n"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(T.canonical_url(F.col("u"), r"(?:www\.)?h\.kr", r"/hub/\d+/v\.do", "https://www.h.kr").alias("site"), T.canonical_url(F.col("u"), r"(?:www\.)?h\.kr").alias("own"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["https://www.h.kr/hub/12/v.do", "https://www.h.kr/hub/3/v.do", *[None] * 7]
    assert [g[1] for g in got][:3] == ["https://www.h.kr/hub/12/v.do", "http://h.kr/hub/3/v.do", None]


def test_review_summary_keeps_answers_and_links_apart(spark):
    schema = "g string, status string, has_references boolean, answer boolean, link boolean, reasons array<string>, retrieved boolean, cited boolean"
    rows = [
        ("a", "success", True, True, False, ["link"], True, False), ("b", "no_context", False, True, None, None, None, None), ("b", "not_run", True, None, None, None, False, None),
        ("c", "success", False, False, None, ["wrong", "wrong"], None, None),
    ]
    got = {r["g"]: r for r in evaluation.review_summary(spark.createDataFrame(rows, schema), "g").collect()}
    assert (got["a"]["answer_accuracy"], got["a"]["link_accuracy"], got["a"]["retrieval_coverage"], got["a"]["citation_coverage"]) == (100.0, 0.0, 100.0, 0.0)
    assert [tuple(x) for x in got["a"]["failures"]] == [("link", 1)] and [tuple(x) for x in got["b"]["statuses"]] == [("no_context", 1), ("not_run", 1)]
    assert (got["b"]["answer_accuracy"], got["b"]["link_accuracy"], got["b"]["answer_reviewed"]) == (None, None, 1)
    assert (got["c"]["answer_accuracy"], got["c"]["link_accuracy"], got["c"]["retrieval_coverage"]) == (0.0, None, None) and [tuple(x) for x in got["c"]["failures"]] == [("wrong", 1)]


def test_ranks_and_wins_gather_no_group(spark):
    random = np.random.default_rng(4)
    rows = [(None if i % 13 == 0 else f"g{i % 2}", int(random.integers(0, 3)), i) for i in random.permutation(500).tolist()]
    df = spark.createDataFrame(rows, "g string, o int, id long")
    got = {r["id"]: r["turn"] for r in freshness.ranked(df, "g", F.col("o"), "id", per=50).collect()}
    want = {}
    for g in (None, "g0", "g1"):
        want |= {i: n for n, (_, i) in enumerate(sorted((o, i) for h, o, i in rows if h == g), 1)}
    assert got == want
    plan = freshness.last_wins(df, "g", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan
    last = {r["g"]: (r["id"], r["place"], r["o"]) for r in freshness.last_wins(df, "g", "id").collect()}
    first = {r["g"]: r["id"] for r in freshness.first_wins(df, "g", "id").collect()}
    for g in (None, "g0", "g1"):
        of = sorted((i, o) for h, o, i in rows if h == g)
        assert last[g] == (of[-1][0], of[0][0], of[-1][1]) and first[g] == of[0][0]
    nulls = spark.createDataFrame([("k", None, "a"), ("k", 1, "b"), ("n", None, "c")], "g string, id long, v string")
    assert {r["g"]: r["v"] for r in freshness.last_wins(nulls, "g", "id").collect()} == {"k": "b", "n": "c"}
    assert {r["g"]: r["v"] for r in freshness.first_wins(nulls, "g", "id").collect()} == {"k": "a", "n": "c"}


def test_enrichment_tries_failed_media_again_and_newest_first(spark):
    rows = [(1, "u1", "2026-01-03", "text"), (2, "u2", "2026-01-03", "text"), (3, "u3", None, "title_only"), (4, "u4", "2025-01-01", "text"), (5, "u5", "2026-02-01", "text")]
    docs = spark.createDataFrame(rows, "doc_id long, url string, date string, status string")
    before = spark.createDataFrame([("u1", "failed_or_unsupported"), ("u3", "failed_or_unsupported"), ("u5", "complete")], "url string, media_status string")
    picked = lambda **k: {r["doc_id"]: r["selected"] for r in freshness.select_for_enrichment(docs, **k).collect()}
    assert picked(limit=2) == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert picked(since="2026-01-01", bare=True, limit=9) == {1: True, 2: True, 3: True, 5: True}
    assert picked(since="2026-01-01", bare=True, previous=before, limit=1) == {1: True, 3: False}
    texts = spark.createDataFrame([(3, None, "no"), (2, "word", None), (1, "x", "a word"), (4, "word", "")], "place long, title string, content string")
    marked = lambda limit: {r["place"] for r in freshness.keyword_select(texts, "word", limit, "place").filter("processed").collect()}
    assert marked(2) == {1, 2} and marked(None) == {1, 2, 4} and marked(0) == set()
    assert freshness.keyword_select(texts, "word", 2, "place").count() == 4


def test_known_metadata_of_chunks(spark):
    df = spark.createDataFrame([(["a", "b"], "x", ""), (None, None, "y")], "path array<string>, source_type string, contact string")
    got = df.select(T.chunk_metadata(F.col("path"), {"source_type": F.col("source_type"), "contact": F.col("contact")}).alias("m")).collect()
    assert [r["m"] for r in got] == [{"menu_path": "a / b", "source_type": "x"}, {"contact": "y"}]


def test_newest_correction_of_a_title(spark):
    rows = [("a", "t", "2026-01-01", False), ("b", "t", "2026-01-02", True), ("c", "t", "2026-01-03", True), ("d", "t", "2026-01-03", False), ("e", "t", "2026-01-02", False), ("f", "", "2026-01-01", False), ("g", "u", "2026-01-01", False), ("h", "t", None, True)]
    got = evaluation.superseded_by(spark.createDataFrame(rows, "id string, clean string, date string, corrected boolean"))
    assert {r["id"]: (r["newer"], r["n_newer"]) for r in got.collect()} == {"a": ("c", 2), "e": ("c", 1)}


def test_facts_of_a_case_hold_its_required_and_its_asked_terms(spark, tmp_path):
    said = {1: "of the la la", 5: "of the la la", 9: "of the la la zzz", 13: "of the la la zzz", 17: "of the"}
    docs = spark.createDataFrame([(i, said.get(i, ""), "en", "s", 0) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = spark_rows(upkeep_queries.snapshot_cases(spark, str(tmp_path)))
    assert got == sql_rows(con, upkeep_queries.R.sql["snapshot_cases"])
    cases = spark.createDataFrame([(1, ["u"], ["a b"], True)], "case int, expected_urls array<string>, required_terms array<string>, required boolean").withColumn("expected_ids", F.lit(None).cast("array<string>"))
    held = spark.createDataFrame([(1, "u", "p", "x ab")], "case int, url string, parent_id string, content string")
    read = lambda c: tuple(reports.snapshot_cases(c, held).select("facts_present", "missing_terms", "blocks").first())
    assert read(cases) == (True, [], False) and read(cases.withColumn("asked_terms", F.array(F.lit("c")))) == (False, [], False)
