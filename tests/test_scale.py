"""What keeps work in proportion to the input: expressions worked out once, rows dealt over the cores, what tasks hold."""

from __future__ import annotations

import datetime
import gc
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, extraction, retrieval, versions
from corpusloom.plans import corpus, corpus_queries, file_queries
from corpusloom.sources import files, pages
from corpusloom.streaming import upserts


def test_schedule_rules_are_tried_once_a_text(spark):
    docs = spark.createDataFrame([(1, "오늘 18시까지 제출", datetime.date(2026, 1, 5)), (2, "독서 대회\n신청: 3.2 ~ 3.5", datetime.date(2026, 1, 5))], "doc_id long, content string, ref date")
    found = extraction.extract_schedules(docs.withColumn("content", F.concat("content", F.lit(" "))).coalesce(1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("RLIKE" in line or "regexp_extract" in line)]
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["rule"] for r in found.select("rule").collect()) == ["dated_range", "today"]


def _shape(html, plain):
    built = pages._Builder()
    if plain:
        assert built.plain(html)
    else:
        built.feed(html)
        built.close()
    root = built.tree()
    return [(n.tag, n.attrs, n.depth, [c if isinstance(c, str) else c.at for c in n.children], n.stop) for n in root.page]


def test_plain_markup_is_read_by_one_pattern_as_the_parser_reads_it():
    html = "<!DOCTYPE html><ul class='a b'><li><A HREF=\"/x\" b>1 &amp; 2</a><li>3</ul><td rowspan=2 colspan='3'>x<br/>y<!-- c --><script>f()</script><title>a &lt; b</title></p>" + "<div>" * 600 + "z"
    assert _shape(html, True) == _shape(html, False)
    root = pages.read(html)
    assert [n.text() for n in root.all("li")] == ["1 & 2", "3"] and root.marked('b') == root.all('ul')


def test_a_tag_that_pages_repeat_is_read_once():
    pages._tag.cache_clear()
    long = "<p title='" + "x" * 300 + "'>"
    root = pages.read("<ul>" + "<li class='a'>x &lt; y</li>" * 1000 + "</ul>" + long)
    assert pages._tag.cache_info().misses == 4 and len(root.marked("a")) == 1000 and root.marked("a")[9].text() == "x < y"
    assert root.all("p")[0].attrs == {"title": "x" * 300}


def test_pages_without_number_address_or_text(spark):
    found = pages.links(spark.createDataFrame([(None, None, "<a href='/x'>y</a>"), (1, "https://h/", None)], "page_id long, url string, html string"))
    assert [tuple(r) for r in found.collect()] == [(None, 0, "/x", "/x", "y", False, [])]


def test_odd_markup_is_left_to_the_parser():
    for html in ("a < b", "<a href=x/>", "<a href='x&amp;y'>", "<script>'<b>'</script>", "<script>", "<iframe>a &amp; b</iframe>", "<p", "</ p>", "<a b='1'c='2'>"):
        assert not pages._Builder().plain(html)


def test_guidance_pages_are_dealt_over_the_cores(spark):
    assert file_queries._guidance(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_and_files_reach_python_in_small_batches(spark):
    chunking.chunk_documents(spark.createDataFrame([("d", "u", "t", "c")], "id string, url string, title string, content string"))
    files.hwpx_text(spark.createDataFrame([("p", b"")], "path string, content binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_a_group_of_questions_is_scored_in_slices(monkeypatch):
    sizes, scores = [], retrieval._scores
    monkeypatch.setattr(retrieval, "_scores", lambda q, x: sizes.append(len(q)) or scores(q, x))
    v = np.random.default_rng(1).normal(size=(200, 8))
    given = list((v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4"))
    found = retrieval._nearest(3)(pd.DataFrame({"query_id": range(150), "embedding": given[:150]}), pd.DataFrame({"chunk_id": [f"c{i:03d}" for i in range(200)], "embedding": given}))
    assert max(sizes) <= 64 and len(found) == 450
    assert found.groupby("query_id")["chunk_id"].first().tolist() == [f"c{i:03d}" for i in range(150)]


def test_every_later_correction_is_returned(spark):
    rows = [("a", "2026-01-01", "t", False), ("b", "2026-01-02", "t", True), ("c", "2026-01-03", "t", True), ("d", "2025-12-31", "t", True), ("e", "2026-01-01", "", False)]
    found = evaluation.superseding_pairs(spark.createDataFrame(rows, "id string, date string, clean string, corrected boolean"))
    assert sorted(map(tuple, found.collect())) == [("a", "b"), ("a", "c")]


def test_keyword_select_takes_every_document_that_holds_the_word(spark):
    sf = "/root/testdata/sf0.01"
    held = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("text").contains("tion")).count()
    assert held > 50 and corpus_queries.keyword_select(spark, sf).filter("processed").count() == held


def test_a_batch_of_a_stream_writes_its_own_contents_once(spark, tmp_path):
    parts = corpus.version_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    dealt = parts.withColumn("n", F.pmod(F.crc32("key"), F.lit(6)))
    for n in range(6):  # each document in a batch of its own, then those of the first batch once more
        dealt.filter(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    again = dealt.filter("n = 0").drop("n").withColumn("seq", F.col("seq") + 10)
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    state, log = upserts.upsert(upserts.open_stream(spark, str(tmp_path / "rows")), lambda b: b, str(tmp_path / "c"), buckets=4)
    written = {n: spark.read.parquet(str(tmp_path / f"c/versions/batch-{n}")).count() for n in range(7)}
    assert sum(written.values()) == parts.select("key").distinct().count() + again.select("key").distinct().count()
    want = versions.resolve(parts.unionByName(again))
    names = ["key", "current.hash", "current.source", "current.checked_at"]
    assert sorted(map(str, state.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    assert log.count() == versions.log_rows(want).count()


def test_parts_of_an_index_are_merged_by_size():
    held, rows = [], 0
    for n in range(1000):
        stay, _, size = upserts._merged(held, 10)
        held, rows = [*stay, (n, size)], rows + size
        assert sum(s for _, s in held) == 10 * (n + 1) and all(a > 2 * b for (_, a), (_, b) in zip(held, held[1:]))
    assert rows <= 10 * 1000 * 10


def test_trees_of_pages_are_freed_without_a_search_for_rings():
    count = lambda: sum(isinstance(o, pages.Node) for o in gc.get_objects())
    gc.collect()
    held = count()
    gc.disable()
    try:
        for _ in range(10):
            root = pages.read("<div id='x' class='a b'><p>1<ul><li>2</ul></div>")
            assert root.marked("#x") == root.marked("b") == root.all("div")
            pages._part(root)
        del root
        assert count() == held
    finally:
        gc.enable()


def test_plain_addresses_are_joined_as_urljoin_does():
    bases = ("https://h/g/1", "https://h", "http://H:80/a", "https://h/a?b=c/d", "", "https://h/a/b/../c", "//h/x", "https://h/a.html")
    for href in ("/", "/a/b.do?x=1", "//h/x", "../x", "/x?", "/a/../b", "/a/./b.", "/a/..", "/x;y", "/a//b", "/.x", "/a?x#y", "/a.b/c", "http://z/q"):
        assert [pages._join(b, href) for b in bases] == [urljoin(b, href) for b in bases]


def test_pairs_of_one_title_are_made_by_many_tasks(spark):
    rows = [(f"a{i}", f"2026-01-{1 + i % 9:02d}", "t", False) for i in range(40)] + [(f"c{i}", f"2026-01-{1 + i % 13:02d}", "t", True) for i in range(30)]
    rows += [("x", "2026-01-01", "u", False), ("y", "2026-01-02", "u", True), ("z", None, "t", True), ("e", "2026-01-01", "", False)]
    found = evaluation.superseding_pairs(spark.createDataFrame(rows, "id string, date string, clean string, corrected boolean"), per_block=4)
    want = [(a, b) for a, d, t, c in rows for b, e, u, k in rows if t and t == u and k and not c and e and e > d]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    at = found.filter("id LIKE 'a%'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(at) > 5 and max(r["count"] for r in at) < len(want) / 3
