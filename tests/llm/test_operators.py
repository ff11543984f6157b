"""Each operator against plain Python, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import html.parser
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, html_text, jaccard, mixing, packing, ppm, quality, rules, sharding, url_filter, vectors
from corpusloom.llm.queries import QUERIES, SQL
from corpusloom.llm.words import lower_ascii, split_words
from tests.compare import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD_TEXTS = [None, "", " \n\t", "one", "a b\x1cc A\x0bB ÀÉ", LONG, "same text again and again", "same text again and again"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeats, a very long text, and columns whose names clash."""
    rows = [(i, t, "en", f"s{i % 2}" if i else None, 1, "x", 2.0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, ODD_TEXTS[7], "en", "s1", 1, "x", 2.0), (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(con, SQL[name])


# Sharding


def plain_shard(key, shards):
    """The shard of the least -ln(u), u from 32 bits of an md5 of the key and the shard's block of four."""
    digests = [hashlib.md5(f"{'null' if key is None else key}:{b}".encode()).hexdigest() for b in range(-(-shards // 4))]
    return min(range(shards), key=lambda s: (-math.log((int(digests[s // 4][8 * (s % 4) :][:8], 16) + 0.5) / 2**32), s))


def test_sharding(docs, odd, empty):
    rows = sharding.shard_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], 24), plain_shard(r["doc_id"], 25))
        assert r["grown_shard"] in (r["shard"], 24)
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    out = sharding.shard_documents(odd).collect()
    assert len(out) == odd.count() and len({r["shard"] for r in out if r["doc_id"] == 7}) == 1
    assert all(r["shard"] == plain_shard(r["doc_id"], 24) for r in out)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_documents(empty).count() == 0


def test_shares_follow_weights_and_growth_moves_few(spark):
    keys = spark.range(20_000)
    got = sharding.assign(keys, "id", [1, 2, 0, 1], [1, 2, 0, 1, 1]).groupBy("shard", "grown_shard").count().collect()
    by = Counter()
    for r in got:
        by[r["shard"]] += r["count"]
        assert r["grown_shard"] in (r["shard"], 4)
    assert by[2] == 0 and abs(by[1] / 20_000 - 0.5) < 0.02


# Rules


def plain_measures(text):
    words = split_words(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, odd, empty, spark):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(["a " * 8, "a " * 9, "a b " * 20, "x\nx\n \nx", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 1 2 3 4 5 6 7 8", "#$|<>&%*"])], "doc_id long, text string")
    for df in (docs, odd, tricky):
        for r in rules.judge(df).collect():
            want = plain_measures(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert rules.judge(empty).count() == 0
    clashing = odd.select("*", F.lit("mine").alias("n_words"), F.lit("mine").alias("Kept"), F.lit("mine").alias("_words"), F.lit("mine").alias("TEXT"))
    assert [c for c in rules.judge(clashing).columns if c.lower() == "kept"] == ["kept"] and "_words" in rules.judge(clashing).columns
    for df in (odd, clashing):
        kept = rules.keep_documents(df)
        want = Counter(r["doc_id"] for r in rules.judge(odd).filter("kept").collect())
        assert kept.columns == df.columns and Counter(r[0] for r in kept.collect()) == want
    assert rules.keep_documents(empty).count() == 0


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plain_copies(rows, seed=7):
    """Copies of (doc_id, source, size) rows in their order: whole ones, and one more up to the row whose middle passes the rest."""
    size = defaultdict(int)
    for _, source, n in rows:
        size[source] += n
    target, out = plain_targets(dict(size)), [0] * len(rows)
    draw = lambda d: int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:12], 16)
    for source, total in size.items():
        whole = int(target[source] // total) if total else 0
        rest, ahead = target[source] - whole * total, 0
        mine = [i for i, r in enumerate(rows) if r[1] == source]
        for i in sorted(mine, key=lambda i: (draw(rows[i][0]), -1 if rows[i][0] is None else rows[i][0], rows[i][2])):
            out[i] = whole + (rest > 0 and 2 * ahead + rows[i][2] <= 2 * rest)
            ahead += rows[i][2]
    return out


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.repetitions(df).collect()
        assert len(rows) == df.count()
        size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            most[r["source"]] = max(most[r["source"]], r["size"])
            assert r["taken"] <= 2 * r["size"]
        want = plain_targets(dict(size))
        for r in rows:
            assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert all(abs(taken[s] - want[s]) <= most[s] for s in size)
        plain = [(r["doc_id"], r["source"], len(split_words(r["text"]))) for r in df.collect()]
        assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in rows) == Counter((*r, n) for r, n in zip(plain, plain_copies(plain), strict=True))
        assert sorted(map(str, rows)) == sorted(map(str, mixing.repetitions(df).collect()))
    assert mixing.repetitions(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0
    copies = Counter()
    for r in mixing.repetitions(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.repeat_documents(odd).collect()) == +copies and mixing.repeat_documents(odd).columns == odd.columns
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.repetitions(docs).collect()}
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({d: n for d, n in copies.items() if n})


def test_mixing_of_equal_rows(spark):
    """As many of equal rows get one more copy as fit, in every way that they are read."""
    text = " ".join(["w"] * 10)
    rows = [(1, text, "a")] * 100 + [(2, text, "a"), (3, text, "b"), (None, text, "a"), (None, text, "a"), (1, "", "a"), (1, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.repetitions(df).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 5 for s in taken)
    again = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.repeat_documents(df).collect())
    assert sum(n * len((t or "").split()) for (_, t, _), n in again.items()) == sum(taken.values())


# URL filter


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x?q", "https://b.example.org/en/12", "http://x.org", "HTTP://example.com/fr/", "http://c.com/de/#f", "nourl", None, "", "http://spam.net/a.html", "http://www.spam.net/a/", "http://notexample.org/es/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, html string, RULE string")
    listed = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), (None,)], "key string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert url_filter.judge_urls(pages, listed).count() == pages.count()
    want = {0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("b.example.org", "/en/12", "example.org/en/1", "block"), 2: ("x.org", "", None, "allow"), 3: ("example.com", "/fr/", "com/fr/", "allow"),
            4: ("c.com", "/de/", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("spam.net", "/a.html", None, "block"), 9: ("www.spam.net", "/a/", None, "block"),
            10: ("notexample.org", "/es/", "org/", "allow"), 11: ("b:", "//c/d", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want
    assert url_filter.judge_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_urls_that_many_pages_have_are_judged_alike(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT_URLS", 5)
    urls = ["http://spam.net/a"] * 9 + ["http://other.net/b"] * 9 + ["http://few.net/c", "http://spam.net/d", None, "x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([("spam.net/a",)], "key string")).collect()
    assert Counter((r["host"], r["verdict"]) for r in got) == {("spam.net", "block"): 10, ("other.net", "allow"): 9, ("few.net", "allow"): 1, ("spam.net", "allow"): 1, ("", "allow"): 2}


def test_listed_urls_hold_spellings_and_urls_that_no_page_has(spark, con):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    keys = {r["key"] for r in url_filter.listed_urls(read("pages"), read("documents"), read("labels")).collect()}
    pages = {r["key"] for r in read("pages").select(url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("key")).collect()}
    assert len({k.split("/")[0] for k in keys}) >= 6 and keys - pages


def test_bloom_drops_no_key_and_few_others_pass(spark):
    keys = spark.range(5000).select(F.xxhash64(F.lit("k"), "id").alias("h"))
    bloom = url_filter.build_filter(keys, 5000)
    assert url_filter.maybe_listed(keys, bloom).count() == 5000
    assert url_filter.maybe_listed(spark.range(5000).select(F.xxhash64(F.lit("other"), "id").alias("h")), bloom).count() < 250


# HTML


def test_html(spark):
    prose = "The cat of the house is in the garden and it was a good day for all of us to be at home with the others, that is what they said to us in the evening of the day."
    page = f"<title>T</title><div class='menu'><a href=x>Home</a></div><p>{prose}</p><p>Caf&eacute;&nbsp;&amp; <b>bar</b></p><form>Name of the user</form><div id=comments><p>{prose} I say.</p></div><script>var a='<p>x</p>'</script><p>{prose} &copy; 2020</p>"
    assert html_text.main_text(page) == f"{prose}\nCafé & bar"
    framed = f"<header>Top of the page</header><article><h1>Head</h1><p>Short.<p>{prose}<br>more<aside>see also the other one</aside><ul><li>item</ul></article><p>{prose}</p>"
    assert html_text.main_text(framed) == f"Head\nShort.\n{prose} more\nitem"
    odd = ["", None, "<", "<p", "a < b & c", "<article>" + "<p>x y</p>" * 20_000 + "</article>", "<!-- open", "<script>open", '<a title="' + "<" * 5000]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(odd)] + [(0, None, "", None), (None, None, None, None)], "page_id long, url string, html string, TEXT string")
    rows = html_text.extract(df).collect()
    assert len(rows) == len(odd) + 2 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert next(r for r in rows if r["page_id"] == 5)["n_chars"] == 20_000 * 4 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_asides_and_attributes():
    prose = "The cat of the house is in the garden and it was a good day for all of us to be at home with the others, that is what they said to us in the evening of the day."
    story = f"<article><h1>Head</h1><p>{prose}</p>"
    assert html_text.main_text(f"{story}</article><aside><article><p>{prose} Teaser.</p></article></aside>") == f"Head\n{prose}"
    assert html_text.main_text(f"{story}</article><div id=comments><article><p>{prose} I disagree.</p></article></div>") == f"Head\n{prose}"
    assert html_text.main_text(f"{story}<p>Read more: <a href=x>one</a></p><aside>see also</aside><p>End.</p></article>") == f"Head\n{prose}\nEnd."
    assert html_text.main_text(f"<div class='layout sidebar-right'><main><p>{prose}</p></main><p>{prose} Side.</p></div>") == prose
    assert html_text.main_text(f'{story}<p title="{"x" * 5000} > y">{prose} Two.</p></article>') == f"Head\n{prose}\n{prose} Two."
    assert html_text.main_text(f"<p>Up</p><p>{prose}</p><p>down</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>last</p>") == f"Up\n{prose}\ndown"
    for slow in ('<a title="', "<![CDATA[", "<!x", "<select>", "<a b='\"' ", "<", "<a x='>\">"):
        html_text.main_text(slow * 30_000)  # linear: a search that fails is not made again


def test_names_alone_drop_no_dense_prose():
    prose = "The cat of the house is in the garden and it was a good day for all of us to be at home with the others, that is what they said to us in the evening of the day."
    assert html_text.main_text(f'<div class="page sidebar-left"><div><p>{prose}</p><p>Short one.</p></div></div>') == f"{prose}\nShort one."
    assert html_text.main_text(f'<article><p class="notice">{prose}</p><p class="notice">Only a note.</p><p>{prose} Two.</p></article>') == f"{prose}\n{prose} Two."
    assert html_text.main_text(f'<article><p class="notice">{prose}</p></article>') == prose
    assert html_text.main_text(f'<div class="content"><p>{prose}</p></div><div class="comments"><p>{prose} I say.</p></div>') == prose
    assert html_text.main_text(f'<div class="sidebar"><p>{prose} Side.</p></div><article><p>Short.</p></article>') == "Short."


def test_unmatched_end_tags_and_deep_nesting_take_linear_time():
    for page in ("<div></zz>" * 100_000, "<div>" * 100_000 + "x" + "</section></div>" * 60_000, "<section><div class=ad>x</section>" * 30_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 4


class PlainBlocks(html.parser.HTMLParser):
    """Blocks of a page by the standard parser: every block element parts them, inline elements do not, links are counted."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.inside, self.linked = [], [], 0, 0

    def end(self):
        text = " ".join("".join(self.parts).split())
        self.found += [(text, self.linked)] if text else []
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.inside = 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "span", "em"):
            self.end()

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = 0
        elif tag not in ("b", "span", "em"):
            self.end()

    def handle_data(self, data):
        self.parts.append(data)
        self.linked += len(data.strip()) * self.inside


def test_blocks_equal_an_independent_splitter():
    """Generated pages of nested blocks, inline elements, links, references and comments."""
    random = np.random.default_rng(12)
    words = ["the", "word", "caf&eacute;", "a &lt; b", "&amp;", "x\n y", "1&nbsp;2"]

    def text():
        return " ".join(random.choice(words, random.integers(1, 9)))

    def inline():
        kind = random.integers(6)
        return [text(), f"<b>{text()}</b> ", f"<a href='/{random.integers(9)}'>{text()}</a> ", f"<span title='a > b'>{text()}</span>", f"{text()}<br>{text()}", f"{text()}<!-- <p>no</p> --> "][kind]

    def blocks(depth):
        out = ""
        for _ in range(random.integers(1, 5)):
            tag = str(random.choice(["p", "h2", "li", "div", "section", "ul", "table", "blockquote"]))
            inner = "".join(inline() for _ in range(random.integers(0, 4)))
            if tag in ("div", "section", "ul", "table", "blockquote") and depth < 5:
                inner += blocks(depth + 1) + inline()
            out += f"<{tag}>{inner}</{tag}>"
        return out

    for _ in range(300):
        page = f"<html><body>{blocks(0)}</body></html>"
        plain = PlainBlocks()
        plain.feed(page)
        plain.close()
        plain.end()
        assert [(b.text, b.link_chars) for b in html_text.blocks_of(page)] == plain.found


class ArticleText(html.parser.HTMLParser):
    """The blocks of a well-formed page's article, read by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.parts = False, [], []

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text and self.inside else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.inside |= tag == "article"
        self.parts += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.parts.append(data)


def article_blocks(page):
    parser = ArticleText()
    parser.feed(page)
    parser.close()
    return parser.blocks


def plain_labels(blocks, stop_words=frozenset(rules.STOP_WORDS)):
    """Both passes over blocks of a page without an article, by search over all blocks."""
    first = []
    for b in blocks:
        words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in b.text.split()]
        share, links = sum(w in stop_words for w in words) / len(words), b.link_chars / len(b.text)
        short = len(words) < 10
        first.append("bad" if b.aside or links > 0.4 or (short and links > 0.2) or "©" in b.text else "short" if short else "good" if share >= 0.2 and len(words) > 30 else "near" if share >= 0.12 else "bad")
    out = []
    for i, label in enumerate(first):
        near = [(abs(i - j), first[j] != "good") for j, b in enumerate(blocks) if b.section == blocks[i].section and first[j] in ("good", "bad")]
        sides = [min((x for x in near_side), default=None) for near_side in ([(i - j, first[j]) for j in range(i) if blocks[j].section == blocks[i].section and first[j] in ("good", "bad")], [(j - i, first[j]) for j in range(i + 1, len(blocks)) if blocks[j].section == blocks[i].section and first[j] in ("good", "bad")])]
        if label == "near":
            label = "good" if not near or any(x and x[1] == "good" for x in sides) else "bad"
        elif label == "short":
            label = "bad" if not near or min(near)[1] else "good"
        out.append(label)
    return out


def test_html_of_all_pages(spark):
    """Every page against the standard parser; without article elements density alone finds most of it, and only that."""
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r for r in html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert set(got) == set(pages)
    found = wanted = stopless = 0
    for i, page in pages.items():
        blocks = article_blocks(page["html"])
        assert got[i]["text"] == "\n".join(blocks) and got[i]["url"] == page["url"]
        bare = re.sub(r"<(/?)article>", r"<\1div>", page["html"])
        parts = html_text.blocks_of(bare)
        html_text.classify(parts)
        assert [b.label for b in parts] == plain_labels(parts)
        kept = [b.text for b in parts if b.label == "good"]
        assert not set(kept) - set(blocks)
        found, wanted = found + sum(map(len, kept)), wanted + sum(map(len, blocks))
        stopless += html_text.main_text(bare, stop_words=frozenset()) != html_text.main_text(bare)
    assert found >= 0.9 * wanted and stopless >= 0.8 * len(pages)


# Packing


def test_word_encoder_gives_the_tokenizers_ids(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    encoder, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = [r["text"] for r in docs.collect()] + ["it's DON'T", "x\x1cy", "e\u0301 \u0301a", "a\x85b\u3000c", "<|endoftext|> a", "ŒUVRE ÿ Ÿ ß İ Σ", "123 a1b2 ...!? word,,, (word)", "가나 漢字 😀"]
    for t in texts:
        assert encoder.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    for df in (docs, odd):
        rows = packing.pack_documents(df, packing.tokenizer_file()).collect()
        ids = defaultdict(list)
        for r in df.collect():
            ids[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
        want = Counter()
        for d, copies in ids.items():
            for x in copies:
                for k, a in enumerate(range(0, len(x), 2048)):
                    part = x[a : a + 2048]
                    want[(d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1
    assert packing.pack_documents(empty, packing.tokenizer_file()).count() == 0


def test_packing_in_rounds(spark):
    random = np.random.default_rng(1)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(random.integers(1, 900, 3000))], "item long, length long")
    bins = packing.pack(items, capacity=1000, pieces_per_group=500, fan_in=2).collect()
    seen = Counter(m["item"] for b in bins for m in b["members"])
    assert len(seen) == 3000 and set(seen.values()) == {1}
    assert all(sum(m["length"] for m in b["members"]) <= 1000 for b in bins)
    assert len(bins) <= 1.03 * items.agg(F.sum("length")).first()[0] / 1000
    over_half = spark.createDataFrame([(i, 600) for i in range(400)], "item long, length long")
    assert len(packing.pack(over_half, capacity=1000, pieces_per_group=50).collect()) == 400
    some_fit = spark.createDataFrame([(i, 600) for i in range(400)] + [(i, 400) for i in range(400, 800)], "item long, length long")
    assert len(packing.pack(some_fit, capacity=1000, pieces_per_group=50).collect()) <= 430


# Jaccard join


def plain_components(texts):
    sets = {}
    for d, t in texts:
        w = split_words(lower_ascii(t)) if t else []
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts():
    random = np.random.default_rng(3)
    word = lambda: f"w{random.integers(0, 4000)}"
    texts = []
    passage = [word() for _ in range(40)]
    for _ in range(12):  # groups of near copies, with more and with fewer edits, some in a chain
        base = [word() for _ in range(random.integers(30, 200))]
        for k in range(random.integers(2, 16)):
            copy = list(base)
            for _ in range(random.integers(0, max(1, len(base) // 25))):
                copy[random.integers(0, len(copy))] = word()
            if k % 3 == 0:
                copy = copy[: len(copy) * 9 // 10]
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + [word() for _ in range(random.integers(3, 60))]))
    return texts + ["a b c", "A b\tc", "a b", "", None, "x y z v w", "X y z v w"]


def test_jaccard_join(spark, odd, empty):
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df).collect()}
    assert got == plain_components(rows)
    assert jaccard.near_copies(odd).count() == odd.count()
    assert jaccard.near_copies(empty).count() == 0
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if d == c)
    assert Counter(r["doc_id"] for r in jaccard.keep_first(odd).collect())[6] == 1
    assert jaccard.keep_first(empty).count() == 0 and jaccard.keep_first(odd).columns == odd.columns


def test_jaccard_join_of_cut_lists_and_small_blocks(spark, monkeypatch):
    rows = list(enumerate(near_texts()))
    whole = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *given: whole(*given, list_part=4, list_block=2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_bitmaps_bound_the_difference_of_sets_of_any_size():
    random = np.random.default_rng(8)
    for n, changed in ((10, 0), (1000, 100), (1500, 700), (5000, 100), (90_000, 9000)):
        a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[changed:], random.integers(0, 1 << 63, changed // 2).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        got = jaccard._bits_apart([jaccard._bitmap(a)] * 2, [jaccard._bitmap(b), jaccard._bitmap(a)])
        assert got[1] == 0 and apart * 0.4 <= got[0] <= apart


def test_keep_first_judges_each_text_of_a_shared_or_missing_id(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, c + " end"), (None, c), (None, "d e f g h i"), (None, "d e f g h i"), (None, None), (4, ""), (4, ""), (5, "D e f g h i")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _node int")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_first(df).collect())
    best_c = [k for k in got if k[1] and k[1].startswith("c0")]
    assert len(best_c) == 1 and best_c[0][0] == 3 and got[best_c[0]] == 1
    del got[best_c[0]]
    assert got == Counter({(1, a): 1, (2, b): 1, (5, "D e f g h i"): 1, (None, None): 1, (4, ""): 2})
    ids = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df).collect()}
    assert (None, 2, 5) in ids and (None, 36, 3) in ids and (None, 0, None) in ids


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200 and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# PPM


def plain_scores(rows, order=ppm.ORDER):
    counts, words, n_texts = [defaultdict(Counter) for _ in range(order + 1)], Counter(), 0
    split = lambda t: split_words(lower_ascii(t)) if t else []
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    for d, t in rows:
        if train(d):
            b = ppm.END * order + ppm.spelled(split(t))
            for i in range(order, len(b)):
                for k in range(order + 1):
                    counts[k][b[i - k : i]][b[i]] += 1
            words.update(split(t))
            n_texts += 1
    total = sum(words.values()) + n_texts
    bottom = total + 0.5 * (len(words) + (n_texts > 0) + 1)
    out = []
    for d, t in rows:
        b, score = ppm.END * order + ppm.spelled(split(t)), 0.0
        for i in range(order, len(b)):
            gone, found = set(), False
            for k in range(order, -1, -1):
                c = {s: n for s, n in counts[k].get(b[i - k : i], {}).items() if s not in gone}
                if not c:
                    continue
                n = sum(c.values()) + len(c)
                if b[i] in c:
                    score, found = score + math.log10(c[b[i]] / n), True
                    break
                score += math.log10(len(c) / n)
                gone |= set(c)
            score -= 0 if found else math.log10(256 - len(gone))
        base = sum(math.log10((words[w] + 0.5) / bottom) for w in split(t)) + math.log10((n_texts + 0.5) / bottom)
        out.append((not train(d), len(split(t)) + 1, sum(words[w] > 0 for w in split(t)) + (n_texts > 0), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("most_words", [ppm.MOST_WORDS, 3])
def test_ppm(spark, docs, odd, empty, most_words):
    rows = [(r["doc_id"], r["text"][:300]) for r in docs.limit(40).collect()] + [(1000 + i, t[:400] if t else t) for i, t in enumerate(ODD_TEXTS)] + [(1001, ""), (None, "null id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r)[1:] for r in ppm.score_documents(df, most_words=most_words).collect())
    for a, b in zip(got, plain_scores(rows), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-7)
    assert ppm.score_documents(empty, most_words=most_words).count() == 0


@pytest.mark.parametrize("most_words", [ppm.MOST_WORDS, 3])
def test_ppm_keeps_every_node_of_a_trie_that_is_not_broadcast(spark, docs, most_words, monkeypatch):
    monkeypatch.setattr(ppm, "TASK_NODES", 500)
    rows = [(r["doc_id"], r["text"][:300]) for r in docs.limit(40).collect()] + [(1000 + i, t[:400] if t else t) for i, t in enumerate(ODD_TEXTS)] + [(1001, ""), (1001, "\x07 né"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in ppm.score_documents(df, most_nodes=1000, most_words=most_words).collect())
    for a, b in zip(got, plain_scores(rows), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-7)


def test_ppm_batches_ask_for_each_key_once(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BATCHES_PER_PART", 2)
    text = "the same words in every text " * 5
    rows = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    dealt = rows.withColumn("batch", (F.col("doc_id") % 5).cast("int"))
    got = ppm._answers(dealt, ppm.gather(rows, 8), ["ppm", "word"], 8, 5).toPandas()
    sizes = got.assign(n=got["keys"].str.len() // 8, v=got["values"].str.len() // 8).groupby(["kind", "batch"])[["n", "v"]].sum()
    keys = {k for codes, _ in ppm._segments([ppm.spelled(text.split())]) for k in codes}
    assert sizes.loc["ppm"].to_numpy().tolist() == [[len(keys)] * 2] * 5 and sizes.loc["word"].to_numpy().tolist() == [[6, 6]] * 5
    worth = ppm.score_documents(rows, most_nodes=1, most_words=1).select("score", "base_score").distinct().toPandas()
    whole = ppm.score_documents(rows).select("score", "base_score").distinct().toPandas()
    assert np.allclose(worth.to_numpy()[0], whole.to_numpy()[0], atol=1e-7)


def test_small_trie_is_still_a_distribution(spark, docs):
    rows = spark.createDataFrame([(i, r["text"][:500]) for i, r in enumerate(docs.limit(60).collect())], "doc_id long, text string")
    model = ppm.trie(ppm.gather(rows, 8), most_nodes=3000)
    assert sum(map(len, model.keys)) <= 3000 + 256
    for context in (b"the a", b"\n\n\n\n\n", b"zzzzz"):
        code = np.uint64(int.from_bytes(context, "big") << 8)
        assert math.isclose((10 ** model.log10(np.array([code | np.uint64(s) for s in range(256)]))).sum(), 1, rel_tol=1e-9)


# Embeddings


def test_vectors(spark):
    random = np.random.default_rng(5)
    rows, n = [], 0
    for label in range(3):
        for _ in range(12):
            center = random.normal(size=16)
            for _ in range(random.integers(1, 14)):
                rows.append((n, (center + random.normal(size=16) * random.choice([0, 0.05, 0.12, 0.2])).tolist(), label, "x"))
                n += 1
    rows += [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, [float("nan")] + [1.0] * 15, 1, "x"), (n + 3, [None] + [1.0] * 15, 1, "x"), (n + 4, rows[0][1], None, "x"), (n + 5, [float("inf")] * 16, 0, "x"), (n + 6, [1.0, 2.0], 0, "x"), (n + 7, [2.0, 4.0], 0, "x"), (n + 8, [1e300] + [0.0] * 15, 2, "x"), (n + 9, [1e-300] + [0.0] * 15, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    unit = {}
    for i, e, label, _ in rows:
        if e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e) / np.abs(e).max()
            unit[i] = (v / np.linalg.norm(v), label)
    near = {(a, b) for a in unit for b in unit if a != b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98}
    count = Counter(a for a, _ in near)
    assert len(got) == len(rows) and {i: r["n_links"] for i, r in got.items()} == {i: count[i] for i, *_ in rows}
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for a, b in near:
            root[a] = min(root[a], root[b])
    assert {i: r["component_id"] for i, r in got.items()} == root and all(r["kept"] == (i == root[i]) for i, r in got.items())
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_a_grid_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_PER_CELL", 10)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    random = np.random.default_rng(6)
    x = np.repeat(random.normal(size=(20, 32)), 15, axis=0) + random.normal(size=(300, 32)) * 0.08
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum()


# Classifier


def plain_vectors(texts):
    """Sums of the index vectors of the two tokens to either side, one token at a time; then unit length, less the mean."""
    places, signs = quality.index_vectors()
    total, seen = defaultdict(lambda: np.zeros(quality.DIM)), Counter()
    for text in texts:
        ids = quality.tokens(text).tolist()
        seen.update(ids)
        for i, center in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    np.add.at(total[center], places[ids[j]], signs)
    unit = {w: total[w] / max(1e-9, np.linalg.norm(total[w])) for w in seen}
    mean = sum(unit[w] * n for w, n in seen.items()) / max(1, sum(seen.values()))
    return {w: v - mean for w, v in unit.items()}


def plain_score(text, vectors, network):
    """Mean of the tokens' vectors and the three other inputs, through both layers."""
    ids = quality.tokens(text).tolist()
    x = np.zeros(quality.FEATURES)
    if ids:
        x[: quality.DIM] = sum(vectors[i] for i in ids) / len(ids)
        x[quality.DIM :] = math.sqrt(sum(x[: quality.DIM] ** 2)), math.log(1 + len(ids)), sum(i < quality.RESERVED for i in ids) / len(ids)
    logit = network.b2
    for h in range(quality.HIDDEN):
        logit += network.w2[h] * math.tanh(sum((x[k] - network.mean[k]) / network.scale[k] * network.w1[k, h] for k in range(quality.FEATURES)) + network.b1[h])
    return 1 / (1 + math.exp(-max(-50, min(50, logit / network.temperature))))


def test_word_vectors_and_scores_equal_plain_python(spark, docs):
    rows = [(r["doc_id"], r["text"][:400]) for r in docs.limit(60).collect()] + [(1000 + i, t[:500] if t else t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows if d is not None], "doc_id long, quality int")
    model, _ = quality.train(df, labels)
    want = plain_vectors([t for _, t in rows])
    assert all(np.allclose(model.vectors[w], v, atol=1e-5) for w, v in want.items())
    assert not np.any(model.vectors[[i for i in range(quality.BUCKETS) if i not in want][:1000]])
    texts = dict(rows)
    for r in quality.score_documents(df, labels).collect():
        assert math.isclose(r["score"], plain_score(texts[r["doc_id"]], want, model.network), abs_tol=1e-4)


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_the_fit_stops_before_it_overfits_and_temperature_does_not_raise_the_loss(seed):
    random = np.random.default_rng(seed)

    def drawn():
        x = random.normal(size=(3000, quality.FEATURES))
        return x, (x[:, 0] + random.normal(size=3000) > 0).astype(float)

    net = quality.fit(*drawn())
    x, y = drawn()
    loss = lambda t: np.logaddexp(0, np.where(y == 1, -net.logits(x), net.logits(x)) / t).mean()
    assert loss(net.temperature) <= loss(1.0) + 0.01 and ((net.scores(x) > 0.5) == y).mean() > 0.72


def test_temperature_lowers_the_loss_and_the_sample_has_its_size(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(3000, quality.FEATURES))
    y = (x[:, 0] + random.normal(size=3000) > 0).astype(float)
    net = quality.fit(x, y)
    x = random.normal(size=(3000, quality.FEATURES))
    y = (x[:, 0] + random.normal(size=3000) > 0).astype(float)
    loss = lambda t: np.logaddexp(0, np.where(y == 1, -net.logits(x), net.logits(x)) / t).mean()
    assert loss(net.temperature) <= loss(1.0) + 0.01 and ((net.scores(x) > 0.5) == y).mean() > 0.7
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    seen = []
    fit, quality.fit = quality.fit, lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k)
    try:
        quality.train(df, df.select("doc_id", (F.col("doc_id") % 2).alias("quality")), sample_rows=1000)
    finally:
        quality.fit = fit
    assert 0 < seen[0] <= 1200


def test_classifier(spark, docs, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op1_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    aside = [d for d in labels if got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    assert sum(got[d]["predicted"] == labels[d] for d in aside) >= 0.95 * len(aside)
    marks = spark.createDataFrame([(0, 1), (3, 0), (5, 1), (5, 0), (None, 1), (2, None), (4, 7)], "doc_id long, quality int")
    out = quality.score_documents(odd, marks).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(empty, marks).count() == 0
    assert {r["score"] for r in quality.score_documents(odd, marks.limit(0)).collect()} == {0.5}
    kept = quality.keep_documents(odd, marks)
    want = Counter(r["doc_id"] for r in out if r["predicted"])
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == want
    assert quality.keep_documents(empty, marks).count() == 0


# Pipeline


def plain_kept_by_rules(text):
    n_words, chars, symbols, dup_lines, repeated = plain_measures(text)
    words, lines = split_words(text), [x for x in (text or "").split("\n") if split_words(x)]
    stop = set(rules.STOP_FORMS)
    return (
        n_words >= 20 and 100 * repeated <= 30 * n_words and 200 * n_words <= 100 * chars <= 1400 * n_words and 100 * symbols <= 10 * n_words
        and 100 * sum(w in stop for w in words) >= 3 * n_words and 100 * len(re.findall("[A-Z]", text)) <= 30 * chars
        and 100 * dup_lines <= 50 * len(lines) and 100 * sum(a == b for a, b in zip(words, words[1:])) <= 20 * n_words
    )


@pytest.mark.parametrize("kind", ["plain", "odd", "empty"])
def test_pipeline_equals_plain_python_stage_by_stage(spark, docs, kind):
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    whole = docs.schema
    kept = docs
    if kind == "odd":  # nulls in every column, repeats, shared ids, a very long text and a clashing column
        extra = [(None,) * len(whole), (1, None, None, None, None), (2, "", "en", None, 0), (3, LONG, "en", "s", 1), (3, LONG, "en", "s", 1), (3, "another text of this id", "en", "s", 1), (None, LONG, "en", "s", 1)]
        kept = docs.unionByName(spark.createDataFrame(extra, whole)).withColumn("SIZE", F.lit("mine"))
    if kind == "empty":
        kept = docs.limit(0)
    columns = kept.columns
    rows = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name in list(stages)[:-1]:
        before, kept = kept, corpus_pipeline.stored(stages[name](spark, kept, SF))
        given, got = rows(before), rows(kept)
        assert kept.columns == columns
        if name == "quality_classifier":
            model, _ = quality.train(before, labels)
            assert got == Counter({r: n for r, n in given.items() if plain_score(r[1], model.vectors, model.network) >= quality.THRESHOLD})
        elif name == "quality_rules":
            assert got == Counter({r: n for r, n in given.items() if plain_kept_by_rules(r[1])})
        elif name == "jaccard_join":
            texts = list(given)
            part = plain_components([(i, t) for i, (_, t, _) in enumerate(texts)])
            groups = defaultdict(list)
            for i, (n, c) in part.items():
                groups[c if n else -1].append(texts[i])
            alike = groups.pop(-1, [])
            least = {c: min((t[0] for t in g if t[0] is not None), default=None) for c, g in groups.items()}
            assert sum(got.values()) == len(groups) + sum(given[t] for t in alike)
            assert Counter(t[0] for t in got.elements()) == Counter(least.values()) + Counter(t[0] for t in alike for _ in range(given[t]))
        else:
            flat = [r for r, n in given.items() for _ in range(n)]
            copies = plain_copies([(d, source, len(split_words(t))) for d, t, source in flat])
            want = Counter()
            for r, n in zip(flat, copies, strict=True):
                want[r[0], r[2]] += n
            have = Counter()
            for (d, _, source), n in got.items():
                have[d, source] += n
            assert have == +want
    pieces = stages["best_fit_packing"](spark, kept, SF).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in kept.collect())
    ends = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(n <= packing.CAPACITY for n in ends.values())
