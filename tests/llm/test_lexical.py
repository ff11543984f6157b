"""Ranked lexical search against its SQL and plain Python, and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import lexical
from corpusloom.llm.words import lower_ascii
from tests.compare import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, "Some rare words here"), (2, "some rare words here"), (2, "some rare words here"), (3, None), (4, ""), (5, " ,.- "), (6, LONG), (None, "rare"),
    (8, "été Été ÉTÉ rare"), (9, "rare " * 300), (10, "a\x00b \x1frare\x7fWORDS"), (11, "other things"),
]
ITEMS = [(1, "Rare, rare WORDS"), (2, "été"), (2, "word5 word6 nothing"), (3, None), (4, " . "), (None, "other"), (5, "absent term")]


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def plain_search(docs, items):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, all_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // all_terms
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, n in Counter(plain_terms(text)).items() if c[t]
            )
            if score:
                found.append((-score, i is None, i))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:20], 1)]
    return Counter(out)


def answers(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def frames(spark, docs, items):
    # Columns beside those that are read, also ones whose names clash with what is computed.
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, KEY string, n long"),
        spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double"),
    )


@pytest.mark.parametrize("limits", ["plain", "many blocks", "by shuffle"])
def test_odd_rows_equal_plain_python(spark, monkeypatch, limits):
    if limits == "many blocks":
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 20)
        monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 2)
    if limits == "by shuffle":
        monkeypatch.setattr(lexical, "BROADCAST_DOCS", 0)
    docs, items = frames(spark, ODD, ITEMS)
    assert answers(lexical.search(docs, items)) == plain_search(ODD, ITEMS)


def test_empty_tables(spark):
    docs, items = frames(spark, ODD, ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.search(d, i).count() == 0


def test_equal_scores_go_by_id_also_across_the_threshold(spark):
    docs = [(i, "same text of all") for i in range(70, 0, -1)] + [(100 + i, f"filler {i}") for i in range(50)]
    items = [(1, "same text"), (2, "filler all")]
    got = answers(lexical.search(*frames(spark, docs, items)))
    assert got == plain_search(docs, items)
    assert sorted(d for i, _, d, _ in got if i == 1) == list(range(1, 21))


def test_sketches_bound_every_score():
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    docs = [Counter(w.encode() for w in random.choice(words, size)) for size in (3, 40, 300, 3000)] + [Counter({b"w1": 900, b"w2": 1})]
    items = lexical.Items.of([(i, " ".join(random.choice(words, 12)).encode()) for i in range(8)])
    df = Counter(t for c in docs for t in c)
    items.weigh({i: df[t] for i, t in enumerate(items.terms)}, len(docs))
    all_terms = sum(c.total() for c in docs)
    for c in docs:
        m = lexical.length_norm(c.total(), len(docs), all_terms)
        sketch = lexical.sketch(c)
        bound = items.bounds(sketch[None, :], np.array([m]))[0]
        score = defaultdict(int)
        for t, term in enumerate(items.terms):
            for e in range(items.start[t], items.start[t + 1]):
                score[items.item[e]] += int(items.repeats[e] * items.weight[t]) * (lexical.impact(c[term], m) if c[term] else 0)
        assert all(bound[i] >= score[i] for i in range(8))
        assert len(sketch) == lexical.width_of(len(c)) >= 10 * len(c)


def test_equals_sql_on_tables(spark):
    assert spark_rows(lexical.op12_lexical_search(spark, SF)) == sql_rows(views(SF), lexical.SQL["op12_lexical_search"])
