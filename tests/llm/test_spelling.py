"""Spelling variants against their SQL and plain Python, and on odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import spelling
from corpusloom.llm.words import lower_ascii
from tests.compare import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}ending" for i in range(30_000))


def plain_words(docs):
    held = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                held[run] += 1
    return {w: n for w, n in held.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def answers(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def made_docs():
    """Words whose stems many share, with doubled letters, accents and chains of forms."""
    random = np.random.default_rng(6)
    letters = list("abé×àz")
    stems = ["stammen", "aaaaaaa", "éééàààé"]
    words = []
    for stem in stems:
        for _ in range(120):
            w = list(stem)
            for _ in range(random.integers(0, 3)):
                at = random.integers(len(w))
                if (kind := random.integers(3)) == 0:
                    w[at] = random.choice(letters)
                elif kind == 1:
                    w.insert(at, random.choice(letters))
                else:
                    del w[at]
            words.append("".join(w))
    docs = [(i, " ".join(random.choice(words, 40))) for i in range(30)]
    docs += [(1000, "chained " * 600 + "chaimed " * 45 + "chaimad " * 3), (1001, "Sameness samenesy " * 2 + "tiesxone tiesxonf tiesxong " * 10 + "tiesxon " * 2)]
    return docs


@pytest.mark.parametrize("limits", [(32, 300_000), (3, 300_000), (2, 0)])
def test_made_words_equal_plain_python(spark, monkeypatch, limits):
    monkeypatch.setattr(spelling, "LIST", limits[0])
    monkeypatch.setattr(spelling, "BROADCAST_KEYS", limits[1])
    monkeypatch.setattr(spelling, "WORDS_HELD", 50)
    docs = made_docs()
    got = answers(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert got == plain_variants(plain_words(docs))
    assert got["chaimad"][4] == "chained" and got["chaimad"][2] == "chaimed"


def test_odd_rows_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, LONG), (None, "nameless nameless"), (None, "nameless"), (4, "short words only"), (5, "UPPERCASE uppercase Ünderline ünderline"), (5, "UPPERCASE uppercase Ünderline ünderline"), (6, "1234567 _______")]
    df = spark.createDataFrame([(i, t, "x", 3, 1.0) for i, t in docs], "doc_id long, text string, WORD string, n long, form double")
    assert answers(spelling.variants(df)) == plain_variants(plain_words(docs))
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.filter("doc_id = 4")).count() == 0


def test_lists_without_a_longer_word_are_never_gathered(spark):
    words = spark.createDataFrame([(f"prefix{a}{b}", 2) for a in "abcdefghijklmnopqrst" for b in "abcdefghij"], "word string, n long")
    pairs = spelling.near_pairs(words).collect()
    assert len(pairs) == len({(r["a"], r["b"]) for r in pairs}) == 200 * (19 + 9) // 2


def test_equals_sql_on_tables(spark):
    assert spark_rows(spelling.op11_spelling_variants(spark, SF)) == sql_rows(views(SF), spelling.SQL["op11_spelling_variants"])
