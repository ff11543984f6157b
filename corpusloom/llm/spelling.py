"""Spelling variants: words one edit apart, found by a join of chunks with positional grams, and the form each stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import drop_stored, pick, stored, table

LEAST_LENGTH = 7  # code points of a word
LEAST_COUNT = 2
TIMES = 10  # a form occurs so many times as often as its variant, at least
DELETES = 31  # a run loses a code point if this divides its hash
LIST = 32  # words of a chunk that are compared with each other; a longer list is cut by the halves of what its words do not share
WORDS_HELD = 400_000  # of a task, whose counts are added up before they are shuffled
BROADCAST_KEYS = 300_000  # chunks with long lists up to which they are broadcast

RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)  # after A-Z are lower-cased; a shorter run is no word, and a deletion makes it none


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n of every distinct word, from all whole texts: counts are added up in the tasks before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else doc_id.encode()))
                for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DELETES == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    held[run] += n
                if len(held) > WORDS_HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _rest(word: str, longest: Column) -> tuple[Column, Column]:
    """What a word has before and after the stretch lo to hi of a word that is `longest` long."""
    w = F.col(word)
    return F.substring(w, F.lit(1), F.col("lo")), F.substring(w, F.col("hi") - longest + F.length(w) + 1, F.length(w))


def with_key(rows: DataFrame) -> DataFrame:
    """Each row's chunk, with its place: the word without the stretch lo to hi in which the edit may lie."""
    before, after = _rest("word", F.col("longest"))
    return rows.withColumn("key", F.xxhash64("longest", "lo", "hi", before, after))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb of every two words that differ by one inserted, deleted or replaced code point, once; b is not longer than a.

    The longer word is cut into two disjoint chunks, its halves, and gives both with their
    places; the other gives its grams of the chunks' lengths at the places that a chunk can have
    there: shifted by one if the edit before it makes the word shorter, else not. One edit lies
    in one half, so that the other is preserved and the words meet there; what meets is verified.
    A chunk with more than LIST words is not compared as a whole: its words, which now differ
    within one half only, are cut again by the halves of that half, until lists are short or one
    code point is left, for which there are no more words than letters. Only lists without a word
    of the longer length, which hold no pair, are left out.
    """
    rows = words.select("word", "n", F.length("word").alias("size")).withColumn("longest", F.explode(F.array("size", F.col("size") + 1)))
    rows = rows.select("word", "n", "longest", F.lit(0).alias("lo"), F.col("longest").alias("hi"))
    parts = []
    while True:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
        cut = with_key(rows.withColumn("half", F.explode(F.filter(halves, lambda h: h["lo"] < h["hi"]))).select("word", "n", "longest", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi")))
        cut = stored(cut)
        own = F.length("word") == F.col("longest")
        long = stored(
            cut.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(own).alias("own"), F.max(F.col("hi") - F.col("lo")).alias("open"))
            .filter(f"NOT own OR (rows > {LIST} AND open > 1)").filter("rows > 1").select("key", "own")
        )
        n_long, n_again = long.agg(F.count(F.lit(1)), F.count_if("own")).first()
        hint = F.broadcast if n_long <= BROADCAST_KEYS else (lambda df: df)
        short = cut.join(hint(long), "key", "left_anti") if n_long else cut
        parts.append(stored(_compared(short)))
        if not n_again:
            break
        # What is cut again is counted and joined by its new chunks; a chunk's rows never meet as a whole.
        rows = stored(cut.join(hint(long.filter("own")), "key", "left_semi").drop("key"))
        drop_stored(cut)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _compared(cut: DataFrame) -> DataFrame:
    """Pairs within short lists that one edit parts. Of the places where a deletion gives the same word the last counts, so that a pair is found once."""
    lists = cut.groupBy("key", "longest", "lo", "hi").agg(F.collect_list(F.struct("word", "n")).alias("list")).filter(F.size("list") > 1)
    a = lists.withColumn("a", F.explode(F.filter("list", lambda x: F.length(x["word"]) == F.col("longest"))))
    first = lambda w, n: F.substring(w, F.lit(1), n)
    word = F.col("a.word")
    near = F.filter("list", lambda x: (
        ((F.length(x["word"]) < F.col("longest")) | (x["word"] < word))
        & (first(x["word"], F.col("hi")) != first(word, F.col("hi"))) & (first(x["word"], F.col("lo")) == first(word, F.col("lo")))
        & (F.levenshtein(x["word"], word, 1) == 1)
    ))
    found = a.select("a", F.explode(near).alias("b"))
    return found.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root (the last form reached) of every row of forms (word, form). Each round doubles the steps; forms only get more frequent, so they end."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_stored(reached)
        reached = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return reached


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every distinct word of LEAST_LENGTH code points that occurs LEAST_COUNT times.

    Words are runs of letters of the whole texts, with A-Z lower-cased, after the deletion of a
    code point where the hash of doc_id and run asks for it; a null doc_id is hashed as an empty
    one. Null and empty texts have no words. Repeated rows count as often as they are there. Ties
    between near words go to the smallest in code-point order. Columns other than doc_id and text
    are not read. An empty table gives an empty table.
    """
    words = stored(counted_words(docs))
    pairs = near_pairs(words)
    ways = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("other")).alias("by")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("other")).alias("by"))
    )
    near = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("by").alias("by"))
    often = -F.col("by.less") >= TIMES * F.col("n")
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("by.other")).alias("form"), F.when(often, -F.col("by.less")).alias("form_n")
    ))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# The crc is taken byte by byte from a table of 256 that the recursion makes; near words share what is left of them without one code point.
SQL = {
    "op11_spelling_variants": r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256))::UBIGINT AS i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*)::BIGINT AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[1:-2], lambda x: ('0x' || x)::UBIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM runs, crc
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run)::UBIGINT)::BIGINT) || substring(run, (h % length(run)::UBIGINT)::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), walk(word, reached) AS (
  SELECT word, word FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON walk.reached = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.reached AS root FROM walk JOIN formed f ON walk.reached = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
}
