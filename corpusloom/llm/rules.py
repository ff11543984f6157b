"""Quality rules: a table of thresholds compiled into Spark projections (native)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import words_column
from corpusloom.session import table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper", "n_doubled")

# Common words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was with as on be by are this from or an at he not "
    "de la le les et des un une du que qui en dans pour par sur est au pas avec ce il se ne "
    "der die und das den von zu im ein eine mit auf des dem ist nicht für als auch es an sich "
    "el los las del y una por con para no su al lo como más o esta"
).split()

STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


class Rule(NamedTuple):
    """A text fails if numerator / denominator is below least or above most."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


# A text that fails one of these has too little or too much repeated text to be judged further.
BASE: tuple[Rule, ...] = (
    Rule("words", "n_words", None, 20, None),
    Rule("repeated words", "n_repeat_words", "n_words", None, 0.3),
)
RULES: tuple[Rule, ...] = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols a word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words a word", "n_stop_words", "n_words", 0.03, None),
    Rule("upper-case letters a character", "n_upper", "word_chars", None, 0.3),
    Rule("repeated lines a line", "n_dup_lines", "n_lines", None, 0.5),
    Rule("doubled words a word", "n_doubled", "n_words", None, 0.2),
)


def compiled(rules: Sequence[Rule]) -> Column:
    """The rules as one boolean expression: true if all hold. Bounds are compared without division."""
    holds = F.lit(True)
    for rule in rules:
        by = F.col(rule.denominator) if rule.denominator else F.lit(1)
        if rule.least is not None:
            holds = holds & (F.col(rule.numerator) * 100 >= by * round(rule.least * 100))
        if rule.most is not None:
            holds = holds & (F.col(rule.numerator) * 100 <= by * round(rule.most * 100))
    return holds


def _named_apart(docs: DataFrame, text: str, added: Sequence[str]) -> tuple[DataFrame, str, list[Column]]:
    """docs under names that cannot clash, the text's name there, and the columns to give back: those not named as one of `added`."""
    held = docs.columns
    place = held.index(text) if text in held else [c.lower() for c in held].index(text.lower())
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(held) if c.lower() not in added]
    return docs.toDF(*[f"_c{i}" for i in range(len(held))]), f"_c{place}", back


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns COUNTS (long), all 0 for null and empty text. Narrow; no user functions.

    Every row is measured by itself, whole and whatever its length; repeated rows alike. A
    column of docs that is called like a count is replaced by it, any other stays as it is. An
    empty table gives an empty table. n_repeat_words: words in 8-word windows that occur twice
    or more in the text. A text whose window hashes all differ has none; for the others the
    windows themselves are sorted with their places and compared, so that no hash decides a count.
    """
    docs, text, back = _named_apart(docs, text, COUNTS)
    content = F.coalesce(F.col(text), F.lit(""))
    gone = lambda c: F.octet_length(content) - F.octet_length(F.replace(content, F.lit(c), F.lit("")))
    lines = F.filter(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    split = docs.withColumns({
        "_words": words_column(F.col(text)),
        "_lines": lines,
        "n_symbols": sum((gone(c) for c in SYMBOLS[1:]), gone(SYMBOLS[0])).cast("long"),
        "n_upper": F.regexp_count(content, F.lit("[A-Z]")).cast("long"),
    })
    last = F.size("_words") - (WINDOW - 1)
    windows = lambda f: F.transform(F.sequence(F.lit(1), last), lambda i: f(i, F.slice(F.col("_words"), i, WINDOW)))
    counted = split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_FORMS))).cast("long"),
        "n_doubled": F.when(
            F.size("_words") > 1,
            F.size(F.filter(F.sequence(F.lit(2), F.size("_words")), lambda i: F.element_at(F.col("_words"), i) == F.element_at(F.col("_words"), i - 1))),
        ).otherwise(0).cast("long"),
        "_hash1": F.when(last > 1, F.transform("_words", lambda w: F.xxhash64(w))),
    })
    # Hashes of 2, 4 and 8 words, each from two of the half width: three steps a window instead of eight.
    for width in (1, 2, 4):
        held = F.col(f"_hash{width}")
        pairs = F.zip_with(F.slice(held, 1, F.size(held) - width), F.slice(held, F.lit(width + 1), F.size(held) - width), lambda a, b: F.xxhash64(a, b))
        counted = counted.withColumn(f"_hash{2 * width}", pairs)
    suspect = counted.withColumn("_repeats", F.coalesce(F.size(F.array_distinct("_hash8")) < F.size("_hash8"), F.lit(False)))
    placed = F.when(F.col("_repeats"), F.array_sort(windows(lambda i, w: F.struct(F.array_join(w, " ").alias("w"), i.alias("i")))))
    ordered = suspect.withColumn("_placed", placed)
    at = lambda k: F.element_at(F.col("_placed"), k).getField("w")
    top = F.size("_placed")
    twice = F.filter(
        F.transform(
            F.sequence(F.lit(1), top),
            lambda k: F.when(((k > 1) & (at(F.greatest(k - 1, F.lit(1))) == at(k))) | ((k < top) & (at(F.least(k + 1, top)) == at(k))), F.element_at(F.col("_placed"), k).getField("i")),
        ),
        lambda i: i.isNotNull(),
    )
    found = ordered.withColumn("_places", F.when(F.col("_repeats"), F.array_sort(twice)))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(1).alias("free"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("free"), (acc["n"] + i + WINDOW - F.greatest(acc["free"], i)).alias("n")),
        lambda acc: acc["n"],
    )
    out = found.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long"))
    # Through a generator of one row, so that a filter on the counts stays above them instead of being copied into each.
    kept = out.select(*docs.columns, F.explode(F.array(F.struct(*COUNTS))).alias("_counts"))
    return kept.select(*back, *[F.col(f"_counts.{c}").alias(c) for c in COUNTS])


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """measures() with base_failed and kept (boolean), which replace columns of docs that are called so."""
    plain, name, back = _named_apart(docs, text, (*COUNTS, "base_failed", "kept"))
    counted = measures(plain, name)
    return counted.select(*back, *COUNTS, (~compiled(BASE)).alias("base_failed"), (compiled(BASE) & compiled(rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows whose text the rules keep, with the columns they had, whatever these are called.

    Null and empty texts go; repeated rows stay or go together. An empty table gives an empty table.
    """
    plain, name, back = _named_apart(docs, "text", ())
    return judge(plain, name).filter("kept").select(*back)


_STOP = ", ".join(f"'{w}'" for w in STOP_FORMS)
SQL = {
    "op5_quality_rules": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM docs, unnest(range(1, len(w) - 6)) AS u(i)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM repeated, range(8) AS r(k) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled
  FROM docs d LEFT JOIN covered c USING (doc_id)
), based AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1400 * n_words AND 100 * n_symbols <= 10 * n_words
   AND 100 * n_stop_words >= 3 * n_words AND 100 * n_upper <= 30 * word_chars AND 100 * n_dup_lines <= 50 * n_lines
   AND 100 * n_doubled <= 20 * n_words) AS kept
FROM based"""
}
