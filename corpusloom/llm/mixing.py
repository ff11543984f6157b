"""Mixing sources to target weights: capped water-filling, then seeded repetitions (native)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import count_words
from corpusloom.session import pick, stored, table

BROADCAST_SOURCES = 10_000  # source tables up to so many rows are broadcast, larger ones are joined by shuffle
ROWS_PER_BUCKET = 200
DRAW_BITS = 48


def fill(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Targets of sources (source, source_size): adds rank, weight and target (double).

    Weights go round by the sources' order by code point, null last. A source whose share
    would exceed max_epochs times its size is clamped there; what is left is shared again
    by weight among the others, until no share exceeds its cap. In the order of cap to
    weight every clamp comes before every free source, so two running sums find the level
    at which that ends. One row per source passes through one task, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", choice)
        .withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy("_ratio", "rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) * budget_share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    leveled = ranked.withColumn("_level", left / F.sum("weight").over(onward))
    return (
        leveled.withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
        .withColumn("_final", F.first("_open", ignorenulls=True).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def _draw(seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def _place() -> Column:
    """A row's place in its source's seeded order."""
    return F.struct(F.col("_draw").alias("draw"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.col("size").alias("size"))


def _source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """How a mix takes each source: _key, source_size, target, _whole (copies of all), _bound, _some and _of.

    rows: doc_id, source, size, _draw. Rows before the place _bound in the source's order get one
    more copy, and at it _some of the _of rows that are equal there (all where _of is null): those
    whose middle lies within what the whole copies leave of the target. Only the hash bucket in
    which that ends is put in order, equal rows as one, the others are known by their sums, so
    that no task holds a source.
    """
    n = rows.count()
    bits = min(20, max(4, math.ceil(math.log2(max(1, n) / ROWS_PER_BUCKET))))
    bucketed = rows.withColumn("_bucket", F.shiftright("_draw", DRAW_BITS - bits).cast("int"))
    sums = stored(bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"), F.max(_place()).alias("_last")))
    targets = fill(sums.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, budget_share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    keyed = stored(targets.select(_source_key().alias("_key"), "source_size", "target", "_whole", "_rest"))
    hint = F.broadcast if keyed.count() <= BROADCAST_SOURCES else (lambda df: df)

    upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("_key", _source_key()).withColumn("_upto", F.sum("_size").over(upto)).join(hint(keyed.select("_key", "_rest")), "_key")
    open_ = F.when(F.col("_upto") > F.col("_rest"), F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("_before")))
    full = F.when((F.col("_upto") <= F.col("_rest")) & (F.col("_rest") > 0), F.struct("_bucket", "_last"))
    ends = running.groupBy("_key").agg(F.min(open_).alias("_edge"), F.max(full).alias("_full"))
    edges = stored(ends.join(keyed.select("_key", "_rest"), "_key").select("_key", "_rest", "_edge._bucket", "_edge._before", F.col("_full._last").alias("_last")))

    edge = bucketed.withColumn("_key", _source_key()).join(hint(edges.filter("_bucket IS NOT NULL").drop("_last")), ["_key", "_bucket"])
    places = edge.groupBy("_key", "_rest", "_before", _place().alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("_at.size")
    ahead = F.col("_before") + F.coalesce(F.sum(size * F.col("_n")).over(inside), F.lit(0))
    more = F.when(size == 0, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor((F.col("_rest") - F.col("_ahead")) / F.greatest(size, F.lit(1)) + 0.5)))
    first_fits = (F.col("_rest") > 0) & (2 * F.col("_ahead") + size <= 2 * F.col("_rest"))
    taken = places.withColumn("_ahead", ahead).filter(first_fits).withColumn("_some", F.least(F.col("_n"), more))
    last = taken.groupBy("_key").agg(F.max(F.struct("_at", "_some", F.col("_n").alias("_of"))).alias("_in"))
    bounds = edges.select("_key", "_last").join(last, "_key", "left")
    bounds = bounds.select("_key", F.coalesce("_in._at", "_last").alias("_bound"), F.col("_in._some").alias("_some"), F.col("_in._of").alias("_of"))
    return stored(keyed.drop("_rest").join(bounds, "_key", "left"))


def _with_copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows with source_size, target and copies; the plan is broadcast up to BROADCAST_SOURCES sources.

    Where only some of equal rows get one more copy, these are numbered: within parts of the
    written rows, whose counts give where each part starts.
    """
    hint = F.broadcast if plans.count() <= BROADCAST_SOURCES else (lambda df: df)
    joined = rows.withColumn("_key", _source_key()).join(hint(plans), "_key")
    inner = ["_key", "_whole", "_bound", "_some", "_of"]
    extra = lambda more: (F.col("_whole") + F.coalesce(more.cast("long"), F.lit(0).cast("long")))
    if plans.filter("_some < _of").isEmpty():
        return joined.withColumn("copies", extra(_place() <= F.col("_bound"))).drop(*inner)
    shared = F.coalesce((_place() == F.col("_bound")) & (F.col("_some") < F.col("_of")), F.lit(False))
    plain = joined.filter(~shared).withColumn("copies", extra(_place() <= F.col("_bound"))).drop(*inner)
    equal = stored(joined.filter(shared).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = equal.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n")).select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_id"))
    numbered = equal.withColumn("_number", number).join(starts, ["_key", "_part"])
    some = numbered.withColumn("copies", extra(F.col("_start") + F.col("_number") <= F.col("_some"))).drop(*inner, "_id", "_part", "_number", "_start")
    return plain.unionByName(some)


def repetitions(docs: DataFrame, seed: int = 7, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, copies (long), taken (long).

    Every document is repeated the whole number of times that its source's rate allows. The
    rest of the target is met with one more copy of the documents that come first in a seeded
    order of the source, up to the document whose middle passes it: the error is half a
    document at most. size: words of the whole text, 0 for null and empty. Sources and ids may
    be null. Of rows equal in id, source and size as many get one more copy as fit; which of
    them do is left open. Columns other than doc_id, source and text are not read. An empty
    table gives an empty table.
    """
    rows = stored(pick(docs, "doc_id", "source", "text").select("doc_id", "source", count_words(F.col("text")).alias("size"), _draw(seed).alias("_draw")))
    out = _with_copies(rows, plan(rows, weights, budget_share, max_epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs as often as repetitions() takes them, with the columns they had. Texts are not shuffled.

    Nulls, long texts and repeated rows as there; columns of any name may ride along. An empty
    table gives an empty table.
    """
    held = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(held))])
    at = {n: held.index(n) if n in held else [c.lower() for c in held].index(n) for n in ("doc_id", "source", "text")}
    named = plain.withColumns({"doc_id": F.col(f"_c{at['doc_id']}"), "source": F.col(f"_c{at['source']}"), "size": count_words(F.col(f"_c{at['text']}"))})
    rows = named.withColumn("_draw", _draw(seed))
    narrow = stored(rows.select("doc_id", "source", "size", "_draw"))
    repeated = _with_copies(rows, plan(narrow)).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(held)])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op6_source_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:12] AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM docs GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources
), leveled AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), final AS (
  SELECT *, (SELECT arg_min(level, ratio) FROM leveled WHERE ratio > level) AS lvl FROM leveled
), targets AS (
  SELECT source, source_size, coalesce(least(cap, lvl * weight), cap)::DOUBLE AS target FROM final
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered"""
}
