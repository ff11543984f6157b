"""Status reports, recheck planning and selections over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored


def distribution(docs: DataFrame, *by: str) -> DataFrame:
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def date_range(docs: DataFrame, by: str) -> DataFrame:
    """Oldest and latest date of ten characters or more."""
    d = F.when(F.length("date") >= 10, F.col("date"))
    return docs.groupBy(by).agg(F.min(d).alias("oldest"), F.max(d).alias("latest"))


def bare_title_causes(docs: DataFrame) -> DataFrame:
    """Why documents have a bare title, and whether their share calls for a note (over 30 %)."""
    cause = F.when(F.coalesce(F.col("content"), F.lit("")) == "", "no_body").when(F.col("content") == F.col("title"), "body_is_title").otherwise("marked")
    bare = docs.filter("status = 'title_only'").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "title_only").alias("bare"))
    return bare.join(F.broadcast(total)).select("cause", "n", (F.col("bare") * 100 > F.col("total") * 30).alias("noteworthy"))


def due_for_recheck(docs: DataFrame, policy: DataFrame, now: Column, default_days: int = 14, forced: Column | None = None) -> DataFrame:
    """docs with `recheck`: requires_manual_review, due or not_due. policy: url, days, manual (one row a url); forced rows are due whatever their age."""
    joined = docs.join(policy, "url", "left")
    forced = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    age = (F.unix_micros(now) - F.unix_micros("checked_at")) >= F.coalesce("days", F.lit(default_days)).cast("long") * 86_400_000_000
    state = F.when(F.coalesce("manual", F.lit(False)), "requires_manual_review").when(forced | F.col("checked_at").isNull() | age, "due").otherwise("not_due")
    return joined.withColumn("recheck", state)


def snapshot_due(docs: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """One row: whether a snapshot must be taken again, which it need not if all its rows have a check and the oldest is recent."""
    a = docs.agg(F.count(F.lit(1)).alias("n"), F.count("checked_at").alias("checked"), F.min("checked_at").alias("oldest"))
    recent = (F.unix_micros(now) - F.unix_micros("oldest")) < F.lit(days).cast("long") * 86_400_000_000
    return a.select("n", "checked", (~((F.col("n") > 0) & (F.col("n") == F.col("checked")) & recent)).alias("due"))


def newest_first(docs: DataFrame, wanted: Column, limit: int, groups: str) -> DataFrame:
    """Wanted rows with `rank` within each group, newest first, and `selected` for the first `limit`.

    Rows are ordered within a group's day; how many rows the later days have gives where each starts.
    """
    dealt = docs.filter(wanted).withColumn("_day", F.substring(F.col("date").cast("string"), 1, 10))
    later = Window.partitionBy("_of").orderBy(F.col("_on").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col(groups).alias("_of"), F.col("_day").alias("_on")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_of", "_on", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_start"))
    within = Window.partitionBy(groups, "_day").orderBy(F.col("date").desc(), "doc_id")
    joined = dealt.withColumn("_in_day", F.row_number().over(within)).join(starts, F.col(groups).eqNullSafe(F.col("_of")) & F.col("_day").eqNullSafe(F.col("_on")))
    ranked = joined.withColumn("rank", (F.col("_start") + F.col("_in_day")).cast("int")).drop("_day", "_of", "_on", "_in_day", "_start")
    return ranked.withColumn("selected", F.col("rank") <= limit)


def select_for_enrichment(docs: DataFrame, since: str | None = None, bare: bool = False, previous: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """docs that are to be enriched, with `selected` for the `limit` newest of them; the others wait.

    Wanted are documents since a date and, with `bare`, bare titles; without both, all. With
    `previous` (url, media_status of the last enrichment) only those whose media failed then are
    tried again. Of one date the lesser doc_id comes first; a null date is the oldest. Spark keeps
    `limit` rows a task, so that no order over all documents is made.
    """
    known = F.coalesce(F.col("date").cast("string"), F.lit(""))
    tests = ([known >= since] if since is not None else []) + ([F.col("status") == "title_only"] if bare else [])
    wanted = docs
    if tests:
        wanted = docs.filter(reduce(lambda a, b: a | b, tests))
    if previous is not None:
        wanted = wanted.join(previous.filter(F.col("media_status") == "failed_or_unsupported").select("url"), "url", "left_semi")
    first = wanted.orderBy(known.desc(), "doc_id").limit(limit).select("doc_id", F.lit(True).alias("selected"))
    return wanted.join(first, "doc_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def keyword_select(docs: DataFrame, keyword: str, limit: int | None, order: str) -> DataFrame:
    """docs with `processed`: whether a row's title or content holds the keyword and it is among the first `limit` that do, in the given order. Others pass through."""
    holds = F.coalesce(F.col("title").contains(keyword), F.lit(False)) | F.coalesce(F.col("content").contains(keyword), F.lit(False))
    if limit is None:
        return docs.withColumn("processed", holds)
    first = docs.filter(holds).select(order).orderBy(order).limit(limit).withColumn("processed", F.lit(True))
    return docs.join(first, order, "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def deferred(selected: DataFrame, groups: str) -> DataFrame:
    """Per group of newest_first()'s rows how many were selected and how many wait."""
    return selected.groupBy(groups).agg(F.count_if("selected").alias("taken"), F.count_if(~F.col("selected")).alias("deferred"))


def greedy_budget(candidates: DataFrame, by: str, max_docs: int, max_assets: int) -> DataFrame:
    """Per group, in the order of priority, whether a row is taken: a row that does not fit both budgets consumes nothing, and one without assets is passed over.

    Of the rows with the same number of assets those are taken that come first: what no longer
    fits does not fit later. So only the first max_docs rows of each number up to max_assets can
    ever be taken. These candidates are found by a ranking that is cut in the tasks before it is
    shuffled, and one ordered fold over at most max_docs * max_assets of them per group decides:
    two jobs, whatever the budgets, and no group is gathered. Rows of equal priority go by
    doc_id. Null assets count as none.
    """
    rows = candidates.select(by, "priority", "doc_id", F.coalesce("assets", F.lit(0)).cast("long").alias("assets")).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows)
    same = Window.partitionBy(by, "assets").orderBy("priority", "doc_id", "_row")
    able = rows.filter((F.col("assets") > 0) & (F.col("assets") <= max_assets)).withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= max_docs)
    inner = F.array_sort(F.collect_list(F.struct("priority", "doc_id", "_row", "assets")))
    state = "struct<docs:int,used:bigint,taken:array<bigint>>"
    start = F.struct(F.lit(0).alias("docs"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken")).cast(state)

    def step(held: Column, row: Column) -> Column:
        fits = (held["docs"] < max_docs) & (held["used"] + row["assets"] <= max_assets)
        after = F.struct((held["docs"] + 1).alias("docs"), (held["used"] + row["assets"]).alias("used"), F.concat(held["taken"], F.array(row["_row"])).alias("taken"))
        return F.when(fits, after.cast(state)).otherwise(held)

    folded = able.groupBy(by).agg(inner.alias("_rows")).select(F.explode(F.aggregate("_rows", start, step, lambda held: held["taken"])).alias("_row"))
    return rows.join(folded.withColumn("taken", F.lit(True)), "_row", "left").select(by, "doc_id", F.coalesce("taken", F.lit(False)).alias("taken"))


def _row_of(rows: DataFrame, chosen: Column, key: str, *also: Column) -> DataFrame:
    """Per key the chosen row with its columns; rows of a key are compared in the tasks before they are shuffled, so that no key is gathered."""
    picked = rows.groupBy(key).agg(chosen.alias("_row"), *also)
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns], *[c for c in picked.columns if c not in (key, "_row")])


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with `place`: where the key was first seen. Null places are the first; of equal ones any row stays."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return _row_of(rows, F.max_by(whole, F.struct(order)), key, F.min(order).alias("place"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; of equal places any row stays."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return _row_of(rows, F.min_by(whole, F.struct(order)), key)


def ranked(rows: DataFrame, group: str, order: Column, number: str, per: int = 4096) -> DataFrame:
    """rows with `turn`: the place of each within its group by the order, then by number (a whole number), from 1.

    Rows are placed within parts of a group's equal orders, of `per` numbers each; how many rows
    the parts before hold gives where each starts. So no group, and no order that many rows
    share, is sorted in one task.
    """
    dealt = rows.withColumns({"_order": order, "_part": F.floor(F.col(number) / per)})
    parts = dealt.groupBy(F.col(group).alias("_g"), F.col("_order").alias("_o"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_o", "_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_g", "_o", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_order", "_part").orderBy(number)))
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col("_order").eqNullSafe(F.col("_o")) & F.col("_part").eqNullSafe(F.col("_p"))
    return placed.join(starts, same).withColumn("turn", F.col("_start") + F.col("_in")).drop("_order", "_part", "_in", "_g", "_o", "_p", "_start")


def missing_bodies(docs: DataFrame) -> DataFrame:
    """Documents to collect again: without a body, with the title for one, or marked as a bare title."""
    return docs.filter((F.coalesce("content", F.lit("")) == "") | (F.col("content") == F.col("title")) | (F.col("status") == "title_only"))


def exhausted(pages: DataFrame, board: str, number: str, urls: str) -> DataFrame:
    """Whether a listing page shows the same set of URLs as the page before it."""
    w = Window.partitionBy(board).orderBy(number)
    now = F.array_sort(F.array_distinct(urls))
    return pages.withColumn("exhausted", F.coalesce(F.lag(now).over(w) == now, F.lit(False)))
