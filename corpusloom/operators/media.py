"""Texts of a document's media: their status, merging, reuse and what is kept when a refresh fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import revision_signature

RETAINED = "previous_media_retained_after_refresh_failure"


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "")


def media_status(assets: Column) -> Column:
    """not_applicable without assets, complete if all were read, partial if some gave text, else failed_or_unsupported."""
    return (
        F.when(F.coalesce(F.size(assets), F.lit(0)) <= 0, "not_applicable").when(F.forall(assets, lambda a: F.coalesce(a["status"].isin("success", "empty"), F.lit(False))), "complete")
        .when(F.exists(assets, lambda a: F.coalesce(a["text"], F.lit("")) != ""), "partial").otherwise("failed_or_unsupported")
    )


def merged_sections(title: Column, body: Column, images: Column, attachments: Column) -> Column:
    """struct(content, status): body, texts of images and of attachments, each with a label, in one text.

    Sections that repeat another, white space aside, are left out, and so are those under 40
    characters that another holds. Without any text the title stands alone.
    """
    none = F.array().cast("array<struct<label:string,text:string>>")
    section = lambda label, text: F.struct(label.cast("string").alias("label"), text.alias("text"))
    base = _text(body)
    seen = F.filter(
        F.transform(images, lambda a, i: F.struct(F.concat(F.lit("이미지 OCR 추출 #"), (i + 1).cast("string"), F.lit(": "), F.element_at(F.split(a["url"], "/"), -1)).alias("label"), _text(a["text"]).alias("text"), a["status"].alias("status"))),
        lambda a: (a["text"] != "") & (a["status"] == "success"),
    )
    files = F.filter(
        F.transform(attachments, lambda a: F.struct(F.concat(F.lit("첨부파일 추출: "), F.coalesce(a["name"], F.lit("첨부파일"))).alias("label"), _text(a["text"]).alias("text"), a["status"].alias("status"))),
        lambda a: (a["text"] != "") & a["status"].isin("success", "partial"),
    )
    bare = lambda sections: F.coalesce(F.transform(sections, lambda a: section(a["label"], a["text"])), none)
    given = F.concat(F.when(base != "", F.array(section(F.lit(None), base))).otherwise(none), bare(seen), bare(files))

    def add(state: Column, s: Column) -> Column:
        key = F.regexp_replace(s["text"], r"(?U)\s+", "")
        held = F.exists(state["keys"], lambda k: (k == key) | ((F.length(key) < 40) & F.contains(k, key)))
        shown = F.when(s["label"].isNull(), s["text"]).otherwise(F.concat(F.lit("["), s["label"], F.lit("]\n"), s["text"]))
        longer = F.struct(F.array_append(state["keys"], key).alias("keys"), F.array_append(state["out"], shown).alias("out"))
        return F.when(held | (key == ""), state).otherwise(longer)

    strings = F.array().cast("array<string>")
    out = F.aggregate(given, F.struct(strings.alias("keys"), strings.alias("out")), add, lambda s: s["out"])
    any_seen, any_file = F.coalesce(F.size(seen), F.lit(0)) > 0, F.coalesce(F.size(files), F.lit(0)) > 0
    status = (
        F.when(any_seen & (any_file | (base != "")), "mixed").when(any_seen, "ocr").when(any_file & (base != ""), "mixed")
        .when(any_file, "attachment").when(base != "", "text").otherwise("title_only")
    )
    content = F.when(F.size(given) == 0, title).otherwise(F.array_join(out, "\n\n"))
    return F.struct(content.alias("content"), status.alias("status"))


def page_rollup(pages: DataFrame, most_pages: int) -> DataFrame:
    """file, text, status, method, error of files from the results of their pages (file, page, status, method, error, text).

    A file without text failed if a page could not be read, and is empty otherwise; one with text
    is partial if a page lacks or lies beyond most_pages. A file's pages are few.
    """
    within = F.col("page") <= most_pages
    rows = pages.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(within & ~F.col("status").isin("success", "empty")).alias("lacking"), F.bool_or(within & F.col("status").isin("failed", "ocr_tool_missing")).alias("failed"),
        F.array_sort(F.collect_set(F.when(within, F.col("method")))).alias("methods"),
        F.min(F.when(within & ~F.col("status").isin("success", "empty"), F.struct("page", "error")))["error"].alias("error"),
        F.array_sort(F.collect_list(F.when(within & (F.coalesce("text", F.lit("")) != ""), F.struct("page", "text")))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    none = F.size("parts") == 0
    status = F.when(none & F.col("failed"), "failed").when(none, "empty").when(F.col("lacking") | (F.col("n") > most_pages), "partial").otherwise("success")
    both = F.array_contains("methods", "pdf_ocr") & F.array_contains("methods", "pdf_text")
    method = F.when(F.size("methods") == 1, F.element_at("methods", 1)).when(both, "mixed").otherwise("page_by_page")
    return rows.select("file", text.alias("text"), status.alias("status"), method.alias("method"), F.when(none & F.col("failed"), F.coalesce("error", F.lit("no page could be read"))).alias("error"))


def retain_previous(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with what old held where a refresh of the same revision gave less: media of it are kept and the attempt is noted.

    Both: url (one row each), title, html_content, content, content_status, images, attachments,
    media_status, attempted_at. A page whose source changed never gets old media back.
    """
    kept = ["html_content", "content", "content_status", "images", "attachments", "media_status", "attempted_at"]
    signature = lambda p: revision_signature(*[F.col(f"{p}.{c}") for c in ("title", "html_content", "content", "content_status", "images", "attachments")])
    j = new.alias("n").join(old.alias("o"), F.col("n.url") == F.col("o.url"), "left").withColumns({"_new": signature("n"), "_old": signature("o")})
    failed = ~F.col("n.media_status").isin("complete", "not_applicable")
    back = F.coalesce((F.to_json("_new") == F.to_json("_old")) & (F.col("o.media_status") == "complete") & failed, F.lit(False))
    fields = [F.when(back, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in kept]
    return j.select(
        F.col("n.url").alias("url"), F.col("n.title").alias("title"), *fields, F.when(back, F.col("n.media_status")).alias("media_refresh_status"),
        F.when(back, F.col("n.attempted_at")).alias("failed_attempt_at"), F.when(back, RETAINED).alias("coverage_status"),
    )


def reuse_assets(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current (id, assets) with the texts that previous (order, assets) has for the same URLs; `reused` counts them.

    Of several earlier texts of one URL the last in order counts. Assets keep their places and
    names; documents without assets stay.
    """
    memo = previous.select("order", F.explode("assets").alias("a")).groupBy(F.col("a.url").alias("_url")).agg(F.max_by("a", "order").alias("held"))
    rows = current.select("id", F.posexplode_outer("assets").alias("at", "a")).withColumn("_url", F.col("a.url"))
    j = rows.join(memo, "_url", "left")
    asset = F.struct(F.col("a.url").alias("url"), F.col("a.name").alias("name"), F.coalesce("held.text", "a.text").alias("text"), F.coalesce("held.status", "a.status").alias("status"))
    made = j.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", asset.alias("a"))))).alias("rows"), F.count("held").alias("reused"))
    return made.select("id", F.transform("rows", lambda r: r["a"]).alias("assets"), "reused")


def incomplete_collections(reports: DataFrame) -> DataFrame:
    """stage and reasons of collections that may not go on: errors, a limit that was reached, boards that did not finish.

    reports: stage, n_errors, limit_reached, targets (array of statuses), boards (map of name to
    struct<reached_since, list_complete>).
    """
    open_boards = F.filter(F.map_entries("boards"), lambda e: ~F.coalesce(e["value"]["reached_since"], F.lit(False)) & ~F.coalesce(e["value"]["list_complete"], F.lit(False)))
    deferred = F.coalesce("limit_reached", F.lit(False)) | F.coalesce(F.array_contains("targets", "deferred_limit"), F.lit(False))
    reasons = F.concat(
        F.array_compact(F.array(F.when(F.col("n_errors") > 0, F.concat(F.col("n_errors").cast("string"), F.lit(" collection errors"))), F.when(deferred, "budget exhausted"))),
        F.array_sort(F.coalesce(F.transform(open_boards, lambda e: F.concat(F.lit("unfinished board "), e["key"])), F.array().cast("array<string>"))),
    )
    return reports.select("stage", reasons.alias("reasons")).filter(F.size("reasons") > 0)
