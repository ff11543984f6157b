"""The corpus that queries work on, derived from the given tables, and the same in SQL.

No table carries titles, dates or versions; they follow from a document's text and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import versions
from corpusloom.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rows(table(spark, sf_dir, "documents"))


def document_rows(d: DataFrame) -> DataFrame:
    source_type = F.create_map(*[F.lit(x) for x in ("en", "notice", "fr", "guidance", "de", "faq", "es", "form")])[F.col("lang")]
    return d.select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://h/"), F.col("doc_id").cast("string")).alias("url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd").alias("date"),
        source_type.alias("source_type"), "lang", F.col("source").alias("site"),
    )


DOCUMENTS_SQL = """base AS (
  SELECT doc_id, 'd' || doc_id AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, 'https://h/' || doc_id AS url,
    strftime(DATE '2024-01-01' + (doc_id % 400)::INT, '%Y-%m-%d') AS date,
    CASE lang WHEN 'en' THEN 'notice' WHEN 'fr' THEN 'guidance' WHEN 'de' THEN 'faq' WHEN 'es' THEN 'form' END AS source_type, lang, source AS site
  FROM documents)"""


def version_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_rows(table(spark, sf_dir, "documents"))


def version_rows(d: DataFrame) -> DataFrame:
    """Three overlapping sources: the site, an archive of a third with cut texts, a feed of a fifth with bare titles.

    Some pages have an image, which the feed finds replaced on some; it sees some pages without a
    text in their html, and fails on some.
    """
    base = document_rows(d)
    day = lambda n: F.date_format(F.date_add(F.col("date").cast("date"), n), "yyyy-MM-dd")
    at = lambda n: (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=n))
    number = F.col("doc_id").cast("int")
    common = ["doc_id", "id", "title", "url", "source_type"]
    none = lambda kind: F.lit(None).cast(kind)
    image = lambda end: F.array(F.struct(F.concat(F.lit("https://h/i/"), F.col("id"), F.lit(end)).alias("url")))
    no_image = F.array().cast("array<struct<url:string>>")
    unseen = [none("string").alias("html"), F.lit(False).alias("failed"), none("string").alias("attached")]
    site = base.select(*common, F.lit(1).alias("seq"), F.lit("site").alias("source"), F.lit(2).alias("rank"), "content", F.lit("text").alias("status"), "date",
                       F.when(number % 7 == 0, at(number % 10)).alias("updated_at"), at(number % 30).alias("checked_at"), F.when(number % 4 == 0, image(".png")).otherwise(no_image).alias("images"), *unseen)
    archive = base.filter(number % 3 == 0).select(
        *common, F.lit(2).alias("seq"), F.lit("archive").alias("source"), F.lit(3).alias("rank"), F.substring("content", 1, 200).alias("content"),
        F.when(number % 9 == 0, "attachment").otherwise("text").alias("status"), day(number % 3).alias("date"),
        F.when(number % 14 == 0, at(number % 12)).alias("updated_at"), at(F.lit(9)).alias("checked_at"), F.when(number % 4 == 0, image(".png#archived")).otherwise(no_image).alias("images"), *unseen)
    feed = base.filter(number % 5 == 0).select(
        *common, F.lit(3).alias("seq"), F.lit("feed").alias("source"), F.lit(1).alias("rank"), F.when(number % 10 == 0, "").otherwise(F.col("title")).alias("content"), F.lit("title_only").alias("status"),
        day(number % 2).alias("date"), none("timestamp").alias("updated_at"), at(number * 7 % 33).alias("checked_at"), F.when(number % 25 == 0, image("-new.png")).when(number % 4 == 0, image(".png")).otherwise(no_image).alias("images"),
        F.when(number % 10 == 0, "").alias("html"), (number % 15 == 0).alias("failed"), F.element_at(F.array(*map(F.lit, ("pending", "failed", "not_applicable", "attempted"))), F.floor(number / 5).cast("int") % 4 + 1).alias("attached"))
    rows = versions.with_hash(site.unionByName(archive).unionByName(feed))
    no_files = F.lit(None).cast("array<struct<url:string>>")
    signed = rows.withColumns({
        "signature": T.revision_hash(T.revision_signature(F.col("title"), F.col("html"), F.col("content"), F.col("status"), F.col("images"), no_files)),
        "media": F.array_join(T.media_signature(F.col("images")), " "),
    }).drop("images", "html")
    return signed.withColumn("key", versions.canonical_key(F.col("source_type"), F.col("id"), F.col("url")))


VERSIONS_SQL = DOCUMENTS_SQL + """, raw AS (
  SELECT doc_id, id, title, url, source_type, 1 AS seq, 'site' AS source, 2 AS rank, content, 'text' AS status, date,
    CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2026-01-01' + to_days((doc_id % 10)::INT) END AS updated_at,
    TIMESTAMP '2026-01-01' + to_days((doc_id % 30)::INT) AS checked_at, CASE WHEN doc_id % 4 = 0 THEN 'https://h/i/' || id || '.png' ELSE '' END AS media, NULL AS html, false AS failed, NULL AS attached FROM base
  UNION ALL SELECT doc_id, id, title, url, source_type, 2, 'archive', 3, substr(content, 1, 200), CASE WHEN doc_id % 9 = 0 THEN 'attachment' ELSE 'text' END,
    strftime(date::DATE + (doc_id % 3)::INT, '%Y-%m-%d'), CASE WHEN doc_id % 14 = 0 THEN TIMESTAMP '2026-01-01' + to_days((doc_id % 12)::INT) END,
    TIMESTAMP '2026-01-10', CASE WHEN doc_id % 4 = 0 THEN 'https://h/i/' || id || '.png' ELSE '' END, NULL, false, NULL FROM base WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, id, title, url, source_type, 3, 'feed', 1, CASE WHEN doc_id % 10 = 0 THEN '' ELSE title END, 'title_only', strftime(date::DATE + (doc_id % 2)::INT, '%Y-%m-%d'), NULL,
    TIMESTAMP '2026-01-01' + to_days((doc_id * 7 % 33)::INT), CASE WHEN doc_id % 25 = 0 THEN 'https://h/i/' || id || '-new.png' WHEN doc_id % 4 = 0 THEN 'https://h/i/' || id || '.png' ELSE '' END,
    CASE WHEN doc_id % 10 = 0 THEN '' END, doc_id % 15 = 0, ['pending', 'failed', 'not_applicable', 'attempted'][(doc_id // 5) % 4 + 1] FROM base WHERE doc_id % 5 = 0
), versions AS (
  SELECT *, substr(sha256(title || chr(10) || content), 1, 16) AS hash,
    CASE WHEN html IS NOT NULL THEN sha256(trim(title) || chr(1) || trim(html) || chr(1) || media || chr(1))
      WHEN status NOT IN ('mixed','ocr','ocr_enhanced','attachment') THEN sha256(trim(title) || chr(1) || trim(content) || chr(1) || media || chr(1)) END AS signature,
    CASE WHEN source_type = 'faq' THEN 'id:' || id ELSE 'url:' || url END AS key FROM raw)"""


def step_sql(name: str, old: str, seq: int) -> str:
    """One step of the fold as CTEs: `old` (one row a key) against the versions of seq."""
    ok = lambda p: f"({p}.status IN ('text','mixed','ocr','ocr_enhanced','attachment') AND coalesce({p}.content,'') <> '' AND {p}.content <> coalesce({p}.title,''))"
    fields = ["seq", "source", "rank", "id", "title", "content", "status", "date", "updated_at", "checked_at", "signature", "media", "hash", "failed", "attached", "source_type"]
    taken = "why[1] = '+'"
    emptied = """n.status = 'title_only' AND NOT n.failed AND n.attached IN ('pending', 'attempted', 'not_applicable') AND (o.checked_at IS NULL OR n.checked_at > o.checked_at)
      AND NOT n.date < o.date AND (coalesce(o.signature <> n.signature, false) OR o.media <> n.media)"""
    picks = ", ".join(f"CASE WHEN why IS NOT NULL AND {taken} THEN n_{f} ELSE " + (
        "CASE WHEN why IS NOT NULL AND signature IS NOT NULL AND signature = n_signature AND n_checked_at > checked_at THEN n_checked_at ELSE checked_at END" if f == "checked_at" else f
    ) + f" END AS {f}" for f in fields)
    news = ", ".join(f"n.{f} AS n_{f}" for f in fields)
    return f"""{name}_why AS (
  SELECT o.*, {news}, CASE WHEN n.key IS NULL THEN NULL
    WHEN {ok('o')} AND NOT {ok('n')} THEN CASE WHEN {emptied} THEN '+source_emptied' ELSE '-keep_valid' END
    WHEN NOT {ok('o')} AND {ok('n')} THEN '+first_valid'
    WHEN n.updated_at > o.updated_at AND n.status <> 'title_only' THEN '+newer_update' WHEN n.updated_at < o.updated_at THEN '-older_update'
    WHEN o.updated_at IS NOT NULL AND n.updated_at IS NULL THEN '-update_known'
    WHEN o.updated_at IS NULL AND n.updated_at IS NOT NULL AND n.status <> 'title_only' THEN '+update_known'
    WHEN n.date > o.date AND n.status <> 'title_only' THEN '+newer_date' WHEN n.date < o.date THEN '-stale_date'
    WHEN (CASE WHEN o.signature IS NOT NULL AND n.signature IS NOT NULL THEN o.signature <> n.signature ELSE o.hash <> n.hash END) AND n.checked_at > o.checked_at AND n.status <> 'title_only' THEN '+newer_check'
    WHEN (CASE WHEN o.signature IS NOT NULL AND n.signature IS NOT NULL THEN o.signature <> n.signature ELSE o.hash <> n.hash END) AND n.checked_at < o.checked_at THEN '-stale_check'
    WHEN o.status IN ('mixed','ocr','ocr_enhanced','attachment') AND n.status = 'text' THEN '-keep_enriched'
    WHEN o.status = 'text' AND n.status IN ('mixed','ocr','ocr_enhanced','attachment') THEN '+enriched'
    WHEN n.rank < o.rank THEN '+rank' || CASE WHEN o.hash <> n.hash THEN '_content_differs' ELSE '' END
    WHEN n.rank > o.rank THEN '-rank' || CASE WHEN o.hash <> n.hash THEN '_content_differs' ELSE '' END
    WHEN len(n.content) > len(o.content) THEN '+longer' ELSE '-not_longer' END AS why
  FROM {old} o LEFT JOIN (SELECT * FROM versions WHERE seq = {seq}) n ON o.key = n.key
), {name} AS (SELECT key, {picks} FROM {name}_why)"""


RESOLVED_SQL = VERSIONS_SQL + """, first AS (SELECT key, seq, source, rank, id, title, content, status, date, updated_at, checked_at, signature, media, hash, failed, attached, source_type FROM versions WHERE seq = 1), """ + step_sql("second", "first", 2) + ", " + step_sql("third", "second", 3)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.resolve(version_stream(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks: a vector of `embeddings` for the document of the same number, one chunk each."""
    e = table(spark, sf_dir, "embeddings")
    d = documents(spark, sf_dir)
    return d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id").withColumn("chunk_id", F.concat("id", F.lit("_c0")))


CHUNKS_SQL = DOCUMENTS_SQL + """, chunks AS (
  SELECT b.*, e.embedding, e.label, b.id || '_c0' AS chunk_id FROM base b JOIN embeddings e ON e.vec_id = b.doc_id)"""
