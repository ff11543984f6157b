"""Version resolution, status reports, recheck planning and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import freshness, indexing, versions
from corpusloom.plans import Registry
from corpusloom.plans.corpus import DOCUMENTS_SQL, RESOLVED_SQL, VERSIONS_SQL, documents, resolved, version_stream
from corpusloom.session import table

R = Registry()
NOW = "2026-01-20 00:00:00"


@R.add("resolve_versions", f"WITH {RESOLVED_SQL} SELECT key, id, source, status, date, checked_at, hash FROM third")
def resolve_versions(spark, sf_dir):
    c = resolved(spark, sf_dir).select("key", "current.*")
    return c.select("key", "id", "source", "status", "date", "checked_at", "hash")


_LOG = """log AS (
  SELECT key, 2 AS seq, source AS old_source, n_source AS new_source, why FROM second_why WHERE why IS NOT NULL
  UNION ALL SELECT key, 3, source, n_source, why FROM third_why WHERE why IS NOT NULL)"""


@R.add("resolution_log", f"""WITH {RESOLVED_SQL}, {_LOG}
SELECT key, seq, CASE WHEN why[1] = '+' THEN 'overwritten' ELSE 'skipped' END AS decision, old_source, new_source, substr(why, 2) AS reason FROM log""")
def resolution_log(spark, sf_dir):
    return versions.log_rows(resolved(spark, sf_dir))


@R.add("resolution_audit", f"""WITH {RESOLVED_SQL}, {_LOG}, fared AS (
  SELECT new_source AS source, count(*) FILTER (why[1] = '+') AS overwritten, count(*) FILTER (why[1] = '-') AS skipped FROM log GROUP BY 1
), seen AS (SELECT source, count(*) AS n_rows FROM versions GROUP BY 1)
SELECT source, n_rows, coalesce(overwritten, 0) AS overwritten, coalesce(skipped, 0) AS skipped,
  n_rows - coalesce(overwritten, 0) - coalesce(skipped, 0) AS new FROM seen LEFT JOIN fared USING (source)""")
def resolution_audit(spark, sf_dir):
    return versions.audit(version_stream(spark, sf_dir), versions.log_rows(resolved(spark, sf_dir)))


@R.add("resolution_sample", f"""WITH {RESOLVED_SQL}, {_LOG} SELECT key, seq, old_source, new_source, substr(why, 2) AS reason, (SELECT count(*) FROM log) AS total FROM log ORDER BY key, seq LIMIT 50""")
def resolution_sample(spark, sf_dir):
    return versions.audit_sample(versions.log_rows(resolved(spark, sf_dir))).select("key", "seq", "old_source", "new_source", "reason", "total")


@R.add("crowded_keys", f"WITH {VERSIONS_SQL} SELECT key, count(*) AS n FROM versions GROUP BY key HAVING count(*) > 2")
def crowded_keys(spark, sf_dir):
    return versions.crowded(version_stream(spark, sf_dir), most=2)


@R.add("status_distribution", f"""WITH {RESOLVED_SQL} SELECT t.source_type, r.status, count(*) AS n
FROM third r JOIN base t ON r.id = t.id GROUP BY t.source_type, r.status""")
def status_distribution(spark, sf_dir):
    c = resolved(spark, sf_dir).select("current.*").join(documents(spark, sf_dir).select("id", "source_type"), "id")
    return freshness.distribution(c, "source_type", "status")


@R.add("freshness_range", f"WITH {RESOLVED_SQL} SELECT source, min(date) AS oldest, max(date) AS latest FROM third WHERE len(date) >= 10 GROUP BY source")
def freshness_range(spark, sf_dir):
    return freshness.date_range(resolved(spark, sf_dir).select("current.*"), "source")


@R.add("title_only_causes", f"""WITH {VERSIONS_SQL}, bare AS (
  SELECT CASE WHEN content = '' THEN 'no_body' WHEN content = title THEN 'body_is_title' ELSE 'marked' END AS cause, count(*) AS n FROM versions WHERE status = 'title_only' GROUP BY 1)
SELECT cause, n, (SELECT 100 * count(*) FILTER (status = 'title_only') > 30 * count(*) FROM versions) AS noteworthy FROM bare""")
def title_only_causes(spark, sf_dir):
    return freshness.bare_title_causes(version_stream(spark, sf_dir))


@R.add("source_type_by_site", f"WITH {DOCUMENTS_SQL} SELECT site, source_type, count(*) AS n FROM base GROUP BY GROUPING SETS ((site, source_type), (source_type), ())")
def source_type_by_site(spark, sf_dir):
    documents(spark, sf_dir).createOrReplaceTempView("_source_types")
    return spark.sql("SELECT site, source_type, count(*) AS n FROM _source_types GROUP BY GROUPING SETS ((site, source_type), (source_type), ())")


@R.add("content_hash", f"WITH {DOCUMENTS_SQL} SELECT id, substr(sha256(title || chr(10) || content), 1, 16) AS hash FROM base")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("id", T.content_hash(F.col("title"), F.col("content")).alias("hash"))


@R.add("url_forms", r"""SELECT page_id, trim(split_part(coalesce(url, ''), '#', 1)) AS normal,
  CASE WHEN regexp_matches(url, '^(https?)://([a-z.-]+\.example\.(?:com|org))(?::(?:80|443))?(/[^?#]*)?(?:[?#].*)?$')
    THEN regexp_replace(url, '^(https?)://([a-z.-]+\.example\.(?:com|org))(?::(?:80|443))?(/[^?#]*)?(?:[?#].*)?$', '\1://\2\3') END AS canonical,
  CASE WHEN regexp_matches(split_part(url, '#', 1), '[?&]page=') THEN regexp_replace(split_part(url, '#', 1), '([?&])page=[^&]*', '\1page=7')
    ELSE split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'page=7' END AS paged,
  CASE WHEN regexp_matches(url, '^https?://[a-z.-]+\.example\.(?:com|org)(?::(?:80|443))?/[a-z]+/[^?#]*(?:[?#].*)?$') THEN 'https://site' || regexp_extract(url, '^[^/]*//[^/]*(/[^?#]*)', 1) END AS of_site
FROM pages""")
def url_forms(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(u).alias("normal"), T.canonical_url(u, r"[a-z.-]+\.example\.(?:com|org)").alias("canonical"), T.set_query_param(u, "page", F.lit(7)).alias("paged"),
        # Scheme and host count in any case, here in capitals, and only pages below a folder are the site's.
        T.canonical_url(F.concat(F.upper(F.substring_index(u, "/", 3)), F.substring(u, F.length(F.substring_index(u, "/", 3)) + 1, F.length(u))), r"[a-z.-]+\.example\.(?:com|org)", r"/[a-z]+/.*", "https://site").alias("of_site"))


@R.add("compact_text", r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md, len(regexp_replace(text, '\s+', '', 'g')) AS n FROM documents""")
def compact_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("collapsed_md"), F.length(T.compact(F.col("text"))).alias("n"))


@R.add("due_for_recheck", f"""WITH {VERSIONS_SQL}, policy AS (
  SELECT url, (doc_id % 20 + 1)::INT AS days, doc_id % 11 = 0 AS manual FROM base WHERE doc_id % 4 = 0)
SELECT v.key, v.source, CASE WHEN coalesce(manual, false) THEN 'requires_manual_review'
  WHEN doc_id % 23 = 0 OR checked_at IS NULL OR TIMESTAMP '{NOW}' - checked_at >= to_days(coalesce(days, 14)) THEN 'due' ELSE 'not_due' END AS recheck
FROM versions v LEFT JOIN policy p USING (url)""")
def due_for_recheck(spark, sf_dir):
    n = F.col("doc_id").cast("int")
    policy = documents(spark, sf_dir).filter(n % 4 == 0).select("url", (n % 20 + 1).alias("days"), (n % 11 == 0).alias("manual"))

    v = version_stream(spark, sf_dir)
    return freshness.due_for_recheck(v, policy, F.lit(NOW).cast("timestamp"), forced=F.col("doc_id") % 23 == 0).select("key", "source", "recheck")


@R.add("snapshot_due", f"""WITH {VERSIONS_SQL} SELECT count(*) AS n, count(checked_at) AS checked,
  NOT (count(*) > 0 AND count(*) = count(checked_at) AND TIMESTAMP '{NOW}' - min(checked_at) < INTERVAL 14 DAY) AS due FROM versions""")
def snapshot_due(spark, sf_dir):
    return freshness.snapshot_due(version_stream(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@R.add("select_for_enrichment", f"""WITH {DOCUMENTS_SQL}, wanted AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC, doc_id) AS rank FROM base WHERE date >= '2024-06-01' OR doc_id % 5 = 0)
SELECT doc_id, site, rank, rank <= 10 AS selected FROM wanted""")
def select_for_enrichment(spark, sf_dir):
    d = documents(spark, sf_dir)
    return freshness.newest_first(d, (F.col("date") >= "2024-06-01") | (F.col("doc_id") % 5 == 0), 10, "site").select("doc_id", "site", "rank", "selected")


@R.add("enrichment_retry", f"""WITH {DOCUMENTS_SQL}, wanted AS (
  SELECT doc_id, row_number() OVER (ORDER BY date DESC, doc_id) AS place FROM base WHERE (date >= '2024-06-01' OR doc_id % 5 = 0) AND doc_id % 3 = 0)
SELECT doc_id, place <= 25 AS selected FROM wanted""")
def enrichment_retry(spark, sf_dir):
    n, d = F.col("doc_id"), documents(spark, sf_dir)
    before = d.select("url", F.when(n % 3 == 0, "failed_or_unsupported").when(n % 3 == 1, "partial").otherwise("complete").alias("media_status"))
    rows = d.withColumn("status", F.when(n % 5 == 0, "title_only").otherwise("text"))
    return freshness.select_for_enrichment(rows, "2024-06-01", True, before, 25).select("doc_id", "selected")


@R.add("keyword_select", f"""WITH {DOCUMENTS_SQL} SELECT doc_id, site, coalesce(contains(title, 'tion'), false) OR coalesce(contains(content, 'tion'), false) AS processed FROM base""")
def keyword_select(spark, sf_dir):
    return freshness.keyword_select(documents(spark, sf_dir), "tion", None, "doc_id").select("doc_id", "site", "processed")


@R.add("missing_body", f"""WITH {VERSIONS_SQL} SELECT source, status, count(*) AS n FROM versions
WHERE coalesce(content, '') = '' OR content = title OR status = 'title_only' GROUP BY source, status""")
def missing_body(spark, sf_dir):
    return freshness.distribution(freshness.missing_bodies(version_stream(spark, sf_dir)), "source", "status")


@R.add("missing_body_rows", f"WITH {VERSIONS_SQL} SELECT key, source FROM versions WHERE coalesce(content, '') = '' OR content = title OR status = 'title_only'")
def missing_body_rows(spark, sf_dir):
    return freshness.missing_bodies(version_stream(spark, sf_dir)).select("key", "source")


@R.add("enrichment_deferred", f"""WITH {DOCUMENTS_SQL}, wanted AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY date DESC, doc_id) <= 10 AS taken FROM base WHERE (date >= '2024-06-01' OR doc_id % 5 = 0) AND doc_id % 3 = 0)
SELECT site, count(*) FILTER (taken) AS taken, count(*) FILTER (NOT taken) AS deferred FROM wanted GROUP BY site""")
def enrichment_deferred(spark, sf_dir):
    # Only what failed before is tried again: those whose number divides by 3.
    n, d = F.col("doc_id"), documents(spark, sf_dir)
    return freshness.deferred(freshness.newest_first(d, ((F.col("date") >= "2024-06-01") | (n % 5 == 0)) & (n % 3 == 0), 10, "site"), "site")


@R.add("first_wins", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY user_id")
def first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    return freshness.first_wins(e, "user_id", "seq").select("user_id", "event_id")


@R.add("greedy_budget", f"""WITH RECURSIVE {DOCUMENTS_SQL}, c AS (
  SELECT site, doc_id, doc_id % 7 AS assets, row_number() OVER (PARTITION BY site ORDER BY date DESC, doc_id) AS i FROM base
), walk(site, i, doc_id, taken, docs, used) AS (
  SELECT site, 0, NULL::BIGINT, false, 0, 0::BIGINT FROM (SELECT DISTINCT site FROM c)
  UNION ALL
  SELECT w.site, c.i, c.doc_id, c.assets > 0 AND w.docs < 8 AND w.used + c.assets <= 20, w.docs + (c.assets > 0 AND w.docs < 8 AND w.used + c.assets <= 20)::INT,
    w.used + CASE WHEN c.assets > 0 AND w.docs < 8 AND w.used + c.assets <= 20 THEN c.assets ELSE 0 END
  FROM walk w JOIN c ON c.site = w.site AND c.i = w.i + 1)
SELECT site, doc_id, taken FROM walk WHERE i > 0""")
def greedy_budget(spark, sf_dir):
    c = documents(spark, sf_dir).select("site", "doc_id", (F.col("doc_id") % 7).alias("assets"), F.struct((-F.unix_date(F.col("date").cast("date"))).alias("a"), F.col("doc_id").alias("b")).alias("priority"))
    return freshness.greedy_budget(c, "site", 8, 20)


@R.add("last_wins", """SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, min(event_id) AS place FROM events GROUP BY user_id""")
def last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = e.withColumn("seq", F.struct("ts", "event_id"))
    last = freshness.last_wins(w, "user_id", "seq").select("user_id", "event_id")
    return last.join(e.groupBy("user_id").agg(F.min("event_id").alias("place")), "user_id")


@R.add("listing_exhausted", f"""WITH p AS (SELECT o_custkey % 50 AS board, o_orderkey // 64 AS page, list_sort(list_distinct(list(o_orderpriority))) AS urls FROM orders GROUP BY 1, 2)
SELECT board, page, coalesce(lag(urls) OVER (PARTITION BY board ORDER BY page) = urls, false) AS exhausted FROM p""")
def listing_exhausted(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.groupBy((F.col("o_custkey") % 50).alias("board"), F.floor(F.col("o_orderkey") / 64).alias("page")).agg(F.collect_set("o_orderpriority").alias("urls"))
    return freshness.exhausted(p, "board", "page", "urls").select("board", "page", "exhausted")


INDEX_SQL = """index AS (
  SELECT id, CASE WHEN doc_id % 13 <> 0 THEN substr(sha256(title || chr(10) || CASE WHEN doc_id % 6 = 0 THEN content || 'x' ELSE content END), 1, 16) END AS hash FROM base WHERE doc_id % 9 <> 0
  UNION ALL SELECT 'gone' || doc_id, 'x' FROM base WHERE doc_id % 17 = 0)"""


def index_rows(spark, sf_dir):
    d, n = documents(spark, sf_dir), F.col("doc_id")
    held = d.filter(n % 9 != 0).select("id", F.when(n % 13 != 0, T.content_hash(F.col("title"), F.when(n % 6 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))).alias("hash"))
    return held.unionByName(d.filter(n % 17 == 0).select(F.concat(F.lit("gone"), n.cast("string")).alias("id"), F.lit("x").alias("hash")))


@R.add("sync_diff", f"""WITH {DOCUMENTS_SQL}, {INDEX_SQL} SELECT coalesce(d.id, i.id) AS id,
  CASE WHEN i.id IS NULL THEN 'missing' WHEN d.id IS NULL THEN 'extra' WHEN i.hash IS NULL THEN 'unverifiable'
    WHEN i.hash = substr(sha256(title || chr(10) || content), 1, 16) THEN 'matched' ELSE 'stale' END AS state
FROM base d FULL JOIN index i ON d.id = i.id""")
def sync_diff(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("hash", T.content_hash(F.col("title"), F.col("content")))
    return indexing.sync_diff(d, index_rows(spark, sf_dir))


_CHUNK_SETS = DOCUMENTS_SQL + """, existing AS (
  SELECT id || '_c' || k AS chunk_id, id AS parent_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE url END AS url, k AS chunk_index, CASE WHEN doc_id % 5 = 0 AND k = 0 THEN 'h' || doc_id END AS content_hash,
    substr(content, 1 + (length(content) + 2) // 3 * k::INT, (length(content) + 2) // 3) AS page_content FROM base, range(3) AS r(k)
), incoming AS (
  SELECT 'n' || id || '_c' || k AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN id ELSE 'n' || id END AS parent_id, url, k AS chunk_index, NULL::VARCHAR AS content_hash, 'new ' || content AS page_content
    FROM base, range(2) AS r(k) WHERE doc_id % 7 = 0
  UNION ALL SELECT id || '_c0', id, url, 0, NULL, content FROM base WHERE doc_id % 11 = 0
), stale AS (
  SELECT chunk_id FROM existing e WHERE (chunk_id IN (SELECT chunk_id FROM incoming) OR parent_id IN (SELECT parent_id FROM incoming) OR (url <> '' AND url IN (SELECT url FROM incoming)))
    AND chunk_id NOT IN (SELECT chunk_id FROM incoming))"""


def _chunk_sets(spark, sf_dir):
    d, n = documents(spark, sf_dir), F.col("doc_id")
    k = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    name = lambda prefix: F.concat(F.lit(prefix), F.col("id"), F.lit("_c"), F.col("k").cast("string")).alias("chunk_id")
    none = F.lit(None).cast("string").alias("content_hash")
    third = F.floor((F.length("content") + 2) / 3).cast("int")  # a document's whole text is in its three chunks
    existing = k.select(name(""), F.col("id").alias("parent_id"), F.when(n % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.col("k").cast("long").alias("chunk_index"),
                        F.when((n % 5 == 0) & (F.col("k") == 0), F.concat(F.lit("h"), n.cast("string"))).alias("content_hash"), F.substring("content", 1 + third * F.col("k"), third).alias("page_content"))
    new = k.filter((n % 7 == 0) & (F.col("k") < 2)).select(name("n"), F.when(n % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("n"), "id")).alias("parent_id"), "url", F.col("k").cast("long").alias("chunk_index"), none, F.concat(F.lit("new "), "content").alias("page_content"))
    again = k.filter((n % 11 == 0) & (F.col("k") == 0)).select(name(""), F.col("id").alias("parent_id"), "url", F.lit(0).cast("long").alias("chunk_index"), none, F.col("content").alias("page_content"))
    return existing, new.unionByName(again)


@R.add("stale_chunks", f"WITH {_CHUNK_SETS} SELECT chunk_id FROM stale")
def stale_chunks(spark, sf_dir):
    return indexing.stale_chunks(*_chunk_sets(spark, sf_dir))


@R.add("upsert_chunks", f"""WITH {_CHUNK_SETS} SELECT chunk_id, parent_id, url, chunk_index, page_content FROM existing
WHERE chunk_id NOT IN (SELECT chunk_id FROM stale) AND chunk_id NOT IN (SELECT chunk_id FROM incoming)
UNION ALL SELECT chunk_id, parent_id, url, chunk_index, page_content FROM incoming""")
def upsert_chunks(spark, sf_dir):
    return indexing.upsert_chunks(*_chunk_sets(spark, sf_dir)).drop("content_hash")


@R.add("parent_hash", f"""WITH {_CHUNK_SETS} SELECT parent_id,
  coalesce(arg_min(coalesce(content_hash, ''), chunk_index) FILTER (content_hash IS NOT NULL AND chunk_index = 0), substr(sha256(string_agg(page_content, '' ORDER BY chunk_index)), 1, 16)) AS hash,
  count(*)::INT AS n_chunks FROM existing GROUP BY parent_id""")
def parent_hash(spark, sf_dir):
    return indexing.parent_hash(_chunk_sets(spark, sf_dir)[0])


@R.add("manifest_check", """WITH have AS (
  SELECT lang AS name, count(*) AS n, sum(('0x' || substr(sha256(text), 1, 10))::BIGINT) AS digest FROM documents GROUP BY lang)
SELECT name, true AS named, name <> 'fr' AS same_count, name <> 'de' AS same_content FROM have""")
def manifest_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.col("text").alias("content"))
    digest = F.sum(F.conv(F.substring(F.sha2("content", 256), 1, 10), 16, 10).cast("decimal(38,0)"))
    manifest = d.groupBy("name").agg((F.count(F.lit(1)) + F.when(F.col("name") == "fr", 1).otherwise(0)).alias("n"), (digest + F.when(F.col("name") == "de", 1).otherwise(0)).alias("digest"))
    return indexing.manifest_check(d, manifest)
