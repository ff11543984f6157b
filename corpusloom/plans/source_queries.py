"""Page jobs and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans import Registry
from corpusloom.plans.corpus import RESOLVED_SQL, version_rows
from corpusloom.session import shared_dir, table
from corpusloom.sources import pages as P
from corpusloom.streaming import upserts as U

R = Registry()


@R.add("page_links", """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
SELECT page_id, i::INT AS place, h[i + 1] AS href, trim(t[i + 1]) AS label, true AS in_menu FROM a, unnest(range(len(h))) AS u(i)""")
def page_links(spark, sf_dir):
    return P.links(table(spark, sf_dir, "pages")).drop("target", "menu_path")


_HOST = r"[a-z0-9.-]+\.example\.(?:com|org|net)"


@R.add("discover_links", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages
), l AS (SELECT page_id, i, scheme || '://' || host || h[i + 1] AS url, trim(t[i + 1]) AS title, host FROM a, unnest(range(len(h))) AS u(i)
), best AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, i) = 1)
SELECT url, title, [title] AS menu_path, 'guidance' AS kind, 14 AS interval_days, CASE WHEN regexp_matches(host, '^[a-z0-9.-]+\.example\.(com|org|net)$') THEN 'pending' ELSE 'external_or_dynamic_review' END AS status FROM best""")
def discover_links(spark, sf_dir):
    return P.discover(table(spark, sf_dir, "pages"), lambda u: T.canonical_url(u, _HOST))


@R.add("extract_page", """SELECT page_id, 'content_missing' AS coverage, 'text' AS content_status, regexp_extract_all(html, '<a href="/[^"]*">').len()::BIGINT AS n_related, 0::BIGINT AS n_files FROM pages""")
def extract_page(spark, sf_dir):
    p = P.extract_page(table(spark, sf_dir, "pages"))
    return p.select("page_id", "coverage", "content_status", F.size("related").cast("long").alias("n_related"), F.size("attachments").cast("long").alias("n_files"))


@R.add("board_rows", """WITH b AS (SELECT o_custkey AS page_id, o_orderkey AS k, o_orderdate AS d FROM orders), u AS (SELECT *, 'https://h/bbs/x/1/' || (k // 2) || '/artclView.do' AS url FROM b WHERE k % 5 <> 0)
SELECT sha256(url) AS id, 'Title ' || k AS title, 'Title ' || k AS content, 'Board (W' || k % 3 || ')' AS source, 'c' AS category, strftime(d, '%Y-%m-%d') AS date, url FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, k) = 1""")
def board_rows(spark, sf_dir):
    return P.board_rows(_boards(spark, sf_dir), "Board", "c", F.lit("2030-01-01"))


def _boards(spark, sf_dir):
    """A board page of each customer's orders, a row each."""
    k, say = F.col("o_orderkey"), lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    key = k.cast("string")
    view = F.when(k % 5 == 0, "artclList.do").otherwise("artclView.do")
    row = say("<tr class='", F.when(k % 7 == 0, "notice").otherwise(""), "'><td>", key, "</td><td><a href='/bbs/x/1/", F.floor(k / 2).cast("string"), "/", view, "'> Title ", key, "</a></td><td>W", (k % 3).cast("string"),
              "</td><td></td><td>", F.date_format("o_orderdate", "yyyy.MM.dd"), "</td></tr>")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    return g.select("page_id", F.lit("https://h/bbs/x/1/artclList.do").alias("url"), say("<table>", F.col("rows"), "</table>").alias("html"))


@R.add("parse_listing", """WITH b AS (SELECT o_custkey AS page_id, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 5 <> 0)
SELECT page_id, 'Title ' || k AS title, date, k % 7 = 0 AS pinned, date >= '2000-09-01' AS wanted FROM b WHERE date >= '2000-01-01'""")
def parse_listing(spark, sf_dir):
    return P.listing(_boards(spark, sf_dir), "2000-09-01", r"https://h/bbs/x/1/\d+/artclView\.do").select("page_id", "title", "date", "pinned", "wanted")


@R.add("faq_rows", """SELECT o_custkey AS page_id, 'https://h/faq/' || o_custkey AS url, o_orderpriority || ' Order ' || o_orderkey || '?' AS question,
  'State ' || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'date | ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'date | ' || o_custkey || chr(10) ELSE '' END || 'by ' || o_custkey AS answer,
  o_orderpriority AS category, (o_custkey % 9 + 1)::INTEGER AS total, sha256('faq:' || o_orderpriority || ' Order ' || o_orderkey || '?') AS id FROM orders""")
def faq_rows(spark, sf_dir):
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    grid = say("<table><tr><th rowspan=2>date</th><td>", F.date_format("o_orderdate", "yyyy-MM-dd"), "</td></tr><tr><td>", text("o_custkey"), "</td></tr></table>\n")
    item = say("<li><p class='question'><span class='cate-name'>", text("o_orderpriority"), "</span><b>Order ", text("o_orderkey"), "?</b></p><div class='answer'> State ", text("o_orderstatus"), "\n", F.when(key % 3 == 0, grid).otherwise(""), "by ", text("o_custkey"), "</div>")
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    html = say("<h1>FAQ</h1><div class='faq-list'><ul>", F.col("items"), "</ul></div><i class='_totPage'>", (F.col("page_id") % 9 + 1).cast("string"), "</i>")
    return P.faq(lists.select("page_id", say("https://h/faq/", text("page_id")).alias("url"), html.alias("html")), "faq:").drop("content_hash")


@R.add("page_headings")
def page_headings(spark, sf_dir):
    # No SQL: some headings break off within a reference, which DuckDB cannot decode; tests compare every page with the standard parser.
    return P.fields(table(spark, sf_dir, "pages")).select("page_id", "heading", "n_images", F.size("attachments").alias("n_files"))


@R.add("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    s = U.open_stream(spark, f"{sf_dir}/events.parque[t]")
    return U.first_seen(s, ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")


@R.add("stream_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    s = U.open_stream(spark, f"{sf_dir}/events.parque[t]")
    return U.windowed(s, "ts", "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("stream_late_rejects", f"""WITH {RESOLVED_SQL} SELECT key, 2 AS seq, substr(why, 2) AS reason FROM second_why WHERE why[1] = '-' UNION ALL SELECT key, 3, substr(why, 2) FROM third_why WHERE why[1] = '-'""")
def stream_late_rejects(spark, sf_dir):
    _, log = U.upsert(U.open_stream(spark, f"{sf_dir}/documents.parque[t]"), version_rows)
    return log.filter("decision = 'skipped'").select("key", "seq", "reason")


@R.add("stream_backfill", "SELECT event_id, user_id, upper(event_type) AS kind FROM events")
def stream_backfill(spark, sf_dir):
    s = U.open_stream(spark, f"{sf_dir}/events.parque[t]")
    return U.backfill(s, lambda d: d.select("event_id", "user_id", F.upper("event_type").alias("kind")), f"{shared_dir(spark)}/backfill-{uuid.uuid4().hex}")


@R.add("stream_upsert", f"WITH {RESOLVED_SQL} SELECT key, id, source, status, date, hash FROM third")
def stream_upsert(spark, sf_dir):
    s = U.open_stream(spark, f"{sf_dir}/documents.parque[t]")
    state, _ = U.upsert(s, version_rows)
    return state.select("key", "current.*").select("key", "id", "source", "status", "date", "hash")
