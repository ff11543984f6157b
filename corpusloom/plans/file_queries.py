"""Sources and sinks: files that Spark writes out of the given tables and reads back, archives, and pages of a site."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusloom.functions import text as T
from corpusloom.plans import Registry
from corpusloom.plans.corpus import DOCUMENTS_SQL, documents
from corpusloom.session import shared_dir, spread, table
from corpusloom.sources import files as S
from corpusloom.sources import pages as P

R = Registry()
PER_FILE = 500  # documents of a file of JSON arrays


def _folder(spark):
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _write_arrays(rows, key, path):
    """Rows as JSON arrays in the order of their key, PER_FILE of them a file."""
    json = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    arrays = rows.select(F.floor(F.col(key) / PER_FILE).cast("int").alias("part"), F.struct(F.col(key), json.alias("j")).alias("r")).groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    arrays.select("part", _say("[", F.array_join(F.transform("rows", lambda r: r["j"]), ","), "]").alias("value")).write.partitionBy("part").text(path)


@R.add("document_files", f"WITH {DOCUMENTS_SQL} SELECT id, title, content, source_type, CASE WHEN doc_id % 3 = 0 THEN '' END AS html_content FROM base")
def document_files(spark, sf_dir):
    # What a document lacks is null after reading, what is empty stays empty.
    path = _folder(spark)
    _write_arrays(documents(spark, sf_dir).select("doc_id", "id", "title", "content", "source_type", F.when(F.col("doc_id") % 3 == 0, "").alias("html_content")), "doc_id", path)
    return S.read_documents(spark, path).select("id", "title", "content", "source_type", "html_content")


@R.add("catalogued_sources", f"""WITH {DOCUMENTS_SQL} SELECT id, 'notices' AS catalogue_name, 1 AS priority, 0 AS source_order, CASE WHEN doc_id % 2 = 0 THEN 'guidance' ELSE 'notice' END AS source_type, content FROM base WHERE doc_id % 3 = 0
UNION ALL SELECT id, 'forms', 3, 2, 'form', NULL FROM base WHERE doc_id % 3 = 1""")
def catalogued_sources(spark, sf_dir):
    d, n, path = documents(spark, sf_dir), F.col("doc_id"), _folder(spark)
    _write_arrays(d.filter(n % 3 == 0).select("doc_id", "id", "content", F.when(n % 2 == 0, "guidance").alias("source_type")), "doc_id", f"{path}/a")
    _write_arrays(d.filter(n % 3 == 1).select("doc_id", "id", F.lit("notice").alias("source_type")), "doc_id", f"{path}/b")
    entry = lambda name, at, kind, priority, required: {"name": name, "path": at, "default_type": kind, "priority": priority, "required": required}
    catalogue = [entry("notices", f"{path}/a", "notice", 1, True), entry("gone", f"{path}/none", "faq", 2, False), entry("forms", f"{path}/b", "form", 3, True)]
    return S.read_sources(spark, catalogue).select("id", "catalogue_name", "priority", "source_order", "source_type", "content")


@R.add("source_fingerprint", f"""WITH f AS (SELECT doc_id // {PER_FILE} AS part, '[' || string_agg('{{"id":"d' || doc_id || '"}}', ',' ORDER BY doc_id) || ']' || chr(10) AS body, count(*) AS rows FROM documents GROUP BY 1)
SELECT part::INTEGER AS part, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256, rows FROM f""")
def source_fingerprint(spark, sf_dir):
    path = _folder(spark)
    _write_arrays(documents(spark, sf_dir).select("doc_id", "id"), "doc_id", path)
    return S.fingerprint(spark, [path]).select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "bytes", "sha256", "rows")


@R.add("line_files", "SELECT item_id, text, item_id % 2 = 0 AS verified FROM benchmark UNION ALL SELECT doc_id, text, false FROM documents")
def line_files(spark, sf_dir):
    path = _folder(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 2 == 0).alias("verified"))
    S.write_documents(b.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.lit(False).alias("verified"))), path)
    return S.read_lines(spark, path, "item_id long, text string, verified boolean")


@R.add("snapshots", "SELECT doc_id, text, true AS refused FROM documents")
def snapshots(spark, sf_dir):
    path, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    S.write_snapshot(d, path)
    try:
        S.write_snapshot(d, path)
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@R.add("rss_items", """SELECT 'Order ' || o_orderkey AS title, 'https://h/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'by <b> & ' || o_orderstatus ELSE 'Order ' || o_orderkey END AS content,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'published ' || o_orderkey END AS date FROM orders WHERE o_orderkey % 5 <> 0""")
def rss_items(spark, sf_dir):
    k, path = F.col("o_orderkey"), _folder(spark)
    key = k.cast("string")
    title = F.when(k % 5 == 0, " ").otherwise(_say("Order ", key))
    told = F.when(k % 2 == 0, _say("<description><![CDATA[by <b> & ", F.col("o_orderstatus"), "]]></description>")).otherwise("<description> </description>")
    day = F.when(k % 3 == 0, _say("<dc:date>", F.date_format("o_orderdate", "yyyy-MM-dd"), "</dc:date>")).otherwise("")
    item = _say("<item><title>", title, "</title><link>https://h/", key, "</link>", told, "<pubDate>published ", key, "</pubDate>", day, "</item>")
    feeds = table(spark, sf_dir, "orders").groupBy(F.floor(k / PER_FILE).alias("part")).agg(_say("<rss xmlns:dc='u'><channel>", F.array_join(F.collect_list(item), ""), "</channel></rss>").alias("value"))
    feeds.write.partitionBy("part").text(path)
    return S.read_rss(spark, path, 2**31 - 1)


@F.pandas_udf(BinaryType())
def _zipped(members: pd.Series) -> pd.Series:
    """Archives of (name, text) members."""

    def put(rows) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in rows:
                z.writestr(r["name"], r["text"])
        return out.getvalue()

    return members.map(put)


def _archives(spark, sf_dir, name, text):
    """An archive for each customer, a member for each of its orders."""
    members = F.array_sort(F.collect_list(F.struct(name.alias("name"), text.alias("text"))))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(_zipped(members).alias("content"))


@R.add("archived_lines", """SELECT o_custkey::VARCHAR AS path, 'shard-' || lpad(o_orderkey::VARCHAR, 12, '0') || '.jsonl' AS member, i::BIGINT AS place, CASE i WHEN 0 THEN '{"k":' || o_orderkey || '}' ELSE o_orderstatus END AS line FROM orders, range(2) AS r(i)""")
def archived_lines(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return S.zip_lines(_archives(spark, sf_dir, _say("shard-", F.lpad(key, 12, "0"), ".jsonl"), _say('{"k":', key, "}\n", F.col("o_orderstatus"), "\n")))


@R.add("hwpx_texts", """SELECT o_custkey::VARCHAR AS path, string_agg('Order ' || o_orderkey || chr(10) || o_orderstatus, chr(10) || chr(10) ORDER BY o_orderkey) AS text, 'success' AS status, count(*)::INTEGER AS sections FROM orders GROUP BY 1""")
def hwpx_texts(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    body = _say("<s xmlns:h='u'><h:p><h:t>Order </h:t><h:t>", key, "</h:t></h:p><h:p/><h:p><h:t> ", F.col("o_orderstatus"), " </h:t></h:p></s>")
    return S.hwpx_text(_archives(spark, sf_dir, _say("Contents/section", F.lpad(key, 12, "0"), ".xml"), body)).drop("error")


# How files of each kind begin, and what a file of that beginning is.
HEADS = (("255044462D312E37", "pdf"), ("D0CF11E0A1B11AE1", "hwp"), ("FFD8FFE0", "image"), ("89504E470D0A1A0A", "image"), ("524946460000000057454250", "image"), ("5249464600000000", "unsupported"), ("504B0304", "unsupported"), ("", "unsupported"))


@R.add("file_formats", f"SELECT doc_id, {[k for _, k in HEADS]}[doc_id % {len(HEADS)} + 1] AS format FROM documents")
def file_formats(spark, sf_dir):
    n = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h, _ in HEADS]), (n % len(HEADS) + 1).cast("int"))
    f = table(spark, sf_dir, "documents").select("doc_id", _say("https://h/", n.cast("string")).alias("path"), F.unhex(F.concat(head, F.hex(F.encode(F.when(head != "", F.col("text")).otherwise(""), "utf-8")))).alias("content"))
    return S.file_format(f).select("doc_id", "format")


@R.add("content_statuses", f"""WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'title_only' WHEN doc_id % 4 = 2 THEN 'ocr' WHEN trim(content) = trim(title) THEN 'title_only' ELSE 'text' END AS status
FROM base WHERE trim(content) <> trim(title) AND trim(content) <> ''""")
def content_statuses(spark, sf_dir):
    n, d = F.col("doc_id"), documents(spark, sf_dir).filter("trim(content) <> trim(title) AND trim(content) <> ''")
    content = F.when(n % 5 == 0, " ").when(n % 7 == 0, _say(F.col("title"), " ")).otherwise(F.col("content"))
    given = F.when(n % 4 == 1, "fetch_failed").when(n % 4 == 2, "ocr").when(n % 4 == 3, "text")
    return d.select("doc_id", T.content_status(F.col("title"), content, given).alias("status"))


def _guidance(spark, sf_dir):
    """A page of a site for each order: tabs, a content element with prose, a table of spans, files, pictures and board links, and a contact line."""
    k = F.col("o_orderkey")
    key, day = k.cast("string"), F.date_format("o_orderdate", "yyyy.MM.dd")
    tabs = _say("<ul id='menuUItab'><li><a href='/g/", key, "'>Own ", key, "</a></li><li><a href='/g/x'>Other</a></li></ul>")
    grid = _say("<table><tr><th>kind</th><th colspan=2>", F.col("o_orderpriority"), "</th></tr><tr><td rowspan=2>state</td><td>", F.col("o_orderstatus"), "</td><td>", day, "</td></tr><tr><td>left<br>over</td></tr></table>")
    file = F.when(k % 3 == 0, _say("<p><a href='/f/download.do?id=", key, "'>File ", key, "</a></p>")).otherwise("")
    picture = F.when(k % 4 == 0, _say("<img src='/i/", key, ".png' alt='pic'>")).otherwise("")
    board = F.when(k % 5 == 0, "<div><a href='/bbs/n/7/99/artclView.do'>Row</a></div>").otherwise("")
    frame = F.when(k % 7 == 0, "<iframe src='x'></iframe>").otherwise("")
    html = _say("<nav><a href='/z'>Menu</a></nav><h1>Head</h1>", tabs, "<div id='_contentBuilder'><p>Order <b>", key, "</b> is\n here</p><p class='hidden'>no</p>", grid, file, picture, board, frame,
                "<script>x()</script></div><div class='wrap-contact'>Office 최종 수정일 : ", day, "</div>")
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"))
    return orders.select(k.alias("page_id"), _say("https://h/g/", F.when(k % 2 == 0, key).otherwise("y")).alias("url"), html.alias("html"))


@R.add("guidance_pages", """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Own ' || o_orderkey ELSE 'Head' END AS title,
  'Order ' || o_orderkey || ' is here' || chr(10) || 'kind | ' || o_orderpriority || ' | ' || o_orderpriority || chr(10) || 'state | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y.%m.%d') || chr(10) || 'state | left over | '
    || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'File ' || o_orderkey ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'Row' ELSE '' END AS content,
  CASE WHEN o_orderkey % 3 = 0 THEN ['https://h/f/download.do?id=' || o_orderkey] ELSE [] END AS files, CASE WHEN o_orderkey % 4 = 0 THEN ['https://h/i/' || o_orderkey || '.png'] ELSE [] END AS images,
  CASE WHEN o_orderkey % 5 = 0 THEN ['https://h/bbs/n/7/artclList.do'] ELSE [] END AS boards, ['https://h/g/' || o_orderkey, 'https://h/g/x'] AS tabs, strftime(o_orderdate, '%Y-%m-%d') AS updated,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 THEN 'dynamic_content_requires_review' WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'html_text_with_unextracted_media' ELSE 'html_text_only' END AS coverage FROM orders""")
def guidance_pages(spark, sf_dir):
    urls = lambda c: F.transform(c, lambda x: x["url"]).alias(c)
    p = P.extract_page(_guidance(spark, sf_dir)).withColumnRenamed("attachments", "files")
    return p.select("page_id", "title", "content", urls("files"), urls("images"), "boards", urls("tabs"), "updated", "coverage")


@R.add("table_spans", """SELECT o_orderkey AS page_id, ['kind | ' || o_orderpriority || ' | ' || o_orderpriority, 'state | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y.%m.%d'), 'state | left over | '] AS tables FROM orders""")
def table_spans(spark, sf_dir):
    return P.fields(_guidance(spark, sf_dir)).select("page_id", "tables")


@R.add("notice_assets", """SELECT o_orderkey AS page_id, 'Notice ' || o_orderkey AS body, CASE WHEN o_orderkey % 2 = 0 THEN ['https://h/p/' || o_orderkey || '.png'] ELSE [] END AS images,
  CASE WHEN o_orderkey % 3 = 0 THEN ['https://h/f/download.do?' || o_orderkey || '=File ' || o_orderstatus] ELSE [] END AS files FROM orders""")
def notice_assets(spark, sf_dir):
    k = F.col("o_orderkey")
    key = k.cast("string")
    picture = F.when(k % 2 == 0, _say("<img src='", key, ".png'><img src='data:x'>")).otherwise("")
    file = F.when(k % 3 == 0, _say("<a href='/f/download.do?", key, "'>File\n ", F.col("o_orderstatus"), "</a><a href='/v/download.do'>바로보기</a>")).otherwise("")
    html = _say("<div class='view viewCont'><div class='txt'>Notice ", key, "\n</div>", picture, "</div>", file)
    found = P.extract_links(table(spark, sf_dir, "orders").select(k.alias("page_id"), F.lit("https://h/p/1").alias("url"), html.alias("html")))
    return found.select("page_id", "body", "images", F.transform("attachments", lambda a: F.concat(a["url"], F.lit("="), a["title"])).alias("files"))
