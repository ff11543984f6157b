"""Reading and writing corpus files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import derived_source_type, scrub
from corpusloom.session import small_batches

LINES_AT_ONCE = 10_000
DOCUMENT = "id string, title string, content string, source string, category string, date string, url string, content_status string, source_type string, content_hash string, html_content string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON arrays of documents; what a document lacks is null, what is empty stays empty."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def read_sources(spark: SparkSession, catalogue: list[dict]) -> DataFrame:
    """All sources of a catalogue (name, path, default_type, priority, required), tagged. A required one must be there."""
    out = None
    for order, s in enumerate(catalogue):
        if not exists(spark, s["path"]):
            if s["required"]:
                raise FileNotFoundError(f"source {s['name']}: {s['path']}")
            continue
        rows = read_documents(spark, s["path"]).withColumns({
            "catalogue_name": F.lit(s["name"]), "priority": F.lit(s["priority"]), "source_order": F.lit(order),
            "source_type": derived_source_type(F.col("source_type"), F.lit(s["default_type"])),
        })
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is there")
    return out


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, SHA-256 and raw rows of whole files of JSON arrays; a file without rows has 0."""
    whole = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = read_documents(spark, paths).groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("rows"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return whole.join(rows, plain(F.col("path")) == plain(F.col("_path")), "left").select("path", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))


def write_documents(df: DataFrame, path: str) -> None:
    """Documents as JSON lines that every reader accepts, in a new folder."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    write_report(df.withColumns({c: scrub(F.col(c)) for c in strings}), path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; lines that do not fit raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Parquet in a new folder: what is there already, even if empty, is never touched."""
    if exists(df.sparkSession, path):
        raise FileExistsError(path)
    df.write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_rss(spark: SparkSession, path: str, max_items: int) -> DataFrame:
    """The first items of a feed in their order: title, url, content (the title where it is empty), date; those without a title are left out.

    A feed is one file of few items.
    """
    schema = "title string, link string, description string, pubDate string, `dc:date` string"
    items = spark.read.format("xml").schema(schema).option("rowTag", "item").load(path)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    named = items.filter(text("title") != "").withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(max_items)
    return named.select(
        text("title").alias("title"), text("link").alias("url"), F.when(text("description") == "", text("title")).otherwise(text("description")).alias("content"),
        F.coalesce(F.nullif(text("dc:date"), F.lit("")), text("pubDate")).alias("date"),
    )


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files inside the archives under a path; see zip_lines()."""
    return zip_lines(spark.read.format("binaryFile").load(path).select("path", "content"))


def zip_lines(files: DataFrame) -> DataFrame:
    """path, member, place, line of the text files inside archives (path, content); members are read line by line, not as a whole."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, int, str]]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        with z.open(member) as f:
                            for place, line in enumerate(io.TextIOWrapper(f, "utf-8")):
                                yield name, member, place, line.rstrip("\r\n")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lines(batches)
        while some := list(islice(found, LINES_AT_ONCE)):
            yield pd.DataFrame(some, columns=["path", "member", "place", "line"])

    return files.select("path", "content").mapInPandas(unzip, "path string, member string, place long, line string")


def file_format(files: DataFrame) -> DataFrame:
    """Adds format by the content of files (path, content): pdf, hwp, hwpx, image or unsupported.

    An archive is a hwpx if it has that format's parts, else if its name says so; an archive that
    cannot be read is judged by its name.
    """

    @F.pandas_udf("boolean")
    def holds_hwpx(contents: pd.Series) -> pd.Series:
        def judge(content: bytes | None) -> bool:
            try:
                names = set(zipfile.ZipFile(io.BytesIO(content or b"")).namelist())
            except (zipfile.BadZipFile, ValueError, OSError):
                return False
            return len(names) <= 10_000 and {"Contents/section0.xml", "Contents/content.hpf"} <= names

        return contents.map(judge)

    head = F.hex(F.substring("content", 1, 16))
    archive = head.startswith("504B")
    named = F.lower("path").rlike(r"\.hwpx(?:[?#].*)?$")
    image = head.rlike("^(?:FFD8FF|89504E47|47494638|424D|49492A00|4D4D002A)") | head.rlike("^52494646.{8}57454250")
    # Only archives reach Python; the rest of the column is null there.
    hwpx = archive & (holds_hwpx(F.when(archive, F.col("content"))) | named)
    kind = F.when(head.startswith("255044462D"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "hwp").when(hwpx, "hwpx").when(image, "image")
    return files.withColumn("format", kind.otherwise("unsupported"))


def hwpx_text(files: DataFrame) -> DataFrame:
    """path, text, status, error, sections of files in the hwpx format: the paragraphs of their XML sections, in order.

    A file that is no archive, has no sections or holds broken XML failed; one without text is empty.
    """

    def extract(content: bytes | None) -> tuple[str, str, str | None, int]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                names = sorted(n for n in z.namelist() if n.startswith("Contents/section") and n.endswith(".xml"))
                names = names or sorted(n for n in z.namelist() if "section" in n.lower() and n.endswith(".xml"))
                if not names:
                    return "", "failed", "no sections", 0
                parts = []
                for name in names:
                    paragraphs = [e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.split("}")[-1] == "p"]
                    texts = ["".join(t.text for t in p.iter() if t.tag.split("}")[-1] == "t" and t.text).strip() for p in paragraphs]
                    parts.append("\n".join(t for t in texts if t))
        except (zipfile.BadZipFile, ValueError, OSError):
            return "", "failed", "no archive", 0
        except ElementTree.ParseError:
            return "", "failed", "broken XML", 0
        text = "\n\n".join(p for p in parts if p).strip()
        return text, "success" if text else "empty", None, len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(c) for c in batch["content"]]
            yield pd.DataFrame([(p, *f) for p, f in zip(batch["path"], found, strict=True)], columns=["path", "text", "status", "error", "sections"])

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, text string, status string, error string, sections int")
