"""One current version per document out of overlapping sources, with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash

# Statuses that mean a body was found, those that mean it was enriched, and the sources' ranks.
VALID = ("text", "mixed", "ocr", "ocr_enhanced", "attachment")
ENRICHED = ("mixed", "ocr", "ocr_enhanced", "attachment")
UNRANKED = 99
OBSERVED = ("pending", "attempted", "not_applicable")  # what a collector that has seen the page says of its attachments

VERSION = (
    "struct<seq:int,source:string,rank:int,id:string,title:string,content:string,status:string,date:string,"
    "updated_at:timestamp,checked_at:timestamp,signature:string,media:string,hash:string,failed:boolean,attached:string>"
)
LOG = "array<struct<seq:int,decision:string,old_source:string,new_source:string,reason:string>>"


def canonical_key(source_type: Column, doc_id: Column, url: Column) -> Column:
    """FAQ entries share a page and go by id; others by URL, without one by id."""
    return F.when(source_type == "faq", F.concat(F.lit("id:"), doc_id)).when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("id:"), doc_id))


def is_valid(v: Column) -> Column:
    return v["status"].isin(*VALID) & (F.coalesce(v["content"], F.lit("")) != "") & (v["content"] != F.coalesce(v["title"], F.lit("")))


def source_emptied(old: Column, new: Column) -> Column:
    """Whether a bare title shows that the source itself took its text away or replaced its media, so that what was read before no longer holds.

    Only a collector that saw the page after the old check can tell: it did not fail, it says how
    it fares with the attachments, and the page is not dated earlier. Then the revision (title,
    html and media), where both are known, or the media alone must differ.
    """
    later = new["checked_at"].isNotNull() & (old["checked_at"].isNull() | (new["checked_at"] > old["checked_at"]))
    changed = F.coalesce(old["signature"] != new["signature"], F.lit(False)) | (F.coalesce(old["media"], F.lit("")) != F.coalesce(new["media"], F.lit("")))
    seen = (new["status"] == "title_only") & ~F.coalesce(new["failed"], F.lit(False)) & F.coalesce(new["attached"].isin(*OBSERVED), F.lit(False))
    earlier = (F.coalesce(old["date"], F.lit("")) != "") & (F.coalesce(new["date"], F.lit("")) != "") & (new["date"] < old["date"])
    return seen & later & ~earlier & changed


def decision(old: Column, new: Column) -> Column:
    """Why the new version is taken ('+...') or left ('-...'); the first rule that applies decides.

    A newer version that is a bare title never wins by being newer: the rules fall through.
    """
    old_ok, new_ok = is_valid(old), is_valid(new)
    bare = new["status"] == "title_only"
    o_up, n_up = old["updated_at"], new["updated_at"]
    o_date, n_date = F.nullif(old["date"], F.lit("")), F.nullif(new["date"], F.lit(""))  # decides only where both are known
    both_signed = old["signature"].isNotNull() & new["signature"].isNotNull()
    revised = F.when(both_signed, old["signature"] != new["signature"]).otherwise(old["hash"] != new["hash"])
    checked = old["checked_at"].isNotNull() & new["checked_at"].isNotNull() & revised
    differs = F.when(old["hash"] != new["hash"], "_content_differs").otherwise("")
    return (
        F.when(old_ok & ~new_ok, F.when(source_emptied(old, new), "+source_emptied").otherwise("-keep_valid"))
        .when(~old_ok & new_ok, "+first_valid")
        .when((n_up > o_up) & ~bare, "+newer_update").when(n_up < o_up, "-older_update")
        .when(o_up.isNotNull() & n_up.isNull(), "-update_known").when(o_up.isNull() & n_up.isNotNull() & ~bare, "+update_known")
        .when((n_date > o_date) & ~bare, "+newer_date").when(n_date < o_date, "-stale_date")
        .when(checked & (new["checked_at"] > old["checked_at"]) & ~bare, "+newer_check").when(checked & (new["checked_at"] < old["checked_at"]), "-stale_check")
        .when(old["status"].isin(*ENRICHED) & (new["status"] == "text"), "-keep_enriched").when((old["status"] == "text") & new["status"].isin(*ENRICHED), "+enriched")
        .when(new["rank"] < old["rank"], F.concat(F.lit("+rank"), differs)).when(new["rank"] > old["rank"], F.concat(F.lit("-rank"), differs))
        .when(F.length(F.coalesce(new["content"], F.lit(""))) > F.length(F.coalesce(old["content"], F.lit(""))), "+longer")
        .otherwise("-not_longer")
    )


def resolve(versions: DataFrame, key: str = "key", *kept: str) -> DataFrame:
    """key, current (a version) and log of decisions, by an ordered fold over each key's versions.

    kept: columns that follow from the key and stay; rows dealt by one of them are folded where they are.

    A key has about one version per source, so its array stays small; `n_versions` shows it.
    On a skip with equal signatures the kept row's check time moves up to the later check,
    which later steps see. Order: seq, then id.
    """
    fields = [f.split(":")[0] for f in VERSION[7:-1].split(",")]
    grouped = versions.groupBy(*kept, key).agg(F.sort_array(F.collect_list(F.struct(*fields).cast(VERSION))).alias("vs"))
    start = F.struct(F.element_at("vs", 1).alias("cur"), F.array().cast(LOG).alias("log"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["cur"]
        why = decision(old, new)
        taken = why.startswith("+")
        same = old["signature"].isNotNull() & (old["signature"] == new["signature"]) & (new["checked_at"] > old["checked_at"])
        kept = F.when(F.coalesce(same, F.lit(False)), old.withField("checked_at", new["checked_at"])).otherwise(old)
        entry = F.struct(new["seq"].alias("seq"), F.when(taken, "overwritten").otherwise("skipped").alias("decision"), old["source"].alias("old_source"), new["source"].alias("new_source"), F.substring(why, 2, 100).alias("reason"))
        return F.struct(F.when(taken, new).otherwise(kept).cast(VERSION).alias("cur"), F.concat(acc["log"], F.array(entry).cast(LOG)).alias("log"))

    folded = grouped.withColumn("r", F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), start.cast(f"struct<cur:{VERSION},log:{LOG}>"), step))
    return folded.select(*kept, key, F.col("r.cur").alias("current"), F.col("r.log").alias("log"), F.size("vs").alias("n_versions"))


def with_hash(versions: DataFrame) -> DataFrame:
    return versions.withColumn("hash", content_hash(F.col("title"), F.col("content")))


def log_rows(resolved: DataFrame, key: str = "key") -> DataFrame:
    return resolved.select(key, F.explode("log").alias("e")).select(key, "e.*")


def audit(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Per source: its rows, those that were first of their key, and how its others fared."""
    seen = versions.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    fared = log.groupBy(F.col("new_source").alias("source")).agg(F.count_if(F.col("decision") == "overwritten").alias("overwritten"), F.count_if(F.col("decision") == "skipped").alias("skipped"))
    joined = seen.join(fared, "source", "left").na.fill(0, ["overwritten", "skipped"])
    return joined.withColumn("new", F.col("n_rows") - F.col("overwritten") - F.col("skipped"))


def audit_sample(log: DataFrame, n: int = 50) -> DataFrame:
    """The first n decisions by key and order, each with the number of all; Spark keeps n rows a task and merges them."""
    total = log.agg(F.count(F.lit(1)).alias("total"))
    return log.orderBy("key", "seq").limit(n).join(F.broadcast(total))


def crowded(versions: DataFrame, key: str = "key", most: int = 64) -> DataFrame:
    """Keys with more versions than a fold over an array should hold, which resolve() is not meant for."""
    return versions.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
