"""Keeping a chunk index in step with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_diff(docs: DataFrame, index: DataFrame) -> DataFrame:
    """id and state of every document or index parent: missing, extra, unverifiable, matched or stale. Both have (id, hash)."""
    j = docs.select("id", F.col("hash").alias("want")).join(index.select("id", F.col("hash").alias("have"), F.lit(True).alias("held")), "id", "full_outer")
    state = (
        F.when(F.col("held").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "unverifiable")
        .when(F.col("want") == F.col("have"), "matched").otherwise("stale")
    )
    return j.select("id", state.alias("state"))


def stale_chunks(existing: DataFrame, incoming: DataFrame, match_url: bool = True) -> DataFrame:
    """Existing chunks that an ingest replaces or orphans: of its chunk ids, parents or URLs, and not emitted again.

    The three ways are joined one by one; an OR in one join would compare all pairs.
    """
    ways = [existing.join(incoming.select("chunk_id").distinct(), "chunk_id", "left_semi"), existing.join(incoming.select("parent_id").distinct(), "parent_id", "left_semi")]
    if match_url:
        ways.append(existing.join(incoming.filter("url <> ''").select("url").distinct(), "url", "left_semi"))
    met = ways[0].select("chunk_id")
    for w in ways[1:]:
        met = met.unionByName(w.select("chunk_id"))
    return met.distinct().join(incoming.select("chunk_id"), "chunk_id", "left_anti")


def upsert_chunks(existing: DataFrame, incoming: DataFrame, match_url: bool = True) -> DataFrame:
    """The index after an ingest: untouched parents stay, stale chunks go, chunks emitted again are replaced. Nothing to ingest is refused."""
    if incoming.isEmpty():
        raise ValueError("no chunks to ingest")
    kept = existing.join(stale_chunks(existing, incoming, match_url), "chunk_id", "left_anti").join(incoming.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(incoming)


def parent_hash(chunks: DataFrame) -> DataFrame:
    """Per parent the hash that its first chunk carries, else that of its chunks in order, else null."""
    rows = chunks.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash", "page_content"))).alias("c"))
    given = F.element_at("c", 1)["content_hash"]
    whole = F.substring(F.sha2(F.array_join(F.transform("c", lambda x: x["page_content"]), ""), 256), 1, 16)
    computable = F.forall("c", lambda x: x["page_content"].isNotNull())
    return rows.select("parent_id", F.coalesce(given, F.when(computable, whole)).alias("hash"), F.size("c").alias("n_chunks"))


def manifest_check(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether a manifest (name, n, digest) names a collection, and its row count and order-free digest are those of docs; one row a name."""
    digest = F.sum(F.conv(F.substring(F.sha2("content", 256), 1, 10), 16, 10).cast("decimal(38,0)"))
    have = docs.groupBy("name").agg(F.count(F.lit(1)).alias("have_n"), digest.alias("have_digest"))
    return expected.join(have, "name", "left").select("name", (F.trim(F.coalesce("name", F.lit(""))) != "").alias("named"), (F.col("n") == F.coalesce("have_n", F.lit(0))).alias("same_count"), F.coalesce(F.col("digest") == F.col("have_digest"), F.lit(False)).alias("same_content"))
