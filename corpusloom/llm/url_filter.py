"""URL filters: a blocked Bloom filter of listed keys in front of an exact join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import nonnull, pick, stored, table

BLOCK_WORDS = 8  # a block is one cache line: 8 words of 64 bits
BITS_SET = 8  # bits a key sets, all in its block
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 20  # 64 MB: beyond it the filter gets denser and more keys go to the join, none is lost
SLICE_BLOCKS = 1 << 10
EXACT_RULES = 10_000  # rule tables up to so many rows are broadcast to the join

# The contract's rules: (host and path, verdict).
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
HOT_URLS = 10_000  # urls that more than 1 in so many pages have are joined by broadcast; there can be no more of them
# Registered names under which the query's list has URLs.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    rest = F.regexp_extract(nonnull(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; '' without ://."""
    return F.regexp_extract(nonnull(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or blog. before it, path without .html and closing slash."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), F.regexp_replace(path, r"(?:\.html|/+)$", ""))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and 8-word mask of each key."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    masks = np.zeros((len(hashes), BLOCK_WORDS), np.uint64)
    with np.errstate(over="ignore"):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(len(hashes))
    for k in range(BITS_SET):
        bit = (mixed >> np.uint64(7 * k)) & np.uint64(511)
        np.bitwise_or.at(masks, (rows, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return block.astype(np.int64), masks


def build_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """Blocked Bloom filter of keys.h (xxhash64 of a key) as an array of (blocks, 8) words.

    Its size follows the number of keys up to MOST_BLOCKS. Tasks set bits in slices that are
    merged by slice; the driver gets the finished filter alone, at most 64 MB.
    """
    blocks = min(MOST_BLOCKS, max(1, 1 << math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY / (64 * BLOCK_WORDS) + 1))))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, masks = _bits(batch["h"].to_numpy(np.int64).view(np.uint64), blocks)
            for s in np.unique(at // SLICE_BLOCKS):
                part = held.setdefault(int(s), np.zeros((min(SLICE_BLOCKS, blocks), BLOCK_WORDS), np.uint64))
                here = at // SLICE_BLOCKS == s
                np.bitwise_or.at(part, at[here] % SLICE_BLOCKS, masks[here])
        if held:
            yield pd.DataFrame({"slice": list(held), "bits": [v.tobytes() for v in held.values()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint64) for b in group["bits"]])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [bits.tobytes()]})

    schema = "slice int, bits binary"
    parts = keys.select("h").mapInPandas(set_bits, schema).groupBy("slice").applyInPandas(merge, schema).collect()
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    for slice_, bits in parts:
        part = np.frombuffer(bits, np.uint64).reshape(-1, BLOCK_WORDS)
        out[slice_ * SLICE_BLOCKS : slice_ * SLICE_BLOCKS + len(part)] = part
    return out


def maybe_listed(candidates: DataFrame, bloom: np.ndarray) -> DataFrame:
    """Rows of candidates whose h may be among the keys: no listed key is dropped."""
    shared = candidates.sparkSession.sparkContext.broadcast(bloom)

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for batch in batches:
            at, masks = _bits(batch["h"].to_numpy(np.int64).view(np.uint64), len(words))
            yield batch[((words[at] & masks) == masks).all(axis=1)]

    return candidates.mapInPandas(passing, candidates.schema)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (boolean) for every row of pages.

    listed: a table with the column `key` of canonical URLs; repeated and null keys count once
    and never. A page's candidates are its canonical URL and, for each rule-path length, each
    host suffix with so much of its path. The filter passes those that may be listed, and an
    exact join on the key itself drops what it passed wrongly. The longest rule wins (a tie:
    the longer host); without a rule a listed page is blocked and any other allowed. A null or
    odd url has an empty host and path, and is allowed. Urls are read whole whatever their
    length. Repeated pages are judged each, pages without id too. Columns other than page_id and
    url are not read. An empty table gives an empty table, an empty list blocks by rules alone.
    """
    spark = pages.sparkSession
    urls = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = spark.createDataFrame([(r, v) for r, v in rules], "key string, rule_verdict string")
    keys = pick(listed, "key").filter("key IS NOT NULL").select(F.concat(F.lit("u:"), "key").alias("key")).distinct()
    rules_keys = rows.select(F.concat(F.lit("r:"), "key").alias("key"))
    entries = keys.unionByName(rules_keys).withColumn("h", F.xxhash64("key"))
    bloom = build_filter(entries, keys.count() + len(rules))

    lengths = sorted({len(r) - r.index("/") for r, _ in rules if "/" in r} | ({0} if any("/" not in r for r, _ in rules) else set()))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit("r:"), s, p))))
    own = F.array(F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))))
    # Equal (host, path) are judged once; hosts and paths are few against pages.
    counted = stored(urls.filter("host <> '' OR path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    distinct = counted.select("host", "path")
    candidates = distinct.select("host", "path", F.explode(F.array_distinct(F.concat(own, rule_keys))).alias("key")).withColumn("h", F.xxhash64("key"))
    hits = maybe_listed(candidates, bloom).select("host", "path", "key")
    ruled = hits.filter(F.col("key").startswith("r:")).withColumn("key", F.substring("key", 3, 1 << 30))
    small = F.broadcast(rows) if len(rules) <= EXACT_RULES else rows
    by_rule = ruled.join(small, "key").select(
        "host", "path", F.struct(F.length("key").alias("n"), F.locate("/", F.col("key")).alias("host_n"), F.col("key").alias("rule"), "rule_verdict").alias("rule"), F.lit(False).alias("listed")
    )
    by_list = hits.filter(F.col("key").startswith("u:")).join(keys, "key", "left_semi").select("host", "path", F.lit(None).cast(by_rule.schema["rule"].dataType).alias("rule"), F.lit(True).alias("listed"))
    judged = by_rule.unionByName(by_list).groupBy("host", "path").agg(F.max("rule").alias("best"), F.max("listed").alias("listed"))
    # Pages without host and path need no join, and urls that very many pages have none by shuffle.
    most = max(HOT_URLS, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_URLS)
    judged = stored(distinct.join(judged, ["host", "path"], "left"))
    hot = counted.filter(F.col("n") > most).select("host", "path")
    none = [F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("best", "listed")]
    parts = [
        urls.filter("host = '' AND path = ''").select("page_id", "host", "path", *none),
        urls.join(F.broadcast(hot), ["host", "path"], "left_anti").join(judged, ["host", "path"]).select("page_id", "host", "path", "best", "listed"),
        urls.join(F.broadcast(judged.join(F.broadcast(hot), ["host", "path"], "left_semi")), ["host", "path"]).select("page_id", "host", "path", "best", "listed"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    is_listed = F.coalesce("listed", F.lit(False))
    return out.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        is_listed.alias("listed"),
    )


def listed_urls(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's list of canonical URLs: key.

    A stand-in for the lists that are published: the pages of LISTED_NAMES that a crawl has
    seen, in any spelling, and for every toxic document an address under each of these names,
    few of which any page has.
    """
    seen = pages.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    seen = seen.filter(F.col("key").rlike(rf"^(?:[^/]*\.)?(?:{'|'.join(LISTED_NAMES)})\.example\.[a-z]+/"))
    toxic = documents.select("doc_id", "lang").join(labels.filter("toxic = 1").select("doc_id"), "doc_id")
    hosts = F.explode(F.array(*[F.lit(f"{n}.example.net/") for n in LISTED_NAMES]))
    reported = toxic.select("doc_id", "lang", hosts.alias("host")).select(F.concat("host", "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("key"))
    return seen.unionByName(reported)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = listed_urls(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in RULES)
SQL = {
    "op9_url_filter": rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^(?:www|m|blog)\.', '') || regexp_replace(path, '(?:\.html|/+)$', '') AS name FROM parts
), listed AS (
  SELECT name FROM named WHERE regexp_matches(name, '^([^/]*\.)?({'|'.join(LISTED_NAMES)})\.example\.[a-z]+/')
  UNION SELECT h || '.example.net/' || lang || '/' || doc_id FROM documents JOIN labels USING (doc_id), (SELECT unnest({list(LISTED_NAMES)}) AS h) WHERE toxic = 1
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {_RULES}
)
SELECT page_id, host, path, arg_max(rule_host || rule_path, len(rule_host) + len(rule_path)) AS rule,
  coalesce(arg_max(rule_verdict, len(rule_host) + len(rule_path)),
           CASE WHEN any_value(name) IN (SELECT name FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path"""
}
