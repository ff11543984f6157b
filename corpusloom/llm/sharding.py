"""Weighted rendezvous sharding of records by a stable key (native)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import pick, stored, table

DRAWS_PER_DIGEST = 4  # an md5 digest holds four draws of 32 bits
ROWS_PER_SLOT_GROUP = 20_000


def _draws(key: Column, blocks: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(b)))) for b in range(blocks)]


def rendezvous(digests: Sequence[Column], weights: Sequence[float]) -> Column:
    """Number of the shard with the least -ln(u)/weight; the lower number at a tie.

    u is a draw in (0, 1) that depends on the key and the shard's number alone, so that a
    shard that is added wins rows only for itself, and a shard's share follows its weight.
    """
    bids = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        block, part = divmod(shard, DRAWS_PER_DIGEST)
        number = F.conv(F.substring(digests[block], 1 + 8 * part, 8), 16, 10).cast("double")
        cost = -F.log((number + 0.5) / F.lit(float(2**32))) / F.lit(float(weight))
        bids.append(F.struct(cost.alias("cost"), F.lit(shard).alias("shard")))
    if not bids:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*bids)).getField("shard")


def assign(rows: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Add `shard` (int) and, with grown_weights, `grown_shard`: the shard under those weights.

    A null key is a key of its own. Rows of equal keys share a shard. Narrow: no shuffle.
    """
    most = max(len(weights), len(grown_weights or ()))
    blocks = -(-most // DRAWS_PER_DIGEST)
    names = [f"_digest{b}" for b in range(blocks)]
    with_digests = rows.withColumns(dict(zip(names, _draws(F.col(key), blocks), strict=True)))
    cols: Mapping[str, Column] = {"shard": rendezvous([F.col(n) for n in names], weights)}
    if grown_weights is not None:
        cols = {**cols, "grown_shard": rendezvous([F.col(n) for n in names], grown_weights)}
    return with_digests.withColumns(cols).drop(*names)


def number_slots(rows: DataFrame) -> DataFrame:
    """rows, written, with `slot`: 0, 1, 2, ... within each shard, without bringing a shard or a key to one task.

    Rows are dealt into groups by where they were written, at most ROWS_PER_SLOT_GROUP of a
    written part each, and numbered within (shard, group); the groups' counts, summed along each
    shard, give where each group starts.
    """
    written = stored(rows.withColumn("_id", F.monotonically_increasing_id()))
    in_part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    grouped = written.withColumn("_group", F.struct(F.shiftright("_id", 33).alias("part"), F.floor(in_part / ROWS_PER_SLOT_GROUP).alias("piece")))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        grouped.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    numbered = grouped.withColumn("_in_group", F.row_number().over(Window.partitionBy("shard", "_group").orderBy("_id")) - 1)
    joined = numbered.join(starts, ["shard", "_group"])
    return joined.withColumn("slot", (F.col("_start") + F.col("_in_group")).cast("long")).drop("_id", "_group", "_start", "_in_group")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents to `shards` equal shards by doc_id: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the whole text plus 8 (null text: 8, checksum of no bytes). law is
    'key'. Rows without doc_id share a shard, as do repeated rows, and have a slot each; the
    order of slots is left open. Bids that are equal go to the lower shard. Columns other than
    doc_id and text are not read. An empty table gives an empty table.
    """
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = number_slots(assign(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# No SQL: DuckDB has neither crc32 nor an order of rows to number slots by; tests compare with plain Python.
def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))

