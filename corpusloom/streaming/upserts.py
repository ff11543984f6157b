"""Incremental corpus upkeep with Structured Streaming; each job agrees with its batch operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import versions
from corpusloom.session import shared_dir

AS_VERSION = [f.split(":")[0] for f in versions.VERSION[7:-1].split(",")]
BUCKETS = 64  # of a state that upsert() keeps
RESOLVED = f"key string, current {versions.VERSION}, log {versions.LOG}, n_versions int, batch int"  # what a batch of upsert() writes


def open_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the parquet files under a path or glob, with the schema that they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _folder(spark: SparkSession, name: str, given: str | None) -> str:
    """Where a stream keeps its checkpoint and what belongs to it: the caller's folder, else a new one in the shared folder."""
    return given.rstrip("/") if given else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the batches whose output under a folder is complete, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path)]
    done = [p.getName() for p in names if p.getName().startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(prefix) :]) for n in done)


def _places(spark: SparkSession, states: str, before: int) -> dict[int, list[tuple[int, int]]]:
    """Each bucket's parts of the index below a number, as (batch, rows), the oldest first."""
    done = [n for n in _finished(spark, states, "places-") if n < before]
    if not done:
        return {}
    rows = spark.read.schema("bucket int, parts array<struct<batch:int,rows:long>>").parquet(f"{states}/places-{done[-1]}").collect()
    return {r["bucket"]: [tuple(p) for p in r["parts"]] for r in rows}


def _index(spark: SparkSession, states: str, parts: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """key and batch of some buckets' parts of the index; a key's largest batch is the one that its current version lies under."""
    paths = [f"{states}/index-{n}/bucket={b}" for b, held in sorted(parts.items()) for n, _ in held]
    empty = spark.createDataFrame([], "key string, batch int")
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def _held(spark: SparkSession, states: str, batches: Iterable[int], buckets: Iterable[int]) -> DataFrame:
    """What batches have resolved of the keys in some buckets; only their files are read."""
    any_of = lambda xs: "{" + ",".join(map(str, sorted(xs))) + "}"
    return spark.read.schema(RESOLVED).parquet(f"{states}/batch-{any_of(batches)}/bucket={any_of(buckets)}")


def _merged(held: list[tuple[int, int]], rows: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Parts of a bucket's index that stay and those that new rows take in, and the rows then: each part that stays has more than twice the rows of the next."""
    stay, taken = list(held), []
    while stay and stay[-1][1] <= 2 * rows:
        taken.append(stay.pop())
        rows += taken[-1][1]
    return stay, taken, rows


def upsert(stream: DataFrame, to_versions: Callable[[DataFrame], DataFrame], checkpoint: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The current versions and the log after all that a stream holds now.

    Keys are dealt to buckets by their hash. Each batch folds its versions onto the current ones
    of the same keys and writes what comes of it once, under its own number beside the checkpoint,
    with the numbers of the batches whose versions it replaces. An index tells under which batch a
    key's current version lies; it holds no contents, and its parts are merged so that each has
    more than twice the rows of the next: a batch reads few files of its buckets, and a row of the
    index is written again as often as the logarithm of the batches. A batch that runs again after
    a failure reads what lies before it and writes the same. With the same checkpoint, and the same
    number of buckets, a later call goes on where the last one ended, also without new rows. A late
    or older version loses by the same rules as in the batch operator, and shows in the log as
    skipped.
    """
    spark = stream.sparkSession
    root = _folder(spark, "upsert", checkpoint)
    states = f"{root}/versions"
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        given = f"{states}/given-{number}"
        to_versions(batch).select("key", *AS_VERSION).write.mode("overwrite").parquet(given)
        new = spark.read.parquet(given)
        keys = new.select("key").distinct()
        sizes = {r["bucket"]: r["count"] for r in keys.groupBy(bucket.alias("bucket")).count().collect()}  # as many as there are buckets at most
        places = _places(spark, states, number)
        before = _index(spark, states, {b: places[b] for b in sizes if b in places})
        before.join(keys, "key", "left_semi").groupBy("key").agg(F.max("batch").alias("batch")).write.mode("overwrite").parquet(f"{states}/replaced-{number}")
        replaced = spark.read.schema(before.schema).parquet(f"{states}/replaced-{number}")
        met = replaced.agg(F.collect_set("batch").alias("batches"), F.collect_set(bucket).alias("buckets")).first()
        if met["batches"]:
            # The current version stands first in the fold: its seq is below any other.
            known = _held(spark, states, met["batches"], met["buckets"]).join(replaced, ["key", "batch"], "left_semi").select("key", "current.*").withColumn("seq", F.lit(-1))
            new = known.select("key", *AS_VERSION).unionByName(new)
        dealt = versions.resolve(new.withColumn("bucket", bucket).repartition("bucket"), "key", "bucket")
        dealt.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("bucket").parquet(f"{states}/batch-{number}")
        merged = {b: _merged(places.get(b, []), n) for b, n in sizes.items()}
        index = keys.withColumn("batch", F.lit(number)).unionByName(_index(spark, states, {b: taken for b, (_, taken, _) in merged.items()}))
        index.withColumn("bucket", bucket).repartition("bucket").groupBy("bucket", "key").agg(F.max("batch").alias("batch")).write.mode("overwrite").partitionBy("bucket").parquet(f"{states}/index-{number}")
        now = places | {b: [*stay, (number, n)] for b, (stay, _, n) in merged.items()}
        spark.createDataFrame(sorted(now.items()), "bucket int, parts array<struct<batch:int,rows:long>>").coalesce(1).write.mode("overwrite").parquet(f"{states}/places-{number}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = _finished(spark, states, "places-")
    if not done or not _places(spark, states, done[-1] + 1):
        empty = spark.createDataFrame([], RESOLVED)
        return empty.select("key", "current"), versions.log_rows(empty)
    held = _held(spark, states, done, range(buckets))
    replaced = spark.read.schema("key string, batch int").parquet(*[f"{states}/replaced-{n}" for n in done])
    return held.join(replaced, ["key", "batch"], "left_anti").select("key", "current"), versions.log_rows(held)


def backfill(stream: DataFrame, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """What work gives for all rows that a stream holds now, batch by batch.

    A batch that fails stops the run; what came before it is kept beside the checkpoint, and the
    next call with the same checkpoint starts at that batch. No row is worked on twice once its
    batch is done.
    """
    spark = stream.sparkSession
    root = _folder(spark, "backfill", checkpoint)

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{root}/done/batch-{number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = _finished(spark, f"{root}/done", "batch-")
    return spark.read.parquet(*[f"{root}/done/batch-{n}" for n in done]) if done else work(spark.createDataFrame([], stream.schema))


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days", checkpoint: str | None = None) -> DataFrame:
    """The first row of each key within the watermark, as a table of what a stream holds now."""
    spark = stream.sparkSession
    root = _folder(spark, "dedupe", checkpoint)
    once = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    query = once.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{root}/out")


def windowed(stream: DataFrame, time: str, width: str, by: str, delay: str = "1 hour", checkpoint: str | None = None) -> DataFrame:
    """Counts by window and group of what a stream holds now.

    Batches write the windows that they changed; of a window the largest count is the last. A
    window is forgotten once the watermark passes its end, so that the state does not grow with
    the stream; rows that come later than `delay` then count no more.
    """
    spark = stream.sparkSession
    root = _folder(spark, "window", checkpoint)
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(F.col("window.start").alias("start"), by, "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch-{number}")

    query = flat.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = _finished(spark, f"{root}/out", "batch-")
    shown = spark.read.schema(flat.schema).parquet(*[f"{root}/out/batch-{n}" for n in done]) if done else spark.createDataFrame([], flat.schema)
    return shown.groupBy("start", by).agg(F.max("n").alias("n"))
