"""Session settings, table access and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Settings whose absence would change results: dates are read in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name first and else by any case.

    Extra columns, also such as differ in case only, can therefore never clash
    with what an operator computes. A column that is missing raises KeyError.
    """
    held = df.columns
    places = []
    for name in names:
        same = [i for i, c in enumerate(held) if c == name] or [i for i, c in enumerate(held) if c.lower() == name.lower()]
        if not same:
            raise KeyError(f"no column {name!r} among {held}")
        places.append(same[0])
    plain = df.toDF(*[f"_c{i}" for i in range(len(held))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one in the warehouse.

    Off a local master a warehouse in a local folder is refused: executors would not see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_intermediate"


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Python workers get at most n rows in a batch in the jobs that run inside: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Python workers get batches of at most so many MB, unless the session says how large: 10,000 whole texts or files would fill them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(mb << 20))


def stored(df: DataFrame, partition_by: list[str] | None = None, row_group_mb: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends at files that outlive executors.

    row_group_mb: size of the files' row groups, which tasks hold while they write and read; smaller for large binary columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write if row_group_mb is None else df.write.option("parquet.block.size", row_group_mb << 20)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files make fewer parts, before work that is slow per row. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: filters and steps above read what a generator gave, where they would repeat a plain column's expression."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing needs any more: it does when the driver's JVM collects its garbage, which may be late."""
    spark._jvm.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that stored() made, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        at = file.find("/t-")
        if at < 0:
            continue
        folder = file[: at + 3 + 32]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":")[-1].rstrip("/").split("/")[-1] in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nonnull(col: str | Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
