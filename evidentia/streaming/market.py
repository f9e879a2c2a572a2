"""Prices as a stream: duplicates within the watermark are dropped, and each micro-batch is folded into the stored snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from evidentia.operators.changes import upsert

KEYS = ["product_id", "date", "source"]
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def price_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as events; files that were read are remembered in the query's checkpoint."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(path)


def snapshots(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each event, once, with its day; events later than the watermark are left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("product_id"), "ts", F.to_date("ts").alias("date"), F.col("event_type").alias("source"), F.col("value").alias("price"))


def windowed_prices(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and highest price of each kind of event in each window; a window is given out when its watermark has passed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "avg_value", "max_value")
    )


def fold_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key at `path`/current-N; a repeated batch writes the same folder again, so it does nothing new.

    Each batch reads the folder of the batch before it, so a lost driver resumes from the last folder that was finished.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.desc("ts"), F.desc("snapshot_id")]
        fresh = batch
        if number > 0:
            stored = spark.read.schema(batch.schema).parquet(f"{path}/current-{number - 1}")
            both = upsert(stored, batch.unionByName(stored), KEYS, order)
        else:
            both = upsert(fresh.limit(0), fresh, KEYS, order)
        both.write.mode("overwrite").parquet(f"{path}/current-{number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of the stored table of which a batch rewrites those that it touches.
BUCKETS = 256


def current(spark: SparkSession, path: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The rows that fold_into_buckets() keeps: of each bucket (of those in `only`) its last version (before a batch); None if there is none yet."""
    try:
        written = spark.read.schema("batch long, bucket int").parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if before is not None:
        written = written.where(F.col("batch") < before)
    if only is not None:
        written = written.where(F.col("bucket").isin(only))
    last = written.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row a bucket
    folders = [f"{path}/rows/batch={r['batch']}/bucket={r['bucket']}" for r in last]
    return spark.read.parquet(*folders) if folders else None


def _drop_superseded(spark: SparkSession, path: str, batch: int, touched: list[int]) -> None:
    """Of each touched bucket only the last two versions stay: readers that began before this batch still find theirs."""
    versions: dict[int, list[int]] = {}
    log = spark.read.schema("batch long, bucket int").parquet(f"{path}/log").where(F.col("bucket").isin(touched) & (F.col("batch") <= batch)).distinct()
    kept = Window.partitionBy("bucket").orderBy(F.desc("batch"))
    third = log.withColumn("n", F.row_number().over(kept)).where("n = 3")  # earlier ones went with earlier batches
    for r in third.collect():
        versions.setdefault(r["bucket"], []).append(r["batch"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for bucket, batches in versions.items():
        for number in batches:
            folder = hadoop(f"{path}/rows/batch={number}/bucket={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold_into_buckets(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Like fold_into(), for large tables: rows stand in buckets by product, and a batch writes new versions of the buckets that it touches only.

    A version is `path`/rows/batch=N/bucket=B, and `path`/log tells which there are. A repeated batch reads the versions before it and writes its own again, so it
    does nothing new; rows count once the log has their version.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            stored = current(spark, path, number, touched)
            old = fresh.limit(0) if stored is None else stored.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int"))
            both = upsert(old, fresh.unionByName(old), KEYS, [F.desc("ts"), F.desc("snapshot_id")])
            both.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
            log = spark.createDataFrame([(number, b) for b in touched], "batch long, bucket int")
            log.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/of={number}")
            _drop_superseded(spark, path, number, touched)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
