"""Change streams: replay, subscription, expiry, heartbeats and micro-batch merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumenspar.operators.accounting import latest
from lumenspar.work import remove


def read_log(spark: SparkSession, path: str, schema: str, batch_files: int = 16) -> DataFrame:
    """The change log as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(path)


def replicate(log: DataFrame, after: int = 0) -> DataFrame:
    """Entries beyond a clock; of a stream or a table."""
    return log.where(F.col("clock") > after)


def subscribe(events: DataFrame, types: Sequence[str] = (), collection: str | None = None) -> DataFrame:
    """Events of some types (none given: all) and one collection (none given: all)."""
    out = events if not types else events.where(F.col("type").isin(list(types)))
    return out if collection is None else out.where(F.col("collection") == collection)


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Rows that outlived ttl seconds since ts; rows without a ttl never do."""
    return rows.where(F.coalesce(F.col("ts") + F.make_dt_interval(secs=F.col("ttl")) <= now, F.lit(False)))


def alive(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(~F.coalesce(F.col("ts") + F.make_dt_interval(secs=F.col("ttl")) <= now, F.lit(False)))


def tick(log: DataFrame) -> DataFrame:
    """The next clock of a log."""
    return log.agg((F.coalesce(F.max("clock"), F.lit(0)) + 1).alias("clock"))


def merge_clocks(mine: Column, theirs: Column) -> Column:
    return F.greatest(mine, theirs) + 1


def merge_into(path: str, key: str = "id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key under ``path``; ``merged`` reads it.

    Keys lie in buckets by hash, and a batch rewrites only the buckets that it touches, as
    version ``epoch`` of these; a bucket's newest version holds. A repeated batch starts from
    the versions before its own and rewrites the same one, so delivery twice does no harm.
    Versions that no repeat can need any more are removed.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.b for r in new.select("b").distinct().collect()]  # no more than there are buckets
        if not touched:
            return
        if epoch:
            new = new.unionByName(_newest(spark, path, batch.schema, epoch).where(F.col("b").isin(touched)).select(*batch.columns, "b"))
        merged_ = latest(new.select(*batch.columns), key).withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged_.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/v={epoch}")
        for v, b in _superseded(spark, path, batch.schema, epoch):
            remove(spark, f"{path}/v={v}/b={b}")

    return run


def _versions(spark: SparkSession, path: str, schema: StructType, before: int) -> DataFrame:
    """Rows of all versions before an epoch, with b and v."""
    full = StructType([*schema.fields, StructField("v", IntegerType()), StructField("b", IntegerType())])
    return spark.read.schema(full).parquet(path).where(F.col("v") < before)


def _newest(spark: SparkSession, path: str, schema: StructType, before: int) -> DataFrame:
    rows = _versions(spark, path, schema, before)
    newest = rows.groupBy("b").agg(F.max("v").alias("v"))  # a row a bucket, from the folders' names
    return rows.join(F.broadcast(newest), ["b", "v"])


def _superseded(spark: SparkSession, path: str, schema: StructType, epoch: int) -> list[tuple[int, int]]:
    """Versions older than the one that a repeat of this epoch would start from."""
    there = _versions(spark, path, schema, epoch).select("b", "v").distinct()
    return [(v, r.b) for r in there.groupBy("b").agg(F.array_sort(F.collect_set("v")).alias("vs")).collect() for v in r.vs[:-1]]


def merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that ``merge_into`` keeps under a path."""
    kept = spark.createDataFrame([], schema)
    return _newest(spark, path, kept.schema, 2**31 - 1).select(*kept.columns)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and type, for streams and tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there, batch by batch."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def emit_trajectory(points: DataFrame, path: str, metric: str = "l2") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that searches for each row(id, vector) and emits an event with the top hit.

    Events (type, query_id, id, x, y) of a batch make one folder, which a repeated batch rewrites.
    """
    from lumenspar.operators.search import batch_search

    def run(batch: DataFrame, epoch: int) -> None:
        found = batch_search(points, batch, 1, metric).select("query_id", "id")
        place = points.select("id", F.element_at("vector", 1).alias("x"), F.element_at("vector", 2).alias("y"))
        found.join(place, "id").select(F.lit("trajectory").alias("type"), "query_id", "id", "x", "y").write.mode("overwrite").parquet(f"{path}/{epoch}")

    return run


def monitor(events: DataFrame) -> DataFrame:
    """Running counts, sums and last times by type, of a stream or a table."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))


def replace_at(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for complete results: a version each, the one before the last removed."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={epoch}")
        if epoch > 1:
            remove(batch.sparkSession, f"{path}/v={epoch - 2}")

    return run


def last_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version under a path."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{path}/v={newest}")
