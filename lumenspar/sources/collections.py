"""Collections as Parquet logs in a folder: ingestion, upserts, deletes, snapshots, scans.

A collection is an append-only log of rows (clock, seq, op, id, vector, metadata); what is
live is the last row of each id that is not a delete. A batch shares a clock, and its rows
have their places in it as ``seq``, so of several rows of an id the last holds. Payloads
lie in files of their own and are joined after a limit.

The log lies in numbered folders; the one of the largest number that is complete is the
log. A rewrite writes the next one and only then removes the old, so a crash leaves one
or the other. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.functions.distance import valid
from lumenspar.functions.vectors import mean_vector, normalize
from lumenspar.operators.accounting import latest
from lumenspar.spec import CollectionSpec
from lumenspar.work import remove

LOG = "clock long, seq long, op string, id long, vector array<double>, metadata map<string,string>"
DURABILITY = ("strict", "batch", "async")
PAYLOADS = "clock long, seq long, id long, payload binary"


class Catalog:
    """Named collections under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{name}/meta")
        return fs.exists(p)

    def create(self, spec: CollectionSpec) -> Collection:
        if self.exists(spec.name):
            raise ValueError(f"collection {spec.name} exists")
        self.spark.createDataFrame([(spec.to_json(),)], "value string").coalesce(1).write.text(f"{self.root}/{spec.name}/meta")
        self.spark.createDataFrame([], LOG).write.parquet(f"{self.root}/{spec.name}/log-0")
        self.spark.createDataFrame([], PAYLOADS).write.parquet(f"{self.root}/{spec.name}/payloads")
        return self.get(spec.name)

    def get(self, name: str) -> Collection:
        if not self.exists(name):
            raise KeyError(name)
        text = self.spark.read.text(f"{self.root}/{name}/meta").first().value
        return Collection(self.spark, f"{self.root}/{name}", CollectionSpec.from_json(text))

    def delete(self, name: str) -> None:
        if not self.exists(name):
            raise KeyError(name)
        remove(self.spark, f"{self.root}/{name}")

    def list(self, tenant: str | None = None) -> list[str]:
        fs, p = self._fs(self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
        return [n for n in names if tenant is None or n.startswith(tenant + "_")]


class Collection:
    def __init__(self, spark: SparkSession, path: str, spec: CollectionSpec):
        self.spark, self.path, self.spec = spark, path, spec
        self._frozen: DataFrame | None = None
        self._held: list[DataFrame] = []
        self._ticks = 0
        self._writer: Future | None = None

    def _version(self) -> int:
        """The largest number of a complete log folder."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max(int(n[4:]) for n in names if n.startswith("log-") and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def log(self) -> DataFrame:
        """The log as written, and what this handle still holds back."""
        out = self.spark.read.schema(LOG).parquet(f"{self.path}/log-{self._version()}")
        for rows in self._held:
            out = out.unionByName(rows)
        return out

    def clock(self) -> int:
        """The largest clock so far; 0 for an empty log."""
        if self._held:
            return self._ticks
        return self.log().agg(F.max("clock").alias("c")).first().c or 0

    def insert(self, rows: DataFrame, strict: bool = True, durability: str = "strict") -> int:
        """Appends rows(id, vector, metadata[, payload]); the batch shares one tick of the clock, the last row of an id holds.

        Longer vectors are cut, shorter or invalid ones an error (or left out). With
        ``durability`` strict the rows are written before the call returns; with batch they
        are held, seen through this handle alone, until ``commit``; with async they are
        written by a thread that ``commit`` waits for. Held rows have to come from a source
        that gives them again, as nothing of them is copied.
        """
        if durability not in DURABILITY:
            raise ValueError(f"durability is one of {', '.join(DURABILITY)}")
        dim, tick = self.spec.dimension, self.clock() + 1
        vector = F.slice(F.col("vector").cast("array<double>"), 1, dim)
        vector = normalize(vector) if self.spec.metric == "cosine" else vector
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
        ready = rows.withColumn("vector", vector)
        good = (F.size("vector") == dim) & valid(F.col("vector"), self.spec.metric)
        if strict:
            bad = F.raise_error(F.concat(F.lit("invalid vector for id "), F.col("id").cast("string")))
            ready = ready.withColumn("vector", F.when(good, F.col("vector")).otherwise(bad.cast("array<double>")))
        else:
            ready = ready.where(good)
        meta = F.col("metadata") if "metadata" in rows.columns else F.expr("cast(map() as map<string,string>)")
        logged = ready.select(F.lit(tick).cast("long").alias("clock"), "seq", F.lit("insert").alias("op"), F.col("id").cast("long").alias("id"), "vector", meta.alias("metadata"))
        self._ticks = tick
        if durability == "strict":
            self.commit()
            self._append(logged)
        elif durability == "batch":
            self._held.append(logged)
        else:
            self.commit()
            pool = ThreadPoolExecutor(1)
            self._writer = pool.submit(self._append, logged)
            pool.shutdown(wait=False)
        if "payload" in rows.columns:
            stored = rows.where(F.col("payload").isNotNull()).select(F.lit(tick).cast("long").alias("clock"), "seq", F.col("id").cast("long"), F.col("payload").cast("binary"))
            stored.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/payloads")
        return tick

    def commit(self) -> None:
        """Writes what is held in one append, and waits for a write that is under way."""
        if self._writer:
            self._writer.result()
            self._writer = None
        if held := self._held:
            rows = held[0]
            for more in held[1:]:
                rows = rows.unionByName(more)
            self._append(rows)
            self._held = []

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/log-{self._version()}")

    def delete(self, ids: DataFrame) -> int:
        self.commit()
        tick = self.clock() + 1
        none = [F.expr(f"cast(null as {kind})").alias(name) for name, kind in (("vector", "array<double>"), ("metadata", "map<string,string>"))]
        self._append(ids.select(F.lit(tick).cast("long").alias("clock"), F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("op"), F.col("id").cast("long"), *none))
        return tick

    def live(self) -> DataFrame:
        """The points as they stand: last write wins, deleted ids are gone."""
        if self._frozen is not None:
            return self._frozen
        return latest(self.log(), "id", "clock", "seq").where("op = 'insert'").select("id", "vector", "metadata", "clock")

    def freeze(self) -> None:
        """Keeps the live points in executor memory until ``unfreeze``."""
        self._frozen = self.live().persist()

    def unfreeze(self) -> None:
        if self._frozen is not None:
            self._frozen.unpersist()
            self._frozen = None

    def update_payload(self, patch: DataFrame) -> int:
        """Merges patch(id, metadata) key by key into live points; an id that is not live is an error."""
        now = self.live().withColumnRenamed("metadata", "old")
        both = patch.select("id", F.col("metadata").alias("new")).join(now, "id", "left")
        missing = F.raise_error(F.concat(F.lit("no such id "), F.col("id").cast("string")))
        kept = F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys("new"), k))
        merged = both.select("id", F.when(F.col("vector").isNull(), missing.cast("array<double>")).otherwise(F.col("vector")).alias("vector"), F.map_concat(kept, F.col("new")).alias("metadata"))
        return self.insert(merged)

    def payloads(self, ids: DataFrame | None = None) -> DataFrame:
        rows = latest(self.spark.read.schema(PAYLOADS).parquet(f"{self.path}/payloads"), "id", "clock", "seq")
        out = rows.join(self.live().select("id"), "id", "left_semi").select("id", "payload")
        return out if ids is None else out.join(ids.select("id"), "id", "left_semi")

    def stats(self) -> DataFrame:
        """One row: live points, log rows, last clock, bytes per vector in the storage mode."""
        from lumenspar.functions.quantize import bytes_per_vector

        live = self.live().agg(F.count(F.lit(1)).alias("points"))
        log = self.log().agg(F.count(F.lit(1)).alias("log_rows"), F.max("clock").alias("clock"))
        return live.join(log).withColumn("vector_bytes", F.lit(bytes_per_vector(self.spec.mode, self.spec.dimension)))

    def snapshot(self, path: str) -> None:
        self.live().write.mode("overwrite").parquet(path)

    def restore(self, path: str) -> int:
        return self.insert(self.spark.read.parquet(path).select("id", "vector", "metadata"))

    def vacuum(self, predicate: Column | None = None) -> None:
        """Rewrites the log as the live points less those that match; an index is to be rebuilt after it."""
        self.commit()
        old = self._version()
        keep = self.live() if predicate is None else self.live().where(~predicate)
        ready = keep.select("clock", F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), "id", "vector", "metadata")
        # the new folder counts once it is complete
        ready.write.mode("overwrite").parquet(f"{self.path}/log-{old + 1}")
        remove(self.spark, f"{self.path}/log-{old}")

    def flush(self, chunks: int, to: str | None = None) -> DataFrame:
        """Live points written by chunk of ids; returns (chunk, centroid, n) for routing.

        ``to`` is a folder of any store that Spark reaches; without it the collection's own.
        """
        live = self.live().withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        live.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(to or f"{self.path}/chunks")
        stored = self.spark.read.parquet(to or f"{self.path}/chunks")
        return stored.groupBy("chunk").agg(mean_vector(F.col("vector"), self.spec.dimension).alias("centroid"), F.count(F.lit(1)).alias("n"))


def read_chunks(spark: SparkSession, path: str, chunks: Sequence[int]) -> DataFrame:
    """The points of some chunks; files of the others are not touched, and of these only the columns asked for."""
    return spark.read.parquet(path).where(F.col("chunk").isin(list(chunks)))


def changed(old: DataFrame, new: DataFrame, delta: float) -> DataFrame:
    """(id, reindex): whether a rewrite moves the vector beyond delta or alters metadata."""
    from lumenspar.functions.distance import l2

    both = old.select("id", F.col("vector").alias("v0"), F.col("metadata").alias("m0")).join(new.select("id", F.col("vector").alias("v1"), F.col("metadata").alias("m1")), "id")
    entries = lambda m: F.array_sort(F.map_entries(m))
    return both.select("id", ((l2(F.col("v0"), F.col("v1")) > delta * delta) | ~entries("m0").eqNullSafe(entries("m1"))).alias("reindex"))


def get_points(points: DataFrame, ids: Sequence[int]) -> DataFrame:
    return points.where(F.col("id").isin(list(ids)))


def peek(points: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest ids first; at most 250 rows."""
    return points.orderBy(F.desc("id")).offset(offset).limit(min(limit, 250))


def scroll(points: DataFrame, where: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows in id order, filtered and then skipped."""
    rows = points if where is None else points.where(where)
    return rows.orderBy("id").offset(offset).limit(limit)


def scroll_unfiltered_offset(points: DataFrame, where: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows in id order, skipped and then filtered, as the older interface pages."""
    return points.orderBy("id").offset(offset).where(where).orderBy("id").limit(limit)


def count(points: DataFrame, where: Column | None = None) -> DataFrame:
    rows = points if where is None else points.where(where)
    return rows.agg(F.count(F.lit(1)).alias("n"))
