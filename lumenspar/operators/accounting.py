"""Tenancy, metering, energy accounting, retries of storage, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1024.0**3
MONTH = 30 * 24 * 3600.0
WATTS_PER_GIB, CO2_KG_PER_KWH = 3.0, 0.4


def tenant_collection(tenant: Column, name: Column) -> Column:
    return F.concat_ws("_", tenant, name)


def collections_of(rows: DataFrame, tenant: str) -> DataFrame:
    return rows.where(F.col("collection").startswith(tenant + "_")).select(F.substring("collection", len(tenant) + 2, 1 << 20).alias("name")).distinct()


def usage_report(rows: DataFrame) -> DataFrame:
    """Per tenant: collections, rows and bytes of rows(tenant, collection, bytes)."""
    return rows.groupBy("tenant").agg(F.countDistinct("collection").alias("collections"), F.count(F.lit(1)).alias("points"), F.sum("bytes").alias("bytes"))


def metering(events: DataFrame, price_micro_usd: float = 1_000_000.0) -> DataFrame:
    """Per tenant: inserts at 1, searches at 10 micro-dollars, and storage rent by GiB month.

    ``events(tenant, kind, bytes, seconds)``; tenants with nothing to bill are left out.
    """
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    rent = F.sum(F.when(F.col("kind") == "storage", price_micro_usd * F.col("bytes") * F.col("seconds") / (GIB * MONTH)).otherwise(0.0))
    out = events.groupBy("tenant").agg(count("insert").alias("inserts"), count("search").alias("searches"), rent.alias("rent"))
    out = out.withColumn("cost", F.col("inserts") * 1.0 + F.col("searches") * 10.0 + F.col("rent"))
    return out.where((F.col("inserts") > 0) | (F.col("searches") > 0) | (F.col("rent") > 0))


def throttle(balances: DataFrame, now: Column, grace_days: int = 7) -> DataFrame:
    """balances(tenant, balance, exhausted_at): deadline of the grace and whether it has passed."""
    deadline = F.col("exhausted_at") + F.make_dt_interval(F.lit(grace_days))
    return balances.select("tenant", F.when(F.col("balance") <= 0, deadline).alias("deadline"), F.coalesce((F.col("balance") <= 0) & (now > deadline), F.lit(False)).alias("throttled"))


def eco(collections: DataFrame, bytes_per_vector: Column) -> DataFrame:
    """RAM saved against flat 32-bit vectors, the tier it earns, energy and CO2 of an hour."""
    out = collections.withColumns({"baseline": F.col("n") * F.col("full_dim") * 4, "actual": F.col("n") * bytes_per_vector})
    saved = F.greatest(F.col("baseline") - F.col("actual"), F.lit(0))
    ratio = F.when(F.col("baseline") > 0, saved / F.col("baseline")).otherwise(0.0)
    tier = F.when(ratio > 0.75, "platinum").when(ratio > 0.5, "gold").when(ratio > 0.3, "silver").when(ratio > 0.1, "bronze").otherwise("none")
    wh = saved / GIB * WATTS_PER_GIB
    return out.withColumns({"saved": saved, "ratio": ratio, "tier": tier, "wh": wh, "co2_kg": wh / 1000 * CO2_KG_PER_KWH})


RANGES = {"24h": 86_400, "30d": 30 * 86_400, "365d": 365 * 86_400, "all": None}


def esg_report(records: DataFrame, now: int, span: str = "all") -> DataFrame:
    """Sums over records(ts, saved_bytes, wh, co2_kg, ratio) of a span, last ratio, and a signature."""
    rows = records if RANGES[span] is None else records.where(F.col("ts") >= now - RANGES[span])
    out = rows.agg(F.count(F.lit(1)).alias("records"), F.sum("wh").alias("wh"), F.sum("co2_kg").alias("co2_kg"), F.max_by("ratio", "ts").alias("ratio"))
    text = F.concat_ws("|", F.lit(span), "records", F.format_number("wh", 6), F.format_number("co2_kg", 6))
    return out.withColumn("signature", F.sha2(text, 256))


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: recall, MRR and NDCG at k of ranked(query_id, id, rank) against relevant(query_id, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi")
    return _quality(hits, relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), k)


def label_quality(ranked: DataFrame, queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """``retrieval_quality`` where the other points(id, label) of a query's label are relevant to queries(query_id, label).

    They are counted by label, so that a pair of query and relevant point is no row. Queries are points.
    """
    hits = ranked.where(F.col("rank") <= k).join(queries, "query_id").join(points, ["id", "label"], "left_semi")
    per_label = points.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    return _quality(hits, queries.join(F.broadcast(per_label), "label").where("n > 0").select("query_id", "n"), k)


def _quality(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Of hits(query_id, rank) and wanted(query_id, n), how many points are relevant."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    both = wanted.join(per, "query_id", "left").na.fill(0, ["found", "dcg"])
    return both.agg(
        F.avg(F.col("found") / F.col("n")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("dcg") / ideal).alias("ndcg"), F.count(F.lit(1)).alias("queries")
    )


def eviction(entries: DataFrame, capacity: int, policy: str = "lru") -> DataFrame:
    """entries(id, last_access, hits, expires) to evict: those over capacity, a tenth at least."""
    order = {"lru": "last_access", "lfu": "hits", "ttl": "expires"}[policy]
    over = entries.count() - capacity
    if over <= 0:
        return entries.limit(0).select("id")
    return entries.orderBy(order, "id").limit(max(over, -(-capacity // 10))).select("id")


def stale_peers(beats: DataFrame, now: Column, ttl_seconds: int = 30) -> DataFrame:
    """(peer, last_seen, stale) of beats(peer, ts)."""
    return beats.groupBy("peer").agg(F.max("ts").alias("last_seen")).withColumn("stale", now - F.col("last_seen") > F.make_dt_interval(secs=F.lit(ttl_seconds)))


def latest(log: DataFrame, key: str = "id", *clock: str) -> DataFrame:
    """The last row of each key by the clock columns (``clock`` if none is named), earlier ones first.

    The best row of a key is found map-side first, so a key with many writes is no hot spot.
    """
    order = F.struct(*(clock or ("clock",)))
    best = log.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*log.columns), order).alias("_row"))
    return best.select("_row.*")
