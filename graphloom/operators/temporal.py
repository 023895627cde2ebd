"""Versioned vertices: every state of a key with its interval, and questions about time.

Times are microseconds (bigint). A version lives in [created, expired); the current one has the
expiry NEVER.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scan import annotate_groups

#: Expiry of a version that is not closed.
NEVER = (1 << 63) - 1
#: Moments that are broadcast, at most.
MOMENTS_MOST = 1_000_000
#: Fixed value: how long a closed version is kept, in seconds.
RETAIN_SECONDS = 2_592_000


@dataclass(frozen=True)
class TemporalConfig:
    ttl_retain_seconds: int = RETAIN_SECONDS
    has_version: str = "hasVersion"
    smart_field: str | None = None
    exclude_collections: tuple[str, ...] = ()

    def applies(self, collection: str) -> bool:
        return collection not in self.exclude_collections


def proxy_in(collection: str) -> str:
    return f"{collection}ProxyIn"


def proxy_out(collection: str) -> str:
    return f"{collection}ProxyOut"


def _sharded(key: Column, config: TemporalConfig, df: DataFrame) -> Column:
    if config.smart_field and config.smart_field in df.columns:
        shard = F.col(f"`{config.smart_field}`").cast("string")
        return F.when(shard.isNotNull(), F.concat(shard, F.lit(":"), key)).otherwise(key)
    return key


def versions_from_log(log: DataFrame, config: TemporalConfig | None = None) -> DataFrame:
    """All versions of a log of changes (`_key`, `op`, `seq`, `ts`, document columns).

    Adds to the document `_key` ({key}-{version}, after the shard if there is one), `_proxy` (the
    key), `_version` (from 0, over the log's sequence), `created`, `expired` and `ttlExpireAt`
    (NULL while current). INSERT and REPLACE each start a version and close the one before; DELETE
    closes it; an INSERT after a DELETE goes on with the next version. A key that holds any share
    of the log is spread over tasks. Of changes with the same key and sequence one counts, the
    largest; NULL keys are left out.
    """
    config = config or TemporalConfig()
    fields = [c for c in log.columns if c not in ("_key", "op", "seq", "ts")]
    clean = log.where("_key is not null and op in ('INSERT', 'REPLACE', 'DELETE')")
    once = clean.groupBy("_key", "seq").agg(F.max(F.struct("op", "ts", *[F.col(f"`{c}`") for c in fields])).alias("r"))
    flat = once.select("_key", "seq", "r.op", F.col("r.ts").cast("bigint").alias("ts"), *[F.col(f"r.`{c}`").alias(c) for c in fields])
    stated = flat.withColumn("__state", F.when(F.col("op") == "DELETE", 0).otherwise(1).cast("bigint"))
    numbered = annotate_groups(stated, "_key", ["seq"], number="_version", counted="__state", lead={"ts": "__next"}).where("__state = 1")
    proxy = _sharded(F.col("_key"), config, numbered)
    expired = F.coalesce("__next", F.lit(NEVER))
    return numbered.select(
        F.concat_ws("-", proxy, F.col("_version").cast("string")).alias("_key"),
        proxy.alias("_proxy"),
        "_version",
        F.col("ts").alias("created"),
        expired.alias("expired"),
        F.when(F.col("__next").isNotNull(), F.floor(F.col("__next") / 1_000_000) + config.ttl_retain_seconds).alias("ttlExpireAt"),
        *[F.col(f"`{c}`") for c in fields if c not in ("_proxy", "_version", "created", "expired", "ttlExpireAt")],
    )


def proxies(versions: DataFrame) -> DataFrame:
    """The proxy vertices (`_key`), alike for both proxy collections: one per entity."""
    return versions.select(F.col("_proxy").alias("_key")).distinct()


def version_edges(versions: DataFrame, collection: str, config: TemporalConfig | None = None) -> DataFrame:
    """The two edges of each version: from its ProxyIn, and to its ProxyOut, with its interval."""
    config = config or TemporalConfig()
    version = F.concat(F.lit(f"{collection}/"), F.col("_key"))
    ends = F.array(
        F.struct(F.lit("in").alias("way"), F.concat(F.lit(f"{proxy_in(collection)}/"), F.col("_proxy")).alias("_from"), version.alias("_to")),
        F.struct(F.lit("out").alias("way"), version.alias("_from"), F.concat(F.lit(f"{proxy_out(collection)}/"), F.col("_proxy")).alias("_to")),
    )
    return versions.select("_key", "created", "expired", "ttlExpireAt", F.explode(ends).alias("e")).select(
        F.concat_ws("-", "_key", "e.way").alias("_key"), "e._from", "e._to", F.lit(config.has_version).alias("_label"), "created", "expired", "ttlExpireAt"
    )


def proxify(edges: DataFrame) -> DataFrame:
    """Topology edges between proxies: from the ProxyOut of the start to the ProxyIn of the end."""
    return edges.withColumn("_from", F.regexp_replace("_from", "^([^/]+)/", "$1ProxyOut/")).withColumn("_to", F.regexp_replace("_to", "^([^/]+)/", "$1ProxyIn/"))


def snapshot_at(versions: DataFrame, t: int) -> DataFrame:
    """Versions alive at t: created <= t < expired."""
    return versions.where((F.col("created") <= t) & (F.col("expired") > t))


def snapshots_at(versions: DataFrame, moments: DataFrame, t: str = "t", width: int = 86_400_000_000) -> DataFrame:
    """Versions alive at each of many moments: a row per version and moment.

    Up to MOMENTS_MOST different moments are broadcast in order, and each version finds its own by
    binary search, so that nothing is shuffled and no more rows come up than the result has. Beyond,
    versions and moments meet by bucket of `width` microseconds."""
    asked = moments.where(F.col(t).isNotNull()).select(F.col(t).cast("bigint").alias(t)).distinct()
    listed = [r[0] for r in asked.limit(MOMENTS_MOST + 1).collect()]
    if not listed:
        return versions.limit(0).withColumn(t, F.lit(None).cast("bigint"))
    if len(listed) > MOMENTS_MOST:
        return _bucketed_snapshots(versions, asked, t, width)
    known = versions.sparkSession.sparkContext.broadcast(np.array(sorted(listed), dtype=np.int64))

    @F.pandas_udf("array<bigint>")
    def alive(created: pd.Series, expired: pd.Series) -> pd.Series:
        times = known.value
        first, last = np.searchsorted(times, created.to_numpy(), "left"), np.searchsorted(times, expired.to_numpy(), "left")
        return pd.Series([times[a:b] for a, b in zip(first, last)], dtype=object)

    some = versions.where((F.col("created") <= max(listed)) & (F.col("expired") > min(listed)))
    return some.select("*", F.explode(alive("created", "expired")).alias(t))


def _bucketed_snapshots(versions: DataFrame, asked: DataFrame, t: str, width: int) -> DataFrame:
    """snapshots_at for any number of moments. A version enters the buckets that it shares with the
    first and last moment."""
    lo, hi = asked.agg(F.min(t), F.max(t)).first()
    spans = versions.where((F.col("created") <= hi) & (F.col("expired") > lo))
    first, last = F.floor(F.greatest("created", F.lit(lo)) / width), F.floor(F.least(F.col("expired") - 1, F.lit(hi)) / width)
    keyed = spans.withColumn("__b", F.explode(F.sequence(first, last)))
    return keyed.join(asked.withColumn("__b", F.floor(F.col(t) / width)), "__b").where((F.col("created") <= F.col(t)) & (F.col("expired") > F.col(t))).drop("__b")


def overlapping(versions: DataFrame, start: int, end: int) -> DataFrame:
    """Versions whose interval meets [start, end], both ends counted."""
    return versions.where((F.col("created") <= end) & (F.col("expired") >= start))


def changed_between(versions: DataFrame, after: int, until: int) -> DataFrame:
    """Versions created or expired in (after, until], with created_in and expired_in."""
    made = (F.col("created") > after) & (F.col("created") <= until)
    gone = (F.col("expired") > after) & (F.col("expired") <= until)
    return versions.where(made | gone).withColumn("created_in", made).withColumn("expired_in", gone)


def current(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("expired") >= NEVER)


def history(versions: DataFrame, edges: DataFrame, collection: str, proxy: str) -> DataFrame:
    """The versions of one entity, newest first, by the edges from its ProxyIn."""
    ours = edges.where(F.col("_from") == f"{proxy_in(collection)}/{proxy}").select(F.substring(F.col("_to"), F.lit(len(collection) + 2), F.length("_to")).alias("_key"))
    return versions.join(ours, "_key").orderBy(F.col("_version").desc())


def aged(versions: DataFrame, now_seconds: int) -> DataFrame:
    """Versions that the retention still keeps at a time."""
    return versions.where(F.col("ttlExpireAt").isNull() | (F.col("ttlExpireAt") > now_seconds))
