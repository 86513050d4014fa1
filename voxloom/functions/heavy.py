"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_PARTS = 2000
BROADCAST_ROWS = 1_000_000


def heavy_split_join(rows: DataFrame, per_key: DataFrame, key: str, weight: str, total: int, parts: int = HEAVY_PARTS, keys: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per key) on ``key`` without a hot partition.

    ``weight`` is the column of ``per_key`` with the number of rows the key has in ``rows`` and ``total`` the number of all
    rows. Keys with more than ``total / parts`` rows number fewer than ``parts`` by counting: how many shares each is cut into is
    broadcast, its row of ``per_key`` is repeated for every share, and each of its rows goes to one of them. So ``rows`` are read
    and moved once, and no group of the join is larger than ``total / parts`` rows. ``keys``: the number of keys where it is
    known; up to BROADCAST_ROWS of them are broadcast and nothing is moved.
    """
    if keys is not None and keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_key), key)
    share = max(1, total // parts)
    shares = F.ceil(F.col(weight) / share).cast("int")
    heavy = per_key.where(F.col(weight) > share).select(key, shares.alias("_shares"))
    spread = F.pmod(F.xxhash64(*rows.columns), F.col("_shares")).cast("int")
    marked = rows.join(F.broadcast(heavy), key, "left").withColumn("_share", F.coalesce(spread, F.lit(0))).drop("_shares")
    repeated = per_key.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return marked.join(repeated, [key, "_share"]).drop("_share")
