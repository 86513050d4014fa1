"""Reading the tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_delivery(df: DataFrame, keys: list[str], columns: list[str] | None = None, loaded: str = "loaded_at") -> DataFrame:
    """One row per key: the earliest delivery, ties broken by content. Rows with a null key are kept as they are grouped.

    Only ``columns`` (default: all but ``loaded``) travel through the shuffle, so project before calling.
    """
    rest = [c for c in (columns or df.columns) if c not in keys and c != loaded]
    if not rest:
        return df.select(*keys).distinct()
    payload = F.struct(*[F.col(c) for c in rest])
    order = F.struct(F.col(loaded), F.xxhash64(*[F.to_json(payload) if _has_map(df, rest) else payload]))
    kept = df.groupBy(*keys).agg(F.min_by(payload, order).alias("_kept"))
    return kept.select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in rest])


REPEATED_ROWS = 2_000_000


def delivered_once(df: DataFrame, key: str, loaded: str = "loaded_at") -> DataFrame:
    """The earliest delivery of every key, without moving the rows of keys that came once.

    Only keys are shuffled to find those that came more than once; their rows alone go through ``first_delivery``. The repeated
    keys are broadcast up to REPEATED_ROWS of them and joined by a shuffle beyond. Rows without a key are all kept.
    """
    from voxloom.plans.shared import materialize

    repeated = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    few = repeated.count() <= REPEATED_ROWS
    marks = F.broadcast(repeated) if few else repeated
    rest = [c for c in df.columns if c != loaded]
    return df.join(marks, key, "left_anti").select(*rest).unionByName(first_delivery(df.join(marks, key, "left_semi"), [key]).select(*rest))


def _has_map(df: DataFrame, columns: list[str]) -> bool:
    return any("map<" in kind for name, kind in df.dtypes if name in columns)
