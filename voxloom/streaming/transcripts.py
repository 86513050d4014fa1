"""Transcripts as they arrive: utterances from a file stream, each delivery once, and late-tolerant counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import segment
from voxloom.operators.base import supported_language
from voxloom.sources import schema


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of transcript JSON files."""
    return spark.readStream.schema(schema.TRANSCRIPT).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("arrived", F.current_timestamp())


def utterances(stream: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Utterances of arriving transcripts; a recording delivered again within the watermark is left out.

    Segmentation is a fold inside the row, so it runs on a stream as it does on a table.
    """
    once = stream.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["recording_id"])
    words = F.flatten(F.transform(F.filter("segments", lambda s: ~segment.invented(s) & s["words"].isNotNull()), lambda s: F.filter(s["words"], lambda w: F.coalesce((w["word"] != "") & (w["word"] != "..."), F.lit(False)))))
    rows = once.where("recording_id is not null and segments is not null").select("recording_id", F.coalesce(supported_language(F.col("language")) == "fr", F.lit(False)).alias("french"), words.alias("ws"))
    return segment.utterances_from_words(rows)


def hourly_words(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Words and recordings by hour of arrival."""
    size = X.whitespace_words(F.coalesce("text", F.lit("")))
    return stream.withWatermark("arrived", watermark).groupBy(F.window("arrived", "1 hour")).agg(F.sum(size).alias("words"), F.approx_count_distinct("recording_id").alias("recordings"))
