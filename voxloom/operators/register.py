"""Register: preferences, address, familiar words (AGG26-AGG28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS, java_pattern, pattern, preferences, standalone


def preference_counts(utts: DataFrame, lang: str) -> DataFrame:
    """(speaker_id, ord, use, avoid, use_count, avoid_count)."""
    listed = preferences(LEXICONS[lang])
    count = lambda form: F.sum(F.regexp_count("norm", F.lit(java_pattern(pattern(form)))))
    sums = utts.groupBy("speaker_id").agg(*[c for k, (_, u, _, a) in enumerate(listed) for c in (count(u).alias(f"u{k}"), count(a).alias(f"a{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(u).alias("use"), F.lit(a).alias("avoid"), F.col(f"u{k}").alias("use_count"), F.col(f"a{k}").alias("avoid_count")) for k, (u, _, a, _) in enumerate(listed)])
    return sums.select("speaker_id", F.explode(rows).alias("p")).select("speaker_id", "p.*")


def address_rate(utts: DataFrame, sizes: DataFrame, lang: str) -> DataFrame:
    """How often the listener is addressed."""
    counts = utts.groupBy("speaker_id").agg(F.sum(F.regexp_count("norm", F.lit(java_pattern(standalone(LEXICONS[lang].address))))).alias("count"))
    return counts.join(sizes.select("speaker_id", "words"), "speaker_id").select("speaker_id", "count", X.per_1k(F.col("count"), F.col("words")).alias("per_1k"))


def familiar_matches(utts: DataFrame, lang: str) -> DataFrame:
    """(speaker_id, recording_id, utt_id, index, text, word), one row a match. Each word of the list is searched on its own, so
    overlapping phrases all count; utterances without any are filtered out by one pattern first."""
    listed = LEXICONS[lang].familiar
    anyone = java_pattern(standalone("/".join(listed)))
    hits = F.flatten(F.array(*[F.regexp_extract_all("norm", F.lit(java_pattern(standalone(w))), F.lit(0)) for w in listed]))
    return utts.where(F.col("norm").rlike(anyone)).withColumn("word", F.explode(hits)).select("speaker_id", "recording_id", "utt_id", "index", "text", "word")


def familiar_words(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    counts = matches.groupBy("speaker_id", "word").agg(F.count("*").alias("count"))
    return counts.join(sizes.select("speaker_id", "words"), "speaker_id").select("speaker_id", "word", "count", X.per_1k(F.col("count"), F.col("words")).alias("per_1k"))
