"""Utterances of a speaker: lengths, openings, questions (AGG12, AGG13, AGG16-AGG18, FLT8-FLT10, WIN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS, java_pattern
from voxloom.operators.base import spread

LONG, SHORT = 13, 7
TAG_EXAMPLES, OTHER_EXAMPLES = 4, 6
BINS = ((1, 3), (4, 7), (8, 12), (13, 20), (21, 35), (36, None))


def lengths(words: DataFrame) -> DataFrame:
    """(speaker_id, recording_id, utt_id, len) of the utterances with words."""
    return words.groupBy("speaker_id", "recording_id", "utt_id").agg(F.count("*").alias("len"))


def decile(sorted_at, count: Column, i: int) -> Column:
    """The i-th of the nine cut points by the exclusive method. ``sorted_at(k)``: the k-th smallest value, from 1 (WIN5)."""
    m = count + 1
    j = F.greatest(F.lit(1), F.least(F.floor(m * i / 10), count - 1))
    d = m * i - 10 * j
    return (sorted_at(j) * (10 - d) + sorted_at(j + 1) * d) / 10


def length_stats(words: DataFrame) -> DataFrame:
    """Mean, median, deciles (from ten utterances on), shares of long and short ones, coefficient of variation (AGG12).

    Lengths are counted before they are sorted, so a speaker's utterances are never collected: there are few different
    lengths however many utterances there are.
    """
    sizes = lengths(words).groupBy("speaker_id", "len").agg(F.count("*").alias("c"))
    up = Window.partitionBy("speaker_id").orderBy("len")
    cumulative = sizes.withColumn("upto", F.sum("c").over(up))
    agg = cumulative.groupBy("speaker_id").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("len")).alias("s"), F.sum(F.col("c") * F.col("len") * F.col("len")).alias("s2"),
        F.sum(F.when(F.col("len") >= LONG, F.col("c")).otherwise(0)).alias("long"), F.sum(F.when(F.col("len") <= SHORT, F.col("c")).otherwise(0)).alias("short"),
        F.sort_array(F.collect_list(F.struct("upto", "len"))).alias("steps"),
    )

    def at(k: Column) -> Column:
        return F.filter("steps", lambda x: x["upto"] >= k)[0]["len"]

    n = F.col("n")
    median = (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") * n - F.col("s") * F.col("s")) / (n * n)))
    ten = lambda i: F.when(n >= 10, F.round(decile(at, n, i), 4))
    return agg.select("speaker_id", n.alias("utterances"), F.round(mean, 1).alias("mean"), median.alias("median"), ten(1).alias("p10"), ten(9).alias("p90"), F.round(F.col("long") / n, 3).alias("long_share"), F.round(F.col("short") / n, 3).alias("short_share"), F.round(sd / mean, 2).alias("cv"))


def bin_label(lo: int, hi: int | None) -> str:
    return f"{lo}+" if hi is None else f"{lo}-{hi}"


def histogram(words: DataFrame) -> DataFrame:
    """Utterances by bin of length, empty bins kept (AGG13)."""
    n = F.col("len")
    counts = lengths(words).groupBy("speaker_id").agg(F.count("*").alias("n"), *[F.sum((n.between(lo, hi) if hi else n >= lo).cast("long")).alias(f"b{k}") for k, (lo, hi) in enumerate(BINS)])
    stack = ", ".join(f"{k}, '{bin_label(*b)}', b{k}" for k, b in enumerate(BINS))
    return counts.select("speaker_id", "n", F.expr(f"stack({len(BINS)}, {stack}) as (bin, words, count)")).select("speaker_id", "bin", "words", "count", F.round(F.col("count") / F.col("n"), 3).alias("share"))


def starts(words: DataFrame) -> DataFrame:
    """(speaker_id, recording_id, utt_id, first, second): the first two words of each utterance."""
    return words.groupBy("speaker_id", "recording_id", "utt_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "w"))), 1, 2).alias("h")).select("speaker_id", "recording_id", "utt_id", F.col("h")[0]["w"].alias("first"), F.get("h", F.lit(1))["w"].alias("second"))


def top_starts(words: DataFrame, bigrams: bool = False, top: int | None = None) -> DataFrame:
    """How utterances begin: the first word, or the first two (AGG16, AGG17)."""
    s = starts(words)
    n = s.groupBy("speaker_id").agg(F.count("*").alias("n"))
    s = s.where("second is not null").withColumn("words", X.join_tokens(F.array("first", "second"))) if bigrams else s.withColumn("words", F.col("first"))
    counts = s.groupBy("speaker_id", "words").agg(F.count("*").alias("count"), F.min("utt_id").alias("at"))
    rank = F.row_number().over(Window.partitionBy("speaker_id").orderBy(F.desc("count"), "at"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= (top or (10 if bigrams else 12))).join(n, "speaker_id").select("speaker_id", "rank", "words", "count", F.round(F.col("count") / F.col("n"), 3).alias("share"))


def questions(utts: DataFrame, lang: str) -> DataFrame:
    """Utterances that ask, and whether they only check in with a tag (FLT8-FLT10)."""
    asks = F.rtrim(F.col("text")).endswith("?")
    tag = F.col("norm").rlike(java_pattern(LEXICONS[lang].tags))
    return utts.where(asks).withColumn("kind", F.when(tag, "tag").otherwise("other"))


def question_block(utts: DataFrame, lang: str) -> DataFrame:
    """Share of questions and number of tag questions (AGG18)."""
    asks = F.rtrim(F.col("text")).endswith("?")
    tag = asks & F.col("norm").rlike(java_pattern(LEXICONS[lang].tags))
    return utts.groupBy("speaker_id").agg(F.count("*").alias("utterances"), F.sum(asks.cast("long")).alias("questions"), F.sum(tag.cast("long")).alias("tag_questions")).withColumn("share", F.round(F.col("questions") / F.col("utterances"), 3))


def question_examples(utts: DataFrame, lang: str) -> DataFrame:
    """Four tag questions and six other questions of each speaker."""
    asked = questions(utts, lang).select("speaker_id", "kind", "recording_id", F.col("utt_id").alias("rec_order"), "index", "text")
    picked = spread(asked, ["speaker_id", "kind"], max(TAG_EXAMPLES, OTHER_EXAMPLES))
    few = F.when(F.col("kind") == "tag", TAG_EXAMPLES).otherwise(OTHER_EXAMPLES)
    return picked.where(F.col("pick") <= few).select("speaker_id", "kind", "pick", "recording_id", "index", "text")


def opening_examples(utts: DataFrame, words: DataFrame, k: int = 2) -> DataFrame:
    """Two utterances for each of a speaker's most frequent first words (AGG16)."""
    tops = top_starts(words).select("speaker_id", F.col("words").alias("first"))
    begun = starts(words).join(tops, ["speaker_id", "first"]).select("speaker_id", "first", "utt_id")
    rows = begun.join(utts.select("utt_id", "recording_id", "index", "text"), "utt_id").withColumnRenamed("utt_id", "rec_order")
    return spread(rows, ["speaker_id", "first"], k).select("speaker_id", "first", "pick", "recording_id", "index", "text")
