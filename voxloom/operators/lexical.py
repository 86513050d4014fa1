"""Words of a speaker: counts, diversity, distinctive and underused words, pronouns (AGG2, AGG3, AGG6-AGG11, WIN1).

All operators take word rows (speaker_id, recording_id, utt_id, pos, w). Ties are broken by the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS

MATTR_WINDOW = 100
UTTERANCE_BITS, WORD_BITS = 12, 14  # blocks of MATTR; a block is longer than a window
LEAST_COUNT = 3
TOP_DISTINCTIVE, TOP_UNDERUSED = 20, 10


def totals(words: DataFrame) -> DataFrame:
    """Recordings, utterances, words and types of a speaker. Two levels: numbers by utterance and by word are small enough to be
    counted again, and no word row is repeated for a distinct count."""
    spoken = words.groupBy("speaker_id", "recording_id", "utt_id").agg(F.count("*").alias("n")).groupBy("speaker_id", "recording_id").agg(F.count("*").alias("u"), F.sum("n").alias("n"))
    spoken = spoken.groupBy("speaker_id").agg(F.count("*").alias("recordings"), F.sum("u").alias("utterances"), F.sum("n").alias("words"))
    types = words.groupBy("speaker_id", "w").agg(F.lit(1)).groupBy("speaker_id").agg(F.count("*").alias("types"))
    return spoken.join(types, "speaker_id")


def word_counts(words: DataFrame) -> DataFrame:
    first = F.min(F.struct("utt_id", "pos")).alias("first")
    by_recording = words.groupBy("speaker_id", "w", "recording_id").agg(F.count("*").alias("n"), first)
    return by_recording.groupBy("speaker_id", "w").agg(F.sum("n").alias("count"), F.count("*").alias("recordings"), F.min("first").alias("first"))


def mattr(words: DataFrame, window: int = MATTR_WINDOW) -> DataFrame:
    """Moving-average type-token ratio over the word stream of a speaker, across utterances and recordings.

    The sum of distinct words over all windows is a sum over words: each counts in the windows that hold it and not its
    previous occurrence. An occurrence further back than a window tells nothing, so the stream is cut into blocks that carry the
    last words of the block before along; a speaker is as many groups as blocks. The numbering adds the words of the utterances
    before in a block of utterances to those of the blocks before.
    """
    lengths = words.groupBy("speaker_id", "utt_id").agg(F.count("*").alias("len")).withColumn("part", F.shiftright("utt_id", UTTERANCE_BITS))
    inner = F.sum("len").over(Window.partitionBy("speaker_id", "part").orderBy("utt_id")) - F.col("len")
    parts = lengths.groupBy("speaker_id", "part").agg(F.sum("len").alias("size"))
    before = F.sum("size").over(Window.partitionBy("speaker_id").orderBy("part")) - F.col("size")
    total = F.sum("size").over(Window.partitionBy("speaker_id"))
    begins = parts.select("speaker_id", "part", before.alias("before"), total.alias("n"))
    offsets = lengths.withColumn("inner", inner).join(begins, ["speaker_id", "part"]).select("speaker_id", "utt_id", (F.col("before") + F.col("inner")).alias("offset"), "n")
    inside = words.withColumn("k", F.row_number().over(Window.partitionBy("speaker_id", "utt_id").orderBy("pos")) - 1)
    stream = inside.join(offsets, ["speaker_id", "utt_id"]).select("speaker_id", "w", "n", (F.col("offset") + F.col("k")).alias("j"))
    block = F.shiftright("j", WORD_BITS)
    last_ones = (F.col("j") + window) >= (block + 1) * (1 << WORD_BITS)  # they are seen from the next block too
    blocks = F.array_compact(F.array(block, F.when(last_ones, block + 1)))
    shown = stream.withColumn("block", F.explode(blocks))
    previous = F.coalesce(F.lag("j").over(Window.partitionBy("speaker_id", "block", "w").orderBy("j")), F.lit(-1))
    placed = shown.withColumn("p", previous).where(block == F.col("block"))
    held = F.greatest(F.lit(0), F.least(F.col("j"), F.col("n") - window) - F.greatest(F.col("p") + 1, F.col("j") - window + 1, F.lit(0)) + 1)
    sums = placed.groupBy("speaker_id").agg(F.max("n").alias("words"), F.sum(held).alias("distinct_sum"), F.sum((F.col("p") < 0).cast("long")).alias("types"))
    value = F.when(F.col("words") >= window, F.col("distinct_sum") / (F.col("words") - window + 1) / window).otherwise(F.col("types") / F.col("words"))
    return sums.select("speaker_id", "words", F.when(F.col("words") >= window, F.col("distinct_sum")).otherwise(F.col("types")).alias("distinct_sum"), F.round(value, 3).alias("mattr"))


def baseline(words: DataFrame) -> DataFrame:
    """(w, freq): how often a word is used by all speakers, as a share of all words. A stand-in for general usage."""
    counts = words.groupBy("w").agg(F.count("*").alias("c"))
    return counts.crossJoin(F.broadcast(words.agg(F.count("*").alias("all")))).select("w", (F.col("c") / F.col("all")).alias("freq"))


def against_baseline(words: DataFrame, base: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Every candidate word with its rate and log ratio to the baseline (JN1, FLT7, AGG8)."""
    counts = word_counts(words).where((F.col("count") >= least) & (F.length("w") >= 2) & F.replace(F.col("w"), F.lit("'"), F.lit("")).rlike(r"^[\p{L}\p{M}]+$"))
    size = words.groupBy("speaker_id").agg(F.count("*").alias("n"), F.count_distinct("recording_id").alias("n_recordings"))
    rows = counts.join(size, "speaker_id").join(base, "w", "left")
    log = F.round(F.log2(F.col("count") / F.col("n") / F.col("freq")), 2)
    return rows.select("speaker_id", "w", "count", X.per_1k(F.col("count"), F.col("n")).alias("per_1k"), F.round(1000 * F.coalesce("freq", F.lit(0.0)), 3).alias("baseline_per_1k"), F.when(F.col("freq") > 0, log).alias("log2_ratio"), "recordings", "n_recordings", "first")


def distinctive(rated: DataFrame, bucket=None, top: int = TOP_DISTINCTIVE) -> DataFrame:
    """The most over-used words by bucket, said in at least two recordings where there are two (AGG9)."""
    kept = rated.where((F.col("log2_ratio") > 1) & (F.col("recordings") >= F.least(F.lit(2), F.col("n_recordings"))))
    kept = kept.withColumn("bucket", F.lit("all") if bucket is None else bucket)
    rank = F.row_number().over(Window.partitionBy("speaker_id", "bucket").orderBy(F.desc("log2_ratio"), "first"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).drop("first", "n_recordings")


def underused(rated: DataFrame, top: int = TOP_UNDERUSED) -> DataFrame:
    """Words of general usage that the speaker avoids (AGG10)."""
    kept = rated.where((F.col("baseline_per_1k") >= 1) & (F.col("log2_ratio") < -1) & F.col("w").rlike(r"^[\p{L}\p{M}]+$"))
    rank = F.row_number().over(Window.partitionBy("speaker_id").orderBy("log2_ratio", "first"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).drop("first", "n_recordings")


def pronouns(words: DataFrame, base: DataFrame, lang: str) -> DataFrame:
    """Every pronoun of the language with its rate, 0 where it is not used (AGG11, JN2)."""
    spark = words.sparkSession
    listed = spark.createDataFrame([(k, p, p.rstrip("'")) for k, p in enumerate(LEXICONS[lang].pronouns)], "ord int, pronoun string, bare string")
    size = words.groupBy("speaker_id").agg(F.count("*").alias("n"))
    counts = words.join(F.broadcast(listed.select(F.col("pronoun").alias("w"))), "w", "left_semi").groupBy("speaker_id", "w").agg(F.count("*").alias("count"))
    small = base.join(F.broadcast(listed.select(F.col("bare").alias("w")).distinct()), "w")
    grid = size.crossJoin(F.broadcast(listed)).join(F.broadcast(small.withColumnRenamed("w", "bare")), "bare", "left")
    out = grid.join(counts.withColumnRenamed("w", "pronoun"), ["speaker_id", "pronoun"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("speaker_id", "ord", "pronoun", "count", X.per_1k(F.col("count"), F.col("n")).alias("per_1k"), F.round(1000 * F.col("freq"), 2).alias("baseline_per_1k"))
