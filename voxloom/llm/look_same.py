"""Problem 1: utterances and quotes that look the same but are written with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.canon import as_seen
from voxloom.plans.shared import materialize, spread_out

SHARE = 1000


def same_looking_texts(utterances: DataFrame) -> DataFrame:
    """Pairs (first_id < second_id) of utterances of one recording that look the same but differ in code points.

    Texts travel as two 64-bit hashes of the seen form and one of the stored form. Groups with a single stored form are
    removed by an aggregate before the pairs are joined, so repeated identical remarks never meet each other.
    Null texts, null recordings and texts that are invisible altogether give no pair; a row delivered twice counts once.
    """
    keyed = materialize(
        spread_out(utterances.select("utt_id", "recording_id", "text"), "utt_id").select("utt_id", "recording_id", "text", as_seen("text").alias("_seen"))
        .where("recording_id is not null and _seen is not null and _seen <> ''")
        .select("utt_id", "recording_id", F.xxhash64("_seen").alias("_k1"), F.xxhash64("_seen", F.lit(1)).alias("_k2"), F.xxhash64("text").alias("_raw"))
        .distinct(),
        "seen-keys",
    )
    group = ["recording_id", "_k1", "_k2"]
    sizes = keyed.groupBy(*group).agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi")
    # A group with many members is cut into shares: each of its rows goes to one on the left and to all on the right, so no task
    # makes more than SHARE pairs for a row.
    shares = F.ceil(F.col("_n") / SHARE).cast("int")
    members = keyed.join(sizes.select(*group, shares.alias("_shares")), group)
    left = members.withColumn("_share", F.pmod(F.xxhash64("utt_id"), F.col("_shares")).cast("int")).drop("_shares")
    right = members.select(*group, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), F.col("utt_id").alias("_second"), F.col("_raw").alias("_other"))
    pairs = left.join(right, [*group, "_share"]).where("_raw <> _other and utt_id < _second")
    return pairs.select(F.col("utt_id").alias("first_id"), F.col("_second").alias("second_id")).distinct()


def quotes_found_as_seen(annotations: DataFrame, utterances: DataFrame) -> DataFrame:
    """(annotation_id, utt_id) where the quote is in the utterance only after both are brought to the seen form.

    Utterances are those of the annotation's recording whose index is listed. Null or empty quotes, texts and lists give
    no row; repeated list entries and redelivered utterances give one.
    """
    asked = annotations.where("quote <> ''").select("annotation_id", "recording_id", F.explode(F.array_distinct("utterances")).alias("index"), "quote")
    texts = utterances.where("text is not null").select("utt_id", "recording_id", "index", "text")
    # Only pairs whose stored forms do not settle the question are brought to the seen form.
    unlike = asked.join(texts, ["recording_id", "index"]).where(~F.col("text").contains(F.col("quote")))
    seen = unlike.select("annotation_id", "utt_id", as_seen("quote").alias("_quote"), as_seen("text").alias("_text"))
    return seen.where((F.col("_quote") != "") & F.col("_text").contains(F.col("_quote"))).select("annotation_id", "utt_id").distinct()


def consistent_text(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with ``column`` brought to the seen form, in place or as column ``to``."""
    return df.withColumn(to or column, as_seen(F.col(column)))


def found(annotations: DataFrame, utterances: DataFrame) -> DataFrame:
    text = same_looking_texts(utterances).select(F.lit("text").alias("pair_kind"), "first_id", "second_id")
    quote = quotes_found_as_seen(annotations, utterances).select(F.lit("quote").alias("pair_kind"), F.col("annotation_id").alias("first_id"), F.col("utt_id").alias("second_id"))
    return text.unionByName(quote)
