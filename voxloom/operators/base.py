"""The frames that the profile operators work on: utterances in corpus order, and their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import FUNCTION_WORDS, LANGUAGE_NAMES
from voxloom.sources.tables import delivered_once


def supported_language(name: Column) -> Column:
    """fr or en for a language given by code, region tag or name; null for every other (FLT12)."""
    low = F.lower(F.trim(name))
    head = F.split(low, "[-_ ]")[0]
    return F.when(low.isin(*LANGUAGE_NAMES["fr"]) | head.isin(*LANGUAGE_NAMES["fr"]), "fr").when(low.isin(*LANGUAGE_NAMES["en"]) | head.isin(*LANGUAGE_NAMES["en"]), "en")


def text_language(text: Column) -> Column:
    """fr or en for a text without a label, by its function words; null for every other language, and where none prevails.

    The language with most of its words in the text has it, if they are a tenth of all words; other languages in Latin letters
    are there to win their own texts.
    """
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (computes x once)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")

    def count(words: Column, code: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS[code].split()))).alias("n"), F.lit(code).alias("lang"), F.size(words).alias("of"))

    def verdict(ranked: Column) -> Column:
        first, second = ranked[0], ranked[1]
        return F.when((first["n"] > second["n"]) & (first["n"] >= 0.1 * first["of"]) & first["lang"].isin(*LANGUAGE_NAMES), first["lang"])

    return once(once(words, lambda ws: F.sort_array(F.array(*[count(ws, code) for code in FUNCTION_WORDS]), False)), verdict)


def utterance_rows(utterances: DataFrame) -> DataFrame:
    """(utt_id, speaker_id, recording_id, index, start, text, norm), a delivered-twice row once; utt_id is the corpus order."""
    once = delivered_once(utterances.select("utt_id", "speaker_id", "recording_id", "index", "start", "text", "loaded_at"), "utt_id")
    return once.where("text is not null").withColumn("norm", X.norm(F.col("text")))


def word_rows(parsed: DataFrame) -> DataFrame:
    """(speaker_id, recording_id, utt_id, pos, w): the words with a letter, as they are counted (FLT4)."""
    once = delivered_once(parsed.select("utt_id", "speaker_id", "recording_id", "words", "loaded_at"), "utt_id")
    rows = once.select("speaker_id", "recording_id", "utt_id", F.posexplode("words").alias("pos", "raw"))
    return rows.withColumn("w", X.lookup_form(F.col("raw"))).where(X.is_word(F.col("w"))).drop("raw")


def recording_languages(transcripts: DataFrame) -> DataFrame:
    """(recording_id, lang) of the recordings whose transcript is in a supported language."""
    lang = supported_language(F.col("language"))
    return transcripts.groupBy("recording_id").agg(F.min(lang).alias("lang")).where("lang is not null")


def spread(rows: DataFrame, feature: list[str], k: int) -> DataFrame:
    """At most k example utterances by feature, spread over recordings (WIN2).

    ``rows``: feature columns, recording_id, rec_order, index, text. Within a recording readable lengths (4 to 30 words) come
    first, then the order of speech; recordings take turns in the order of their first utterance; a text that was picked
    before is skipped and its turn is used up. Adds ``pick`` from 1.

    Ranks are taken over ids and a hash of each text; every window is cut to its first rows before rows are moved, and the texts
    of those picked are fetched at the end by ``rec_order``, the id of the utterance.
    """
    slim = rows.select(*feature, "recording_id", "rec_order", "index", F.struct(F.xxhash64("text"), F.length("text")).alias("_text"), F.when(X.whitespace_words(F.col("text")).between(4, 30), 0).otherwise(1).alias("_late"))
    place = Window.partitionBy(*feature, "recording_id")
    rounds = slim.withColumn("_first", F.min("rec_order").over(place)).withColumn("_round", F.row_number().over(place.orderBy("_late", "index", "rec_order")))
    fresh = rounds.withColumn("_seen", F.row_number().over(Window.partitionBy(*feature, "_text").orderBy("_round", "_first"))).where("_seen = 1")
    pick = F.row_number().over(Window.partitionBy(*feature).orderBy("_round", "_first"))
    picked = fresh.withColumn("pick", pick).where(F.col("pick") <= k).select(*feature, "pick", "rec_order")
    return rows.join(picked, [*feature, "rec_order"]).dropDuplicates([*feature, "pick"])
