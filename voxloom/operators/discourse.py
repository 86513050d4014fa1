"""Markers, recurring phrases, repetition (AGG21-AGG23, JN3, JN4, JN11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS, Lexicon, java_pattern, markers, pattern
from voxloom.operators.base import spread

TOKEN = r"[\p{L}\p{M}\p{N}'’-]+|[^\s\p{Z}]"
LEAST_PHRASE, COVERED, TOP_PHRASES = 3, 0.8, 40


def marker_list(lexicon: Lexicon) -> list[tuple[int, str, str, str]]:
    return [(k, category, label, java_pattern(pattern(form))) for k, (category, label, form) in enumerate(markers(lexicon))]


def count_matches(utts: DataFrame, listed: list[tuple[int, str]]) -> DataFrame:
    """(speaker_id, recording_id, ord, n) for (ord, pattern) pairs: every pattern is a literal, all are counted in one scan,
    and only the sums by recording are turned into rows."""
    sums = utts.groupBy("speaker_id", "recording_id").agg(*[F.sum(F.regexp_count("norm", F.lit(p))).alias(f"m{k}") for k, p in listed])
    stack = ", ".join(f"{k}, m{k}" for k, _ in listed)
    return sums.select("speaker_id", "recording_id", F.expr(f"stack({len(listed)}, {stack}) as (ord, n)")).where("n > 0")


def marker_counts_by_recording(utts: DataFrame, lang: str) -> DataFrame:
    listed = marker_list(LEXICONS[lang])
    names = utts.sparkSession.createDataFrame([(k, c, label) for k, c, label, _ in listed], "ord int, category string, marker string")
    return count_matches(utts, [(k, p) for k, _, _, p in listed]).join(F.broadcast(names), "ord").select("speaker_id", "category", "marker", "ord", "recording_id", F.col("n").alias("count"))


def marker_rates(by_recording: DataFrame, sizes: DataFrame) -> DataFrame:
    """(speaker_id, category, marker, count, per_1k, recordings). ``sizes``: (speaker_id, words)."""
    total = by_recording.groupBy("speaker_id", "category", "marker", "ord").agg(F.sum("count").alias("count"), F.count("*").alias("recordings"))
    return total.join(sizes.select("speaker_id", "words"), "speaker_id").select("speaker_id", "category", "marker", "ord", "count", X.per_1k(F.col("count"), F.col("words")).alias("per_1k"), "recordings")


def absent_markers(rates: DataFrame, speakers: DataFrame, lang: str) -> DataFrame:
    """Markers a speaker never uses (JN4)."""
    names = rates.sparkSession.createDataFrame([(k, c, label) for k, c, label, _ in marker_list(LEXICONS[lang])], "ord int, category string, marker string")
    return speakers.select("speaker_id").distinct().crossJoin(F.broadcast(names)).join(rates.select("speaker_id", "ord"), ["speaker_id", "ord"], "left_anti").select("speaker_id", "category", "marker", "ord")


def marker_examples(utts: DataFrame, lang: str, k: int = 3) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(F.col("norm").rlike(p), F.lit(label)) for _, _, label, p in marker_list(LEXICONS[lang])]))
    rows = utts.withColumn("marker", F.explode(hit)).select("speaker_id", "marker", "recording_id", F.col("utt_id").alias("rec_order"), "index", "text").distinct()
    return spread(rows, ["speaker_id", "marker"], k)


def utterance_words(parsed_once: DataFrame) -> DataFrame:
    """(speaker_id, recording_id, utt_id, ws): the counted words of each utterance as an array."""
    return parsed_once.withColumn("ws", F.filter(F.transform("words", X.lookup_form), X.is_word)).drop("words")


def tagged_words(tagged: DataFrame) -> DataFrame:
    """The same from tagged utterances, with which of the words are nouns or names."""
    said = F.filter("tokens", lambda t: t["is_word"])
    return tagged.select("speaker_id", "recording_id", "utt_id", F.transform(said, lambda t: t["lw"]).alias("ws"), F.transform(said, lambda t: t["pos"].isin("NOUN", "PROPN")).alias("nouns"))


def _grams(ws: Column, n: int) -> Column:
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.slice(ws, i, n))).otherwise(F.array())


def _gram_rows(words: DataFrame, lo: int, hi: int) -> DataFrame:
    """(speaker_id, recording_id, utt_id, g, noun): every n-gram, and whether it holds a noun where that is known."""
    nouns = F.col("nouns") if "nouns" in words.columns else F.transform("ws", lambda _: F.lit(None).cast("boolean"))
    held = words.withColumn("_nouns", nouns)

    def grams(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.size("ws") - (n - 1))
        gram = lambda i: F.struct(F.slice("ws", i, n).alias("g"), F.array_max(F.slice("_nouns", i, n)).alias("noun"))
        return F.when(F.size("ws") >= n, F.transform(begins, gram)).otherwise(F.array())

    return held.select("speaker_id", "recording_id", "utt_id", F.explode(F.concat(*[grams(n) for n in range(lo, hi + 1)])).alias("x")).select("speaker_id", "recording_id", "utt_id", "x.g", "x.noun")


def signature_phrases(words: DataFrame, lo: int = 3, hi: int = 5, top: int = TOP_PHRASES, keep_words: bool = False) -> DataFrame:
    """Recurring n-grams: at least three times, in two recordings where there are two, and not nearly always part of a longer
    recurring one. Containment is an equi-join with the parts of the longer ones. ``kind``: a phrase that was ever said with a
    noun or name in it is a formula, tied to its subject, any other a phrasing; null where parts of speech are not known."""
    by_recording = _gram_rows(words, lo, hi).groupBy("speaker_id", "g", "recording_id").agg(F.count("*").alias("n"), F.max("noun").alias("noun"))
    counts = by_recording.groupBy("speaker_id", "g").agg(F.sum("n").alias("count"), F.count("*").alias("recordings"), F.max("noun").alias("noun"))
    size = words.where(F.size("ws") > 0).select("speaker_id", "recording_id").distinct().groupBy("speaker_id").agg(F.count("*").alias("n_recordings"))
    kept = counts.where(F.col("count") >= LEAST_PHRASE).join(size, "speaker_id").where(F.col("recordings") >= F.least(F.lit(2), F.col("n_recordings"))).drop("n_recordings")
    parts = F.concat(*[F.when(F.size("g") > n, _grams(F.col("g"), n)).otherwise(F.array()) for n in range(lo, hi)])
    longer = kept.select("speaker_id", F.explode(F.array_distinct(parts)).alias("g"), F.col("count").alias("c")).groupBy("speaker_id", "g").agg(F.max("c").alias("longest"))
    free = kept.join(longer, ["speaker_id", "g"], "left").where(F.col("longest").isNull() | (F.col("longest") < COVERED * F.col("count")))
    weight = F.col("count") * F.size("g")
    rank = F.row_number().over(Window.partitionBy("speaker_id").orderBy(weight.desc(), "g"))
    kind = F.when(F.col("noun"), "formula").when(~F.col("noun"), "phrasing")
    ranked = free.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("speaker_id", "rank", X.join_tokens(F.col("g")).alias("phrase"), "count", "recordings", kind.alias("kind"), *(["g"] if keep_words else []))


def phrase_examples(words: DataFrame, utts: DataFrame, k: int = 2) -> DataFrame:
    """Two utterances for each signature phrase (AGG22)."""
    listed = signature_phrases(words, keep_words=True).select("speaker_id", "rank", "phrase", "g")
    said = _gram_rows(words, 3, 5).join(listed, ["speaker_id", "g"]).select("speaker_id", "rank", "phrase", "utt_id")
    rows = said.join(utts.select("utt_id", "recording_id", "index", "text"), "utt_id").withColumnRenamed("utt_id", "rec_order")
    return spread(rows, ["speaker_id", "rank", "phrase"], k).select("speaker_id", "rank", "phrase", "pick", "recording_id", "index", "text")


def repeats(utts: DataFrame, lang: str) -> DataFrame:
    """Immediate repetitions: (speaker_id, recording_id, utt_id, index, text, word, run, kind), kind emphatic or stutter (AGG23).

    Tokens include punctuation, which separates. The run is two and the number of equal tokens among the four that follow.
    """
    lex = LEXICONS[lang]
    tokens = F.transform(F.regexp_extract_all("norm", F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, "^-+", ""))

    def at(i: Column) -> Column:
        return F.get("toks", i)

    def pair(i: Column) -> Column:
        more = F.size(F.filter(F.slice("toks", i + 3, 4), lambda t: t == at(i)))
        return F.struct(at(i).alias("word"), (at(i) == at(i + 1)).alias("same"), (more + 2).alias("run"))

    rows = utts.withColumn("toks", tokens).where(F.size("toks") >= 2)
    found = rows.withColumn("r", F.explode(F.transform(F.sequence(F.lit(0), F.size("toks") - 2), pair))).where(F.col("r.same") & X.is_word(F.col("r.word")) & ~F.col("r.word").isin(*lex.repeat_ok))
    kind = F.when(F.col("r.word").isin(*lex.emphatic) | (F.col("r.run") >= 3), "emphatic").otherwise("stutter")
    return found.select("speaker_id", "recording_id", "utt_id", "index", "text", "r.word", "r.run", kind.alias("kind"))


def repeat_summary(found: DataFrame, sizes: DataFrame) -> DataFrame:
    counts = found.groupBy("speaker_id", "kind", "word").agg(F.count("*").alias("count"))
    return counts.join(sizes.select("speaker_id", "words"), "speaker_id").select("speaker_id", "kind", "word", "count", X.per_1k(F.col("count"), F.col("words")).alias("per_1k"))
