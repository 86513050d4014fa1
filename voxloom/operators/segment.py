"""From words to utterances, from utterances to chunks and passages (SEG1-SEG9, FLT1-FLT3, WIN4, WIN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.base import supported_language

PAUSE_S, LONG_RUN, SHORT_PAUSE_S = 0.5, 20, 0.2
CHUNK_WORDS, CONTEXT, PASSAGE_WORDS = 350, 3, 130


def invented(segment: Column) -> Column:
    """A segment the recogniser made up over silence; a missing value keeps it (FLT1)."""
    return F.coalesce((segment["no_speech_prob"] > 0.8) & (segment["avg_logprob"] < -1.0), F.lit(False))


def kept_words(transcripts: DataFrame) -> DataFrame:
    """(recording_id, french, ws): the words of a transcript in order, without invented segments, empty words and "..." (FLT1, FLT2)."""
    def words(s: Column) -> Column:
        return F.filter(s["words"], lambda w: F.coalesce((w["word"] != "") & (w["word"] != "..."), F.lit(False)))

    ws = F.flatten(F.transform(F.filter("segments", lambda s: ~invented(s) & s["words"].isNotNull()), words))
    french = F.coalesce(supported_language(F.col("language")) == "fr", F.lit(False))
    return transcripts.where("recording_id is not null and segments is not null").groupBy("recording_id").agg(F.max_by(F.struct(french.alias("french"), ws.alias("ws")), F.struct("created_at", "loaded_at")).alias("t")).select("recording_id", "t.french", "t.ws")


def _final(word: Column) -> Column:
    return F.right(word, F.lit(1)).isin(".", "?", "!", "…")


def utterances_from_words(words: DataFrame, pause_s: float = PAUSE_S, long_run: int = LONG_RUN, short_pause_s: float = SHORT_PAUSE_S) -> DataFrame:
    """(recording_id, index, start, end, text, split): one fold over the words of a recording (SEG1).

    A final mark ends an utterance, else a pause, else a short pause in a long run. The fold carries the place where the
    utterance began and collects the places of the breaks; utterances are slices of the words, so nothing is shuffled.
    Utterances without a letter or digit are dropped after they have ended a run, and the index counts those left.
    """
    init = F.struct(F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,end:int,why:string>>").alias("out"))
    n = F.size("ws")

    def step(acc: Column, k: Column) -> Column:
        word, nxt = F.get("ws", k), F.get("ws", k + 1)
        gap = nxt["start"] - word["end"]
        pause = F.coalesce((gap > pause_s) | ((k + 1 - acc["begin"] >= long_run) & (gap > short_pause_s)), F.lit(False))
        why = F.when(_final(word["word"]), F.lit("punct")).when(pause, F.lit("pause")).when(k + 1 >= n, F.lit("end"))
        more = F.array_append(acc["out"], F.struct(acc["begin"].alias("begin"), (k + 1).alias("end"), why.alias("why")))
        return F.struct(F.when(why.isNull(), acc["begin"]).otherwise(k + 1).alias("begin"), F.when(why.isNull(), acc["out"]).otherwise(more).alias("out"))

    def utterance(b: Column) -> Column:
        w = F.slice("ws", b["begin"] + 1, b["end"] - b["begin"])
        text = X.space_marks(F.array_join(F.transform(w, lambda x: x["word"]), " "), F.col("french"))
        return F.struct(F.get(w, F.lit(0))["start"].alias("start"), F.get(w, F.size(w) - 1)["end"].alias("end"), text.alias("text"), b["why"].alias("split"))

    broken = words.where(n > 0).withColumn("breaks", F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), init, step)["out"])
    made = broken.withColumn("us", F.filter(F.transform("breaks", utterance), lambda u: u["text"].rlike(r"(?U)\w")))
    return made.select("recording_id", F.posexplode("us").alias("index", "u")).select("recording_id", "index", "u.start", "u.end", "u.text", "u.split")


def hard_breaks(words: DataFrame, pause_s: float = PAUSE_S) -> DataFrame:
    """Words by (recording_id, island): broken at final marks and long pauses only, as gaps and islands."""
    rows = words.select("recording_id", F.posexplode("ws").alias("pos", "w")).select("recording_id", "pos", "w.*")
    order = Window.partitionBy("recording_id").orderBy("pos")
    ends = F.coalesce(_final(F.col("word")) | (F.lead("start").over(order) - F.col("end") > pause_s), F.lit(False))
    island = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("ends", ends).withColumn("island", island).groupBy("recording_id", "island").agg(F.count("*").alias("words"), F.min("pos").alias("first_pos"))


def utterances_from_text(texts: DataFrame, id_column: str, french: Column) -> DataFrame:
    """(id, index, text) of plain texts: split after marks before white space, and at line ends (SEG4)."""
    parts = F.filter(F.split("text", r"(?U)(?<=[.?!…])\s+|\n+"), lambda p: p.rlike(r"(?U)\w"))
    rows = texts.where("text is not null").withColumn("_f", french).select(id_column, "_f", F.posexplode(parts).alias("index", "part"))
    return rows.select(id_column, "index", X.space_marks(F.col("part"), F.col("_f")).alias("text"))


def _windows(words_column: Column, most: int) -> Column:
    """[(begin, end, words)] of greedy windows over word counts: a window ends with the element that brings it to ``most``."""
    init = F.struct(F.lit(0).alias("begin"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<begin:int,end:int,words:bigint>>").alias("out"))
    size = F.size(words_column)

    def step(acc: Column, k: Column) -> Column:
        total = acc["n"] + F.get(words_column, k)
        full = (total >= most) | (k + 1 >= size)
        more = F.array_append(acc["out"], F.struct(acc["begin"].alias("begin"), (k + 1).alias("end"), total.alias("words")))
        return F.struct(F.when(full, k + 1).otherwise(acc["begin"]).alias("begin"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("n"), F.when(full, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), init, step)["out"]


def _by_recording(utts: DataFrame) -> DataFrame:
    """The utterances of a recording in one row (a recording is bounded by its length in time), with their word counts."""
    u = F.struct("index", "text", X.whitespace_words(F.col("text")).alias("words"))
    return utts.groupBy("recording_id").agg(F.array_sort(F.collect_list(u)).alias("us")).withColumn("counts", F.transform("us", lambda u: u["words"]))


def chunks(utts: DataFrame, most: int = CHUNK_WORDS, context: int = CONTEXT) -> DataFrame:
    """(recording_id, number, key, first_index, last_index, words, texts, context): greedy chunks of a recording (SEG6, SEG7)."""
    rows = _by_recording(utts).select("recording_id", "us", F.posexplode(_windows(F.col("counts"), most)).alias("number", "w"))
    mine = F.slice("us", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin"))
    texts = F.transform("mine", lambda u: u["text"])
    lead = F.least(F.lit(context), F.col("w.begin"))
    before = F.transform(F.slice("us", F.col("w.begin") - lead + 1, lead), lambda u: u["text"])
    return rows.withColumn("mine", mine).select(
        "recording_id", "number", F.substring(F.sha2(F.array_join(texts, "\n"), 256), 1, 16).alias("key"), F.col("mine")[0]["index"].alias("first_index"), F.element_at("mine", -1)["index"].alias("last_index"),
        F.col("w.words").alias("words"), texts.alias("texts"), before.alias("context"),
    )


def chunk_lines(utts: DataFrame, most: int = CHUNK_WORDS, context: int = CONTEXT) -> DataFrame:
    """(recording_id, number, key, lines, context): the chunks of ``chunks`` with the index, start and text of each of their lines."""
    u = F.struct("index", "start", "text", X.whitespace_words(F.col("text")).alias("words"))
    rows = utts.groupBy("recording_id").agg(F.array_sort(F.collect_list(u)).alias("us")).withColumn("counts", F.transform("us", lambda u: u["words"]))
    cut = rows.select("recording_id", "us", F.posexplode(_windows(F.col("counts"), most)).alias("number", "w"))
    lines = F.slice("us", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin"))
    lead = F.least(F.lit(context), F.col("w.begin"))
    before = F.transform(F.slice("us", F.col("w.begin") - lead + 1, lead), lambda u: u["text"])
    held = cut.select("recording_id", "number", lines.alias("lines"), before.alias("context"))
    key = F.substring(F.sha2(F.array_join(F.transform("lines", lambda u: u["text"]), "\n"), 256), 1, 16)
    return held.select("recording_id", "number", key.alias("key"), "lines", "context")


def passages(utts: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(recording_id, window, role, first_index, last_index, words, text, indices): windows of a recording; a tail of less than
    half the words joins the window before it unless it is the only one (SEG8, SEG9)."""
    wins = _windows(F.col("counts"), words)
    rows = _by_recording(utts).withColumn("wins", wins)
    tail, before = F.element_at("wins", -1), F.element_at("wins", -2)
    joined = F.struct(before["begin"].alias("begin"), tail["end"].alias("end"), (before["words"] + tail["words"]).alias("words"))
    merged = F.when((F.size("wins") > 1) & (tail["words"] < words / 2), F.array_append(F.slice("wins", 1, F.size("wins") - 2), joined)).otherwise(F.col("wins"))
    each = rows.withColumn("wins", merged).select("recording_id", "us", F.size("wins").alias("n"), F.posexplode("wins").alias("window", "w"))
    role = F.when(F.col("window") == 0, "opening").when(F.col("window") == F.col("n") - 1, "closing").otherwise("middle")
    each = each.withColumn("mine", F.slice("us", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin")))
    return each.select("recording_id", "window", role.alias("role"), F.col("mine")[0]["index"].alias("first_index"), F.element_at("mine", -1)["index"].alias("last_index"), F.col("w.words").alias("words"), F.array_join(F.transform("mine", lambda u: u["text"]), " ").alias("text"), F.transform("mine", lambda u: u["index"]).alias("indices"))
