"""Annotations of rhetorical devices: verification against the passage, summaries, what is left to do (FN3, FN4, AGG30, WIN3, JN7, JN12, JN16, JN17)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.functions import text as X
from voxloom.functions.lexicon import DEVICES, PASSAGE_DEVICES
from voxloom.operators import segment
from voxloom.plans.shared import materialize
from voxloom.sources import schema

EXAMPLES = 5
PROMPT_VERSION = 1
# What a device is, in our words.
MEANINGS = {
    "rhetorical_question": "asks without wanting an answer, or gives it at once",
    "contrast": "sets two things, choices or states against each other",
    "analogy": "explains one thing by the picture of another",
    "anecdote": "tells something that happened, often to themselves",
    "emphatic_repetition": "says a word or phrase again so that it weighs more",
    "list": "strings three or more things together",
    "reframing": "puts another view in place of the expected one",
    "provocative_opening": "begins with something that makes people listen",
    "counterargument": "takes up an objection before anybody makes it",
    "humor": "jokes, teases, or laughs at themselves",
    "authority": "leans on their own trade, years or standing",
}


def verify(items: DataFrame, utts: DataFrame) -> DataFrame:
    """Annotation items with ``kept``, the reason they are not, the lines they span and the time (FN4).

    ``items``: annotation_id, recording_id, device, utterances, quote, and number where it is known which passage was annotated.
    ``utts``: recording_id, index, start, text. The passage is a whole chunk: that of ``number``, else one that holds a claimed
    line, else the first of the recording in which the quote is found. Its lines are those claimed that it has and those whose
    words are part of the quote or hold it; the time is that of the first. Passages travel as rows of lines, and only items whose
    own passage lacks the quote meet the other passages of their recording.
    """
    line = lambda u: F.struct(u["index"].alias("index"), u["start"].alias("start"), X.quote_norm(u["text"]).alias("words"))
    passages = materialize(segment.chunk_lines(utts).select("recording_id", "number", F.transform("lines", line).alias("lines")), "passages")
    numbered = passages.withColumnRenamed("number", "_number")
    asked = items.withColumn("_q", X.quote_norm(F.coalesce("quote", F.lit(""))))
    known = "number" in items.columns
    if known:
        named = asked.withColumnRenamed("number", "_number")
    else:
        held = numbered.select("recording_id", "_number", F.explode("lines.index").alias("_line"))
        claims = asked.select("annotation_id", "recording_id", F.explode("utterances").alias("_line")).join(held, ["recording_id", "_line"]).select("annotation_id", "_number").distinct()
        named = asked.join(claims, "annotation_id", "left")
    best = _best(named.join(numbered, ["recording_id", "_number"], "left"))
    first = materialize(items.select("annotation_id", "recording_id", "device", "quote", "utterances").join(best, "annotation_id", "left"), "verified")
    out = first
    if not known:
        lacking = first.where(~F.coalesce(F.col("b.late") == 0, F.lit(False)) & (F.coalesce("quote", F.lit("")) != "")).drop("b")
        others = _best(lacking.withColumn("_q", X.quote_norm(F.col("quote"))).join(numbered, "recording_id")).withColumnRenamed("b", "o")
        elsewhere = F.coalesce(F.col("o.late") == 0, F.lit(False))
        out = first.join(others, "annotation_id", "left").withColumn("b", F.when(elsewhere, F.col("o")).otherwise(F.col("b")))
    found = F.coalesce(F.col("b.late") == 0, F.lit(False))
    reason = F.when(F.coalesce(F.col("quote"), F.lit("")) == "", "empty quote").when(~F.coalesce(F.col("device").isin(*DEVICES), F.lit(False)), "unknown device").when(~found, "quote not found")
    lines = F.when(reason.isNull(), F.col("b.hits")).otherwise(F.array().cast("array<int>"))
    return out.select("annotation_id", "recording_id", "device", "quote", reason.isNull().alias("kept"), reason.alias("reason"), lines.alias("lines"), F.when(reason.isNull(), F.col("b.at")).alias("t"))


def _best(pairs: DataFrame) -> DataFrame:
    """(annotation_id, b) of items met with passages: the first passage that holds the quote, the lines it spans, the time of the first."""
    text = F.array_join(F.filter(F.transform("lines", lambda u: u["words"]), lambda w: w != ""), " ")
    hit = lambda u: (u["words"] != "") & (F.col("_q") != "") & (F.col("_q").contains(u["words"]) | u["words"].contains(F.col("_q")))
    claimed = lambda u: F.coalesce(F.array_contains("utterances", u["index"]), F.lit(False))
    spanned = F.array_sort(F.filter("lines", lambda u: claimed(u) | hit(u)))
    hits = F.array_distinct(F.transform(spanned, lambda u: u["index"]))
    late = F.when(F.coalesce(X.quote_in(F.col("quote"), text), F.lit(False)), 0).otherwise(1)
    judged = pairs.select("annotation_id", F.struct(late.alias("late"), "_number", hits.alias("hits"), F.get(spanned, F.lit(0))["start"].alias("at")).alias("b"))
    return judged.groupBy("annotation_id").agg(F.min("b").alias("b"))


def device_summary(verified: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, device, count, per_1k, recordings) of the kept annotations (AGG30). ``sizes``: by, words (white-space words)."""
    counts = verified.groupBy(*by, "device").agg(F.count("*").alias("count"), F.count_distinct("recording_id").alias("recordings"))
    return counts.join(sizes, by).select(*by, "device", "count", X.per_1k(F.col("count"), F.col("words")).alias("per_1k"), "recordings")


def device_examples(verified: DataFrame, by: list[str], k: int = EXAMPLES) -> DataFrame:
    """Up to k quotes a device: in order of time inside a recording; recordings take turns in the order of their earliest item
    (WIN3). An item without a time counts as at the beginning; of equals the one with the smaller id comes first."""
    mine = Window.partitionBy(*by, "device", "recording_id")
    at = F.struct(F.coalesce("t", F.lit(0.0)).alias("t"), "annotation_id")
    rows = verified.withColumn("_round", F.row_number().over(mine.orderBy(at))).withColumn("_first", F.min(at).over(mine))
    pick = F.row_number().over(Window.partitionBy(*by, "device").orderBy("_round", "_first"))
    return rows.withColumn("pick", pick).where(F.col("pick") <= k).select(*by, "device", "pick", "annotation_id", "recording_id", "quote")


def absent_devices(summary: DataFrame, speakers: DataFrame) -> DataFrame:
    """Devices a speaker was never found to use (JN12)."""
    listed = summary.sparkSession.createDataFrame([(d,) for d in DEVICES], "device string")
    return speakers.select("speaker_id").distinct().crossJoin(F.broadcast(listed)).join(summary, ["speaker_id", "device"], "left_anti")


def annotated(chunks: DataFrame, ask: Callable[[list[str], list[int], list[str]], list[dict]], tag: str) -> DataFrame:
    """Chunks (recording_id, speaker_id, number, key, lines, context) with what a model finds in them, as rows of the cache (SNK7).

    ``ask``: texts, line numbers, context -> finds. It runs on the executors, one chunk at a time. A chunk for which it fails
    three times ends the job; what was written before stays in the cache.
    """
    names = ["tag", "recording_id", "number", "key", "speaker_id", "items"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                finds = ask([u["text"] for u in r.lines], [int(u["index"]) for u in r.lines], list(r.context))
                items = [(f.get("device"), [int(i) for i in f.get("utterances") or []], f.get("quote"), f.get("why")) for f in finds]
                rows.append((tag, r.recording_id, r.number, r.key, r.speaker_id, [dict(zip(("device", "utterances", "quote", "why"), i)) for i in items]))
            yield frames.frame(names, rows)

    return chunks.mapInPandas(run, schema.ANNOTATED_CHUNK)


def cached_items(cache: DataFrame, chunks: DataFrame, tag: str) -> DataFrame:
    """The finds of the chunks that are still what they were (recording_id, number, key), ready to be verified; ids by content."""
    current = cache.where(F.col("tag") == tag).join(chunks.select("recording_id", "number", "key"), ["recording_id", "number", "key"], "left_semi").dropDuplicates(["recording_id", "number"])
    rows = current.select("speaker_id", "recording_id", "number", F.posexplode("items").alias("place", "i"))
    return rows.select(F.xxhash64("recording_id", "number", "place").alias("annotation_id"), "speaker_id", "recording_id", "number", "i.device", "i.utterances", "i.quote", "i.why")


def pending_chunks(chunks: DataFrame, cache: DataFrame, tag: str) -> DataFrame:
    """Chunks not yet annotated under this tag of prompt version, model and settings (JN16)."""
    done = cache.where(F.col("tag") == tag).select("recording_id", "number", "key")
    return chunks.join(done, ["recording_id", "number", "key"], "left_anti")


def cache_tag(version: int, model: str, thinking: bool) -> str:
    """Eight characters that change with whatever changes the answers (CTL10)."""
    import hashlib

    return hashlib.sha256(f"{version}|{model}|{thinking}".encode()).hexdigest()[:8]


def passage_devices(passages: DataFrame, verified: DataFrame) -> DataFrame:
    """Passages with the devices annotated inside them (JN7): exploded lines meet exploded indices, then one set a passage."""
    marks = verified.where(F.col("kept") & F.col("device").isin(*PASSAGE_DEVICES)).select("recording_id", "device", F.explode("lines").alias("index"))
    held = passages.select("recording_id", "window", F.explode("indices").alias("index")).join(marks, ["recording_id", "index"])
    sets = held.groupBy("recording_id", "window").agg(F.array_sort(F.collect_set("device")).alias("devices"))
    return passages.join(sets, ["recording_id", "window"], "left").withColumn("devices", F.coalesce("devices", F.array().cast("array<string>")))
