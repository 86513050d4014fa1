"""Problem 5: repetition inside a single document.

Each text is measured where it lies: the share of its words that lie in a run already seen earlier in the same text. The
failures of that rule are then aggregated by host, the hosts' failure rates are shrunk with an empirical beta prior, and the
host verdicts are joined back to the documents. The host of a text is the speaker it was recorded from or written for.

A host verdict is "clean" (its shrunk rate is what a host of its size has without any failure), "mixed" or "flagged" (a rate of
HOST_LIMIT or more). ``found`` takes the documents of hosts that are not clean and checks each of them exactly, since the
question is about texts, not hosts.

Defined results: a null or wordless text has 0 words and share 0; a row delivered twice counts once; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.functions.heavy import heavy_split_join
from voxloom.llm import units
from voxloom.plans.shared import materialize, spread_out

RUN_WORDS = 8
RUN_LETTERS = 16
FAIL_SHARE = 0.3
HOST_LIMIT = 0.25


def repeated_units(text: str | None, run_words: int = RUN_WORDS, run_letters: int = RUN_LETTERS) -> tuple[int, int]:
    """(units, repeated units) of a text: words, or letters where most letters belong to a script without spaces."""
    if not text:
        return 0, 0
    if units.spaceless_share(text) > 0.5:
        items, run = units.letters(text).astype(np.uint64), run_letters
    else:
        found, run = units.words(text), run_words
        if len(found) <= run:
            return len(found), 0
        items = units.hashes(found)
    seen = units.windows(items, run)
    if len(seen) < 2:
        return len(items), 0
    order = np.argsort(seen, kind="stable")
    again = np.flatnonzero(seen[order][1:] == seen[order][:-1])
    if not len(again):
        return len(items), 0
    edges = np.zeros(len(items) + 1, np.int64)
    starts = order[again + 1]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run, -1)
    return len(items), int((np.cumsum(edges[:-1]) > 0).sum())


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        both = [repeated_units(t if isinstance(t, str) else None) for t in batch["text"]]
        yield frames.columns(kind=batch["kind"], item_id=batch["item_id"], host=[h if isinstance(h, str) else None for h in batch["host"]], words=[a for a, _ in both], repeated=[b for _, b in both])


def measure(texts: DataFrame) -> DataFrame:
    """(kind, item_id, host, text) -> (kind, item_id, host, words, repeated), once per kind and item. Only counts are shuffled."""
    counted = spread_out(texts.select("kind", "item_id", "host", "text"), "item_id").mapInPandas(_measure, "kind string, item_id string, host string, words long, repeated long")
    one = F.max(F.struct("words", "repeated", "host")).alias("m")
    return counted.groupBy("kind", "item_id").agg(one).select("kind", "item_id", "m.host", "m.words", "m.repeated")


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, docs, failures, rate, shrunk, spotless): failure rates shrunk towards a beta prior fitted to all hosts by moments, and
    the shrunk rate of a host of this size without a failure."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    hosts = hosts.withColumn("rate", F.col("failures") / F.col("docs"))
    moments = hosts.agg(F.sum("failures").alias("f"), F.sum("docs").alias("d"), F.count("*").alias("h"), F.sum(F.col("docs") * F.col("rate") ** 2).alias("s2")).first()
    if not moments["d"]:
        return hosts.withColumn("shrunk", F.col("rate")).withColumn("spotless", F.lit(0.0))
    mean = min(max(moments["f"] / moments["d"], 1e-6), 1 - 1e-6)
    variance = max(moments["s2"] / moments["d"] - mean**2, 0.0)
    noise = mean * (1 - mean) * moments["h"] / moments["d"]  # expected from sampling alone
    between = max(variance - noise, 1e-9)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    lifted = lambda failures: (failures + F.lit(mean * strength)) / (F.col("docs") + strength)
    return hosts.withColumn("shrunk", lifted(F.col("failures"))).withColumn("spotless", lifted(F.lit(0)))


def repetition_report(texts: DataFrame, recordings: DataFrame | None = None, fail_share: float = FAIL_SHARE, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Every text with its share, whether it fails the rule, and the verdict on its host. ``recordings`` (id, speaker_id) has the
    hosts of texts that come without one; a text of no known host belongs to the host "unknown"."""
    rated = measure(texts).withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0))
    if recordings is not None:
        speakers = recordings.where("id is not null").groupBy(F.col("id").alias("item_id")).agg(F.min("speaker_id").alias("_speaker"))
        rated = rated.join(speakers, "item_id", "left").withColumn("host", F.coalesce("host", F.when(F.col("kind") == "transcript", F.col("_speaker")))).drop("_speaker")
    rated = materialize(rated.withColumn("failed", F.col("share") >= fail_share).withColumn("host", F.coalesce("host", F.lit("unknown"))), "repetition")
    hosts = materialize(host_rates(rated), "hosts")
    size = hosts.agg(F.sum("docs").alias("docs"), F.count("*").alias("hosts")).first()
    verdict = F.when(F.col("shrunk") >= host_limit, "flagged").when(F.col("shrunk") > F.col("spotless"), "mixed").otherwise("clean")
    verdicts = hosts.select("host", "docs", F.col("shrunk").alias("host_rate"), verdict.alias("host_verdict"))
    joined = heavy_split_join(rated, verdicts, "host", "docs", size["docs"] or 0, keys=size["hosts"])
    return joined.select("kind", "item_id", "host", "words", "repeated", "share", "failed", F.col("docs").alias("host_docs"), "host_rate", "host_verdict")


def corpus_texts(transcripts: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions with the speaker they imitate as their host; the speakers of transcripts are in the table of recordings."""
    spoken = transcripts.select(F.lit("transcript").alias("kind"), F.col("recording_id").alias("item_id"), F.lit(None).cast("string").alias("host"), "text")
    written = versions.select(F.lit("version").alias("kind"), F.col("version_id").alias("item_id"), F.col("speaker_id").alias("host"), "text")
    return spoken.unionByName(written).where("item_id is not null")


def found(report: DataFrame) -> DataFrame:
    """The texts that fail the rule, of hosts that the verdict does not clear."""
    return report.where(F.col("host_verdict").isin("mixed", "flagged") & F.col("failed")).select("kind", "item_id")
