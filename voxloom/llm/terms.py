"""Problems 2 and 6: how often every term occurs, and how distinctive it is of a record.

Terms are the elements of ``parsed.words`` in the consistent form (without look-alike letters), lower case, NFC. A record is
a ``recording_id``. Null or empty words, words that are invisible altogether and rows without a recording are no terms; a row
delivered twice counts once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.functions.heavy import heavy_split_join
from voxloom.llm.canon import transducer
from voxloom.plans.shared import materialize
from voxloom.sources.tables import delivered_once

RARE_RECORDS = 3
COMMON_SHARE = 0.35
SMOOTHING = 0.75


def term_of(word: str | None) -> str:
    if word is None:
        return ""
    return unicodedata.normalize("NFC", transducer(False)(word).lower()).strip()


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Term and record pairs, counted within each batch before anything is shuffled."""
    known: dict[str, str] = {}
    for batch in batches:
        counts: Counter = Counter()
        for record, words in zip(batch["recording_id"], batch["words"]):
            if words is None:
                continue
            for word in words:
                term = known.get(word)
                if term is None:
                    if len(known) > 500_000:
                        known.clear()
                    term = known[word] = term_of(word)
                if term:
                    counts[term, record] += 1
        yield frames.frame(["term", "recording_id", "n"], [(t, r, n) for (t, r), n in counts.items()])


def term_pairs(parsed: DataFrame) -> DataFrame:
    """(term, recording_id, n): partial counts, several rows a pair, written once in the shared folder."""
    rows = delivered_once(parsed.where("recording_id is not null").select("utt_id", "recording_id", "words", "loaded_at"), "utt_id")
    # Words are counted where their rows lie; neighbouring utterances of a recording are mostly in one batch.
    return materialize(rows.select("recording_id", "words").mapInPandas(_combine, "term string, recording_id string, n long"), "term-pairs")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run lengths over sorted pairs. A run that spans batches is carried; one that spans partitions is summed later."""
    term, record, total, records = None, None, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        new_term = batch["term"].ne(batch["term"].shift())
        new_record = new_term | batch["recording_id"].ne(batch["recording_id"].shift())
        runs = pd.DataFrame({"run": new_term.cumsum(), "term": batch["term"], "n": batch["n"], "r": new_record})
        runs = runs.groupby("run", sort=False).agg(term=("term", "first"), n=("n", "sum"), r=("r", "sum"))
        terms, sums, recs = runs["term"].tolist(), runs["n"].tolist(), runs["r"].tolist()
        if terms[0] == term:
            sums[0] += total
            recs[0] += records - (batch["recording_id"].iloc[0] == record)
        elif term is not None:
            terms, sums, recs = [term, *terms], [total, *sums], [records, *recs]
        term, total, records, record = terms.pop(), sums.pop(), recs.pop(), batch["recording_id"].iloc[-1]
        yield frames.columns(term=terms, n=sums, r=recs)
    if term is not None:
        yield frames.columns(term=[term], n=[total], r=[records])


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(term, occurrences, records): range partitions sorted by term and record, then one scan of run lengths.

    The range key is the pair, so a term said everywhere spreads over partitions; equal pairs share one, which makes the
    record counts of the parts add up.
    """
    ordered = pairs.repartitionByRange("term", "recording_id").sortWithinPartitions("term", "recording_id")
    runs = ordered.mapInPandas(_scan, "term string, n long, r long")
    return runs.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("records"))


def term_report(parsed: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """Every term with its occurrences, records, and whether it is too rare or too common to describe a speaker.

    Too rare: in fewer than ``rare`` records. Too common: in more than ``common`` of the records that have any term. An empty
    table gives an empty report.
    """
    pairs = term_pairs(parsed)
    n_records = pairs.agg(F.count_distinct("recording_id")).first()[0]
    return term_frequencies(pairs).select(
        "term", "occurrences", "records", (F.col("records") < rare).alias("too_rare"), (F.col("records") > common * n_records).alias("too_common")
    )


def verdicts(report: DataFrame) -> DataFrame:
    """(term, verdict), one row a verdict; in a collection so small that both hold a term has two rows."""
    marks = F.array_compact(F.array(F.when(F.col("too_rare"), F.lit("rare")), F.when(F.col("too_common"), F.lit("common"))))
    return report.select("term", F.explode(marks).alias("verdict"))


def distinctive_terms(parsed: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Positive pointwise mutual information of term and record, with the counts it is made of.

    ppmi = max(0, log2(p(term, record) / (p(term) * p'(record)))), where p' is proportional to the record's term count to the
    power ``smoothing``. Columns: recording_id, term, n (joint count), occurrences, records, ppmi. Pairs with ppmi 0 are
    kept. Only group-bys and joins are used; terms and records that hold a large part of the pairs are joined by broadcast of
    their provably few rows.
    """
    joint = materialize(term_pairs(parsed).groupBy("term", "recording_id").agg(F.sum("n").alias("n")), "term-joint")
    terms = joint.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))
    contexts = materialize(joint.groupBy("recording_id").agg(F.sum("n").alias("size"), F.count("*").alias("pairs")), "contexts")
    sums = contexts.agg(F.sum(F.pow("size", F.lit(smoothing))).alias("smoothed"), F.sum("pairs").alias("pairs"), F.count("*").alias("records")).first()
    if not sums["pairs"]:
        return joint.select("recording_id", "term", "n", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"), F.lit(0.0).alias("ppmi"))
    scored = heavy_split_join(joint, contexts, "recording_id", "pairs", sums["pairs"], keys=sums["records"])
    scored = heavy_split_join(scored, terms, "term", "records", sums["pairs"])
    pmi = F.log2(F.col("n") / F.col("occurrences") * F.lit(float(sums["smoothed"])) / F.pow("size", F.lit(smoothing)))
    return scored.select("recording_id", "term", "n", "occurrences", "records", F.greatest(F.lit(0.0), pmi).alias("ppmi"))


def found_distinctive(scores: DataFrame, least: int = 4, records: tuple[int, int] = (2, 4)) -> DataFrame:
    """Terms that are more frequent in a record than its smoothed share of all terms lets expect (ppmi above 0) and, by an exact
    check, said at least ``least`` times there and in few records.

    In a collection of more than a few records the check implies a positive ppmi, unless one of the other records says the term
    thousands of times.
    """
    return scores.where((F.col("ppmi") > 0) & (F.col("n") >= least) & F.col("records").between(*records)).select("recording_id", "term")
