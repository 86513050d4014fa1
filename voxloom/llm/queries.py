"""The queries of the training-text operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import look_same

    return look_same.found(table(spark, d, "annotations"), table(spark, d, "utterances"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import terms

    return terms.verdicts(terms.term_report(table(spark, d, "parsed")))


def p2_term_report(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import terms

    return terms.term_report(table(spark, d, "parsed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_languages(spark, d).select("scope", "item_id", "seg_no", "lang")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import language

    return language.language_report(*(table(spark, d, t) for t in ("transcripts", "documents", "recordings", "speakers")))


def p3_document_languages(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import language

    return language.document_languages(table(spark, d, "documents"))


def p3_document_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut where its language changes."""
    from voxloom.llm import language

    return language.document_segments(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import turns

    return turns.found(turns.speaker_turns(table(spark, d, "transcripts"), table(spark, d, "rosters"), only_rostered=True))


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import turns

    return turns.speaker_turns(table(spark, d, "transcripts"), table(spark, d, "rosters"), split_pauses=True)


def p4_utterances(spark: SparkSession, d: str) -> DataFrame:
    """The utterances of recordings with several voices, with their turn and voice, in clean text."""
    from voxloom.llm import turns

    return turns.utterance_turns(table(spark, d, "utterances"), table(spark, d, "transcripts"), table(spark, d, "rosters"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import repetition

    return repetition.found(p5_repetition(spark, d))


def p5_repetition(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import repetition

    return repetition.repetition_report(repetition.corpus_texts(table(spark, d, "transcripts"), table(spark, d, "versions")), table(spark, d, "recordings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import terms

    return terms.found_distinctive(terms.distinctive_terms(table(spark, d, "parsed")))


def p6_term_scores(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import terms

    return terms.distinctive_terms(table(spark, d, "parsed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import sentences

    return sentences.sentence_spans(table(spark, d, "utterances"), table(spark, d, "versions"))


def p7_lost_marks(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import sentences

    return sentences.sentence_spans(table(spark, d, "utterances"), table(spark, d, "versions"), lost_marks=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import leaks

    return leaks.found(p8_leaks(spark, d))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import leaks

    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import mixing

    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import mixing

    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p9_kept_shares(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source with documents supplies its share."""
    from voxloom.llm import mixing

    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"), keep_shares=True)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Repeats, budgets and what is left of them, counted on the rows of p9_mix."""
    from voxloom.llm import mixing

    return mixing.checks(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    from voxloom.llm import pieces

    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_term_report, p3_found, p3_languages, p3_document_languages, p3_document_segments, p4_found, p4_turns, p4_utterances, p5_found, p5_repetition, p6_found, p6_term_scores, p7_found, p7_lost_marks, p8_found, p8_leaks, p9_mix, p9_shares, p9_kept_shares, p9_checks, p10_pieces)}
SQL: dict[str, str] = {
    "p9_checks": "SELECT source, true AS within_repeats, true AS within_budget, true AS filled FROM source_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0",
}
