"""The engine's queries over the tables of a corpus directory, by operator of the survey."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS
from voxloom.operators import annotate, base, catalog, critic, discourse, lexical, register, rhetoric, rhythm, segment, syntax
from voxloom.plans.shared import materialize
from voxloom.sources.tables import delivered_once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def query_by_language(f):
    """Registers a query of the English recordings, and with _fr behind its name the same of the French ones."""

    def french(s, d):
        return f(s, d, "fr")

    french.__name__, french.__doc__ = f"{f.__name__}_fr", f.__doc__
    QUERIES[french.__name__] = french
    return query(f)


def _utts(s, d, lang=None):
    rows = base.utterance_rows(table(s, d, "utterances"))
    return rows if lang is None else rows.join(_languages(s, d, lang), "recording_id", "left_semi")


def _words(s, d, lang=None):
    rows = base.word_rows(table(s, d, "parsed"))
    return rows if lang is None else rows.join(_languages(s, d, lang), "recording_id", "left_semi")


def _languages(s, d, lang):
    return base.recording_languages(table(s, d, "transcripts")).where(F.col("lang") == lang)


def _parsed_once(s, d):
    return delivered_once(table(s, d, "parsed").select("utt_id", "speaker_id", "recording_id", "words", "loaded_at"), "utt_id")


@query
def agg2_corpus_totals(s, d):
    return lexical.totals(_words(s, d))


@query
def agg3_word_counts(s, d):
    return lexical.word_counts(_words(s, d)).select("speaker_id", "w", "count", "recordings")


@query
def agg7_mattr(s, d):
    return lexical.mattr(_words(s, d))


@query
def agg8_log_ratios(s, d):
    words = _words(s, d)
    return lexical.against_baseline(words, lexical.baseline(words)).select("speaker_id", "w", "count", "per_1k", "baseline_per_1k", "log2_ratio", "recordings")


@query
def agg9_distinctive_words(s, d):
    words = _words(s, d)
    return lexical.distinctive(lexical.against_baseline(words, lexical.baseline(words))).select("speaker_id", "rank", "w", "count", "log2_ratio", "recordings")


@query_by_language
def agg9_distinctive_by_pos(s, d, lang="en"):
    tokens = syntax.token_rows(annotate.annotate(_utts(s, d, lang), lang))
    words = tokens.select("speaker_id", "recording_id", "utt_id", F.col("pos_i").alias("pos"), "w")
    rated = lexical.against_baseline(words, lexical.baseline(words)).join(syntax.dominant_pos(tokens), ["speaker_id", "w"])
    return lexical.distinctive(rated, syntax.style_bucket()).select("speaker_id", "bucket", "rank", "w", "count", "log2_ratio", "recordings")


@query
def agg10_underused_words(s, d):
    words = _words(s, d)
    return lexical.underused(lexical.against_baseline(words, lexical.baseline(words))).select("speaker_id", "rank", "w", "count", "log2_ratio")


@query_by_language
def agg11_pronouns(s, d, lang="en"):
    words = _words(s, d, lang)
    return lexical.pronouns(words, lexical.baseline(words), lang)


@query
def agg12_length_stats(s, d):
    return rhythm.length_stats(_words(s, d))


@query
def agg13_length_histogram(s, d):
    return rhythm.histogram(_words(s, d))


@query
def agg16_openings(s, d):
    return rhythm.top_starts(_words(s, d))


@query
def agg17_opening_bigrams(s, d):
    return rhythm.top_starts(_words(s, d), bigrams=True)


@query_by_language
def agg18_questions(s, d, lang="en"):
    return rhythm.question_block(_utts(s, d, lang), lang)


@query_by_language
def win2_question_examples(s, d, lang="en"):
    return rhythm.question_examples(_utts(s, d, lang), lang)


@query
def agg21_markers_en(s, d):
    return discourse.marker_rates(discourse.marker_counts_by_recording(_utts(s, d, "en"), "en"), lexical.totals(_words(s, d, "en"))).drop("ord")


@query
def agg21_markers_fr(s, d):
    return discourse.marker_rates(discourse.marker_counts_by_recording(_utts(s, d, "fr"), "fr"), lexical.totals(_words(s, d, "fr"))).drop("ord")


def _plain(rates, lang):
    from voxloom.functions.lexicon import markers

    listed = [(c, label) for c, label, form in markers(LEXICONS[lang]) if not set("^{|\\") & set(form)]
    return rates.join(F.broadcast(rates.sparkSession.createDataFrame(listed, "category string, marker string")), ["category", "marker"], "left_semi")


@query
def agg21_plain_markers_en(s, d):
    """The markers that SQL can count too."""
    return _plain(agg21_markers_en(s, d), "en")


@query
def agg21_plain_markers_fr(s, d):
    return _plain(agg21_markers_fr(s, d), "fr")


@query_by_language
def agg21_marker_examples(s, d, lang="en"):
    return discourse.marker_examples(_utts(s, d, lang), lang).select("speaker_id", "marker", "pick", "recording_id", "index", "text")


@query_by_language
def jn4_absent_markers(s, d, lang="en"):
    sizes = lexical.totals(_words(s, d, lang))
    rates = discourse.marker_rates(discourse.marker_counts_by_recording(_utts(s, d, lang), lang), sizes)
    return discourse.absent_markers(rates, sizes, lang).drop("ord")


@query
def agg22_signature_phrases(s, d):
    return discourse.signature_phrases(discourse.utterance_words(_parsed_once(s, d))).drop("kind")


@query
def agg22_phrase_examples(s, d):
    return discourse.phrase_examples(materialize(discourse.utterance_words(_parsed_once(s, d)), "phrase-words"), _utts(s, d))


@query_by_language
def agg22_phrase_kinds(s, d, lang="en"):
    """Signature phrases with their kind, by the tagger."""
    return discourse.signature_phrases(discourse.tagged_words(annotate.annotate(_utts(s, d, lang), lang)))


@query
def agg16_opening_examples(s, d):
    return rhythm.opening_examples(_utts(s, d), materialize(_words(s, d), "words"))


@query_by_language
def win2_feature_examples(s, d, lang="en"):
    utts = materialize(_utts(s, d, lang), "utts")
    rows = syntax.syntax_rows(annotate.annotate(utts, lang), lang)
    return syntax.feature_examples(rows, discourse.repeats(utts, lang), register.familiar_matches(utts, lang))


@query
def jn6_spoken_minutes(s, d):
    return catalog.spoken_minutes(_utts(s, d), table(s, d, "recordings"))


@query_by_language
def agg23_repeats(s, d, lang="en"):
    return discourse.repeats(_utts(s, d, lang), lang).groupBy("speaker_id", "kind", "word").agg(F.count("*").alias("count"), F.max("run").alias("longest"))


@query_by_language
def agg26_preferences(s, d, lang="en"):
    return register.preference_counts(_utts(s, d, lang), lang)


@query_by_language
def agg27_address(s, d, lang="en"):
    return register.address_rate(_utts(s, d, lang), lexical.totals(_words(s, d, lang)), lang)


@query_by_language
def agg28_familiar_words(s, d, lang="en"):
    return register.familiar_words(register.familiar_matches(_utts(s, d, lang), lang), lexical.totals(_words(s, d, lang)))


@query
def flt1_kept_words(s, d):
    return segment.kept_words(table(s, d, "transcripts")).select("recording_id", F.size("ws").alias("words"), F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + F.length(w["word"])).alias("letters"))


@query
def seg1_pause_utterances(s, d):
    return segment.utterances_from_words(segment.kept_words(table(s, d, "transcripts")))


@query
def seg1_hard_breaks(s, d):
    return segment.hard_breaks(segment.kept_words(table(s, d, "transcripts")))


@query
def seg4_text_utterances(s, d):
    return segment.utterances_from_text(table(s, d, "versions").select("version_id", "text"), "version_id", F.lit(False))


@query
def seg6_chunks(s, d):
    return segment.chunks(_utts(s, d)).select("recording_id", "number", "key", "first_index", "last_index", "words", F.size("context").alias("context_lines"))


@query
def seg8_passages(s, d):
    return segment.passages(_utts(s, d)).drop("text", "indices")


def _items(s, d):
    return table(s, d, "annotations").select("annotation_id", "recording_id", "speaker_id", "device", "utterances", "quote", "t")


@query
def fn4_verified_annotations(s, d):
    return rhetoric.verify(_items(s, d), _utts(s, d))


def _kept(s, d):
    """The annotations whose quote was found, with their speaker and the time of their first line."""
    return rhetoric.verify(_items(s, d), _utts(s, d)).where("kept").join(_items(s, d).select("annotation_id", "speaker_id"), "annotation_id")


@query
def agg30_device_summary(s, d):
    sizes = _utts(s, d).groupBy("speaker_id").agg(F.sum(X.whitespace_words(F.col("text"))).alias("words"))
    return rhetoric.device_summary(_kept(s, d), sizes, ["speaker_id"])


@query
def win3_device_examples(s, d):
    return rhetoric.device_examples(_kept(s, d), ["speaker_id"])


@query
def jn7_passage_devices(s, d):
    verified = rhetoric.verify(_items(s, d), _utts(s, d))
    return rhetoric.passage_devices(segment.passages(_utts(s, d)), verified).select("recording_id", "window", "role", "words", "devices")


@query
def agg29_corpus_stats(s, d):
    return catalog.stats(table(s, d, "recordings"))


@query
def jn15_duplicate_content(s, d):
    return catalog.duplicates(table(s, d, "recordings"))


@query
def flt6_pending_recordings(s, d):
    return catalog.pending(table(s, d, "recordings"), table(s, d, "transcripts"))


@query
def ctl5_catalogue_problems(s, d):
    return catalog.problems(table(s, d, "recordings"))


@query
def agg33_status(s, d):
    return catalog.status(table(s, d, "speakers"), table(s, d, "recordings"), table(s, d, "transcripts"), _words(s, d), table(s, d, "annotations"), table(s, d, "versions"))


@query
def fn1_slugs(s, d):
    return table(s, d, "recordings").select("id", X.slugify(F.col("title")).alias("slug"))


@query
def fn5_clean_drafts(s, d):
    return table(s, d, "versions").select("version_id", X.clean_draft(F.col("text")).alias("clean"))


def _syntax(s, d, lang):
    return syntax.syntax_rows(annotate.annotate(_utts(s, d, lang), lang), lang)


@query
def agg14_syntax_en(s, d):
    return syntax.syntax_profile(_syntax(s, d, "en"))


@query
def agg14_syntax_fr(s, d):
    return syntax.syntax_profile(_syntax(s, d, "fr"))


@query_by_language
def agg19_imperative_verbs(s, d, lang="en"):
    return syntax.imperative_verbs(_syntax(s, d, lang))


@query_by_language
def agg4_top_lemmas(s, d, lang="en"):
    return syntax.top_lemmas(syntax.token_rows(annotate.annotate(_utts(s, d, lang), lang)))


def _profiles(s, d, lang, speakers):
    """The profiles of those speakers; nothing of others is tagged."""
    mine = lambda df: df.join(speakers, "speaker_id", "left_semi")
    utts, words = materialize(mine(_utts(s, d, lang)), "utts"), materialize(mine(_words(s, d, lang)), "words")
    rows = syntax.syntax_rows(annotate.annotate(utts, lang), lang)
    return critic.profile(utts, words, rows, lang)


def _judged(s, d):
    """(lang, drafts in it, profiles in it of their speakers) for each supported language."""
    drafts = table(s, d, "versions").select("version_id", "speaker_id", "text", base.text_language(F.col("text")).alias("lang"))
    heard = table(s, d, "recordings").select(F.col("id").alias("recording_id"), "speaker_id").join(base.recording_languages(table(s, d, "transcripts")), "recording_id").select("speaker_id", "lang").distinct()
    versions = materialize(drafts.where("lang is not null").join(heard, ["speaker_id", "lang"], "left_semi"), "versions")  # the others have nothing to be held against
    for lang in LEXICONS:
        mine = versions.where(F.col("lang") == lang).drop("lang")
        judged = critic.draft_profiles(mine, lang, "version_id").join(mine.select("version_id", "speaker_id"), "version_id")
        yield lang, materialize(judged, "drafts"), materialize(_profiles(s, d, lang, mine.select("speaker_id").distinct()), "profiles")


def _issues(judged):
    return reduce(DataFrame.unionByName, [critic.issues(drafts, targets, lang, "version_id") for lang, drafts, targets in judged])


@query
def cr_style_issues(s, d):
    """Every draft in a supported language against the profile of its speaker in that language: the flagship."""
    return _issues(_judged(s, d))


@query
def agg31_style_scores(s, d):
    """Drafts in other languages, and drafts whose speaker has no profile in their language, have no score."""
    judged = list(_judged(s, d))
    met = reduce(DataFrame.unionByName, [drafts.join(targets, "speaker_id", "left_semi").select("version_id") for _, drafts, targets in judged])
    return critic.scores(_issues(judged), table(s, d, "versions"), "version_id", met)


@query_by_language
def card_style_cards(s, d, lang="en"):
    """Style cards of all speakers of a language (CARD1-CARD10)."""
    from voxloom.operators import documents
    from voxloom.plans.documents import measured

    return documents.style_cards(measured(_utts(s, d, lang), _words(s, d, lang), _items(s, d), lang), lang)


@query_by_language
def snk11_reports(s, d, lang="en"):
    from voxloom.operators import documents
    from voxloom.plans.documents import measured

    return documents.reports(measured(_utts(s, d, lang), _words(s, d, lang), _items(s, d), lang), lang)


@query
def src11_flat_transcripts(s, d):
    """The stored transcripts through the normal form of recogniser output; whole texts must come out again."""
    from voxloom.sources.store import flatten_transcript

    return flatten_transcript(table(s, d, "transcripts").where("segments is not null")).select("recording_id", "text").distinct()
