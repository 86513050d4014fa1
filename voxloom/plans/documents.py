"""The frames that cards and reports need, measured from the tables of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import annotate, critic, discourse, lexical, register, rhetoric, rhythm, syntax
from voxloom.plans.shared import materialize, spread_out


def measured(utts: DataFrame, words: DataFrame, annotations: DataFrame, lang: str, tagger=None) -> dict[str, DataFrame]:
    utts, words = spread_out(materialize(utts, "utts"), "utt_id"), materialize(words, "words")  # read by a dozen branches each
    tagged = materialize(annotate.annotate(utts, lang, tagger or annotate.RuleTagger), "tagged")
    rows = materialize(syntax.syntax_rows(tagged, lang), "syntax")
    base, sizes = materialize(lexical.baseline(words), "baseline"), materialize(lexical.totals(words), "totals")
    rates = materialize(discourse.marker_rates(discourse.marker_counts_by_recording(utts, lang), sizes), "rates")
    spoken = utts.groupBy("speaker_id").agg(F.sum(X.whitespace_words(F.col("text"))).alias("words"))
    kept = rhetoric.verify(annotations, utts).where("kept").join(annotations.select("annotation_id", "speaker_id"), "annotation_id")
    profile = critic.profile(utts, words, rows, lang).drop("preferences", "markers")
    profile = profile.join(rhythm.length_stats(words).select("speaker_id", "short_share"), "speaker_id").join(lexical.mattr(words).select("speaker_id", "mattr"), "speaker_id")
    frames = {
        "profile": profile, "preferences": register.preference_counts(utts, lang), "pronouns": lexical.pronouns(words, base, lang), "bigrams": rhythm.top_starts(words, bigrams=True),
        "imperatives": syntax.imperative_verbs(rows), "markers": rates, "absent": discourse.absent_markers(rates, sizes, lang), "familiar": register.familiar_words(register.familiar_matches(utts, lang), sizes),
        "phrases": discourse.signature_phrases(discourse.tagged_words(tagged)), "lemmas": syntax.top_lemmas(syntax.token_rows(tagged)), "openings": rhythm.top_starts(words),
        "questions": rhythm.question_block(utts, lang), "question_examples": rhythm.question_examples(utts, lang),
        "examples": syntax.feature_examples(rows, discourse.repeats(utts, lang), register.familiar_matches(utts, lang)), "device_examples": rhetoric.device_examples(kept, ["speaker_id"]), "devices": rhetoric.device_summary(kept, spoken, ["speaker_id"]),
        "distinctive": lexical.distinctive(lexical.against_baseline(words, base)),
    }
    return {name: materialize(df, name) for name, df in frames.items()}  # documents read each several times; all are small
