"""Drafts against the profile of their speaker: what to fix, and how much it weighs (CR1-CR13, AGG31, JN8-JN10).

Profiles are frames with one row a subject; many drafts meet many speakers in one job. A profile frame has: subject columns,
words, recordings, median, long_share, cv, fragment_share, negations, share_full, address_count, address_per_1k, and the
arrays preferences (ord, use, avoid, use_count, avoid_count) and markers (category, marker, count, per_1k, recordings), where
a marker that was looked for and not found has count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS
from voxloom.plans.shared import materialize, spread_out

LEAST_WORDS_FOR_ABSENCE = 2000
METRICS = "words recordings median long_share cv fragment_share negations share_full address_count address_per_1k preferences markers".split()


def profile(utts: DataFrame, words: DataFrame, tagged_rows: DataFrame, lang: str, by: str = "speaker_id") -> DataFrame:
    """A profile frame for the subjects in ``speaker_id`` of the given frames."""
    from voxloom.operators import discourse, lexical, register, rhythm, syntax

    # Every group of measures reads them again; patterns are searched on all cores however small the table is.
    utts, words = spread_out(materialize(utts, "utts"), "utt_id"), materialize(words, "words")
    sizes = materialize(lexical.totals(words), "totals")
    lengths = rhythm.length_stats(words).select("speaker_id", "median", "long_share", "cv")
    grammar = syntax.syntax_profile(tagged_rows).select("speaker_id", "fragment_share", "negations", "share_full")
    address = register.address_rate(utts, sizes, lang).select("speaker_id", F.col("count").alias("address_count"), F.col("per_1k").alias("address_per_1k"))
    prefs = register.preference_counts(utts, lang).groupBy("speaker_id").agg(F.array_sort(F.collect_list(F.struct("ord", "use", "avoid", "use_count", "avoid_count"))).alias("preferences"))
    rates = materialize(discourse.marker_rates(discourse.marker_counts_by_recording(utts, lang), sizes), "rates")
    absent = discourse.absent_markers(rates, sizes, lang).select("speaker_id", "category", "marker", "ord", F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("per_1k"), F.lit(0).cast("long").alias("recordings"))
    marks = rates.unionByName(absent).groupBy("speaker_id").agg(F.array_sort(F.collect_list(F.struct("ord", "category", "marker", "count", "per_1k", "recordings"))).alias("markers"))
    out = sizes.select("speaker_id", "words", "recordings")
    for part in (lengths, grammar, address, prefs, marks):  # a subject that a part knows nothing of keeps its other measures
        out = out.join(part, "speaker_id", "left")
    out = out.withColumns({"address_count": F.coalesce("address_count", F.lit(0)), "address_per_1k": F.coalesce("address_per_1k", F.lit(0.0)), "negations": F.coalesce("negations", F.lit(0))})
    return out.withColumnRenamed("speaker_id", by)


def issues(drafts: DataFrame, targets: DataFrame, lang: str, draft_id: str, speaker: str = "speaker_id") -> DataFrame:
    """(draft_id, speaker, metric, expected, got, feedback, weight), one row an issue. ``drafts`` has both id columns."""
    t_text = LEXICONS[lang].text
    t, d = F.col("t"), F.col("d")
    pairs = drafts.select(draft_id, speaker, F.struct(*METRICS).alias("d")).join(targets.select(speaker, F.struct(*METRICS).alias("t")), speaker)

    def issue(metric, expected, got, feedback, weight: float = 1.0) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(metric).alias("metric"), as_col(expected).alias("expected"), as_col(got).alias("got"), as_col(feedback).alias("feedback"), F.lit(weight).alias("weight"))

    pc = lambda c: F.concat(F.round(c * 100).cast("int"), F.lit("%"))
    med = lambda p: F.concat(F.lit("median "), F.bround(p["median"], 0).cast("int"))
    cv = lambda p: F.concat(F.lit("CV "), p["cv"])
    length = F.when(d["median"] > 1.4 * t["median"], issue("utterance_length", med(t), med(d), f"Half of the utterances are longer than this voice has breath for. Break them where it would pause, and link what belongs together by a comma or {t_text['chain_words']}.", 2.0)).when(
        d["median"] < 0.6 * t["median"], issue("utterance_length", med(t), med(d), f"The pieces are shorter than this voice makes them. Link some by a comma or {t_text['chain_words']}.", 1.0)
    )
    runs = F.when((t["long_share"] >= 0.15) & (d["long_share"] < F.greatest(F.lit(0.05), t["long_share"] - 0.2)), issue("long_runs", pc(t["long_share"]), pc(d["long_share"]), "Long runs are missing. Let one utterance in four go on for more than a dozen words without a full stop.", 2.0)).when(
        d["long_share"] > t["long_share"] + 0.25, issue("long_runs", pc(t["long_share"]), pc(d["long_share"]), "Long runs crowd out the short pieces. End some of them earlier.", 2.0)
    )
    rhythm = F.when(d["cv"] < F.least(F.lit(0.45), 0.6 * t["cv"]), issue("rhythm_variation", cv(t), cv(d), "The lengths hardly differ. Put very short pieces beside long ones."))
    fragments = F.when(d["fragment_share"] < t["fragment_share"] - 0.12, issue("fragments", pc(t["fragment_share"]), pc(d["fragment_share"]), f"Nearly every utterance has its verb. Leave it out here and there ({t_text['fragment']})."))
    enough = (d["negations"] >= 2) & t["share_full"].isNotNull()
    negation = F.when(enough & (d["share_full"] > t["share_full"] + 0.25), issue("negation", pc(t["share_full"]), pc(d["share_full"]), t_text["too_formal"])).when(
        enough & (d["share_full"] < t["share_full"] - 0.35), issue("negation", pc(t["share_full"]), pc(d["share_full"]), t_text["too_casual"])
    )
    address = F.when((t["address_per_1k"] >= 10) & (d["address_count"] == 0) & (d["words"] >= 100), issue("address", "talks to the listener", "never", "Nobody is spoken to. Address whoever listens.", 2.0))

    def preference(x: Column) -> Column:
        pt, pd = x["a"], x["b"]
        strong = (pt["use_count"] >= 5) & (pt["use_count"] >= 5 * F.greatest(pt["avoid_count"], F.lit(1)))
        rate = pt["avoid_count"] / t["words"]
        over = F.when(rate == 0, pd["avoid_count"] >= 1).otherwise(pd["avoid_count"] > F.greatest(3 * rate * d["words"], F.lit(2.0)))
        expected = F.when(rate == 0, F.lit("never")).otherwise(F.concat(F.lit("~"), F.format_number(rate * d["words"], 1), F.lit("×")))
        return F.when(strong & over, issue(F.concat(F.lit("prefer:"), pt["use"]), expected, F.concat(F.lit("« "), pt["avoid"], F.lit(" » "), pd["avoid_count"], F.lit("×")), F.concat(F.lit("This voice has « "), pt["use"], F.lit(" » where the draft has « "), pt["avoid"], F.lit(" ».")), 2.0))

    def marker(x: Column) -> Column:
        mt, md = x["a"], x["b"]
        name, got = F.concat(F.lit("marker:"), mt["marker"]), md["count"]
        times = F.concat(got, F.lit("×"))
        expected = mt["per_1k"] * d["words"] / 1000
        about = F.concat(F.lit("~"), F.bround(expected, 0).cast("int"), F.lit("×"))
        known = (mt["count"] >= 10) & (mt["recordings"] >= 3)
        core = (mt["recordings"] == t["recordings"]) & (mt["per_1k"] >= 4)
        say = lambda a, b: F.concat(F.lit(a), mt["marker"], F.lit(b))
        return (
            F.when((mt["count"] == 0) & (t["words"] >= LEAST_WORDS_FOR_ABSENCE) & (got > 0), issue(name, "never", times, say("« ", " » is not a word of this voice. Take it out."), 1.5))
            .when(known & core & (expected >= 2) & (got == 0), issue(name, about, "0×", say("« ", " » is missing, though this voice cannot do long without it.")))
            .when(known & ~(core & (expected >= 2) & (got == 0)) & (got >= F.greatest(F.lit(4.0), 3 * expected)), issue(name, about, times, say("« ", " » comes far more often than this voice has it. Keep a few."), 1.5))
        )

    zipped = lambda field: F.zip_with(t[field], d[field], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    singles = F.array(length, runs, rhythm, fragments, negation, address)
    found = F.array_compact(F.concat(singles, F.transform(zipped("preferences"), preference), F.transform(zipped("markers"), marker)))
    return pairs.select(draft_id, speaker, F.explode(found).alias("i")).select(draft_id, speaker, "i.*")


def scores(found: DataFrame, drafts: DataFrame, draft_id: str, judged: DataFrame | None = None) -> DataFrame:
    """The weight of all issues of a draft, 0 where there is none (AGG31). ``judged``: the drafts that met a profile, unless all
    did; the others have neither a score nor a number of issues."""
    total = found.groupBy(draft_id).agg(F.round(F.sum("weight"), 2).alias("score"), F.count("*").alias("issues"))
    rows = drafts.select(draft_id).join(total, draft_id, "left")
    met = F.lit(True)
    if judged is not None:
        rows, met = rows.join(judged.select(draft_id, F.lit(True).alias("met")), draft_id, "left"), F.col("met")
    return rows.select(draft_id, F.when(met, F.coalesce("score", F.lit(0.0))).alias("score"), F.when(met, F.coalesce("issues", F.lit(0)).cast("long")).alias("issues"))


def best_versions(scored: DataFrame, generation: str, version: str) -> DataFrame:
    """The version with the lowest score; of equals the later one. One that was not judged comes after all that were."""
    order = Window.partitionBy(generation).orderBy(F.asc_nulls_last("score"), F.desc(version))
    return scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def draft_profiles(drafts: DataFrame, lang: str, draft_id: str, tagger=None) -> DataFrame:
    """Profiles of plain texts (draft_id, text): split, tagged and measured like speech (CR13)."""
    from voxloom.operators import annotate, segment, syntax

    parts = segment.utterances_from_text(drafts, draft_id, F.lit(LEXICONS[lang].space_before_marks))
    utts = parts.select(F.col(draft_id).alias("speaker_id"), F.col(draft_id).alias("recording_id"), F.col("index").cast("long").alias("utt_id"), F.col("index").cast("int").alias("index"), "text", X.norm(F.col("text")).alias("norm"))
    tagged = annotate.annotate(utts, lang, tagger or annotate.RuleTagger)
    tagged = materialize(tagged, "tagged")
    words = syntax.token_rows(tagged).select("speaker_id", "recording_id", "utt_id", F.col("pos_i").alias("pos"), "w")
    return profile(utts, words, syntax.syntax_rows(tagged, lang), lang, by=draft_id)
