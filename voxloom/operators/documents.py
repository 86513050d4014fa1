"""Profiles as documents: a nested JSON row a speaker, Markdown reports, style cards (SNK6, SNK8, SNK11, SNK12, CARD1-CARD11, FN8-FN14).

Lines are built as columns from tidy frames, for all speakers at once; each line has a section and an order, and a document
is the lines of a speaker in order. Only text leaves the cluster, one row a speaker.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS
from voxloom.operators.rhetoric import MEANINGS

LEAST_COUNT, LEAST_RECORDINGS, LEAST_WORDS = 5, 3, 2000
NOT_PRESCRIBED = ("channel",)
# What to do about a device that a speaker uses, in our words.
GUIDANCE = {
    "counterargument": "name what the listener may hold against it, and deal with that",
    "anecdote": "tell in two lines what happened once, then go on",
    "reframing": "put the usual view aside and say what it comes down to",
    "list": "line up three things without a pause",
    "emphatic_repetition": "let a word that matters come twice",
    "humor": "tease a little, themselves first",
    "authority": "mention having done it for years where advice is given",
    "rhetorical_question": "put a question and give the answer in the same breath",
    "contrast": "hold one choice against the other",
    "analogy": "borrow a picture from the kitchen, the street or the weather",
    "provocative_opening": "begin with a line nobody expects",
}


def _lines(df: DataFrame, section: int, part: int, text: Column, order: Column | None = None) -> DataFrame:
    return df.select("speaker_id", F.lit(section).alias("section"), F.lit(part).alias("part"), (F.lit(0.0) if order is None else order.cast("double")).alias("ord"), text.alias("line")).where("line is not null")


def assemble(lines: list[DataFrame], title: Column) -> DataFrame:
    """(speaker_id, document): the lines of each speaker in order under a title."""
    every = reduce(DataFrame.unionByName, lines)
    body = every.groupBy("speaker_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part", "ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("speaker_id", F.concat(title, F.lit("\n\n"), "body", F.lit("\n")).alias("document"))


def _heading(speakers: DataFrame, section: int, title: str) -> DataFrame:
    return _lines(speakers, section, -1, F.lit(f"## {title}\n"))


def _listed(df: DataFrame, item: Column, order: list, k: int) -> DataFrame:
    """(speaker_id, items): the first k items of each speaker joined by commas."""
    ranked = df.withColumn("_item", item).withColumn("_r", F.row_number().over(Window.partitionBy("speaker_id").orderBy(*order))).where(F.col("_r") <= k)
    return ranked.groupBy("speaker_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_item"))), lambda x: x["_item"]), ", ").alias("items"))


def strong_preferences(preferences: DataFrame) -> DataFrame:
    """Pairs of which one form is clearly preferred (CARD3)."""
    return preferences.where((F.col("use_count") >= 5) & (F.col("use_count") >= 5 * F.greatest("avoid_count", F.lit(1))))


def prescribable_markers(rates: DataFrame) -> DataFrame:
    """Markers frequent and spread enough to prescribe, with whether they are regular (CARD2)."""
    kept = rates.where((F.col("count") >= LEAST_COUNT) & (F.col("recordings") >= LEAST_RECORDINGS) & ~F.col("category").isin(*NOT_PRESCRIBED, "repair"))
    return kept.withColumn("regular", F.col("per_1k") >= 1000 / 600)


def style_cards(frames: dict[str, DataFrame], lang: str) -> DataFrame:
    """Rules for writing like each speaker, from measured frames (CARD1-CARD10).

    ``frames``: profile (words, address_per_1k, median, long_share, short_share, fragment_share, negations, share_full),
    preferences, pronouns, bigrams, imperatives, markers, absent, familiar, phrases, devices (device, count, recordings).
    """
    lex = LEXICONS[lang]
    p = frames["profile"]
    strong = strong_preferences(frames["preferences"])
    first = frames["pronouns"].where((F.col("pronoun") == lex.first_person) & (F.col("per_1k") / F.col("baseline_per_1k") > 1.5))
    shown = "I" if lex.first_person == "i" else lex.first_person
    marks = prescribable_markers(frames["markers"])
    display = lex.imperative_display
    verbs = frames["imperatives"].where("count >= 2")
    if display:
        verbs = verbs.where(F.col("verb").isin(*display)).replace(display, subset=["verb"])
    else:
        verbs = verbs.withColumn("verb", F.initcap("verb"))
    grammar = F.array(*[F.lit(w) for w in sorted(lex.grammar_words)])
    phrases = frames["phrases"].where(F.coalesce(F.col("kind") == "phrasing", F.lit(False)) & (F.col("recordings") >= LEAST_RECORDINGS) & (F.size(F.array_except(F.split(F.replace("phrase", F.lit("'"), F.lit("' ")), r"\s+"), grammar)) > 0))
    never = frames["absent"].where(~F.col("category").isin(*NOT_PRESCRIBED)).join(p.where(F.col("words") >= LEAST_WORDS).select("speaker_id"), "speaker_id", "left_semi").select("speaker_id", F.col("ord").cast("double").alias("o"), F.col("marker").alias("form"))
    never = never.unionByName(strong.where("avoid_count = 0").select("speaker_id", (F.col("ord") + 1000).cast("double").alias("o"), F.col("avoid").alias("form")))
    q = X.guillemets
    rhythm = F.when(F.col("long_share") >= 0.15, F.concat(F.lit("- Short and long alternate: "), X.percent(F.col("short_share")), F.lit(" of what is said comes in pieces of up to 7 words, "), X.percent(F.col("long_share")), F.lit(f" in runs of 13 and more that only commas and {lex.text['chain_words']} hold together."))).otherwise(
        F.concat(F.lit("- Short pieces, mostly of "), F.bround("median", 0).cast("int"), F.lit(" words ("), X.percent(F.col("short_share")), F.lit(" have up to 7); hardly a long run among them."))
    )
    negation = F.when((F.col("negations") >= 5) & (F.col("share_full") < 0.9), F.concat(F.lit("- " + lex.text["negation_card"].split("{freq}")[0]), X.share_words(1 - F.col("share_full")), F.lit(lex.text["negation_card"].split("{freq}")[1])))
    guide = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    quoted = frames["device_examples"].where("pick = 1").select("speaker_id", "device", "quote")
    devices = frames["devices"].where(F.col("recordings") >= 2).withColumn("guide", guide[F.col("device")]).join(quoted, ["speaker_id", "device"], "left")
    brief = frames["examples"].where((F.col("feature") == "fragment") & (X.whitespace_words(F.col("text")) <= 8))
    short = _listed(brief, q(F.col("text")), ["pick"], 3).withColumnRenamed("items", "short_fragments")
    lines = [
        _heading(p, 0, "Voice and address"),
        _lines(p, 0, 0, F.when(F.col("address_per_1k") >= 10, F.lit("- Address whoever listens, again and again."))),
        _lines(strong, 0, 1, F.concat(F.lit("- Say **"), "use", F.lit("**, not *"), "avoid", F.lit("* ("), "use_count", F.lit(" : "), "avoid_count", F.lit(").")), F.col("ord")),
        _lines(first, 0, 2, F.lit(f"- **{shown}** is everywhere: the speaker is part of what is told.")),
        _heading(p, 1, "Rhythm and sentences"),
        _lines(p, 1, 0, rhythm),
        _lines(p.join(short, "speaker_id", "left"), 1, 1, F.concat(F.lit("- No verb in "), (F.bround(F.col("fragment_share") * 10, 0) * 10).cast("int"), F.lit("% of the utterances"), F.coalesce(F.concat(F.lit(", such as "), "short_fragments"), F.lit("")), F.lit("."))),
        _lines(_listed(frames["bigrams"], q(F.col("words")), ["rank"], 8), 1, 2, F.concat(F.lit("- Begins with: "), "items", F.lit("."))),
        _lines(p, 1, 3, negation),
        _lines(_listed(verbs, q(F.col("verb")), ["rank"], 6), 1, 4, F.concat(F.lit("- Orders given: "), "items", F.lit("."))),
        _heading(p, 2, "Words that carry the voice"),
        _lines(marks.where("regular"), 2, 0, F.concat(F.lit("- **"), "marker", F.lit("**: "), X.every(F.col("per_1k"))), -F.col("per_1k")),
        _lines(_listed(marks.where("not regular"), F.concat(F.lit("*"), "marker", F.lit("*")), ["ord"], 1000), 2, 1, F.concat(F.lit("- Rarer: "), "items", F.lit("."))),
        _lines(_listed(frames["familiar"], F.col("word"), [F.desc("count"), "word"], 10), 2, 2, F.concat(F.lit("- Casual words, a few: "), "items", F.lit("."))),
        _lines(_listed(phrases, q(F.col("phrase")), ["rank"], 10), 2, 3, F.concat(F.lit("- Phrases that come back: "), "items", F.lit("."))),
        _heading(p, 3, "Never"),
        _lines(_listed(never, F.concat(F.lit("*"), "form", F.lit("*")), ["o", "form"], 1000), 3, 0, F.concat(F.lit("- Never: "), "items", F.lit("."))),
        _lines(p, 3, 1, F.lit(f"- Nothing that only paper says ({', '.join(lex.formal_connectors)}), and no markup.")),
        _heading(devices.select("speaker_id").distinct(), 4, "Rhetorical habits"),
        _lines(devices, 4, 0, F.concat(F.lit("- **"), F.replace("device", F.lit("_"), F.lit(" ")), F.lit("** ("), "count", F.lit("× in "), "recordings", F.lit(" recordings): "), "guide", F.coalesce(F.concat(F.lit(", as in "), q(F.col("quote"))), F.lit(""))), -F.col("count")),
        _heading(p, 5, "Keep it portable"),
        _lines(p, 5, 0, F.lit("- The manner carries over to any subject; the subjects of the recordings stay behind.\n- No greeting, farewell or request of a channel unless it is part of the task.")),
    ]
    return assemble(lines, F.concat(F.lit("# Style card: "), "speaker_id"))


FEATURES = {
    "fragment": "Without a verb", "imperative": "Orders", "passive": "Passives", "full negation": "Full negations", "informal negation": "Short negations",
    "stutter": "Words said again at once", "emphatic": "Words said again for weight", "familiar": "Casual words",
}
NOT_MEASURED = "- Not measured: how concrete the words are."


def reports(frames: dict[str, DataFrame], lang: str) -> DataFrame:
    """A readable report a speaker from the same frames: numbers, lists, and utterances that show them (SNK11, SNK12)."""
    p = frames["profile"]
    name = LEXICONS[lang].name
    pron = frames["pronouns"].where((F.col("count") > 0) | (F.coalesce("baseline_per_1k", F.lit(0.0)) >= 0.5))
    lemmas = frames["lemmas"].select("speaker_id", "pos", "rank", F.concat("lemma", F.lit(" "), "count").alias("shown"))
    by_pos = lemmas.groupBy("speaker_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), ", ").alias("items"))
    label = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    shown = frames["examples"].withColumn("label", label[F.col("feature")]).withColumn("place", F.array_position(F.array(*[F.lit(x) for x in FEATURES]), F.col("feature")) * 10 + F.col("pick"))
    meaning = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    devices = frames["devices"]
    order = F.array_position(F.array(*[F.lit(d) for d in MEANINGS]), F.col("device"))
    quotes = frames["device_examples"].withColumn("place", order * 10 + F.col("pick"))
    all_devices = p.select("speaker_id").crossJoin(F.broadcast(p.sparkSession.createDataFrame([(d,) for d in MEANINGS], "device string")))
    unseen = all_devices.join(devices.select("speaker_id").distinct(), "speaker_id", "left_semi").join(devices, ["speaker_id", "device"], "left_anti").withColumn("place", order)
    lines = [
        _lines(p, 0, 0, F.concat("recordings", F.lit(" recordings, "), "words", F.lit(f" words. Rates are per thousand words; ×N compares with general usage in {name}.\n"))),
        _heading(p, 1, "Words"),
        _lines(p, 1, 0, F.concat(F.lit("- Diversity (MATTR): **"), "mattr", F.lit("**"))),
        _lines(pron, 1, 1, F.concat(F.lit("- "), "pronoun", F.lit(": "), "per_1k", F.lit(" "), X.ratio(F.col("per_1k"), F.col("baseline_per_1k"))), F.col("ord")),
        _lines(_listed(frames["distinctive"], F.concat(F.lit("**"), "w", F.lit("** ("), "count", F.lit(")")), ["rank"], 15), 1, 2, F.concat(F.lit("- Distinctive: "), "items")),
        _lines(by_pos, 1, 3, F.concat(F.lit("- "), F.lower("pos"), F.lit(": "), "items"), F.ascii("pos")),
        _heading(p, 2, "Sentences"),
        _lines(p, 2, 0, F.concat(F.lit("- Length: median **"), "median", F.lit("**, long "), X.percent(F.col("long_share")), F.lit(", short "), X.percent(F.col("short_share")), F.lit(", variation "), "cv")),
        _lines(p, 2, 1, F.concat(F.lit("- Without a verb: "), X.percent(F.col("fragment_share")))),
        _lines(p, 2, 2, F.concat(F.lit(f"- {LEXICONS[lang].text['negation_label']}: "), F.coalesce(X.percent(F.col("share_full")), F.lit("n/a")), F.lit(" of "), "negations")),
        _lines(_listed(frames["openings"], F.concat("words", F.lit(" "), "count"), ["rank"], 12), 2, 3, F.concat(F.lit("- First words: "), "items")),
        _lines(_listed(frames["bigrams"], F.concat(X.guillemets(F.col("words")), F.lit(" "), "count"), ["rank"], 10), 2, 4, F.concat(F.lit("- First two words: "), "items")),
        _lines(_listed(frames["imperatives"], F.concat("verb", F.lit(" "), "count"), ["rank"], 15), 2, 5, F.concat(F.lit("- Verbs of orders: "), "items")),
        _lines(frames["questions"], 2, 6, F.concat(F.lit("- Questions: "), X.percent(F.col("share")), F.lit(", "), "tag_questions", F.lit(" of them tags"))),
        _lines(frames["question_examples"], 2, 7, F.concat(F.lit("  - "), "kind", F.lit(": "), "text"), F.when(F.col("kind") == "tag", F.col("pick")).otherwise(F.col("pick") + 10)),
        _lines(shown, 2, 8, F.concat(F.lit("  - "), "label", F.lit(": "), "text"), F.col("place")),
        _heading(p, 3, "Markers"),
        _lines(frames["markers"], 3, 0, F.concat(F.lit("- "), "marker", F.lit(": "), "count", F.lit(" ("), "per_1k", F.lit("), in "), "recordings", F.lit(" recordings")), -F.col("count")),
        _lines(_listed(frames["absent"], F.col("marker"), ["ord"], 1000), 3, 1, F.concat(F.lit("- Never used: "), "items")),
        _heading(p, 4, "Phrases"),
        _lines(_listed(frames["phrases"], F.concat(X.guillemets(F.col("phrase")), F.lit(" "), "count", F.coalesce(F.concat(F.lit(" "), "kind"), F.lit(""))), ["rank"], 40), 4, 0, F.concat(F.lit("- "), "items")),
        _heading(devices.select("speaker_id").distinct(), 5, "Rhetoric"),
        _lines(devices, 5, 0, F.concat(F.lit("- "), "device", F.lit(" ("), meaning[F.col("device")], F.lit("): "), "count", F.lit(" in "), "recordings", F.lit(" recordings")), -F.col("count")),
        _lines(quotes, 5, 1, F.concat(F.lit("  - "), "device", F.lit(": "), X.guillemets(F.col("quote")), F.lit(" "), "recording_id"), F.col("place")),
        _lines(_listed(unseen, F.col("device"), ["place"], 1000), 5, 2, F.concat(F.lit("- Not found: "), "items")),
        _lines(p, 6, 0, F.lit(NOT_MEASURED)),
        _lines(p.join(devices.select("speaker_id").distinct(), "speaker_id", "left_anti"), 6, 1, F.lit("- Not annotated: rhetorical devices.")),
    ]
    return assemble(lines, F.concat(F.lit("# Profile: "), "speaker_id"))


def as_json(profile: DataFrame, key: str = "speaker_id") -> DataFrame:
    """One JSON text a subject (SNK6)."""
    return profile.select(key, F.to_json(F.struct(*[c for c in profile.columns if c != key])).alias("json"))


def stamp(card: str) -> str:
    return hashlib.sha256(card.encode()).hexdigest()


def keep_edited(on_disk: str | None, stored_stamp: str | None, fresh: str, force: bool = False) -> tuple[str, bool]:
    """(card, whether it was written anew): a card that was edited by hand is kept unless forced (CARD11)."""
    if on_disk is None or force:
        return fresh, True
    untouched = stamp(on_disk) == stored_stamp if stored_stamp else on_disk == fresh
    return (fresh, True) if untouched else (on_disk, False)
