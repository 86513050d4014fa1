"""What depends on parts of speech: clauses, fragments, imperatives, passives, negation, lemmas (AGG4, AGG5, AGG14, AGG15, AGG19, AGG20, AGG24, AGG25, FN16-FN19, JN18, WIN6, WIN7).

Everything is computed inside the row of an utterance, over its array of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS, Lexicon
from voxloom.operators.base import spread

# Verbs whose compound tenses take être, reflexive forms, parts of speech of style words.
ETRE_VERBS = "aller venir arriver partir sortir entrer rentrer rester tomber naître mourir devenir revenir retourner monter descendre passer apparaître".split()
REFLEXIVE = "me m' te t' se s'".split()
STYLE_POS = "ADV INTJ PRON CCONJ SCONJ ADP DET AUX PART".split()
TOK = "tokens"


def _children(t: Column, test) -> Column:
    return F.exists(TOK, lambda x: (x["head"] == t["i"]) & (x["i"] != t["i"]) & test(x))


def _finite(t: Column) -> Column:
    return F.array_contains(t["verbform"], "Fin")


def _previous(t: Column) -> Column:
    """The last token before t that is not white space (WIN6)."""
    return F.element_at(F.concat(F.array(F.lit(None).cast(_token_type())), F.filter(TOK, lambda x: (x["i"] < t["i"]) & ~x["is_space"])), -1)


def _token_type() -> str:
    from voxloom.operators.annotate import TOKEN

    return TOKEN


def _before(t: Column, k: int = 4) -> Column:
    """The k tokens before t (WIN7)."""
    return F.slice(TOK, F.greatest(t["i"] - k + 1, F.lit(1)), F.least(t["i"], F.lit(k)))


def is_imperative(t: Column, lex: Lexicon) -> Column:
    """A command: at the start of a clause, by ending in French, a bare verb without a subject in English (FN16)."""
    prev = _previous(t)
    starts = prev.isNull() | prev["is_punct"] | prev["lw"].isin(*lex.imperative_after)
    if lex.imperative == "fr_endings":
        shape = (F.length(t["lw"]) >= 4) & (t["lw"].endswith("ez") | (t["lw"].endswith("ons") & t["pos"].isin("VERB", "AUX"))) & ~t["lw"].isin(*lex.imperative_stop)
    else:
        shape = (t["tag"] == "VB") & t["pos"].isin("VERB", "AUX") & ~_children(t, lambda c: c["dep"].isin("nsubj", "nsubjpass", "expl"))
    return t["is_word"] & starts & shape


def imperatives(lex: Lexicon) -> Column:
    return F.transform(F.filter(TOK, lambda t: is_imperative(t, lex)), lambda t: t["lw"])


def clause_heads(lex: Lexicon) -> Column:
    """Heads of finite clauses; commands count (FN18)."""
    def head(t: Column) -> Column:
        free = ~t["dep"].startswith("aux") & (t["dep"] != "cop")
        fin = _finite(t) | _children(t, lambda c: (c["dep"].startswith("aux") | (c["dep"] == "cop")) & _finite(c))
        return (free & fin) | is_imperative(t, lex)

    return F.filter(TOK, head)


def is_passive(t: Column, lex: Lexicon) -> Column:
    """A passive verb; in French not the tenses with être and not reflexives (FN19)."""
    if lex.code == "en":
        return (t["pos"] == "VERB") & _children(t, lambda c: c["dep"] == "auxpass")
    near = F.transform(_before(t), lambda x: x["lw"])
    twice = lambda w: F.size(F.filter(near, lambda x: x == w)) >= 2
    reflexive = F.exists(near, lambda x: x.isin(*REFLEXIVE)) | twice("vous") | twice("nous")
    aux = _children(t, lambda c: c["dep"].isin("aux:pass", "aux:tense") & (c["lemma"] == "être"))
    return (t["pos"] == "VERB") & F.array_contains(t["verbform"], "Part") & ~t["lemma"].isin(*ETRE_VERBS) & aux & ~reflexive


def negations(lex: Lexicon) -> Column:
    """One "full" or "informal" for each verbal negation: ne kept or dropped, not written out or contracted (AGG24, AGG25)."""
    def kind(t: Column) -> Column:
        if lex.negation == "fr_ne":
            near = _before(t)
            verbal = F.exists(near, lambda x: x["pos"].isin("VERB", "AUX"))
            kept = F.exists(near, lambda x: x["lw"].isin(*lex.ne))
            return F.when(t["lw"].isin(*lex.negation_words) & verbal, F.when(kept, "full").otherwise("informal"))
        prev = F.get(TOK, t["i"] - 1)
        out = F.when(F.coalesce(prev["pos"].isin("AUX", "VERB"), F.lit(False)), F.when(prev["text"].rlike("^['’]"), "informal").otherwise("full"))
        return F.when(t["lw"] == "n't", "informal").when((t["lw"] == "not") & (t["i"] > 0), out)

    return F.array_compact(F.transform(TOK, kind))


def syntax_rows(tagged: DataFrame, lang: str) -> DataFrame:
    """Per utterance with a word: n_words, clauses, subordinators, imperative verbs, passive, negations."""
    lex = LEXICONS[lang]
    n = F.size(F.filter(TOK, lambda t: t["is_word"]))
    sub = F.size(F.filter(TOK, lambda t: (t["pos"] == "SCONJ") | F.array_contains(t["prontype"], "Rel")))
    return tagged.select(
        "speaker_id", "recording_id", "utt_id", "index", "text", n.alias("n_words"), F.size(clause_heads(lex)).alias("clauses"), sub.alias("subordinators"), imperatives(lex).alias("imperatives"), F.exists(TOK, lambda t: is_passive(t, lex)).alias("passive"), negations(lex).alias("negations")
    ).where("n_words > 0")


def syntax_profile(rows: DataFrame) -> DataFrame:
    """One row a speaker (AGG14, AGG15, AGG19, AGG20, AGG24/25)."""
    def total(kind: str) -> Column:
        return F.sum(F.size(F.filter("negations", lambda x: x == kind)))

    full, informal = total("full"), total("informal")
    agg = rows.groupBy("speaker_id").agg(
        F.count("*").alias("utterances"), F.sum("n_words").alias("words"), F.round(F.avg("clauses"), 2).alias("clauses_per_utterance"), F.round(F.avg("subordinators"), 2).alias("subordinators_per_utterance"),
        F.round(F.avg((F.col("clauses") == 0).cast("int")), 3).alias("fragment_share"), F.round(100 * F.avg((F.size("imperatives") > 0).cast("int")), 1).alias("imperatives_per_100"), F.sum(F.col("passive").cast("long")).alias("passives"), full.alias("full"), informal.alias("informal"),
    )
    negs = F.col("full") + F.col("informal")
    return agg.select("speaker_id", "utterances", "words", "clauses_per_utterance", "subordinators_per_utterance", "fragment_share", "imperatives_per_100", X.per_1k(F.col("passives"), F.col("words")).alias("passive_per_1k"), negs.alias("negations"), F.when(negs > 0, F.round(F.col("full") / negs, 3)).alias("share_full"))


def imperative_verbs(rows: DataFrame, top: int = 15) -> DataFrame:
    counts = rows.select("speaker_id", "utt_id", F.explode("imperatives").alias("verb")).groupBy("speaker_id", "verb").agg(F.count("*").alias("count"), F.min("utt_id").alias("at"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("speaker_id").orderBy(F.desc("count"), "at", "verb"))).where(F.col("rank") <= top).select("speaker_id", "rank", "verb", "count")


def token_rows(tagged: DataFrame) -> DataFrame:
    return tagged.select("speaker_id", "recording_id", "utt_id", F.explode(F.filter(TOK, lambda t: t["is_word"])).alias("t")).select("speaker_id", "recording_id", "utt_id", F.col("t.i").alias("pos_i"), F.col("t.lw").alias("w"), "t.pos", F.lower("t.lemma").alias("lemma"))


def top_lemmas(tokens: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent lemmas of verbs, nouns, adjectives and adverbs, per thousand of all words (AGG4)."""
    size = tokens.groupBy("speaker_id").agg(F.count("*").alias("n"))
    counts = tokens.where(F.col("pos").isin("VERB", "NOUN", "ADJ", "ADV")).groupBy("speaker_id", "pos", "lemma").agg(F.count("*").alias("count"), F.min(F.struct("utt_id", "pos_i")).alias("at"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("speaker_id", "pos").orderBy(F.desc("count"), "at"))).where(F.col("rank") <= top)
    return ranked.join(size, "speaker_id").select("speaker_id", "pos", "rank", "lemma", "count", X.per_1k(F.col("count"), F.col("n")).alias("per_1k"))


def dominant_pos(tokens: DataFrame) -> DataFrame:
    """(speaker_id, w, pos): the part of speech a word mostly has; of equals the one seen first (AGG5)."""
    counts = tokens.groupBy("speaker_id", "w", "pos").agg(F.count("*").alias("c"), F.min(F.struct("utt_id", "pos_i")).alias("at"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("speaker_id", "w").orderBy(F.desc("c"), "at"))).where("rank = 1").select("speaker_id", "w", "pos")


def style_bucket() -> Column:
    """The bucket of a distinctive word by its part of speech (AGG9)."""
    return F.when(F.col("pos").isin(*STYLE_POS), "function_discourse").when(F.col("pos") == "ADJ", "evaluative").otherwise("content_topic")


def feature_examples(rows: DataFrame, repeated: DataFrame, familiar: DataFrame, k: int = 4) -> DataFrame:
    """(speaker_id, feature, pick, recording_id, index, text): four utterances for each thing that a profile counts (AGG15, AGG19, AGG20,
    AGG23-AGG25, AGG28). An utterance that has it twice takes two turns."""
    base = ["speaker_id", "recording_id", F.col("utt_id").alias("rec_order"), "index", "text"]
    of = lambda df, feature: df.select(F.lit(feature).alias("feature") if isinstance(feature, str) else feature.alias("feature"), *base)
    single = F.array_compact(F.array(F.when(F.col("clauses") == 0, "fragment"), F.when(F.size("imperatives") > 0, "imperative"), F.when(F.col("passive"), "passive")))
    negated = F.transform("negations", lambda n: F.concat(n, F.lit(" negation")))
    found = of(rows.withColumn("_f", F.explode(F.concat(single, negated))), F.col("_f")).unionByName(of(repeated, F.col("kind"))).unionByName(of(familiar.dropDuplicates(["utt_id"]), "familiar"))
    return spread(found, ["speaker_id", "feature"], k).select("speaker_id", "feature", "pick", "recording_id", "index", "text")
