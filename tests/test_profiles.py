"""Profile operators on hand-made rows, against plain Python where there is a choice of method."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import annotate, base, critic, discourse, lexical, register, rhythm, syntax

WORDS = "speaker_id string, recording_id string, utt_id long, pos int, w string"
UTTS = "speaker_id string, recording_id string, utt_id long, index int, text string"


def words_of(spark, texts, speaker="s"):
    return spark.createDataFrame([(speaker, rec, u, k, w) for u, (rec, text) in enumerate(texts) for k, w in enumerate(text.lower().split())], WORDS)


def utts_of(spark, texts, speaker="s"):
    return spark.createDataFrame([(speaker, rec, u, u, t) for u, (rec, t) in enumerate(texts)], UTTS).withColumn("norm", X.norm(F.col("text")))


def plain_mattr(tokens, window):
    if len(tokens) < window:
        return round(len(set(tokens)) / len(tokens), 3)
    parts = [len(set(tokens[i : i + window])) for i in range(len(tokens) - window + 1)]
    return round(sum(parts) / len(parts) / window, 3)


def test_mattr_equals_brute_force(spark):
    rng = random.Random(1)
    for window in (2, 5, 100):
        texts = [("r%d" % (k % 3), " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))) for k in range(30)]
        stream = " ".join(t for _, t in texts).split()
        assert lexical.mattr(words_of(spark, texts), window).first()["mattr"] == plain_mattr(stream, window)


def test_counts_and_ratios(spark):
    w = words_of(spark, [("r1", "a b b c"), ("r2", "b it's it's it's")])
    got = {r["w"]: (r["count"], r["recordings"]) for r in lexical.word_counts(w).collect()}
    assert got == {"a": (1, 1), "b": (3, 2), "c": (1, 1), "it's": (3, 1)}
    b = spark.createDataFrame([("it's", 0.1)], "w string, freq double")
    row = lexical.against_baseline(w, b).first()
    assert (row["w"], row["log2_ratio"], row["per_1k"]) == ("it's", 1.91, 375.0)
    assert lexical.totals(w).first()[1:] == (2, 2, 8, 4)


def test_length_statistics(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 40) for _ in range(57)]
    row = rhythm.length_stats(words_of(spark, [("r", "x " * n) for n in sizes])).first()
    cut = statistics.quantiles(sizes, n=10)
    assert (row["mean"], row["median"]) == (round(statistics.mean(sizes), 1), statistics.median(sizes))
    assert abs(row["p10"] - cut[0]) < 1e-9 and abs(row["p90"] - cut[-1]) < 1e-9
    assert row["cv"] == round(statistics.pstdev(sizes) / statistics.mean(sizes), 2)
    few = rhythm.length_stats(words_of(spark, [("r", "x y")] * 9)).first()
    assert few["p10"] is None and few["cv"] == 0
    bins = {r["words"]: r["count"] for r in rhythm.histogram(words_of(spark, [("r", "x " * n) for n in sizes])).collect()}
    assert bins["36+"] == sum(n >= 36 for n in sizes) and sum(bins.values()) == 57 and len(bins) == 6


def test_openings_break_ties_by_first_use(spark):
    w = words_of(spark, [("r", "b x"), ("r", "a x"), ("r", "a y"), ("r", "b y"), ("r", "c")])
    assert [r["words"] for r in rhythm.top_starts(w).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["words"] for r in rhythm.top_starts(w, bigrams=True).orderBy("rank").collect()] == ["b x", "a x", "a y", "b y"]


def test_questions(spark):
    u = utts_of(spark, [("r", "That's it, right?"), ("r", "Who left?"), ("r", "No.")])
    row = rhythm.question_block(u, "en").first()
    assert (row["questions"], row["tag_questions"]) == (2, 1)


def round_robin(rows, k):
    """The procedure that ``spread`` expresses with windows."""
    by = {}
    for rec, order, index, text in sorted(rows, key=lambda r: r[1]):
        by.setdefault(rec, []).append((not 4 <= len(text.split()) <= 30, index, text))
    for q in by.values():
        q.sort()
    picked = []
    while len(picked) < k and any(by.values()):
        for q in by.values():
            if q and len(picked) < k:
                t = q.pop(0)[2]
                if t not in picked:
                    picked.append(t)
    return picked


def test_examples_spread_over_recordings(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [("r%d" % rng.randint(0, 3), o, o, " ".join(["w%d" % rng.randint(0, 4)] * rng.choice([1, 4, 5, 31]))) for o in range(25)]
        df = spark.createDataFrame([("f", *r) for r in rows], "f string, recording_id string, rec_order int, index int, text string")
        assert [r["text"] for r in base.spread(df, ["f"], 4).orderBy("pick").collect()] == round_robin(rows, 4)


def test_markers_and_absence(spark):
    u = utts_of(spark, [("r1", "So, I mean, it's good."), ("r2", "I mean, yeah! Yeah, you know."), ("r2", "Perfect.")])
    sizes = spark.createDataFrame([("s", 100)], "speaker_id string, words int")
    rates = discourse.marker_rates(discourse.marker_counts_by_recording(u, "en"), sizes)
    got = {r["marker"]: (r["count"], r["recordings"], r["per_1k"]) for r in rates.collect()}
    assert got == {"so (initial)": (1, 1, 10.0), "I mean": (2, 2, 20.0), "yeah": (2, 1, 20.0), "you know": (1, 1, 10.0), "perfect": (1, 1, 10.0)}
    assert discourse.absent_markers(rates, sizes, "en").count() == 54 - 5
    assert discourse.marker_examples(u, "en").where("marker = 'I mean'").count() == 2


def plain_phrases(texts):
    counts, recs = Counter(), {}
    for rec, t in texts:
        ws = t.split()
        for n in (3, 4, 5):
            for i in range(len(ws) - n + 1):
                g = tuple(ws[i : i + n])
                counts[g] += 1
                recs.setdefault(g, set()).add(rec)
    keep = {g for g, c in counts.items() if c >= 3 and len(recs[g]) >= min(2, len({r for r, _ in texts}))}
    within = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
    out = [g for g in keep if not any(len(h) > len(g) and within(g, h) and counts[h] >= 0.8 * counts[g] for h in keep)]
    return [" ".join(g) for g in sorted(out, key=lambda g: (-counts[g] * len(g), g))[:40]]


def test_signature_phrases_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [("r%d" % rng.randint(0, 2), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame([("s", rec, u, t.split()) for u, (rec, t) in enumerate(texts)], "speaker_id string, recording_id string, utt_id long, ws array<string>")
    assert [r["phrase"] for r in discourse.signature_phrases(df).orderBy("rank").collect()] == plain_phrases(texts)


def test_repeats(spark):
    u = utts_of(spark, [("r", "very very good"), ("r", "the the cat"), ("r", "no, no"), ("r", "go go go"), ("r", "that that works"), ("r", "5 5")])
    got = sorted((r["word"], r["kind"], r["run"]) for r in discourse.repeats(u, "en").collect())
    assert got == [("go", "emphatic", 3), ("go", "stutter", 2), ("the", "stutter", 2), ("very", "emphatic", 2)]


def test_register(spark):
    u = utts_of(spark, [("r", "Yeah, I'm gonna do it, yeah."), ("r", "I am going to the sea; going to eat. A bunch of stuff, you know.")])
    prefs = {r["use"]: (r["use_count"], r["avoid_count"]) for r in register.preference_counts(u, "en").collect()}
    assert prefs["yeah"] == (2, 0) and prefs["gonna"] == (1, 1) and prefs["I'm"] == (1, 1)
    fam = Counter(r["word"] for r in register.familiar_matches(u, "en").collect())
    assert fam == {"yeah": 2, "gonna": 1, "a bunch of": 1, "stuff": 1}
    sizes = spark.createDataFrame([("s", 20)], "speaker_id string, words int")
    assert register.address_rate(u, sizes, "en").first()[1:] == (1, 50.0)


def syntax_of(spark, texts, lang):
    return {r["text"]: r for r in syntax.syntax_rows(annotate.annotate(utts_of(spark, [("r", t) for t in texts]), lang), lang).collect()}


def test_syntax_english(spark):
    rows = syntax_of(spark, ["Look at the boat.", "I didn't go.", "It is not good.", "The letter was found by them.", "No way!", "They left because it rained."], "en")
    assert rows["Look at the boat."]["imperatives"] == ["look"] and rows["They left because it rained."]["imperatives"] == []
    assert rows["I didn't go."]["negations"] == ["informal"] and rows["It is not good."]["negations"] == ["full"]
    assert rows["The letter was found by them."]["passive"] and not rows["I didn't go."]["passive"]
    assert rows["No way!"]["clauses"] == 0 and rows["They left because it rained."]["clauses"] == 2
    assert rows["They left because it rained."]["subordinators"] == 1


def test_syntax_french(spark):
    rows = syntax_of(spark, ["Regardez le pont.", "Je sais pas.", "Je ne sais pas.", "La lettre est trouvée.", "Elle est tombée."], "fr")
    assert rows["Regardez le pont."]["imperatives"] == ["regardez"]
    assert rows["Je sais pas."]["negations"] == ["informal"] and rows["Je ne sais pas."]["negations"] == ["full"]
    assert rows["La lettre est trouvée."]["passive"]


def test_own_text_has_no_issues_and_formal_text_has(spark):
    own = "So, look, it's easy. You know, I mean, you grab it. Right? You don't need much, you just take it, and then you cut it, and you stir it, and you wait a bit. Yeah. You can't go wrong. Perfect."
    formal = "One should consider that the preparation of the ingredients is not a simple matter, however it is necessary to proceed with considerable care. It is not possible to overstate that one must not neglect the temperature of the oven during the preparation of this dish."
    texts = [("r%d" % k, p) for k in range(3) for p in own.split(". ")]
    u = utts_of(spark, [(rec, t if t.endswith(("?", ".")) else t + ".") for rec, t in texts])
    tagged = annotate.annotate(u, "en")
    w = syntax.token_rows(tagged).select("speaker_id", "recording_id", "utt_id", F.col("pos_i").alias("pos"), "w")
    target = critic.profile(u, w, syntax.syntax_rows(tagged, "en"), "en")
    drafts = spark.createDataFrame([("own", "s", own), ("formal", "s", formal)], "draft string, speaker_id string, text string")
    measured = critic.draft_profiles(drafts, "en", "draft").join(drafts.select("draft", "speaker_id"), "draft")
    found = critic.issues(measured, target, "en", "draft")
    by = {r["draft"]: (r["score"], r["issues"]) for r in critic.scores(found, drafts, "draft").collect()}
    assert by["own"] == (0.0, 0) and by["formal"][0] >= 4
    metrics = {r["metric"] for r in found.where("draft = 'formal'").collect()}
    assert {"utterance_length", "negation"} <= metrics


def test_every_draft_meets_the_profile_of_its_language(spark):
    from voxloom.plans import queries

    d = "/root/testdata/sf0.01"
    langs = {r["version_id"]: r["lang"] for r in spark.read.parquet(f"{d}/versions.parquet").select("version_id", base.text_language(F.col("text")).alias("lang")).collect()}
    assert {"en", "fr", None} == set(langs.values())
    spoken = {lang: {r["speaker_id"] for r in queries._words(spark, d, lang).select("speaker_id").distinct().collect()} for lang in ("en", "fr")}
    speaker = {r["version_id"]: r["speaker_id"] for r in spark.read.parquet(f"{d}/versions.parquet").collect()}
    scored = {r["version_id"]: r["score"] for r in queries.agg31_style_scores(spark, d).collect()}
    assert set(scored) == set(speaker)
    met = {v for v, score in scored.items() if score is not None}
    assert met == {v for v, lang in langs.items() if lang and speaker[v] in spoken[lang]} and {langs[v] for v in met} == {"en", "fr"}


def test_language_of_drafts(spark):
    texts = [("The neighbours watched the old boat, and we left.", "en"), ("Les voisins cherchaient la cloche, et nous sommes partis.", "fr"), ("Die Nachbarn suchten das Boot, und wir gingen.", None), ("我不知道。", None), ("", None), (None, None)]
    rows = spark.createDataFrame(texts, "text string, want string").select("want", base.text_language(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_unjudged_versions_have_no_score_and_are_not_the_best(spark):
    drafts = spark.createDataFrame([("a",), ("b",), ("c",)], "draft string")
    found = spark.createDataFrame([("b", 2.0)], "draft string, weight double")
    got = critic.scores(found, drafts, "draft", drafts.where("draft <> 'c'"))
    assert {r["draft"]: (r["score"], r["issues"]) for r in got.collect()} == {"a": (0.0, 0), "b": (2.0, 1), "c": (None, None)}
    scored = spark.createDataFrame([("g", 1, 3.0), ("g", 2, None)], "generation string, version int, score double")
    assert critic.best_versions(scored, "generation", "version").first()["version"] == 1


BY_LANGUAGE = "agg11_pronouns agg18_questions win2_question_examples agg21_marker_examples jn4_absent_markers agg23_repeats agg26_preferences agg27_address agg28_familiar_words agg9_distinctive_by_pos agg19_imperative_verbs agg4_top_lemmas card_style_cards snk11_reports".split()


def test_operators_of_a_language_run_on_french_too(spark):
    from voxloom.plans import queries

    d = "/root/testdata/sf0.01"
    french = {r["speaker_id"] for r in queries._words(spark, d, "fr").select("speaker_id").distinct().collect()}
    for name in BY_LANGUAGE:
        got = {r["speaker_id"] for r in queries.QUERIES[f"{name}_fr"](spark, d).select("speaker_id").collect()}
        assert got <= french and (got or name == "agg28_familiar_words"), name  # no French familiar word in these tables
    assert {r["speaker_id"] for r in queries.QUERIES["agg11_pronouns_fr"](spark, d).where("pronoun = 'je'").collect()} == french


def test_sql_of_the_french_twins(spark):
    duckdb = pytest.importorskip("duckdb")
    from voxloom.plans import oracle, queries

    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("utterances", "parsed", "transcripts"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in BY_LANGUAGE:
        if name in oracle.SQL:
            want = db.execute(oracle.SQL[f"{name}_fr"])
            columns = [c[0] for c in want.description]
            rows = Counter(want.fetchall())
            assert Counter(tuple(r) for r in queries.QUERIES[f"{name}_fr"](spark, d).select(*columns).collect()) == rows, name
