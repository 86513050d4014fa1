from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.lexicon import ENGLISH, FRENCH, java_pattern, markers, pattern, preferences, standalone


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normal_forms(spark):
    rows = [("L’Été, OK!",), (None,), ("",)]
    assert values(spark, rows, "t string", X.norm(F.col("t"))) == ["l'été, ok!", None, ""]
    assert values(spark, rows, "t string", X.quote_norm(F.col("t"))) == ["l'été ok", None, ""]
    assert values(spark, [("--Moi",)], "t string", X.lookup_form(F.col("t"))) == ["moi"]
    assert values(spark, [("a?",), ("b",), ("",)], "t string", X.ends_with(F.col("t"))) == ["?", "", ""]
    assert values(spark, [("a  b c ",), ("",)], "t string", X.whitespace_words(F.col("t"))) == [3, 0]


def test_spacing_of_marks(spark):
    rows = [("c 'est bon , non ?",), ("well -known , right !",)]
    assert values(spark, rows, "t string", X.space_marks(F.col("t"), F.lit(True)))[0] == "c'est bon, non ?"
    assert values(spark, rows, "t string", X.space_marks(F.col("t"), F.lit(False)))[1] == "well-known, right!"
    assert values(spark, [(["l'", "huile"],), (["it", "'s"],), (["do", "n't"],), (["a", "b"],)], "t array<string>", X.join_tokens(F.col("t"))) == ["l'huile", "it's", "don't", "a b"]


def test_quotes(spark):
    rows = [("the cat", "I saw The Cat!"), ("I saw … cat", "I saw the cat"), ("cat … saw", "I saw the cat"), ("...", "x"), ("", "x"), (None, "x"), ("saw [...] cat", "I saw, the cat")]
    assert [bool(v) for v in values(spark, rows, "q string, p string", X.quote_in(F.col("q"), F.col("p")))] == [True, True, False, False, False, False, True]


def test_cleaning(spark):
    rows = [("# Title\n**Bold**\n- one\n[he laughs]\n\n\n\n\"So we went.\"",), (None,)]
    got = values(spark, rows, "t string", X.clean_draft(F.col("t")))
    assert got == ["one\n\n\"So we went.", None]
    assert values(spark, [("<think>a\nb</think> yes",)], "t string", F.trim(X.without_thinking(F.col("t")))) == ["yes"]


def test_slugs(spark):
    assert [X.slug(t) for t in ("Été à Nice!", "🎉", None, "a" * 80)] == ["ete-a-nice", "recording", "recording", "a" * 60]
    assert values(spark, [("Le Pont",), (None,)], "t string", X.slugify(F.col("t"))) == ["le-pont", "recording"]


def test_numbers_in_words(spark):
    assert values(spark, [(0.0,), (10.0,), (2.0,), (1.0,)], "r double", X.every(F.col("r"))) == ["never", "about once every 100 words", "about once every 500 words", "occasionally"]
    assert values(spark, [(0.1,), (0.3,), (0.5,), (0.8,), (0.9,)], "r double", X.share_words(F.col("r"))) == ["rarely", "about a third of the time", "about half the time", "most of the time", "almost always"]
    assert values(spark, [(0.23,), (None,)], "r double", X.percent(F.col("r"))) == ["25%", "a few"]
    assert values(spark, [(4.0, 2.0), (1.0, 2.0), (0.0, 2.0), (1.0, None)], "a double, b double", X.ratio(F.col("a"), F.col("b"))) == ["×2.0", "÷2.0", "never", "–"]
    assert values(spark, [(3725.4,)], "s double", X.clock(F.col("s"))) == ["1:02:05"]
    assert values(spark, [(3, 2000), (1, 0)], "c int, n int", X.per_1k(F.col("c"), F.col("n"))) == [1.5, 0.0]


def count(spark, form, text):
    return spark.createDataFrame([(text,)], "t string").select(F.regexp_count("t", F.lit(java_pattern(pattern(form))))).first()[0]


def test_marker_forms(spark):
    forms = {label: form for _, label, form in markers(FRENCH)}
    assert len(forms) == 64 and len(markers(ENGLISH)) == 54
    assert count(spark, forms["voilà"], "voilà, revoilà") == 1
    assert count(spark, forms["bon"], "bon, on y va, bon je pars, c'est bon") == 2
    assert count(spark, forms["quoi (final)"], "c'est ça, quoi.") == 1 and count(spark, forms["quoi (final)"], "quoi ?") == 0
    assert count(spark, forms["après (initial)"], "et après on part") == 1 and count(spark, forms["après (initial)"], "juste après") == 0
    assert count(spark, forms["enfin (repair)"], "je pars enfin non") == 1 and count(spark, forms["enfin (repair)"], "enfin!") == 0
    assert count(spark, standalone("on"), "qu'on, on") == 1
    english = {label: form for _, label, form in markers(ENGLISH)}
    assert count(spark, english["so (initial)"], "so, we go, so so") == 2 and count(spark, english["like (filler)"], "it was, like, big") == 1
    assert count(spark, english["you know"], "you know what, you know") == 1
    assert len(preferences(ENGLISH)) == 6 and len(preferences(FRENCH)) == 4
