"""Languages, turns, sentences, mixtures, pieces: held-out accuracy, fixtures, round trips, awkward rows."""

import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import language, mixing, pieces, sentences, speech, tokens, turns

NOW, LATER = datetime(2024, 1, 1), datetime(2024, 2, 1)
SEG = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>"
TRANSCRIPT = f"recording_id string, language string, text string, segments array<{SEG}>, loaded_at timestamp_ntz, main string, voices string"
DATA = "/root/testdata/sf0.01"


def seg(start, text, nsp=0.1, lp=-0.2, end=None):
    return (start, end if end is not None else (None if start is None else start + 1), text, lp, nsp)


# turns ------------------------------------------------------------------------------------------------------------------


def test_labels():
    lab = speech.Labels([(1, "Ada Lind"), (2, "Bo Falk-Ray")])
    for text, voice in [("Ada: hi", 1), ("bo falk-ray : hi", 2), ("BF: hi", 2), ("B. Falk-Ray: hi", 2), ("(Lind) hi", 1), ("<Bo> hi", 2), ("[Speaker 2] hi", 2), ("SPEAKER_01: hi", 1), ("Spk2 - hi", 2), (">> ADA: hi", 1), ("Ada  - hi", 1), ("S1: hi", 1), ("[00:00:05] S2: hi", 2)]:
        assert lab.split(text)[-1] == (voice, "hi"), text
    for text in ("Ada, come here", "Fact: it rains", "S7: hi", "with Ada Lind and more", "(applause) hi", "bf: hi", "He said: hi"):
        assert len(lab.split(text)) == 1, text
    two = speech.Labels([(1, "Ada Lind"), (2, "Ada Berg")])
    assert len(two.split("Ada: hi")) == 1 and two.split("Berg: hi")[-1][0] == 2
    assert [v for v, _ in lab.split("Ada: one. Bo: two.")] == [None, 1, 2]


def test_content():
    assert not speech.has_content("[00:00:05] um, er... [music] (applause) *coughs* ♪♪ <inaudible> ((pause))")
    assert not speech.has_content("0:42 - ") and not speech.has_content("うーん。") and not speech.has_content("")
    assert speech.has_content("um, yes") and speech.has_content("No.")
    assert speech.clean("[00:00:05] Um, I [music] came.") == "I came."


def test_overlap_equals_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("xy") for _ in range(rng.randint(0, 8))] for _ in range(2))
        want = max((k for k in range(3, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0)
        assert turns.overlap(a, b) == want


def test_turns(spark):
    segs = [seg(5.0, "S2: um."), seg(1.0, "Ada: Good morning to you all."), seg(3.0, "morning to you all and welcome."), seg(7.0001, "Thank you. Bo: Well then."), seg(9.0, "Ada: lies", 0.95, -1.5), seg(None, "More of it."), seg(12.0, None), seg(13.0, "[music]")]
    rows = [("r", None, "x", segs, NOW, None, None), ("r", None, "x", segs, LATER, None, None), ("q", None, "x", [seg(0.0, "Alone."), seg(1.1, "Still."), seg(60.0, "Later.")], NOW, None, None), ("n", None, None, None, NOW, None, None), ("e", None, None, [], NOW, None, None), (None, None, None, [seg(0.0, "x")], NOW, None, None)]
    t = spark.createDataFrame(rows, TRANSCRIPT)
    roster = spark.createDataFrame([("r", 1, "Ada Lind"), ("r", 2, "Bo Falk"), ("z", 1, "No One"), ("r", None, "Ghost")], "recording_id string, voice_no int, display_name string")
    got = [tuple(r) for r in turns.found(turns.speaker_turns(t, roster, only_rostered=True)).orderBy("turn_no").collect()]
    assert got == [("r", 0, 1, 1000), ("r", 1, 2, 7000)]
    texts = [r["text"] for r in turns.speaker_turns(t, roster, only_rostered=True).orderBy("turn_no").collect()]
    assert texts == ["Good morning to you all. and welcome. Thank you.", "Well then. More of it."]
    assert turns.speaker_turns(t, roster, split_pauses=True).where("recording_id = 'q'").count() == 2
    assert turns.speaker_turns(t.limit(0), roster).count() == 0


def test_a_pause_does_not_bring_a_caption_back():
    texts = ["we walked down to the harbour", "down to the harbour", "down to the harbour and then home"]
    got = turns.turns_of([0.0, 60.0, 120.0], [3.0, 63.0, 123.0], texts, [None] * 3, [None] * 3, [], True)
    assert [t[4] for t in got] == ["we walked down to the harbour", "and then home"] and [t[1] for t in got] == [0, 120000]
    voices = [(1, "Ada Lind"), (2, "Bo Falk")]
    got = turns.turns_of([0.0, 4.0], [3.0, 6.0], ["Ada: down to the harbour", "Bo: down to the harbour indeed"], [None] * 2, [None] * 2, voices, False)
    assert [t[4] for t in got] == ["down to the harbour", "down to the harbour indeed"]


def test_turns_begin_at_their_label():
    times = [[1.0, 1.5, 2.0, 2.5, 3.0], None]
    got = turns.turns_of([1.0, 9.0], [4.0, 10.0], ["Ada: One two. Bo: Three", "Ada: four"], [None] * 2, [None] * 2, [(1, "Ada"), (2, "Bo")], False, times)
    assert [(t[0], t[1], t[5]) for t in got] == [(1, 1000, 1000), (2, 1000, 2500), (1, 9000, 9000)]


def test_names_and_notes_of_any_length():
    long = " ".join(f"Name{k}longlonglong" for k in range(12))
    lab = speech.Labels([(1, long), (2, "Bo Falk")])
    assert lab.split(f"So. {long}: hi")[-1] == (1, "hi") and lab.split(f"[{long}] hi")[-1] == (1, "hi")
    assert not speech.has_content("[" + "a very long note about the noise in the hall " * 9 + "]")
    assert speech.has_content("Morning people everywhere.") and not speech.has_content("*coughs* um *laughs*")


def test_utterance_turns(spark):
    word = "struct<word:string,start:double,end:double,p:double>"
    segs = [(1.0, 4.0, "Ada: One two. Bo: Three", -0.2, 0.1, [("Ada:", 1.0, 1.1, 1.0), ("One", 1.5, 1.6, 1.0), ("two.", 2.0, 2.1, 1.0), ("Bo:", 2.5, 2.6, 1.0), ("Three", 3.0, 3.1, 1.0)])]
    t = spark.createDataFrame([("r", None, None, segs, NOW)], f"recording_id string, language string, text string, segments array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<{word}>>>, loaded_at timestamp_ntz")
    roster = spark.createDataFrame([("r", 1, "Ada Lind"), ("r", 2, "Bo Falk")], "recording_id string, voice_no int, display_name string")
    rows = [(1, "r", 0, 1.0, "Ada: One two.", NOW), (1, "r", 0, 1.0, "Ada: One two.", LATER), (2, "r", 1, 3.0, "[00:03] Um, three", NOW), (3, "r", 2, None, "four", NOW), (4, "r", 3, 3.1, "[music]", NOW), (5, "q", 0, 1.0, "x", NOW), (6, "r", 4, 3.2, None, NOW), (7, "r", 5, None, "Ada: five", NOW)]
    u = spark.createDataFrame(rows, "utt_id long, recording_id string, index int, start double, text string, loaded_at timestamp_ntz")
    got = {r["utt_id"]: (r["turn_no"], r["voice_no"], r["text"]) for r in turns.utterance_turns(u, t, roster).collect()}
    assert got == {1: (0, 1, "One two."), 2: (1, 2, "three"), 3: (None, None, "four"), 7: (None, 1, "five")}
    assert turns.utterance_turns(u.limit(0), t, roster).count() == 0


# language ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def identifier(spark):
    return language.identifier_for(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_codes():
    assert [language.code_of(x) for x in ("en", "EN", "en-GB", "en_gb", "English", "français", "und", "", None, "unknown", " Deutsch ")] == ["en", "en", "en", "en", "en", "fr", None, None, None, None, "de"]


def test_held_out_accuracy(spark, identifier):
    rows = spark.read.parquet("/root/testdata/sf0.1/eval_items.parquet").select("text", "lang").collect()
    got = identifier.identify([r["text"] for r in rows])
    assert sum(g[0] == r["lang"] for g, r in zip(got, rows)) / len(rows) > 0.99
    assert identifier.identify([None, "", "1234 !?", "​"]) == [(None, 0.0)] * 4
    assert identifier.identify(["qxzj vkwq " * 50])[0][0] is None
    assert identifier.identify(["the people in this town " * 20_000])[0][0] == "en"


def test_unknown_languages_are_rejected(identifier):
    foreign = ["Dzisiaj wieczorem pójdziemy nad rzekę, ponieważ sąsiedzi naprawili stary most i łódkę.", "Tänään kävelemme joelle, koska naapurit ovat korjanneet vanhan sillan ja veneen.", "Bugün akşam nehre gideceğiz, çünkü komşular eski köprüyü ve kayığı onardı."]
    assert [g[0] for g in identifier.identify(foreign)] == [None] * 3


def test_document_segments(spark, identifier, monkeypatch):
    en = "We repaired the old boat in the morning, and the choir found the heavy letter. The whole team painted the small door. "
    fr = "Les voisins avait trouvé le piano derrière l'école, et nous cherchait encore la lettre. Personne avait réparé le tunnel. "
    monkeypatch.setattr(language, "identifier_for", lambda _: identifier)
    d = spark.createDataFrame([(1, en * 2, 0), (2, en * 2 + fr, 0), (3, None, 0), (4, "", 0), (5, "1234", 0)], "doc_id long, text string, seg_no int")
    got = [tuple(r)[:5] for r in language.document_segments(d).orderBy("doc_id", "seg_no").collect()]
    assert got == [(1, 0, 0, len(en * 2), "en"), (2, 0, 0, len(en * 2), "en"), (2, 1, len(en * 2), len(en * 2 + fr), "fr")]
    assert language.stretches("") == [] and language.stretches("No. No.")[-1][1] == 7


def test_scores_of_a_batch_equal_single_scores():
    from voxloom.llm.charlm import Models

    m = Models.fit({"a": ["abab abba baab"], "b": ["cdcd dccd"]})
    import numpy as np

    texts = ["abab", "cd dc", "zebra"]
    assert np.allclose(m.cross_entropy(texts), np.vstack([m.cross_entropy([t]) for t in texts]))
    assert m.cross_entropy(["abab"])[0].argmin() == 0 and m.cross_entropy(["cdcd"])[0].argmin() == 1


def test_language_report(spark, identifier):
    en = "We repaired the old boat in the morning, and the choir found the heavy letter."
    fr = "Les voisins avait trouvé le piano derrière l'école, et nous cherchait encore la lettre."
    segs = [seg(0.0, en), seg(2.0, "S1: " + en), seg(4.0, "[00:05] " + fr), seg(6.0, "euh..."), seg(8.0, fr, 0.9, -1.5), seg(9.0, None)]
    rows = [("r1", "en-GB", en, segs, NOW, None, None), ("r1", "en-GB", en, segs, LATER, None, None), ("r2", None, fr, [seg(0.0, fr)], NOW, None, None), ("r3", "fr", None, None, NOW, None, None), ("r4", "de", en, [seg(0.0, en)], NOW, None, None)]
    t = spark.createDataFrame(rows, TRANSCRIPT)
    judged = language.transcript_languages(t, identifier)
    recordings = spark.createDataFrame([("r1", "s1"), ("r2", "s1"), ("r4", "s2"), ("r9", None)], "id string, speaker_id string")
    speakers = spark.createDataFrame([("s1", ["English"]), ("s2", None)], "id string, languages array<string>")
    got = {tuple(r)[:4] for r in language.corrections(judged, recordings, speakers).collect()}
    assert got == {("segment", "r1", 2, "fr"), ("transcript", "r2", -1, "fr"), ("transcript", "r4", -1, "en"), ("speaker", "s1", -1, "fr"), ("speaker", "s2", -1, "en")}
    assert language.transcript_languages(t.limit(0), identifier).count() == 0


# sentences --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tagger(spark):
    return sentences.train()


def split(tagger, text):
    return [text[a:b] for a, b in tagger.sentences(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Lena Holm paid 4.5 thousand.", "See notes.example.org for it, or ask J. K. Stern.", "That's it!"],
        ["It took… well, about 3.1 hours.", "so we left.", "Really?!", "Yes."],
        ['Ida Moss said: "Wait. Look. Then go." and sat down.', "Who left it?"],
        ["« Il est tard. On y va », dit Luc.", "M. Luc Roy a payé 3,5 euros, c.-à-d. trop.", "Ah oui !"],
        ["¿Quién dejó aquí la carta?", "Empezamos a las 8 p. m. en la sala.", "¡Vale!"],
        ["Wir gehen, d. h. viel zu spät.", "Siehe Nr. 3, Abs. 2 usw. im Heft."],
        ["См. стр. 20 и т. д. в тетради.", "Он видел мост."],
        ["[00:00:05] S1: We moved it.", "[music] Then we left."],
    ],
)
def test_sentence_fixtures(tagger, parts):
    assert split(tagger, " ".join(parts)) == parts
    assert split(tagger, "\r\n".join(parts)) == parts


def test_sentences_of_other_scripts(tagger):
    assert split(tagger, "老师说：“等一下。再看看山路。”然后就走了。“太晚了！走吧。”他说。") == ["老师说：“等一下。再看看山路。”然后就走了。", "“太晚了！走吧。”他说。"]
    assert split(tagger, "[00:05] ผมวัดรั้ว ดีมาก เวลา18.30น.เราเจอกลอง") == ["[00:05] ผมวัดรั้ว", "ดีมาก", "เวลา18.30น.เราเจอกลอง"]
    assert split(tagger, "ठीक है। मैंने पुल देखा।") == ["ठीक है।", "मैंने पुल देखा।"]


def test_sentence_positions_and_dirt(tagger):
    text = "  We le​ft. Ｔhey café stayed.\n\n \nNo end"
    spans = tagger.sentences(text)
    assert [text[a:b] for a, b in spans] == ["We le​ft.", "Ｔhey café stayed.", "No end"]
    assert tagger.sentences(None) == [] and tagger.sentences(" \n ") == [] and split(tagger, "...") == ["..."]
    assert split(tagger, "We went out.The dog ran.") == ["We went out.", "The dog ran."]
    assert len(tagger.sentences("He came home. " * 20_000)) == 20_000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB.!? \n\"“”«»。ก1'", max_size=60))
def test_sentences_cover_all_text(tagger_text):
    t = sentences.Tagger({})
    spans = t.sentences(tagger_text)
    assert "".join(tagger_text[a:b] for a, b in spans).replace(" ", "") == "".join(tagger_text.split())
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_lost_marks_are_split_on_request_only(spark, tagger):
    loop = "The choir forgot the bridge before lunch " * 3
    assert len(tagger.sentences(loop)) == 1
    texts = sentences.corpus_texts(spark.read.parquet(f"{DATA}/utterances.parquet"), spark.read.parquet(f"{DATA}/versions.parquet"))
    other = sentences.tagger_for(texts, lost_marks=True)
    assert len(other.sentences(loop)) == 3
    assert split(other, "The choir forgot the bridge. My sister found it.") == ["The choir forgot the bridge.", "My sister found it."] and other.sentences("") == []


def test_stripped_sentences_of_every_script_are_found():
    from voxloom.llm import begins

    rng = random.Random(2)
    nouns = {"latin": ["The boat", "My sister", "Their choir"], "han": ["我妹妹", "邻居", "老师"], "thai": ["ครู", "เด็ก", "พ่อ"], "hindi": ["मेरी माँ", "लोग", "बच्चे"], "kana": ["先生は", "母は", "彼らは"]}
    verbs = {"latin": ["left the shore", "sang again", "found a letter"], "han": ["修好了梯子", "搬走了小的鼓", "唱歌"], "thai": ["ร้องเพลง", "วัดรั้ว", "ซื้อบ้าน"], "hindi": ["घर गए", "गाना गाया", "पुल देखा"], "kana": ["歌いました", "走りました", "手紙を読みました"]}
    glue = {"latin": " ", "hindi": " "}
    made = [n + glue.get(k, "") + v + end for k in nouns for n in nouns[k] for v in verbs[k] for end in (".", "!", "")]
    model = begins.fit(sorted(set(made)))
    right = given = true = 0
    for k in nouns:
        for _ in range(20):
            line, at = begins.joined([rng.choice(nouns[k]) + glue.get(k, "") + rng.choice(verbs[k]) for _ in range(4)], rng)
            got = model.boundaries(line)
            right, given, true = right + len(set(got) & set(at)), given + len(got), true + len(at)
    assert right / true > 0.9 and right / given > 0.9
    assert begins.fit([]).boundaries("We left We came") == [] and model.boundaries("") == []


def test_sentence_spans(spark):
    u = spark.createDataFrame([(1, "One. Two.", NOW, "k"), (1, "One. Two.", LATER, "k"), (2, None, NOW, "k"), (3, "", NOW, "k")], "utt_id long, text string, loaded_at timestamp_ntz, kind string")
    v = spark.createDataFrame([("v1", "Hi there.\nBye.", 1), ("v2", None, 1)], "version_id string, text string, start_pos int")
    got = {tuple(r) for r in sentences.sentence_spans(u, v).collect()}
    assert got == {("utterance", "1", 0, 4), ("utterance", "1", 5, 9), ("version", "v1", 0, 9), ("version", "v1", 10, 14)}
    assert sentences.sentence_spans(u.limit(0), v.limit(0)).count() == 0


# mixtures and pieces ------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(5, 60), "big" if i % 3 else "small", "x") for i in range(900)]
    docs += [(5000, None, "big", "x"), (5001, "", "big", "x"), (None, "word", "big", "x"), (5002, "word", None, "x"), (5003, "word", "untargeted", "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), ("zero", 0.0, 2)], "source string, target_share double, max_repeats int")
    for kw in ({}, {"keep_shares": True}, {"total_tokens": 3000}):
        chosen, report = mixing.mixed(d, targets, **kw)
        rows = {r["source"]: r for r in report.collect()}
        assert rows["none"]["tokens"] == 0 and rows["big"]["most_copies"] <= 1 and rows["small"]["most_copies"] <= 3
        for s in ("big", "small"):
            assert 0 <= rows[s]["lacking_tokens"] <= 6  # no document has fewer tokens
        assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
        if kw:
            assert abs(rows["big"]["share"] - 5 / 9) < 0.02
    assert all(tuple(r)[1:] == (True, True, True) for r in mixing.checks(d, targets).collect())
    weights = mixing.materialize(mixing.weighed(d, targets), "weights")
    below = lambda total: {r["source"]: r["rounds"] * mixing.PLACES + r["threshold"] for r in mixing.plan(weights, targets, total)}
    small, large = below(2000), below(4000)
    assert all(small[s] <= large[s] for s in small)
    chosen, _ = mixing.mixed(d, targets)
    assert mixing.copies_as_rows(chosen, d.dropDuplicates(["doc_id"])).count() == sum(r["copies"] for r in chosen.collect())
    chosen, report = mixing.mixed(d.limit(0), targets)
    assert chosen.count() == 0 and {r["share"] for r in report.collect()} == {0.0}
    assert mixing.mixed(d, targets.limit(0))[0].count() == 0


def test_gaps_are_filled_by_what_fits(spark, monkeypatch):
    rng = random.Random(8)
    for k in range(1):
        docs = [(i, "word " * rng.choice([3, 7, 200, 900]), rng.choice("ab")) for i in range(60)]
        d = spark.createDataFrame(docs, "doc_id long, text string, source string")
        targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
        if k == 0:
            assert all(tuple(r)[1:] == (True, True, True) for r in mixing.checks(d, targets, seed=k).collect())
        weights = mixing.materialize(mixing.weighed(d, targets, seed=k), "weights")
        short = {tuple(r) for r in mixing.choose(weights, targets)[0].collect()}
        with monkeypatch.context() as m:
            m.setattr(mixing, "NEAR", 1)  # many stretches
            assert all(tuple(r)[1:] == (True, True, True) for r in mixing.checks(d, targets, seed=k).collect())
        with monkeypatch.context() as m:
            m.setattr(mixing, "ONE_TASK", 0)
            assert {tuple(r) for r in mixing.choose(weights, targets)[0].collect()} == short


TEXTS = ["The cat sat. " * 300, "我们在学校后面保存了绿的鼓。" * 120, "x" * 4000, "a\n\nb, c; d. " * 400, "ผมวัดรั้วเก่าใกล้สถานี" * 60, "🎉" * 500, "one " * 65, "é́" * 900]


def held(text, limit, overlap):
    """The pieces, after a check of cover, limit and overlap on their own texts."""
    got = pieces.pieces(text, limit, overlap)
    if tokens.count(text) <= limit:
        assert got == []
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(n == tokens.count(text[a:b]) <= limit for a, b, n, _, _ in got)
    for x, y in zip(got, got[1:]):
        assert x[0] <= y[0] <= x[1] < y[1] and y[3] == tokens.count(text[y[0] : x[1]]) >= overlap and (overlap or y[0] == x[1])
    return got


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(64, 0), (64, 16), (64, 48), (256, 32), (7, 0), (8, 3)])
def test_pieces(text, limit, overlap):
    held(text, limit, overlap)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab'st \n\t.,1é我。ก🎉", max_size=120), st.integers(1, 64), st.data())
def test_pieces_of_any_text_limit_and_overlap(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    try:
        held(text, limit, overlap)
    except ValueError:  # a sign has up to four tokens; on either side of the overlap it may need that many
        assert limit - overlap < 8


def test_impossible_limits():
    for limit, overlap in ((0, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            pieces.pieces("word " * 50, limit, overlap)
    with pytest.raises(ValueError):
        pieces.pieces("🎉" * 9, 1, 0)
    assert len(held("word " * 5000, 7, 0)) > 700


def test_pieces_prefer_natural_boundaries():
    cuts = {p[4] for p in pieces.pieces("We came home late. " * 200, 64, 8)}
    assert cuts == {"start", "sentence"}


def test_split_oversized(spark):
    d = spark.createDataFrame([(1, "word " * 500, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny", "x")], "doc_id long, text string, cut string")
    limits = spark.createDataFrame([("a", 64, 0), ("b", 256, 32), ("n", None, 3), ("o", 64, None)], "limit_name string, max_tokens int, overlap_tokens int")
    got = pieces.split_oversized(d, limits)
    assert {r["doc_id"] for r in got.collect()} == {1} and {r["limit_name"] for r in got.select("limit_name").distinct().collect()} == {"a", "b", "o"}
    assert pieces.split_oversized(d.limit(0), limits).count() == 0


def test_long_captions_repeat_once():
    first = [f"word{k}" for k in range(700)]
    got = turns.turns_of([0.0, 5.0], [5.0, 9.0], [" ".join(first), " ".join(first + ["and", "more"])], [None] * 2, [None] * 2, [], False)
    assert len(got) == 1 and got[0][4].split() == first + ["and", "more"]
