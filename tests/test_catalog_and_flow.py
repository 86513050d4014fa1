"""Segmentation, rhetoric, catalogue, store, generation, client, streaming."""

import json
import os
import random
import re
import wave

import pytest
from pyspark.sql import functions as F

from voxloom import cli, client, generation
from voxloom.functions.heavy import heavy_split_join
from voxloom.functions.lexicon import DEVICES
from voxloom.operators import catalog, documents, rhetoric, segment
from voxloom.sources import media, schema
from voxloom.sources.store import CatalogError, Store, flatten_transcript
from voxloom.sources.tables import first_delivery
from voxloom.streaming import transcripts as streaming

W = "recording_id string, french boolean, ws array<struct<word:string,start:double,end:double>>"


def plain_utterances(ws, pause=0.5):
    out, cur = [], []
    for i, (word, _, end) in enumerate(ws):
        cur.append(ws[i])
        nxt = ws[i + 1] if i + 1 < len(ws) else None
        why = None
        if word.endswith((".", "?", "!", "…")):
            why = "punct"
        elif nxt and nxt[1] is not None and end is not None and (nxt[1] - end > pause or (len(cur) >= 20 and nxt[1] - end > 0.2)):
            why = "pause"
        elif nxt is None:
            why = "end"
        if why:
            if re.search(r"\w", " ".join(c[0] for c in cur)):
                out.append((len(out), cur[0][1], cur[-1][2], why))
            cur = []
    return out


def test_pause_segmentation_equals_one_pass(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        t, ws = 0.0, []
        for _ in range(rng.choice([0, 1, 5, 90])):
            t += rng.choice([0.0, 0.2, 0.25, 0.5, 0.75])
            ws.append((rng.choice(["a", "b.", "c?", "…", "d", "e", "f", "g"]), None if rng.random() < 0.05 else t, None if rng.random() < 0.05 else t + 0.25))
            t += 0.25
        rows.append((f"r{k}", False, ws))
        want[f"r{k}"] = plain_utterances(ws)
    got = {}
    for r in segment.utterances_from_words(spark.createDataFrame(rows, W)).orderBy("recording_id", "index").collect():
        got.setdefault(r["recording_id"], []).append((r["index"], r["start"], r["end"], r["split"]))
    assert got == {k: v for k, v in want.items() if v}


def test_long_run_of_thirty(spark):
    ws = [("w", k * 0.5, k * 0.5 + 0.25) for k in range(30)]
    got = segment.utterances_from_words(spark.createDataFrame([("r", False, ws)], W)).orderBy("index").collect()
    assert [len(r["text"].split()) for r in got] == [20, 10]


def test_invented_segments_and_dots(spark):
    t = f"{schema.TRANSCRIPT}, loaded_at timestamp"
    w = lambda x: (x, 0.0, 1.0, 1.0)
    segs = [(0.0, 1.0, "a", -1.5, 0.95, 1.0, [w("lie")]), (0.0, 1.0, "a", None, 0.95, 1.0, [w("a"), w("..."), w(""), w(None)]), (0.0, 1.0, "a", -1.0, 0.9, 1.0, None)]
    df = spark.createDataFrame([("r", "s", "m", "fr-CA", None, "2024", 1.0, "x", segs, None), ("n", "s", "m", None, None, "2024", 1.0, None, None, None)], t)
    row = segment.kept_words(df).first()
    assert [x["word"] for x in row["ws"]] == ["a"] and row["french"]


def test_text_utterances(spark):
    df = spark.createDataFrame([("v", "One two.  Three?\n\n...\nFour l 'eau"), ("n", None)], "id string, text string")
    assert [(r["index"], r["text"]) for r in segment.utterances_from_text(df, "id", F.lit(False)).orderBy("index").collect()] == [(0, "One two."), (1, "Three?"), (2, "Four l'eau")]


def plain_windows(counts, most, merge):
    out, cur, n = [], [], 0
    for i, c in enumerate(counts):
        cur.append(i)
        n += c
        if n >= most:
            out.append(cur)
            cur, n = [], 0
    if cur:
        if merge and out and n < most / 2:
            out[-1] += cur
        else:
            out.append(cur)
    return [(w[0], w[-1]) for w in out]


def test_chunks_and_passages_equal_one_pass(spark):
    rng = random.Random(2)
    rows, counts = [], {}
    for k in range(25):
        counts[f"r{k}"] = [rng.randint(1, 12) for _ in range(rng.randint(1, 25))]
        rows += [(f"r{k}", i, "w " * c) for i, c in enumerate(counts[f"r{k}"])]
    u = spark.createDataFrame(rows, "recording_id string, index int, text string")
    for frame, merge in ((segment.chunks(u, 30), False), (segment.passages(u, 30), True)):
        got = {}
        for r in frame.orderBy("recording_id", "first_index").collect():
            got.setdefault(r["recording_id"], []).append((r["first_index"], r["last_index"]))
        assert got == {k: plain_windows(v, 30, merge) for k, v in counts.items()}
    first = segment.chunks(u, 30).where("number = 0").first()
    later = segment.chunks(u, 30).where("number = 1").first()
    assert first["context"] == [] and 1 <= len(later["context"]) <= 3 and len(first["key"]) == 16
    roles = {r["role"] for r in segment.passages(u, 30).collect()}
    assert roles == {"opening", "middle", "closing"}


def test_verification(spark):
    u = spark.createDataFrame([("r", 0, 1.5, "We saw the boat."), ("r", 1, 2.5, "Then we left.")], "recording_id string, index int, start double, text string")
    rows = [(1, "r", "contrast", [0], "the boat"), (2, "r", "analogy", [1, 9], "WE LEFT"), (3, "r", "humor", [0], "the plane"), (4, "r", "sarcasm", [0], "the boat"), (5, "r", "list", None, None), (6, "q", "list", [0], "x")]
    items = spark.createDataFrame(rows, "annotation_id long, recording_id string, device string, utterances array<int>, quote string")
    got = {r["annotation_id"]: (r["kept"], r["reason"], r["lines"], r["t"]) for r in rhetoric.verify(items, u).collect()}
    assert got[1] == (True, None, [0], 1.5) and got[2] == (True, None, [1], 2.5)
    long = spark.createDataFrame([("r", k, float(k), f"line{k} " + "word " * 100) for k in range(9)], "recording_id string, index int, start double, text string")
    asked = [(1, "r", "list", [0], "line3 word"), (2, "r", "list", [3], "line3 word ... line4"), (3, "r", "list", [8], "word line1 word"), (4, "r", "list", [0], "line3 word ... line4"), (5, "r", "list", [0], "line0 ... line8")]
    far = {r["annotation_id"]: (r["kept"], r["lines"][:1]) for r in rhetoric.verify(spark.createDataFrame(asked, items.schema), long).collect()}
    # Chunks are lines 0-3, 4-7 and 8: a quote may cross lines but not chunks, and is found where the claim is wrong.
    assert far[1] == (True, [0]) and far[2][0] is False and far[3] == (True, []) and far[4][0] is False and far[5][0] is False
    assert [got[k][1] for k in (3, 4, 5, 6)] == ["quote not found", "unknown device", "empty quote", "quote not found"]
    assert len(DEVICES) == 11 and len(rhetoric.cache_tag(1, "m", False)) == 8


def test_pending_chunks(spark):
    c = spark.createDataFrame([("r", 0, "k0"), ("r", 1, "k1")], "recording_id string, number int, key string")
    done = spark.createDataFrame([("r", 0, "k0", "t"), ("r", 1, "old", "t")], "recording_id string, number int, key string, tag string")
    assert [r["number"] for r in rhetoric.pending_chunks(c, done, "t").collect()] == [1]
    assert rhetoric.pending_chunks(c, done, "other").count() == 2


REC = [("s", "a", "A", "u1", "lecture", "prepared", "a.mp3", "a.wav", "h1", 1.0, True, None, "", None, "1"), ("s", "b", "B", "u2", "podcast", "prepared", "b.mp3", "b.wav", "h1", 2.0, None, None, "", None, "2"), ("s", "b", "C", "u3", "opera", "sung", "c.mp3", "c.wav", "h3", None, False, None, "", None, "3")]


def test_catalogue(spark):
    r = spark.createDataFrame(REC, schema.RECORDING)
    stats = {(x["kind"], x["value"]): (x["recordings"], x["total_s"]) for x in catalog.stats(r).collect()}
    assert stats["all", ""] == (3, 3.0) and stats["register", "prepared"] == (2, 3.0)
    files = spark.createDataFrame([("a.mp3", "h1"), ("a.wav", "x"), ("b.mp3", "changed"), ("stray.mp3", "y")], "path string, sha256 string")
    found = {(x["id"], x["problem"]) for x in catalog.problems(r, files).collect()}
    assert {("b", "duplicate id"), ("b", "same content"), ("b", "unknown genre"), ("b", "unknown register"), ("b", "changed content"), ("stray.mp3", "untracked file"), ("b", "missing audio file")} <= found
    speakers = spark.createDataFrame([("ada-lind", "Ada Lind")], "id string, name string")
    assert all(catalog.resolve(speakers, n).first()["id"] == "ada-lind" for n in ("ada-lind", "ADA LIND", "Ada  Lind", "adalind"))
    wanted = spark.createDataFrame([("s", 0, "Talk"), ("s", 1, "talk!"), ("s", 2, "New")], "speaker_id string, ord int, title string")
    taken = spark.createDataFrame([("s", "talk"), ("s", "talk-2")], "speaker_id string, id string")
    assert [x["id"] for x in catalog.new_ids(wanted, taken).orderBy("ord").collect()] == ["talk-3", "talk-4", "new"]
    g = spark.createDataFrame([("r", "en", 0.96), ("r", "fr", 0.02), ("q", "fr", 0.95), ("p", "en", 0.45)], "recording_id string, lang string, prob double")
    expected = spark.createDataFrame([("q", "en")], "recording_id string, expected string")
    assert {x["recording_id"]: x["verdict"] for x in catalog.language_gate(g, expected).collect()} == {"r": "accepted", "q": "mismatch", "p": "uncertain"}


def test_first_delivery_and_heavy_join(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, None, None), (None, "x", 1), (None, "y", 2)], "k int, v string, loaded_at int")
    assert {tuple(r) for r in first_delivery(df, ["k"]).collect()} == {(1, "b"), (2, None), (None, "x")}
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(100)], "k string, i int")
    per = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = heavy_split_join(rows, per, "k", "n", 600, 10)
    assert got.count() == 600 and got.where("k = 'hot' and n = 500").count() == 500


def test_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    assert s.read("speakers").count() == 0
    assert s.add_speaker("Ada Lind") == "ada-lind"
    with pytest.raises(CatalogError):
        s.add_speaker("Ada Lind")
    assert s.ensure_speaker("ada lind", "fr") == "ada-lind" and s.read("speakers").first()["languages"] == ["fr"]
    assert s.ensure_speaker("Bo") == "bo"
    new = spark.createDataFrame([tuple(c for k, c in enumerate(r) if k != 1) for r in REC], ", ".join(c for k, c in enumerate(schema.RECORDING.split(", ")) if k != 1))
    assert {tuple(r) for r in s.add_recordings(new).collect()} == {("u1", "added"), ("u2", "already there"), ("u3", "failed")}
    assert s.read("recordings").count() == 1
    assert {r["outcome"] for r in s.add_recordings(new.where("source <> 'u3'")).collect()} == {"already there"}
    s.remove_recording("s", "a") if s.read("recordings").first()["id"] == "a" else s.remove_recording("s", "b")
    assert s.read("recordings").count() == 0
    with pytest.raises(CatalogError):
        s.remove_recording("s", "a")


def test_flat_transcripts(spark):
    raw = spark.createDataFrame([([(0.12345, 1.0, " a ", -0.5, 0.1, 1.0, None), (1.0, 2.0, "b", None, None, None, [(" w ", 1.00049, None, 0.5)])],)], f"segments array<{schema.SEGMENT}>")
    row = flatten_transcript(raw).first()
    assert row["text"] == "a b" and row["segments"][0]["start"] == 0.123 and row["segments"][0]["words"] == [] and row["segments"][1]["words"][0]["word"] == "w"


def test_media(spark, tmp_path):
    for name in ("a.wav", "sub/b.WAV", "c.txt", "d.mp3"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        if name.lower().endswith("wav"):
            with wave.open(str(p), "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(16000)
                f.writeframes(b"\0\0" * 8000)
        else:
            p.write_bytes(b"x")
    assert [os.path.basename(r["path"]) for r in media.media_files(spark, str(tmp_path)).collect()] == ["a.wav", "d.mp3", "b.WAV"]
    assert media.durations(spark, str(tmp_path)).first()["duration_s"] == 0.5
    assert media.wav_seconds(b"nope") is None and media.digests(spark, str(tmp_path)).count() == 3


def plain_choice(candidates, n=generation.PASSAGES):
    left, picked = list(candidates), []

    def take(role, score):
        pool = sorted((p for p in left if p.role == role), key=score, reverse=True)
        used = {p.recording_id for p in picked}
        fresh = [p for p in pool if p.recording_id not in used] or pool
        if fresh:
            picked.append(fresh[0])
            left.remove(fresh[0])
        return bool(fresh)

    take("opening", lambda p: len(p.devices))
    while len(picked) < n - 1 and take("middle", lambda p: (len(set(p.devices) - {d for q in picked for d in q.devices}), len(p.devices))):
        pass
    take("closing", lambda p: len(p.devices))
    return picked[:n]


def test_selection_on_the_cluster_equals_one_pass(spark):
    rng = random.Random(5)
    for size in (0, 1, 3, 40, 40):
        rows = sorted({(f"r{rng.randint(0, 5)}", k): (rng.choice(["opening", "middle", "middle", "closing"]), rng.sample(["humor", "contrast", "analogy", "anecdote"], rng.randint(0, 3))) for k in range(size)}.items())
        df = spark.createDataFrame([(rec, k, role, d) for (rec, k), (role, d) in rows], "recording_id string, window int, role string, devices array<string>")
        assert generation.pick_passages(df) == plain_choice([generation.Passage(rec, k, role, tuple(d)) for (rec, k), (role, d) in rows])
    P = generation.Passage
    assert P("a", 1, "middle", ("humor",)).describe() == "teases" and P("a", 9, "closing", ()).describe().startswith("how a recording ends")


def test_rounds_of_drafts(spark):
    seen = []

    def ask(messages, heat):
        seen.append((len(messages), heat))
        return f"draft {len(seen)}"

    issue = {"metric": "m", "expected": "e", "got": "g", "feedback": "f", "weight": 2.0}
    made = list(generation.rounds(ask, lambda t: (t, [issue] * (2 if t == "draft 1" else 1)), "sys", "boats", revisions=2))
    assert [d[:3] for d in made] == [(0, "draft 1", 4.0), (1, "draft 2", 2.0), (2, "draft 3", 2.0)] and seen == [(2, 0.8), (3, 0.8 * 0.75), (3, 0.8 * 0.75)]
    row = generation.generation_row(spark, made, "s", "Boats at night", "m1", "sys").first()
    assert row["text"] == "draft 3" and row["best"] == 2 and "-boats-at-night-" in row["generation_id"] and len(row["versions"]) == 3
    assert len(list(generation.rounds(ask, lambda t: (t, []), "sys", "boats", revisions=5))) == 1


def test_examples_come_from_all_recordings(spark, tmp_path):
    s = cli.Session(spark, f"{tmp_path}/store")
    said = [("a", i, f"word{i} " + "w " * 129) for i in range(2100)] + [("z", i, f"We joke about number {i}. " + "w " * 129) for i in range(3)]
    s.store.write("utterances", spark.createDataFrame([("s", rec, 0, i, float(i), i + 0.5, t.strip(), "end") for rec, i, t in said], schema.UTTERANCE))
    s.store.write("annotations", spark.createDataFrame([(1, "s", "z", "humor", [1], "We joke about number 1", None, None), (2, "s", "z", "contrast", [2], "never said", None, None)], schema.ANNOTATION))
    picked = s.examples("s")
    assert [(p.recording_id, p.window, p.devices) for p in picked] == [("a", 0, ()), ("z", 1, ("humor",)), ("a", 1, ()), ("a", 2099, ())]
    assert picked[1].text.startswith("We joke about number 1.")


def answered(content):
    return client.Reply(200, json.dumps({"choices": [{"message": {"content": content}}]}))


def test_client():
    seen, waits = [], []

    def send(url, body, headers, timeout):
        seen.append((url, body, headers))
        if body is None:
            return client.Reply(200, '{"data": [{"id": "m1"}, {"id": "m2"}]}')
        if "chat_template_kwargs" in body:
            return client.Reply(400, '{"error": {"param": "chat_template_kwargs"}}')
        return answered('<think>no</think> {"items": []}')

    c = client.Chat({"url": "http://localhost:1/v1/"}, send, waits.append)
    assert c.answer_as("p", generation.answer_schema()) == {"items": []} and c.left_out == {"chat_template_kwargs"} and c.model == "m1"
    assert seen[0][0] == "http://localhost:1/v1/models" and "Authorization" not in seen[-1][2] and not waits
    for reply in (answered(""), client.Reply(0, "no connection"), client.Reply(500, "x"), client.Reply(200, "[]")):
        with pytest.raises(client.ChatError):
            client.Chat({"model": "m"}, lambda *a, r=reply: r, waits.append).ask([])
    assert waits[:3] == list(client.PAUSES)
    replies = [answered('{"items": [{"device": "list"}]}'), answered("no json"), answered('{"items": []}')]
    assert client.Chat({"model": "m"}, lambda *a: replies.pop(0), waits.append).answer_as("p", generation.answer_schema()) == {"items": []}
    hosted = {"url": "https://api.openai.com", "model": "m"}
    assert client.server_of({**client.DEFAULTS, **hosted}).length_field == "max_completion_tokens"
    assert client.key_of({**client.DEFAULTS, **hosted}, {"OPENAI_API_KEY": "k"}) == "k" and client.key_of(client.DEFAULTS, {"OPENAI_API_KEY": "k"}) is None
    assert client.server_of({**client.DEFAULTS, "url": "https://notopenai.com"}).lists_models
    assert client.refused(client.Reply(400, "unknown 'max_completion_tokens'"), {"max_completion_tokens": 1}) == "max_completion_tokens"
    assert client.refused(client.Reply(400, "bad request"), {"temperature": 1}) is None


def test_settings_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[llm]\nurl = "http://a"\nmodel = "m"\nodd = 1\n')
    s = client.settings(str(f), {"VOXLOOM_LLM_MODEL": "n"}, url=None, timeout_s=3.0)
    assert (s["url"], s["model"], s["timeout_s"], s["max_tokens"]) == ("http://a", "n", 3.0, 4096) and "odd" not in s


def test_replacing_a_table_keeps_it_whole(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    s.add_speaker("Ada Lind")
    s.add_speaker("Bo Falk")
    before = s.read("speakers")
    s.write("speakers", before.where("id = 'bo-falk'"))  # read from the table it replaces
    assert [r["id"] for r in s.read("speakers").collect()] == ["bo-falk"]
    bad = spark.range(1).select(F.raise_error(F.lit("crash")).cast("string").alias("id"))
    with pytest.raises(Exception, match="crash"):
        s.write("speakers", bad)
    assert [r["id"] for r in s.read("speakers").collect()] == ["bo-falk"]
    rows = [(f"t{k}", f"u{k % 3}", "lecture", "prepared", f"h{k % 4}") for k in range(6)]
    new = spark.createDataFrame(rows, "title string, source string, genre string, register string, sha256 string").withColumn("speaker_id", F.lit("s"))
    for c in schema.top_level(schema.RECORDING):
        name, kind = c.split()
        if name not in [*new.columns, "id"]:
            new = new.withColumn(name, F.lit(None).cast(kind))
    out = s.add_recordings(new.coalesce(1)).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in out} == {"added": 3, "already there": 3} and s.read("recordings").count() == 3


def test_cards_edited_by_hand_stay(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    card = lambda text: spark.createDataFrame([("s", text), ("t", text)], "speaker_id string, document string")
    assert {r["fresh"] for r in s.save_documents("cards", "en", card("one")).collect()} == {True}
    mine = F.when(F.col("speaker_id") == "s", "mine").otherwise(F.col("document"))
    s.write("cards", s.read("cards").withColumn("document", mine))
    assert {(r["speaker_id"], r["document"], r["fresh"]) for r in s.save_documents("cards", "en", card("two")).collect()} == {("s", "mine", False), ("t", "two", True)}
    assert {(r["speaker_id"], r["document"]) for r in s.save_documents("cards", "en", card("three"), force=True).collect()} == {("s", "three"), ("t", "three")}
    s.save_documents("cards", "fr", card("quatre"))
    assert s.read("cards").count() == 4


class FakeModel(client.Chat):
    """Finds a list in every chunk, quoting its first line, and something never said."""

    def __init__(self):
        super().__init__({"model": "fake"}, send=None)

    def ask(self, messages, temperature=0.8, schema=None, attempts=3):
        if schema is None:
            return "We saw the boat and the bridge."
        line = re.search(r"Lines:\n\[(\d+)\] (.*)", messages[0]["content"])
        return {"items": [{"device": "list", "utterances": [int(line[1])], "quote": line[2], "why": "x"}, {"device": "humor", "utterances": [0], "quote": "never said by anybody", "why": "x"}]}


def test_annotation_run(spark, tmp_path):
    lines = []
    root = f"{tmp_path}/store"
    say = lambda *argv, **kw: cli.run(cli.parser().parse_args(["--root", root, *argv]), spark, lines.append, **kw)
    say("corpus", "init", "Ada", "--language", "en")
    s = cli.Session(spark, root)
    said = [(rec, i, f"line {rec} {i} we saw the boat and the bridge and the lamp " + "word " * 40) for rec in "ab" for i in range(20)]
    s.store.write("utterances", spark.createDataFrame([("ada", rec, ord(rec), i, float(i), i + 0.5, t.strip(), "end") for rec, i, t in said], schema.UTTERANCE))
    assert say("rhetoric", "ada", "--block", "3", chat=FakeModel()) == 0
    chunks = segment.chunks(s.utterances()).count()
    assert lines[-1] == f"{chunks} annotations" and s.store.read("annotations").where("device = 'list' and t is not null").count() == chunks
    asked = len(lines)
    assert say("rhetoric", "ada", chat=FakeModel()) == 0 and lines[asked:] == [f"{chunks} annotations"]  # nothing waits
    assert say("generate", "ada", "boats", chat=FakeModel()) == 0 and lines[-1] == "We saw the boat and the bridge."
    made = s.store.read("generations").first()
    assert made["model"] == "fake" and made["speaker_id"] == "ada" and s.store.profile("en").count() == 1 and s.store.read("cards").count() == 1


def test_transcription_run(spark, tmp_path):
    lines = []
    s = cli.Session(spark, f"{tmp_path}/store")
    s.store.add_speaker("Ada")
    row = lambda i: tuple({"speaker_id": "ada", "id": i, "title": i, "source": i, "genre": "lecture", "register": "prepared", "audio_path": f"{i}.wav", "sha256": "h" + i}.get(c.split()[0]) for c in schema.top_level(schema.RECORDING))
    s.store.write("recordings", spark.createDataFrame([row("a"), row("b")], schema.RECORDING))

    def backend():
        return lambda path, lang: {"model": "fake", "language": lang, "created_at": "2024", "segments": [{"start": 0.0, "end": 1.0, "text": f" of {path} ", "words": [{"word": "Hello.", "start": 0.0, "end": 0.5, "p": 1.0}]}]}

    sure = lambda p: lambda df: df.select(F.col("id").alias("recording_id"), F.lit("fr").alias("lang"), F.lit(p).alias("prob"))
    assert s.transcribe([], None, out=lines.append) == 0 and lines == ["ada/a", "ada/b"]
    with pytest.raises(LookupError):
        s.transcribe(["a", "x"], backend)
    with pytest.raises(CatalogError):
        s.transcribe([], backend, sure(0.4))
    assert s.transcribe(["a"], backend, sure(0.9)) == 1 and s.transcribe([], backend, sure(0.9)) == 1 and s.transcribe([], backend, sure(0.9)) == 0
    got = s.store.read("transcripts").orderBy("recording_id").collect()
    assert [(r["recording_id"], r["language"], r["text"], r["source_sha256"]) for r in got] == [("a", "fr", "of a.wav", "ha"), ("b", "fr", "of b.wav", "hb")]
    assert s.analyze(0.5) == 2 and [r["rec_ord"] for r in s.store.read("utterances").orderBy("recording_id").collect()] == [1, 2]


def test_hooks_report_what_fails(spark):
    df = spark.createDataFrame([("http://x/a",), ("local.wav",), ("http://x/bad",)], "source string")

    def download(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return "/tmp/" + url[-1]

    assert {(r["source"], r["path"], r["error"]) for r in media.fetched(df, download).collect()} == {("http://x/a", "/tmp/a", None), ("local.wav", "local.wav", None), ("http://x/bad", None, "OSError: gone")}
    made = media.normalised(spark.createDataFrame([("file:/a.mp3",)], "path string"), "/out", lambda a, b: None).first()
    assert made["audio_path"].startswith("/out/") and made["error"] is None


def test_edited_cards_are_kept():
    assert documents.keep_edited(None, None, "new") == ("new", True)
    assert documents.keep_edited("old", documents.stamp("old"), "new") == ("new", True)
    assert documents.keep_edited("mine", documents.stamp("old"), "new") == ("mine", False)
    assert documents.keep_edited("mine", None, "new", force=True) == ("new", True)


def test_stream_of_transcripts(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.001/transcripts.parquet").where("segments is not null").drop("loaded_at")
    t.coalesce(2).write.json(f"{tmp_path}/in")
    q = streaming.utterances(streaming.arriving(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = segment.utterances_from_words(segment.kept_words(spark.read.parquet("/root/testdata/sf0.001/transcripts.parquet")))
    assert spark.table("arrived").count() == batch.count() > 0


def test_cli(spark, tmp_path):
    lines = []
    say = lambda *argv: cli.run(cli.parser().parse_args(["--root", f"{tmp_path}/store", *argv]), spark, lines.append)
    assert say("corpus", "init", "Ada Lind", "--language", "en") == 0 and lines == ["ada-lind"]
    with wave.open(f"{tmp_path}/talk.wav", "wb") as f:
        f.setparams((1, 2, 16000, 0, "NONE", ""))
        f.writeframes(b"\0\0" * 16000)
    assert say("corpus", "add", "ada lind", str(tmp_path), "--genre", "lecture") == 0 and lines[-1] == "added: 1"
    assert say("corpus", "list") == 0 and "0:00:01" in lines[-1]
    assert say("corpus", "validate") == 0 and say("transcribe") == 0 and lines[-1] == "ada-lind/talk"
    with pytest.raises(CatalogError):
        say("compare", "nobody", "x")


def test_core_does_not_need_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "voxloom")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "voxloom.llm" not in f.read(), n
