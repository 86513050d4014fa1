"""Consistent text, terms, repetition, leaks: against brute force, and on awkward rows."""

import random
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import leaks, look_same, repetition, terms, units
from voxloom.llm.canon import LOOK_ALIKES, rules, transducer

NOW, LATER = datetime(2024, 1, 1), datetime(2024, 2, 1)
UTT = "utt_id long, recording_id string, index int, text string, loaded_at timestamp_ntz, _seen string, term string"
PARSED = "utt_id long, recording_id string, words array<string>, loaded_at timestamp_ntz, n long"


def test_rules_have_no_conflict_and_are_fixed_points():
    run = transducer(True)
    table = rules(True)
    assert len(table) > 2000
    for source, target in list(table.items())[::7]:
        assert run(run(source)) == run(source) == run(target)


def test_kinds_of_difference():
    run = transducer(True)
    for written in ("café", "café", "ｃａｆé", "c​af­é", "саfé", "c﻿afe​́"):
        assert run(written) == "café"
    assert run("ﬁnd ʼtis") == "find 'tis"
    assert run("ｶﾞｽ") == "ガス" and run("⼤⼈") == "大人" and run("K") == "K"
    assert run("a  b") == "a  b" and run("A") != run("a") and run("e") != run("é") and run("1") == "1" and run("!") != run("?")
    assert run(None) is None and run("") == "" and run("​­") == "" and run("a\nb") == "a\nb"
    assert transducer(False)("саfé") != "café"
    long = "x́" * 200_000
    assert run(long) == run(long)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_seen_form_is_stable_under_normalisation(text):
    run = transducer(True)
    once = run(text)
    assert run(once) == once
    assert run(unicodedata.normalize("NFD", text)) == run(unicodedata.normalize("NFC", text))


def test_look_alikes_cover_every_listed_letter():
    run = transducer(True)
    assert all(run(c) == latin for latin, cs in LOOK_ALIKES.items() for c in cs)


def test_same_looking_pairs(spark):
    rows = [(1, "r", 0, "Hello there", NOW, None, None), (2, "r", 1, "Неllo there", NOW, None, None), (3, "r", 2, "Hello there", NOW, None, None), (2, "r", 1, "Неllo there", LATER, None, None),
            (4, "q", 0, "Hello there", NOW, None, None), (5, "r", 3, None, NOW, None, None), (6, "r", 4, "", NOW, None, None), (7, None, 0, "Hello there", NOW, None, None), (8, "r", 5, "​", NOW, None, None)]
    got = {tuple(r) for r in look_same.same_looking_texts(spark.createDataFrame(rows, UTT)).collect()}
    assert got == {(1, 2), (2, 3)}
    assert look_same.same_looking_texts(spark.createDataFrame([], UTT)).count() == 0


def test_a_large_group_is_cut_into_shares(spark, monkeypatch):
    monkeypatch.setattr(look_same, "SHARE", 7)
    forms = ["Hello", "Неllo", "Ｈello"]
    rows = [(k, "r", k, forms[k % 3], NOW, None, None) for k in range(60)]
    got = [tuple(r) for r in look_same.same_looking_texts(spark.createDataFrame(rows, UTT)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}


def test_quotes(spark):
    u = spark.createDataFrame([(1, "r", 0, "I саme here", NOW, None, None), (2, "r", 1, "I came here", NOW, None, None), (3, "r", 2, None, NOW, None, None)], UTT)
    a = "annotation_id long, recording_id string, utterances array<int>, quote string, text string"
    rows = [(10, "r", [0, 1, 0, 9], "came", "x"), (11, "r", [0], "саme", "x"), (12, "r", [0, 2], None, "x"), (13, "r", None, "came", "x"), (14, "r", [0], "", "x"), (15, "r", [1], "​", "x")]
    got = {tuple(r) for r in look_same.quotes_found_as_seen(spark.createDataFrame(rows, a), u).collect()}
    assert got == {(10, 1)}


def test_terms_against_counters(spark):
    rng = random.Random(3)
    words = ["The", "the", "ＴＨＥ", "cat", "café", "CAFÉ", "dog", "", "​", None, "hot"]
    rows = [(i, f"r{rng.randint(0, 9)}", [rng.choice(words) for _ in range(rng.randint(0, 30))], NOW, 1) for i in range(300)]
    rows += [(r[0], r[1], r[2], LATER, 1) for r in rows[:20]] + [(1000, None, ["ghost"], NOW, 1), (1001, "r1", None, NOW, 1)]
    rows += [(2000 + i, "hot", ["the"] * 40, NOW, 1) for i in range(300)]
    joint = Counter()
    for utt in {r[0]: r for r in reversed(rows)}.values():
        for w in utt[2] or []:
            if utt[1] is not None and (t := terms.term_of(w)):
                joint[t, utt[1]] += 1
    records, total = defaultdict(set), Counter()
    for (t, r), n in joint.items():
        records[t].add(r)
        total[t] += n
    df = spark.createDataFrame(rows, PARSED)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_report(df).collect()}
    assert got == {t: (total[t], len(records[t])) for t in total}
    scores = {(r["recording_id"], r["term"]): r for r in terms.distinctive_terms(df).collect()}
    assert {k: v["n"] for k, v in scores.items()} == {(r, t): n for (t, r), n in joint.items()}
    import math

    sizes = Counter()
    for (_, r), n in joint.items():
        sizes[r] += n
    z = sum(n**0.75 for n in sizes.values())
    for (r, t), v in scores.items():
        want = max(0.0, math.log2(joint[t, r] / total[t] * z / sizes[r] ** 0.75))
        assert abs(v["ppmi"] - want) < 1e-9


def test_terms_of_nothing(spark):
    empty = spark.createDataFrame([], PARSED)
    assert terms.term_report(empty).count() == 0 and terms.distinctive_terms(empty).count() == 0
    tiny = terms.verdicts(terms.term_report(spark.createDataFrame([(1, "r", ["a"], NOW, 1)], PARSED)))
    assert {tuple(r) for r in tiny.collect()} == {("a", "rare"), ("a", "common")}


def brute_repeated(items, run):
    seen, hit = set(), [False] * len(items)
    for i in range(len(items) - run + 1):
        g = tuple(items[i : i + run])
        if g in seen:
            hit[i : i + run] = [True] * run
        seen.add(g)
    return sum(hit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_repetition_equals_brute_force(items):
    text = " ".join(items)
    assert repetition.repeated_units(text) == (len(items), brute_repeated(items, 8))


def test_repetition_units():
    line = "one two three four five six seven eight nine"
    assert repetition.repeated_units(f"{line}. {line.upper()}!") == (18, 9)
    assert repetition.repeated_units(None) == (0, 0) and repetition.repeated_units("…!?") == (0, 0)
    zh = "我们在学校后面保存了绿的鼓而且老师买了重的发动机"
    n, again = repetition.repeated_units(zh + "。" + zh)
    assert n == 2 * len(zh) and again == len(zh)
    n, again = repetition.repeated_units("abc " * 100_000)
    assert n == 100_000 and again == n - 1


def test_repetition_report(spark):
    schema = "kind string, item_id string, host string, text string, words int"
    spam = "buy now it is very very cheap and good " * 20
    rows = [("t", "a", "h", spam, 0), ("t", "a", "h", spam, 0), ("t", "b", "h", None, 0), ("t", "c", None, "short text", 0), ("v", "a", "g", "", 0)]
    got = {(r["kind"], r["item_id"]): r for r in repetition.repetition_report(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4 and got["t", "a"]["failed"] and not got["t", "b"]["failed"] and got["t", "b"]["share"] == 0
    assert got["t", "c"]["host"] == "unknown" and got["t", "c"]["host_verdict"] == "clean" and 0 < got["t", "a"]["host_rate"] < 1
    assert got["t", "a"]["host_verdict"] != "clean" and got["t", "b"]["host"] == "h"
    assert {tuple(r) for r in repetition.found(repetition.repetition_report(spark.createDataFrame(rows, schema))).collect()} == {("t", "a")}
    assert repetition.repetition_report(spark.createDataFrame([], schema)).count() == 0


def test_hosts_come_from_recordings_and_clear_no_failing_text(spark):
    spam = "buy now it is very very cheap and good " * 20
    rows = [("transcript", f"r{k}", None, spam if k % 50 == 0 else "a short text") for k in range(300)] + [("transcript", "none", None, spam)]
    texts = spark.createDataFrame(rows, "kind string, item_id string, host string, text string")
    recordings = spark.createDataFrame([(f"r{k}", "hot" if k < 200 else f"s{k % 9}") for k in range(300)], "id string, speaker_id string")
    report = repetition.repetition_report(texts, recordings)
    assert report.count() == 301 and report.where("item_id = 'none'").first()["host"] == "unknown"
    assert {r["item_id"] for r in repetition.found(report).collect()} == {f"r{k}" for k in range(0, 300, 50)} | {"none"}
    clean = report.where("host_verdict = 'clean'")
    assert clean.count() > 0 and clean.where("failed").count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)), "x") for i in range(8)] + [(8, "他们午饭前修好了梯子邻居午饭前搬走了小的笔记本我妹妹排练以后卖掉了旧的火炉不过我三个冬天里量了重的档案", "x"), (9, None, "x"), (10, "short", "x")]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            source = items[rng.randrange(8)][1].split()
            n = rng.choice([12, 19, 20, 21, 45])
            at = rng.randrange(60 - n)
            piece = source[at : at + n]
            if d % 2:
                piece = [w.upper() + "," for w in piece]
            words[len(words) // 2 : len(words) // 2] = piece
        docs.append((d, " ".join(words), 1))
    docs += [(500, items[8][1][3:45] + "。", 1), (501, items[8][1][3:38], 1), (502, None, 1), (503, "", 1), (504, items[0][1].replace("w", "ｗ").replace(" ", "\n"), 1), (504, items[0][1], 1)]
    want = set()
    for item, text, _ in items[:8]:
        iw = text.split()
        runs = {tuple(iw[k : k + 20]) for k in range(len(iw) - 19)}
        for d, doc, _ in docs:
            dw = units.words(leaks.plain(doc)) if doc else []
            if any(tuple(dw[k : k + 20]) in runs for k in range(len(dw) - 19)):
                want.add((d, item))
    want.add((500, 8))
    d = spark.createDataFrame(docs, "doc_id long, text string, run int")
    i = spark.createDataFrame(items, "item_id long, text string, similarity string")
    assert {tuple(r) for r in leaks.found(leaks.leaked_items(d, i)).collect()} == want
    assert {tuple(r) for r in leaks.found(leaks.leaked_items(d, i, item_block=3)).collect()} == want
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0


def test_case_does_not_undo_look_alikes():
    assert leaks.plain("Нalf тhe ВOAT") == leaks.plain("half the boat".upper()) == leaks.plain("half the boat")
    assert leaks.plain("НИКТО") == leaks.plain("никто")


def test_multi_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    mode = leaks.Mode(20, 3)
    mode.prints = prints
    mode.build({})
    asked = prints.copy()
    for k in range(len(asked)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(b)
    found = {(int(i), int(j)) for a, b in mode.near(asked) for i, j in zip(a, b)}
    assert all((k, k) in found for k in range(len(asked)))
