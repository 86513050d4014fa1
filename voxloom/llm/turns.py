"""Problem 4: transcripts into clean, ordered speaker turns.

Per recording: segments are swept in order of start time; those that are invented or hold no speech are dropped; voice labels
split segments; a turn ends where a label names another voice or, on request, at a pause that is long for the recording; text
that a rolling caption repeats (the end of what was said so far equals the beginning of the next segment) is removed.

Recordings are rows, so nothing is shuffled but the join with the roster. Defined results: null segments, texts and times are
allowed (a segment without a start keeps the place it has in the array, with the start of the segment before it); a
recording delivered twice counts once; a recording without segments has no turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.llm.speech import Labels, clean, has_content, invented
from voxloom.sources.tables import delivered_once

LEAST_OVERLAP = 3
LEAST_PAUSE_S = 1.0
PAUSE_SPREAD = 5.0
TURNS = "recording_id string, turn_no int, voice_no int, start_ms long, end_ms long, segments int, text string, spoken_ms long"


def overlap(before: list[str], after: list[str], least: int = LEAST_OVERLAP) -> int:
    """How many words at the beginning of ``after`` repeat the end of ``before`` (0 if fewer than ``least``).

    Prefix function of ``after`` run over the end of ``before``: linear in both.
    """
    if len(after) < least:
        return 0
    fail, k = [0] * len(after), 0
    for i in range(1, len(after)):
        while k and after[i] != after[k]:
            k = fail[k - 1]
        k += after[i] == after[k]
        fail[i] = k
    k = 0
    for w in before[-len(after) :]:
        while k and (k == len(after) or w != after[k]):
            k = fail[k - 1]
        k += w == after[k]
    return k if k >= least else 0


def calibrated_pause(gaps: list[float]) -> float:
    """The pause that separates turns in this recording: far above its usual gap between segments."""
    gaps = [g for g in gaps if g > 0]
    if len(gaps) < 4:
        return LEAST_PAUSE_S
    mid = median(gaps)
    return max(LEAST_PAUSE_S, mid + PAUSE_SPREAD * median(abs(g - mid) for g in gaps))


def turns_of(starts, ends, texts, logprobs, nospeech, voices: list[tuple[int, str]], split_pauses: bool, times=None) -> list[tuple]:
    """[(voice, start ms, end ms, segments, text, ms of the label or first word)]; ``times``: by segment, when its words begin."""
    times = times if times is not None else [None] * len(texts)
    rows, last = [], None
    for i, text in enumerate(texts):
        start = starts[i] if starts[i] is not None and starts[i] == starts[i] else last
        last = start
        rows.append((start if start is not None else float("-inf"), i, start, ends[i], text))
    rows.sort(key=lambda r: (r[0], r[1]))
    labels = Labels(voices)
    kept = []
    for _, i, start, end, text in rows:
        if not text or invented(nospeech[i], logprobs[i]):
            continue
        parts = []
        for voice, part, at in labels.placed(text):
            full = has_content(part)
            parts.append((voice, clean(part).split() if full else [], full, _spoken_at(times[i], len(text[:at].split()), start) if full else start))
        if any(full for _, _, full, _ in parts):
            kept.append((start, end, parts))
    limit = calibrated_pause([b[0] - a[1] for a, b in zip(kept, kept[1:]) if a[1] is not None and b[0] is not None]) if split_pauses else float("inf")
    longest = max((len(words) for _, _, parts in kept for _, words, _, _ in parts), default=0)  # no caption repeats more
    out: list[list] = []
    voice, ended, said = None, None, []
    for start, end, parts in kept:
        paused = ended is not None and start is not None and start - ended > limit
        for named, words, full, spoken in parts:
            voice = voice if named is None else named
            if not full or (voice is None and voices):
                continue
            same = bool(out) and out[-1][0] == voice
            keys = [_key(w) for w in words]
            again = overlap(said, keys) if same else 0  # a caption rolls on within a voice; another voice may repeat what was said
            fresh, keys = words[again:], keys[again:]
            if same and (not paused or not fresh):
                out[-1][2] = end if end is not None else out[-1][2]
                out[-1][3] += 1
                out[-1][4].extend(fresh)
            else:
                out.append([voice, start, end, 1, fresh, spoken])
            paused = paused and not fresh
            said = ((said if same else []) + keys)[-longest:]
        ended = end if end is not None else ended
    ms = lambda s: None if s is None else int(round(s * 1000))
    return [(v, ms(a), ms(b), n, " ".join(w), ms(at)) for v, a, b, n, w, at in out]


def _spoken_at(times: list | None, words_before: int, start: float | None) -> float | None:
    """When the word after so many is said; the start of the segment where its words have no times."""
    at = times[words_before] if times is not None and words_before < len(times) else None
    return start if at is None or at != at or (start is not None and at < start) else at


def _key(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum()) or word


def _none(x):
    return None if x is None or x != x else x


def speaker_turns(transcripts: DataFrame, rosters: DataFrame, only_rostered: bool = False, split_pauses: bool = False) -> DataFrame:
    """(recording_id, turn_no, voice_no, start_ms, end_ms, segments, text, spoken_ms).

    ``start_ms`` is the start of the segment in which a turn begins, ``spoken_ms`` that of its label or first word.

    Without a roster a recording has one unnamed voice (null). Before the first label of a rostered recording the voice is
    unknown and no turn is made.
    """
    s = F.col("segments")
    slim = transcripts.where("recording_id is not null and segments is not null").select(
        "recording_id", "loaded_at", s.getField("start").alias("starts"), s.getField("end").alias("ends"), s.getField("text").alias("texts"), s.getField("avg_logprob").alias("logprobs"), s.getField("no_speech_prob").alias("nospeech"),
        (F.transform(s, lambda x: F.transform(x["words"], lambda w: w["start"])) if _has_words(transcripts) else F.lit(None).cast("array<array<double>>")).alias("times"),
    )
    voices = rosters.where("recording_id is not null and voice_no is not null").groupBy("recording_id").agg(F.sort_array(F.collect_set(F.struct("voice_no", "display_name"))).alias("voices"))
    joined = slim.join(voices, "recording_id", "inner" if only_rostered else "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                roster = [] if r.voices is None else [(v["voice_no"], v["display_name"]) for v in r.voices]
                columns = [[_none(x) for x in c] for c in (r.starts, r.ends, r.texts, r.logprobs, r.nospeech)]
                for k, turn in enumerate(turns_of(*columns, roster, split_pauses, r.times)):
                    rows.append((r.recording_id, r.loaded_at, k, *turn))
            yield frames.frame(["recording_id", "loaded_at", "turn_no", "voice_no", "start_ms", "end_ms", "segments", "text", "spoken_ms"], rows)

    turns = joined.mapInPandas(run, TURNS.replace("recording_id string,", "recording_id string, loaded_at timestamp_ntz,"))
    kept = F.min_by(F.struct("voice_no", "start_ms", "end_ms", "segments", "text", "spoken_ms"), "loaded_at").alias("t")
    return turns.groupBy("recording_id", "turn_no").agg(kept).select("recording_id", "turn_no", "t.voice_no", "t.start_ms", "t.end_ms", "t.segments", "t.text", "t.spoken_ms")


def _has_words(transcripts: DataFrame) -> bool:
    return "words" in transcripts.schema["segments"].dataType.elementType.names


def utterance_turns(utterances: DataFrame, transcripts: DataFrame, rosters: DataFrame) -> DataFrame:
    """(utt_id, recording_id, index, turn_no, voice_no, text): the utterances of rostered recordings with their turn, in clean text.

    An utterance belongs to the last turn that has begun by its start, found among the turns of its recording in one row; a
    label in its own text goes before that. Without a start it has no turn but that of its label; one that holds no speech is
    left out. A row delivered twice counts once; null texts give no row.
    """
    turns = speaker_turns(transcripts, rosters, only_rostered=True)
    spans = turns.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("spoken_ms", "turn_no", "voice_no"))).alias("spans"))
    voices = rosters.where("recording_id is not null and voice_no is not null").groupBy("recording_id").agg(F.sort_array(F.collect_set(F.struct("voice_no", "display_name"))).alias("voices"))
    once = delivered_once(utterances.where("recording_id is not null and text is not null").select("utt_id", "recording_id", "index", "start", "text", "loaded_at"), "utt_id")
    joined = once.join(voices, "recording_id").join(spans, "recording_id", "left")
    begun = F.filter("spans", lambda x: x["spoken_ms"] <= F.round(F.col("start") * 1000) + 1)
    placed = joined.withColumn("turn", F.try_element_at(begun, F.lit(-1))).select("utt_id", "recording_id", "index", "text", "voices", F.col("turn.turn_no").alias("turn_no"), F.col("turn.voice_no").alias("voice_no"))
    names = ["utt_id", "recording_id", "index", "turn_no", "voice_no", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                roster = tuple((v["voice_no"], v["display_name"]) for v in r.voices)
                if roster not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[roster] = Labels(list(roster))
                parts = [(voice, part) for voice, part in known[roster].split(r.text) if has_content(part)]
                if parts:
                    voice = parts[0][0] if parts[0][0] is not None else _none(r.voice_no)
                    rows.append((r.utt_id, r.recording_id, _none(r.index), _none(r.turn_no), voice, " ".join(clean(p) for _, p in parts)))
            yield frames.frame(names, rows)

    return placed.mapInPandas(run, "utt_id long, recording_id string, index int, turn_no int, voice_no int, text string")


def found(turns: DataFrame) -> DataFrame:
    return turns.select("recording_id", "turn_no", "voice_no", "start_ms")
