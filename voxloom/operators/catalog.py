"""The catalogue of speakers and recordings: statistics, checks, what is to be done (AGG29, AGG33, CTL1, CTL5, FLT5, FLT6, FLT11, JN6, JN13-JN15, WIN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X

# Fixed values.
GENRES = "speech lecture interview podcast conversation debate monologue other".split()
REGISTERS = "scripted prepared spontaneous".split()


def stats(recordings: DataFrame) -> DataFrame:
    """Count, duration and multi-speaker count by speaker, and duration by genre and register, in one pass (AGG29)."""
    seconds = F.coalesce("duration_s", F.lit(0.0))
    sets = recordings.groupingSets([["speaker_id"], ["speaker_id", "genre"], ["speaker_id", "register"]], "speaker_id", "genre", "register")
    out = sets.agg(F.grouping("genre").alias("g"), F.grouping("register").alias("r"), F.count("*").alias("recordings"), F.round(F.sum(seconds), 2).alias("total_s"), F.sum(F.coalesce(F.col("multi_speaker"), F.lit(False)).cast("long")).alias("multi_speaker"))
    kind = F.when(F.col("g") == 0, "genre").when(F.col("r") == 0, "register").otherwise("all")
    value = F.when(F.col("g") == 0, F.col("genre")).when(F.col("r") == 0, F.col("register")).otherwise("")
    return out.select("speaker_id", kind.alias("kind"), value.alias("value"), "recordings", "total_s", "multi_speaker")


def duplicates(recordings: DataFrame) -> DataFrame:
    """Recordings of a speaker whose content is that of an earlier one (JN15). The first is kept."""
    order = Window.partitionBy("speaker_id", "sha256").orderBy("added_at", "id")
    return recordings.where("sha256 is not null").withColumn("n", F.row_number().over(order)).withColumn("same_as", F.first("id").over(order)).where("n > 1").select("speaker_id", "id", "same_as")


def pending(recordings: DataFrame, transcripts: DataFrame, model: str | None = None) -> DataFrame:
    """Recordings without a transcript of their content (and by that model) (FLT6)."""
    current = transcripts.where("segments is not null").select(F.col("recording_id").alias("id"), F.col("source_sha256").alias("sha256"), "model").distinct()
    if model is not None:
        current = current.where(F.col("model") == model)
    return recordings.join(current, ["id", "sha256"], "left_anti").select("speaker_id", "id")


def only(recordings: DataFrame, ids: list[str]) -> DataFrame:
    """The recordings of the given ids; one that is not in the catalogue is an error (FLT5)."""
    kept = recordings.where(F.col("id").isin(ids))
    unknown = set(ids) - {r["id"] for r in kept.select("id").distinct().collect()}
    if unknown:
        raise LookupError(f"no recording {', '.join(sorted(unknown))}")
    return kept


def spoken_minutes(utts: DataFrame, recordings: DataFrame) -> DataFrame:
    """(speaker_id, recordings, minutes) of the recordings that have utterances (JN6); an unknown duration counts nothing."""
    heard = utts.select("recording_id").distinct()
    rows = recordings.select("speaker_id", F.col("id").alias("recording_id"), "duration_s").join(heard, "recording_id", "left_semi")
    return rows.groupBy("speaker_id").agg(F.count("*").alias("recordings"), F.round(F.sum(F.coalesce("duration_s", F.lit(0.0))) / 60, 1).alias("minutes"))


def untracked(transcripts: DataFrame, recordings: DataFrame) -> DataFrame:
    """Transcripts of recordings that are not in the catalogue (JN13)."""
    return transcripts.select(F.col("recording_id").alias("id")).distinct().join(recordings.select("id"), "id", "left_anti")


def problems(recordings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(speaker_id, id, problem): repeated ids, repeated content, genres and registers outside their lists, missing and
    untracked files, changed content (CTL5). ``files``: path, sha256."""
    again = recordings.withColumn("n", F.row_number().over(Window.partitionBy("speaker_id", "id").orderBy("added_at"))).where("n > 1").select("speaker_id", "id", F.lit("duplicate id").alias("problem"))
    same = duplicates(recordings).select("speaker_id", "id", F.lit("same content").alias("problem"))
    genre = recordings.where(~F.coalesce(F.col("genre").isin(*GENRES), F.lit(False))).select("speaker_id", "id", F.lit("unknown genre").alias("problem"))
    register = recordings.where(~F.coalesce(F.col("register").isin(*REGISTERS), F.lit(False))).select("speaker_id", "id", F.lit("unknown register").alias("problem"))
    out = again.unionByName(same).unionByName(genre).unionByName(register)
    if files is not None:
        there = files.select(F.col("path"), F.col("sha256").alias("now"))
        for column, label in (("raw_path", "missing raw file"), ("audio_path", "missing audio file")):
            gone = recordings.join(there.withColumnRenamed("path", column), column, "left_anti").select("speaker_id", "id", F.lit(label).alias("problem"))
            out = out.unionByName(gone)
        changed = recordings.join(there.withColumnRenamed("path", "raw_path"), "raw_path").where("sha256 <> now").select("speaker_id", "id", F.lit("changed content").alias("problem"))
        stray = there.join(recordings.select(F.explode(F.array("raw_path", "audio_path")).alias("path")), "path", "left_anti").select(F.lit(None).cast("string").alias("speaker_id"), F.col("path").alias("id"), F.lit("untracked file").alias("problem"))
        out = out.unionByName(changed).unionByName(stray)
    return out


def status(speakers: DataFrame, recordings: DataFrame, transcripts: DataFrame, words: DataFrame, annotations: DataFrame, versions: DataFrame) -> DataFrame:
    """One row a speaker: recordings, minutes, transcribed, words, annotated, ready, stale, generations (AGG33)."""
    done = transcripts.where("segments is not null").select(F.col("recording_id").alias("id")).distinct().withColumn("done", F.lit(1))
    rec = recordings.join(done, "id", "left").groupBy("speaker_id").agg(F.count("*").alias("recordings"), F.round(F.sum(F.coalesce("duration_s", F.lit(0.0))) / 60, 1).alias("minutes"), F.sum(F.coalesce("done", F.lit(0))).alias("transcribed"))
    size = words.groupBy("speaker_id").agg(F.count("*").alias("words"))
    notes = annotations.groupBy("speaker_id").agg(F.count("*").alias("annotations"))
    made = versions.groupBy("speaker_id").agg(F.count_distinct("generation_id").alias("generations"))
    base = speakers.select(F.col("id").alias("speaker_id"))
    out = base.join(rec, "speaker_id", "left").join(size, "speaker_id", "left").join(notes, "speaker_id", "left").join(made, "speaker_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("speaker_id", zero("recordings"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"), zero("transcribed"), zero("words"), (F.coalesce("annotations", F.lit(0)) > 0).alias("rhetoric"), zero("generations"))
    return out.withColumn("ready", F.col("words") > 0).withColumn("stale", (F.col("words") > 0) & (F.col("transcribed") < F.col("recordings")))


def resolve(speakers: DataFrame, name: str) -> DataFrame:
    """The speaker of an id, name (in any case) or slug; the first by id (CTL1)."""
    wanted = X.slug(name, empty="")
    by_slug = X.slugify(F.col("name"))
    hit = (F.col("id") == name) | (F.lower("name") == name.lower()) | (by_slug == wanted) | (F.replace(by_slug, F.lit("-"), F.lit("")) == wanted.replace("-", ""))
    return speakers.where(hit).orderBy("id").limit(1)


def new_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(speaker_id, ord, title) -> ids: the slug, with -2, -3 … where it is taken (WIN9). ``taken``: speaker_id, id.

    Suffixes go on from the highest one taken, so an id that already has the form slug-n is never given twice.
    """
    slugs = wanted.withColumn("slug", X.slugify(F.col("title")))
    parts = taken.select("speaker_id", F.regexp_replace("id", r"-\d+$", "").alias("slug"), F.coalesce(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("k"))
    whole = taken.select("speaker_id", F.col("id").alias("slug"), F.lit(1).alias("k"))
    used = parts.unionByName(whole).groupBy("speaker_id", "slug").agg(F.max("k").alias("k"))
    n = F.row_number().over(Window.partitionBy("speaker_id", "slug").orderBy("ord")) + F.coalesce("k", F.lit(0))
    return slugs.join(used, ["speaker_id", "slug"], "left").withColumn("n", n).select("speaker_id", "ord", "title", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "n")).alias("id"))


def language_ranking(guesses: DataFrame) -> DataFrame:
    """(recording_id, lang, prob, rank) from guesses of several windows (AGG32)."""
    mean = guesses.groupBy("recording_id", "lang").agg(F.avg("prob").alias("prob"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("prob"), "lang")))


def language_gate(guesses: DataFrame, expected: DataFrame, accept: float = 0.6, warn: float = 0.8) -> DataFrame:
    """(recording_id, lang, prob, verdict): accepted, mismatch (another language than expected, surely) or uncertain (CTL7)."""
    best = language_ranking(guesses).where("rank = 1").drop("rank").join(expected, "recording_id", "left")
    verdict = F.when((F.col("prob") >= warn) & (F.col("expected") != F.col("lang")), "mismatch").when(F.col("expected").isNotNull() | (F.col("prob") >= accept), "accepted").otherwise("uncertain")
    return best.select("recording_id", "lang", "prob", verdict.alias("verdict"))
