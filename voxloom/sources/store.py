"""A catalogue kept as files: speakers and recordings as JSON lines, transcripts as JSON, results as Parquet, JSON or text
(SRC6-SRC9, SRC11, SRC12, SRC14, SNK1-SNK7, SNK10, CARD11, CTL2-CTL4, CTL6)."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import catalog
from voxloom.plans.shared import materialize
from voxloom.sources import schema


class CatalogError(Exception):
    pass


class Store:
    """Tables below a root folder.

    A table is a folder of versions and a pointer to one of them. Replacing a table writes a new version beside the old one and
    then moves the pointer in one step, so whoever reads, or starts again after a crash, finds the old table or the new one, whole.
    """

    KINDS = {
        "speakers": schema.SPEAKER, "recordings": schema.RECORDING, "transcripts": schema.TRANSCRIPT, "utterances": schema.UTTERANCE, "annotations": schema.ANNOTATION,
        "generations": schema.GENERATION, "cards": schema.CARD, "reports": schema.CARD, "annotated_chunks": schema.ANNOTATED_CHUNK,
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _current(self, kind: str) -> str | None:
        """The folder of the version in force."""
        pointer = self._path(kind, "_current")
        files = pointer.getFileSystem(self._conf)
        if not files.exists(pointer):
            return None
        stream = files.open(pointer)
        try:
            return f"{self.root}/{kind}/{stream.readLine()}"
        finally:
            stream.close()

    def _point(self, kind: str, version: str) -> None:
        fresh, pointer = self._path(kind, f"_next-{version}"), self._path(kind, "_current")
        files = pointer.getFileSystem(self._conf)
        stream = files.create(fresh, True)
        stream.writeBytes(version + "\n")
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = files.makeQualified
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf).rename(qualified(fresh), qualified(pointer), how)

    def read(self, kind: str) -> DataFrame:
        """A table; fields outside its schema are ignored, a table that was never written is empty."""
        folder = self._current(kind)
        if folder is None:
            return self.spark.createDataFrame([], self.KINDS[kind])
        return self.spark.read.schema(self.KINDS[kind]).json(folder)

    def write(self, kind: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Replace a table, or add rows to it; added rows come into force when they are all written."""
        folder = self._current(kind)
        if mode == "append" and folder is not None:
            df.write.mode("append").json(folder)
            return
        version = f"v-{uuid.uuid4().hex}"
        df.write.json(f"{self.root}/{kind}/{version}")
        self._point(kind, version)
        if folder is not None:
            old = self._jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(self._conf).delete(old, True)

    def save_profile(self, lang: str, profile: DataFrame) -> None:
        """The measured profiles of all speakers of a language, for later comparisons (SNK6)."""
        kind, version = f"profiles-{lang}", f"v-{uuid.uuid4().hex}"
        profile.write.parquet(f"{self.root}/{kind}/{version}")
        self._point(kind, version)

    def forget_profile(self, lang: str) -> None:
        pointer = self._path(f"profiles-{lang}", "_current")
        pointer.getFileSystem(self._conf).delete(pointer, False)

    def profile(self, lang: str) -> DataFrame | None:
        """The saved profiles of a language, None if there are none (SRC12)."""
        folder = self._current(f"profiles-{lang}")
        return None if folder is None else self.spark.read.parquet(folder)

    def save_documents(self, kind: str, lang: str, made: DataFrame, force: bool = False) -> DataFrame:
        """(speaker_id, document, fresh): cards or reports (speaker_id, document) are kept with the stamp of what was made. One that was
        edited by hand since stays unless forced; those of other speakers and languages stay as they are (CARD11)."""
        there = self.read(kind)
        mine = there.where(F.col("lang") == lang).select("speaker_id", F.col("document").alias("old"), F.col("stamp").alias("old_stamp"))
        both = made.join(mine, "speaker_id", "left")
        untouched = F.col("old").isNull() | (F.sha2(F.col("old"), 256) == F.coalesce("old_stamp", F.sha2(F.col("document"), 256)))
        fresh = F.lit(True) if force else untouched
        rows = materialize(both.select("speaker_id", F.when(fresh, F.col("document")).otherwise(F.col("old")).alias("document"), F.when(fresh, F.sha2(F.col("document"), 256)).otherwise(F.col("old_stamp")).alias("stamp"), fresh.alias("fresh")), kind)
        others = there.join(rows.select("speaker_id", F.lit(lang).alias("lang")), ["speaker_id", "lang"], "left_anti")
        self.write(kind, others.unionByName(rows.select("speaker_id", F.lit(lang).alias("lang"), "document", "stamp")))
        return rows.select("speaker_id", "document", "fresh")

    def add_speaker(self, name: str, id: str | None = None, description: str = "", languages: list[str] | None = None) -> str:
        id = id or X.slug(name)
        if not self.read("speakers").where(F.col("id") == id).isEmpty():
            raise CatalogError(f"there is already a speaker {id}")
        row = (id, name, description, languages or [], datetime.now(timezone.utc).isoformat(timespec="seconds"))
        self.write("speakers", self.spark.createDataFrame([row], schema.SPEAKER), "append")
        return id

    def ensure_speaker(self, name: str, language: str | None = None) -> str:
        """The id of a speaker, made if unknown; a given language comes first in the list (CTL2)."""
        known = self.read("speakers")
        hit = catalog.resolve(known, name).first()
        if hit is None:
            return self.add_speaker(name, languages=[language] if language else [])
        if language and (hit["languages"] or [None])[0] != language:
            first = F.concat(F.array(F.lit(language)), F.array_remove(F.coalesce("languages", F.array().cast("array<string>")), language))
            self.write("speakers", known.withColumn("languages", F.when(F.col("id") == hit["id"], first).otherwise(F.col("languages"))))
        return hit["id"]

    def add_recordings(self, new: DataFrame) -> DataFrame:
        """(source, outcome): rows are added unless their source or content is there already (CTL3, CTL6, JN15).

        ``new``: the recording columns without id; genre and register outside their lists fail.
        """
        there = self.read("recordings")
        bad = ~F.coalesce(F.col("genre").isin(*catalog.GENRES) & F.col("register").isin(*catalog.REGISTERS), F.lit(False))
        seen = there.select("speaker_id", "sha256").distinct().withColumn("again", F.lit(True))
        urls = there.select("speaker_id", "source").distinct().withColumn("url", F.lit(True))
        marked = new.join(seen, ["speaker_id", "sha256"], "left").join(urls, ["speaker_id", "source"], "left")
        outcome = F.when(bad, "failed").when(F.col("again") | F.col("url"), "already there").otherwise("added")
        marked = materialize(marked.withColumn("outcome", outcome).withColumn("ord", F.monotonically_increasing_id()), "new-recordings")
        # Of rows that share their content or their source inside the batch, the first is added.
        nth = lambda key: F.row_number().over(Window.partitionBy("speaker_id", "outcome", key).orderBy("ord"))
        content = marked.withColumn("outcome", F.when((F.col("outcome") == "added") & F.col("sha256").isNotNull() & (nth("sha256") > 1), "already there").otherwise(F.col("outcome")))
        marked = materialize(content.withColumn("outcome", F.when((F.col("outcome") == "added") & F.col("source").isNotNull() & (nth("source") > 1), "already there").otherwise(F.col("outcome"))), "new-recordings")
        fresh = marked.where("outcome = 'added'")
        ids = catalog.new_ids(fresh.select("speaker_id", "ord", "title"), there.select("speaker_id", "id")).select("speaker_id", "ord", "id")
        columns = [c.split()[0] for c in schema.RECORDING.split(", ")]
        self.write("recordings", fresh.join(ids, ["speaker_id", "ord"]).select(*columns), "append")
        return marked.select("source", "outcome")

    def remove_recording(self, speaker_id: str, id: str) -> None:
        there = self.read("recordings")
        mine = (F.col("speaker_id") == speaker_id) & (F.col("id") == id)
        if there.where(mine).isEmpty():
            raise CatalogError(f"{speaker_id} has no recording {id}")
        self.write("recordings", there.where(~mine))


def flatten_transcript(raw: DataFrame) -> DataFrame:
    """A recogniser's output in the shape of a transcript: texts trimmed, numbers to three places, the whole text joined (SRC11)."""
    r = lambda c: F.round(c, 3)
    word = lambda w: F.struct(F.trim(w["word"]).alias("word"), r(w["start"]).alias("start"), r(w["end"]).alias("end"), r(w["p"]).alias("p"))
    segment = lambda s: F.struct(
        r(s["start"]).alias("start"), r(s["end"]).alias("end"), F.trim(s["text"]).alias("text"), r(s["avg_logprob"]).alias("avg_logprob"), r(s["no_speech_prob"]).alias("no_speech_prob"), r(s["compression_ratio"]).alias("compression_ratio"),
        F.transform(F.coalesce(s["words"], F.array().cast(f"array<{schema.WORD}>")), word).alias("words"),
    )
    out = raw.withColumn("segments", F.transform("segments", segment))
    return out.withColumn("text", F.array_join(F.filter(F.transform("segments", lambda s: s["text"]), lambda t: t != ""), " "))


def transcript_texts(transcripts: DataFrame) -> DataFrame:
    """(recording_id, text): one segment a line (SNK4)."""
    return transcripts.select("recording_id", F.array_join(F.col("segments.text"), "\n").alias("text"))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files (SRC14)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
