"""Command line over a store: speakers and recordings, analysis, cards, comparison, generation."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from voxloom import generation
from voxloom.client import Chat, ChatError, settings
from voxloom.functions import text as X
from voxloom.functions.lexicon import LEXICONS
from voxloom.operators import annotate, catalog, critic, documents, rhetoric, segment, syntax
from voxloom.plans.documents import measured
from voxloom.plans.shared import materialize
from voxloom.sources import schema
from voxloom.sources.media import digests, durations, media_files, transcribed
from voxloom.sources.store import CatalogError, Store, flatten_transcript

MOST_UTTERANCES = 1_000_000  # of a recording, in the numbering


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom")
    p.add_argument("--root", default="corpus", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("corpus", help="speakers and recordings").add_subparsers(dest="action", required=True)
    x = c.add_parser("init")
    x.add_argument("name")
    x.add_argument("--id")
    x.add_argument("--description", default="")
    x.add_argument("--language", action="append", default=[])
    x = c.add_parser("add")
    x.add_argument("speaker")
    x.add_argument("folder")
    x.add_argument("--genre", default="other", choices=catalog.GENRES)
    x.add_argument("--register", default="spontaneous", choices=catalog.REGISTERS)
    x.add_argument("--rights", default="")
    x = c.add_parser("rm")
    x.add_argument("speaker")
    x.add_argument("recording")
    for name in ("list", "stats", "validate"):
        c.add_parser(name)
    x = sub.add_parser("learn", help="folder to style card")
    x.add_argument("name")
    x.add_argument("folder")
    x.add_argument("--language")
    x.add_argument("--genre", default="other", choices=catalog.GENRES)
    x.add_argument("--register", default="spontaneous", choices=catalog.REGISTERS)
    x = sub.add_parser("analyze", help="transcripts to utterances and profiles")
    x.add_argument("--pause", type=float, default=segment.PAUSE_S)
    x.add_argument("--language", default="en", choices=sorted(LEXICONS))
    for name in ("report", "stylecard"):
        x = sub.add_parser(name)
        x.add_argument("speaker")
        x.add_argument("--language", default="en", choices=sorted(LEXICONS))
        x.add_argument("--force", action="store_true")
    sub.add_parser("styles", help="what is there for each speaker")
    x = sub.add_parser("rhetoric", help="annotate the chunks of a speaker that wait for it")
    x.add_argument("speaker")
    x.add_argument("--language", default="en", choices=sorted(LEXICONS))
    x.add_argument("--block", type=int, default=64, help="chunks that are annotated before the cache is written")
    for name in ("url", "model"):
        x.add_argument(f"--{name}")
    x = sub.add_parser("transcribe", help="recordings waiting for a transcript; with a backend they are transcribed")
    x.add_argument("--only", action="append", default=[], help="id of a recording")
    x = sub.add_parser("compare", help="a text against a speaker's profile")
    x.add_argument("speaker")
    x.add_argument("file")
    x.add_argument("--language", default="en", choices=sorted(LEXICONS))
    x = sub.add_parser("generate", help="write in a speaker's voice")
    x.add_argument("speaker")
    x.add_argument("instruction")
    x.add_argument("--language", default="en", choices=sorted(LEXICONS))
    x.add_argument("--words", type=int, default=250)
    x.add_argument("--revisions", type=int, default=1)
    x.add_argument("--temperature", type=float, default=0.8)
    for name in ("url", "model"):
        x.add_argument(f"--{name}")
    return p


class Session:
    """The frames of a store that commands share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def speaker(self, name: str) -> str:
        hit = catalog.resolve(self.store.read("speakers"), name).first()
        if hit is None:
            raise CatalogError(f"no speaker {name}")
        return hit["id"]

    def utterances(self):
        """Utterances in corpus order: the number of the recording, then the index."""
        u = self.store.read("utterances")
        return u.select("speaker_id", "recording_id", (F.col("rec_ord").cast("long") * MOST_UTTERANCES + F.col("index")).alias("utt_id"), "index", "start", "text", X.norm(F.col("text")).alias("norm"))

    def frames(self, lang: str):
        utts = self.utterances()
        words = syntax.token_rows(annotate.annotate(utts, lang)).select("speaker_id", "recording_id", "utt_id", F.col("pos_i").alias("pos"), "w")
        return measured(utts, words, self.store.read("annotations"), lang)

    def profiles(self, lang: str):
        """The saved profiles, measured and saved if there are none."""
        saved = self.store.profile(lang)
        if saved is None:
            utts = self.utterances()
            tagged = materialize(annotate.annotate(utts, lang), "tagged")
            words = syntax.token_rows(tagged).select("speaker_id", "recording_id", "utt_id", F.col("pos_i").alias("pos"), "w")
            self.store.save_profile(lang, critic.profile(utts, words, syntax.syntax_rows(tagged, lang), lang))
            saved = self.store.profile(lang)
        return saved

    def examples(self, speaker: str) -> list[generation.Passage]:
        mine = F.col("speaker_id") == speaker
        return generation.examples(self.utterances().where(mine), self.store.read("annotations").where(mine))

    def analyze(self, pause: float) -> int:
        """Utterances of all transcripts. Recordings are numbered by speaker, time of arrival and id."""
        known = self.store.read("recordings").select(F.col("id").alias("recording_id"), "speaker_id", "added_at")
        sizes = known.groupBy("speaker_id").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("speaker_id")) - F.col("n")).drop("n")
        place = F.row_number().over(Window.partitionBy("speaker_id").orderBy("added_at", "recording_id"))
        recordings = known.withColumn("place", place).join(F.broadcast(before), "speaker_id").select("recording_id", "speaker_id", (F.col("before") + F.col("place")).cast("int").alias("rec_ord"))
        transcripts = self.store.read("transcripts").withColumn("loaded_at", F.lit(None).cast("timestamp"))
        made = segment.utterances_from_words(segment.kept_words(transcripts), pause).join(recordings, "recording_id")
        self.store.write("utterances", made.select("speaker_id", "recording_id", "rec_ord", "index", "start", "end", "text", "split"))
        for lang in LEXICONS:
            self.store.forget_profile(lang)
        return self.store.read("utterances").count()

    def annotate_devices(self, speaker: str, lang: str, chat: Chat, block: int, out=print) -> int:
        """Annotates the chunks of a speaker that are not in the cache, block by block, then verifies all that is there; the
        speaker's annotations are replaced by those kept."""
        mine = self.utterances().where(F.col("speaker_id") == speaker)
        chunks = materialize(segment.chunk_lines(mine).withColumn("speaker_id", F.lit(speaker)), "chunks")
        tag = rhetoric.cache_tag(rhetoric.PROMPT_VERSION, chat.model, bool(chat.given["thinking"]))
        waiting = materialize(rhetoric.pending_chunks(chunks, self.store.read("annotated_chunks"), tag), "waiting")
        total = waiting.count()
        numbered = materialize(waiting.withColumn("place", F.row_number().over(Window.orderBy("recording_id", "number")) - 1), "numbered")

        def ask(texts, indices, context):
            return chat.answer_as(generation.annotation_prompt(texts, indices, context, lang), generation.answer_schema())["items"]

        for begin in range(0, total, block):
            part = numbered.where(F.col("place").between(begin, begin + block - 1)).drop("place")
            self.store.write("annotated_chunks", rhetoric.annotated(part, ask, tag), "append")
            out(f"{min(begin + block, total)} of {total} chunks")
        items = materialize(rhetoric.cached_items(self.store.read("annotated_chunks"), chunks, tag), "items")
        kept = rhetoric.verify(items, mine).where("kept").select("annotation_id", F.col("lines").alias("utterances"), "t")
        rows = items.drop("utterances", "number").join(kept, "annotation_id").select("annotation_id", "speaker_id", "recording_id", "device", "utterances", "quote", "why", "t")
        others = self.store.read("annotations").where(F.col("speaker_id") != speaker)
        self.store.write("annotations", others.unionByName(rows))
        return self.store.read("annotations").where(F.col("speaker_id") == speaker).count()

    def transcribe(self, only: list[str], backend, detect=None, out=print) -> int:
        """Transcripts for the recordings that lack one, by ``backend`` (see sources.media). ``detect``: recordings (id, audio_path) ->
        (recording_id, lang, prob); a speaker without a language gets that of the surest guess, or an error if none is sure; a
        recording that surely is in another language is reported and transcribed all the same."""
        recordings = self.store.read("recordings")
        chosen = catalog.only(recordings, only) if only else recordings
        waiting = catalog.pending(chosen, self.store.read("transcripts"))
        speakers = self.store.read("speakers").select(F.col("id").alias("speaker_id"), F.get("languages", F.lit(0)).alias("expected"))
        rows = materialize(chosen.join(waiting, ["speaker_id", "id"], "left_semi").join(speakers, "speaker_id", "left"), "waiting")
        if backend is None:
            for r in rows.orderBy("speaker_id", "id").toLocalIterator():
                out(f"{r['speaker_id']}/{r['id']}")
            return 0
        if detect is not None:
            guesses = materialize(detect(rows.select("id", "audio_path")), "guesses")
            judged = materialize(catalog.language_gate(guesses, rows.select(F.col("id").alias("recording_id"), "expected")).join(rows.select(F.col("id").alias("recording_id"), "speaker_id"), "recording_id"), "judged")
            unsure = judged.where("verdict = 'uncertain'").first()
            if unsure is not None:
                raise CatalogError(f"the language of {unsure['recording_id']} is not clear: state it")
            for r in judged.where("verdict = 'mismatch'").toLocalIterator():
                out(f"{r['recording_id']} sounds like {r['lang']}")
            first = judged.groupBy("speaker_id").agg(F.max_by("lang", "prob").alias("lang"))
            rows = rows.join(first, "speaker_id", "left").withColumn("expected", F.coalesce("expected", "lang")).drop("lang")
        asked = rows.select("id", "audio_path", F.col("expected").alias("language"))
        made = transcribed(asked, backend, schema.TRANSCRIPT).join(rows.select(F.col("id").alias("recording_id"), "sha256"), "recording_id").withColumn("source_sha256", F.col("sha256")).drop("sha256")
        flat = flatten_transcript(made).select(*[c.split()[0] for c in schema.top_level(schema.TRANSCRIPT)])
        done = materialize(flat, "transcribed")
        old = self.store.read("transcripts").join(done.select("recording_id"), "recording_id", "left_anti")
        self.store.write("transcripts", old.unionByName(done))
        return done.count()

    def ingest(self, speaker: str, folder: str, genre: str, register: str, rights: str = "") -> list:
        files = media_files(self.spark, folder).join(digests(self.spark, folder), "path").join(durations(self.spark, folder), "path", "left")
        title = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        new = files.select(
            F.lit(speaker).alias("speaker_id"), title.alias("title"), F.col("path").alias("source"), F.lit(genre).alias("genre"), F.lit(register).alias("register"), F.col("path").alias("raw_path"), F.col("path").alias("audio_path"), "sha256",
            "duration_s", F.lit(False).alias("multi_speaker"), F.lit(None).cast("string").alias("date"), F.lit(rights).alias("rights"), F.lit("").alias("notes"), F.current_timestamp().cast("string").alias("added_at"),
        )
        return self.store.add_recordings(new).groupBy("outcome").count().collect()


def run(args: argparse.Namespace, spark: SparkSession, out=print, chat: Chat | None = None, backend=None, detect=None) -> int:
    s = Session(spark, args.root)
    if args.command == "corpus":
        if args.action == "init":
            out(s.store.add_speaker(args.name, args.id, args.description, args.language))
        elif args.action == "add":
            for r in s.ingest(s.speaker(args.speaker), args.folder, args.genre, args.register, args.rights):
                out(f"{r['outcome']}: {r['count']}")
        elif args.action == "rm":
            s.store.remove_recording(s.speaker(args.speaker), args.recording)
        elif args.action == "list":
            for r in s.store.read("recordings").orderBy("speaker_id", "id").select("speaker_id", "id", "genre", X.clock(F.coalesce("duration_s", F.lit(0.0))).alias("t")).toLocalIterator():
                out(f"{r['speaker_id']}  {r['id']}  {r['genre']}  {r['t']}")
        elif args.action == "stats":
            for r in catalog.stats(s.store.read("recordings")).orderBy("speaker_id", "kind", F.desc("total_s")).toLocalIterator():
                out(f"{r['speaker_id']}  {r['kind']} {r['value']}: {r['recordings']} recordings, {r['total_s']} s")
        else:
            found = catalog.problems(s.store.read("recordings")).collect()
            for r in found:
                out(f"{r['speaker_id']}/{r['id']}: {r['problem']}")
            return int(bool(found))
    elif args.command == "learn":
        speaker = s.store.ensure_speaker(args.name, args.language)
        for r in s.ingest(speaker, args.folder, args.genre, args.register):
            out(f"{r['outcome']}: {r['count']}")
        waiting = catalog.pending(s.store.read("recordings"), s.store.read("transcripts")).where(F.col("speaker_id") == speaker).count()
        out(f"{waiting} recordings wait for a transcript; {s.analyze(segment.PAUSE_S)} utterances")
    elif args.command == "analyze":
        out(f"{s.analyze(args.pause)} utterances")
    elif args.command in ("report", "stylecard"):
        make, kind = (documents.reports, "reports") if args.command == "report" else (documents.style_cards, "cards")
        made = s.store.save_documents(kind, args.language, make(s.frames(args.language), args.language), args.force)
        row = made.where(F.col("speaker_id") == s.speaker(args.speaker)).first()
        if row is None:
            raise CatalogError("nothing to analyze")
        if not row["fresh"]:
            out("edited by hand, kept")
        out(row["document"])
    elif args.command == "styles":
        utts = s.utterances().groupBy("speaker_id").agg(F.count("*").alias("utterances"), F.sum(X.whitespace_words(F.col("text"))).alias("words"))
        for r in s.store.read("speakers").join(utts.withColumnRenamed("speaker_id", "id"), "id", "left").orderBy("id").toLocalIterator():
            out(f"{r['id']}: {r['words'] or 0} words")
    elif args.command == "rhetoric":
        connection = chat or Chat(settings(url=args.url, model=args.model))
        out(f"{s.annotate_devices(s.speaker(args.speaker), args.language, connection, args.block, out)} annotations")
    elif args.command == "transcribe":
        s.transcribe(args.only, backend, detect, out)
    else:
        speaker = s.speaker(args.speaker)
        judge = generation.spark_judge(spark, s.profiles(args.language), speaker, args.language)
        if args.command == "compare":
            with open(args.file, encoding="utf-8") as f:
                found = judge(f.read())[1]
            for i in found:
                out(f"[{i['weight']}] {i['metric']}: expected {i['expected']}, got {i['got']}. {i['feedback']}")
            out(f"score {round(sum(i['weight'] for i in found), 2)}")
            return int(bool(found))
        connection = chat or Chat(settings(url=args.url, model=args.model))
        card = s.store.read("cards").where((F.col("speaker_id") == speaker) & (F.col("lang") == args.language)).first()
        if card is None:
            made = s.store.save_documents("cards", args.language, documents.style_cards(s.frames(args.language), args.language))
            card = made.where(F.col("speaker_id") == speaker).first()
        system = generation.system_prompt(args.speaker, args.language, card["document"] if card else "", s.examples(speaker))
        drafts = list(generation.rounds(connection.ask, judge, system, args.instruction, args.words, args.revisions, args.temperature))
        row = materialize(generation.generation_row(spark, drafts, speaker, args.instruction, connection.model, system), "generation")
        s.store.write("generations", row, "append")
        out(row.first()["text"])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    try:
        return run(args, spark)
    except (CatalogError, ChatError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
