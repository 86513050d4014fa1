"""Media files of a folder: list, digest, duration (SRC1, SRC4, SRC5); downloading, decoding and recognition as hooks (SRC2, SRC3, SRC10)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import frames

# File endings of audio and video.
MEDIA = "mp3 wav m4a aac flac ogg opus wma aiff aif caf amr mp4 m4v mov mkv webm avi 3gp".split()


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the media files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA)).orderBy("path")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of the media files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA)).select("path", F.sha2("content", 256).alias("sha256"))


def wav_seconds(head: bytes) -> float | None:
    """Duration from a RIFF header: bytes of data over bytes a second."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt ":
            rate = struct.unpack("<I", head[at + 16 : at + 20])[0]
        elif name == b"data":
            return size / rate if rate else None
        at += 8 + size + size % 2
    return None


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, duration_s) of the WAV files below a folder, null where the header cannot be read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frames.frame(["path", "duration_s"], [(p, wav_seconds(bytes(c))) for p, c in zip(batch["path"], batch["content"])])

    wav = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder)
    return wav.select("path", "content").mapInPandas(run, "path string, duration_s double")


def ffmpeg_wav(source: str, target: str) -> None:
    """Mono, 16 kHz, by the ffmpeg program of the machine."""
    import subprocess

    subprocess.run(["ffmpeg", "-v", "error", "-y", "-i", source, "-vn", "-ac", "1", "-ar", "16000", target], check=True, capture_output=True)


def _tried(df: DataFrame, column: str, out: str, work: Callable[[str], str]) -> DataFrame:
    """``df``'s column with what ``work`` makes of it, or the error it ends with; one failure stops no other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[column]:
                try:
                    rows.append((value, work(value), None))
                except Exception as e:
                    rows.append((value, None, f"{type(e).__name__}: {e}"))
            yield frames.frame([column, out, "error"], rows)

    return df.select(column).distinct().mapInPandas(run, f"{column} string, {out} string, error string")


def fetched(sources: DataFrame, download: Callable[[str], str]) -> DataFrame:
    """(source, path, error): addresses through a downloader that returns where it put the file; local paths pass through (SRC2)."""
    return _tried(sources, "source", "path", lambda s: download(s) if "://" in s else s)


def normalised(files: DataFrame, folder: str, convert: Callable[[str, str], None] = ffmpeg_wav) -> DataFrame:
    """(path, audio_path, error): every file in the form that recognition reads, below ``folder`` (SRC3)."""
    def work(path: str) -> str:
        import hashlib
        import os

        target = os.path.join(folder, hashlib.sha256(path.encode()).hexdigest()[:24] + ".wav")
        convert(path.removeprefix("file:"), target)
        return target

    return _tried(files, "path", "audio_path", work)


def transcribed(recordings: DataFrame, backend: Callable[[], Callable[[str, str], dict]], schema: str) -> DataFrame:
    """Recordings through a speech recogniser made once per worker: (id, audio_path, language) -> rows of ``schema`` (SRC10, CTL11)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = backend()
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            made = [recognise(a, lang) | {"recording_id": i} for i, a, lang in zip(batch["id"], batch["audio_path"], batch["language"])]
            yield frames.frame(names, [tuple(m.get(n) for n in names) for m in made])

    return recordings.select("id", "audio_path", "language").mapInPandas(run, schema)
