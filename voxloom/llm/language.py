"""Problem 3: the language of transcripts, of their foreign segments, and of speakers.

Character models (see charlm) are fitted on a bounded sample of labelled documents plus a few built-in sentences a language,
cleaned once by their own verdict because labels can be wrong. A text gets the language of lowest length-normalised
cross-entropy; a confidence from the tempered likelihoods, the temperature fitted on held-out texts; and none when its
cross-entropy is beyond what held-out texts of that language reach.

Defined results: null, empty and wordless texts have no language; a transcript delivered twice counts once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.llm import units
from voxloom.llm.canon import transducer
from voxloom.llm.charlm import Models
from voxloom.llm.speech import ANY_LABEL, has_content, invented, without_marks
from voxloom.plans.shared import materialize, spread_out

SAMPLE_ROWS = 150
SAMPLE_CHARS = 120_000
HELD_OUT = 5
SLICE_CHARS = 300_000
PRIOR = 3.0
LENGTHS = (15, 30, 60, 120)  # letters, for which limits are calibrated
GRID = (0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0)
LEAST_TEMPERATURE, LEAST_PIECES, REACH, OPEN_LIMIT = 0.05, 30, 0.999, 4.5
STRETCH = 25  # letters of the smallest piece of a document that is judged by itself
# How languages are named. The first is the code.
NAMES = {
    "en": "en eng english", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "de": "de deu ger german deutsch", "it": "it ita italian italiano", "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский", "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 普通话", "ja": "ja jpn japanese 日本語",
    "hi": "hi hin hindi हिन्दी हिंदी", "th": "th tha thai ไทย ภาษาไทย",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
SEEDS = {
    "en": "The people in this town know that we have been here before and they would like to see what you can do with it. I do not think so, but there is nothing we could say about her work. Well, yes, of course, that is right, thank you.",
    "fr": "Les gens de cette ville savent que nous sommes déjà venus ici et ils voudraient voir ce que vous pouvez en faire. Je ne crois pas, mais il n'y a rien que l'on puisse dire sur son travail. Eh bien, oui, bien sûr, c'est ça, merci.",
    "es": "La gente de esta ciudad sabe que ya hemos estado aquí y les gustaría ver lo que usted puede hacer con ello. No lo creo, pero no hay nada que podamos decir sobre su trabajo. Bueno, sí, claro, eso es, muchas gracias.",
    "de": "Die Leute in dieser Stadt wissen, dass wir schon einmal hier waren, und sie möchten sehen, was man damit machen kann. Ich glaube nicht, aber es gibt nichts, was wir über ihre Arbeit sagen könnten. Na ja, natürlich, genau, vielen Dank.",
    "it": "La gente di questa città sa che siamo già stati qui e vorrebbe vedere che cosa si può fare con esso. Non credo, ma non c'è niente che possiamo dire del suo lavoro. Beh, sì, certo, è proprio così, grazie mille.",
    "pt": "As pessoas desta cidade sabem que já estivemos aqui e gostariam de ver o que você pode fazer com isso. Não acredito, mas não há nada que a gente possa dizer sobre o seu trabalho. Bem, sim, claro, é isso mesmo, muito obrigado.",
    "ru": "Люди в этом городе знают, что мы уже были здесь, и хотели бы посмотреть, что с этим можно сделать. Я так не думаю, но нам нечего сказать о её работе. Ну да, конечно, именно так, большое спасибо.",
    "zh": "这个城市的人知道我们以前来过这里，他们想看看你能用它做什么。我不这么认为，但是关于她的工作我们没有什么可以说的。好吧，对，当然，就是这样，谢谢你。",
    "ja": "この町の人たちは私たちが前にもここに来たことを知っていて、あなたがそれで何をするのか見たいと思っています。そうは思いませんが、彼女の仕事について言えることは何もありません。まあ、はい、もちろん、その通りです、ありがとうございます。",
    "hi": "इस शहर के लोग जानते हैं कि हम पहले भी यहाँ आ चुके हैं और वे देखना चाहते हैं कि आप इसके साथ क्या कर सकते हैं। मुझे ऐसा नहीं लगता, लेकिन उसके काम के बारे में हम कुछ नहीं कह सकते। हाँ, ज़रूर, ठीक है, धन्यवाद।",
    "th": "คนในเมืองนี้รู้ว่าเราเคยมาที่นี่แล้วและพวกเขาอยากเห็นว่าคุณจะทำอะไรกับมันได้บ้าง ผมไม่คิดอย่างนั้นแต่ไม่มีอะไรที่เราจะพูดเกี่ยวกับงานของเธอได้ ใช่ครับ แน่นอน ถูกต้อง ขอบคุณมาก",
}
NOT_LETTERS = re.compile(r"[\W\d_]+")
LEADING_NAME = re.compile(r"^\s*(?:>>\s*)?[^\W\d_][\w.'-]*(?:\s+[\w.'-]+){0,2}(?:\s*[:：]|\s+[-–—](?=\s))\s*")


def code_of(name: str | None) -> str | None:
    """The two-letter code of a language given by code, region tag or name; None for anything else."""
    if not isinstance(name, str):
        return None
    low = name.strip().lower()
    return CODES.get(low) or CODES.get(re.split(r"[-_ ]", low)[0])


def letters_of(text: str) -> str:
    """What the models see: lower-case letters and marks, single spaces."""
    seen = text if text.isascii() else transducer(True)(text)
    return " ".join(_word_runs(seen.lower()))


def _word_runs(text: str) -> list[str]:
    if text.isascii():
        return NOT_LETTERS.sub(" ", text).split()
    return [w for w in (re.sub(r"[\d_]+", "", x) for x in units.word_finder()(text)) if w]


def speech_of(text: str | None) -> str:
    """A segment without time marks, notes and the label in front; "" if no more than hesitations is left."""
    if not text:
        return ""
    bare = without_marks(text)
    bare = LEADING_NAME.sub("", ANY_LABEL.sub("", bare), count=1)
    return bare if has_content(bare) else ""


def word_count(text: str) -> float:
    """Words, estimated from letters where a script has no spaces."""
    if units.spaceless_share(text) > 0.5:
        return max(1.0, len(units.letters(text)) / 2.5)
    return float(max(1, len(text.split())))


def rejection_limits(ce: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """By language, half-way between what nearly all texts of the language reach and what a text of an unknown language usually has.

    ``ce``: cross-entropies of pieces of known languages by model. A piece shows what an unknown language does when the model of
    its own is left out: the best of the others would take it. Pieces that another model fits better are mislabelled and left
    out.
    """
    here = np.arange(len(truth))
    own = ce[here, truth]
    others = ce.copy()
    others[here, truth] = np.inf
    nearest = others.min(axis=1)
    right = own <= nearest
    usual = np.array([np.median(own[right & (truth == j)]) if (right & (truth == j)).any() else np.nan for j in range(ce.shape[1])])
    middle = np.nanmedian(usual) if right.any() else np.nan
    if not np.isfinite(middle):
        return np.full(ce.shape[1], OPEN_LIMIT)
    usual = np.where(np.isfinite(usual), usual, np.nanmax(usual))
    reach = np.quantile(own[right] - usual[truth[right]], REACH)
    foreign = np.median(nearest[np.isfinite(nearest)]) - middle if np.isfinite(nearest).any() else reach
    return usual + max(reach, (reach + foreign) / 2)


@dataclass
class Identifier:
    models: Models
    limit: np.ndarray  # by length (LENGTHS) and language: the cross-entropy beyond which a text is rejected
    temperature: float  # of decisions
    sharpness: float  # of confidences

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> Identifier:
        """From (language, text) rows, some of them wrong."""
        rows = [(lang, letters_of(text)) for lang, text in labelled]
        rows = [(lang, text[:SAMPLE_CHARS]) for lang, text in rows if len(text) > 20]
        rows.sort(key=lambda r: zlib.crc32(r[1].encode()))
        seeds = {lang: [letters_of(s)] for lang, s in SEEDS.items()}

        def group(items):
            out = {lang: list(t) for lang, t in seeds.items()}
            size: Counter = Counter()
            for lang, text in items:
                if size[lang] < SAMPLE_CHARS:
                    out[lang].append(text)
                    size[lang] += len(text)
            return out

        # Labels can be wrong: each half is judged by models of the other, and rows they contradict are left out.
        halves = [rows[0::2], rows[1::2]]
        rows = []
        for mine, other in (halves, halves[::-1]):
            if mine:
                judge = Models.fit(group(other))
                best = judge.cross_entropy([t for _, t in mine]).argmin(axis=1)
                rows += [r for r, j in zip(mine, best) if judge.languages[j] == r[0]]
        train, test = [r for i, r in enumerate(rows) if i % HELD_OUT], rows[::HELD_OUT]
        models = Models.fit(group(train))
        n = len(models.languages)
        limit = np.full((len(LENGTHS), n), OPEN_LIMIT)
        temperature = sharpness = 0.3
        for k, size in enumerate(LENGTHS):
            pieces = [(models.languages.index(lang), text[i : i + size]) for lang, text in test for i in range(0, min(len(text), 10 * size), size) if len(text[i : i + size]) >= size // 2]
            if len(pieces) < LEAST_PIECES:
                continue
            ce = models.cross_entropy([t for _, t in pieces])
            truth = np.array([j for j, _ in pieces])
            limit[k] = rejection_limits(ce, truth)
            if size == 60:
                sizes = np.array([len(t) for _, t in pieces])
                fits = []
                for t in GRID:
                    z = -ce * sizes[:, None] * t
                    z -= z.max(axis=1, keepdims=True)
                    fits.append((float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean()), t))
                sharpness = min(fits)[1]
                temperature = max(sharpness, LEAST_TEMPERATURE)
        return cls(models, limit, temperature, sharpness)

    def allowed(self, letters: int) -> np.ndarray:
        """By language, the cross-entropy up to which a text of so many letters is accepted."""
        return self.limit[max(0, int(np.searchsorted(LENGTHS, letters, "right")) - 1)]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy, tempered log likelihood) by text and language, of texts as letters_of gives them."""
        ce = self.models.cross_entropy(texts)
        return ce, -ce * (np.array([len(t) for t in texts]) + 1)[:, None] * self.temperature if len(texts) else ce

    def confidence(self, loglik: np.ndarray) -> np.ndarray:
        z = np.exp((loglik - loglik.max()) * (self.sharpness / self.temperature))
        return z / z.sum()

    def judge(self, ce: np.ndarray, loglik: np.ndarray, letters: int) -> tuple[str | None, float]:
        j = int(ce.argmin())
        if ce[j] > self.allowed(letters)[j]:
            return None, 0.0
        return self.models.languages[j], float(self.confidence(loglik)[j])

    def identify(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        seen = [letters_of(t) if t else "" for t in texts]
        some = [i for i, t in enumerate(seen) if t]
        ce, ll = self.scores([seen[i] for i in some])
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        for k, i in enumerate(some):
            out[i] = self.judge(ce[k], ll[k], len(seen[i]))
        return out

    def transcripts(self, batch: list[list[str]]) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
        """For the speech of each transcript's segments: main language, confidence, and foreign segments.

        The main language is that of most words. A segment is foreign when its own language is likelier than the main one
        by the prior odds of staying in the main language.
        """
        flat = [(i, k, letters_of(s), word_count(s)) for i, segs in enumerate(batch) for k, s in enumerate(segs) if s]
        flat = [f for f in flat if f[2]]
        ce, ll = self.scores([f[2] for f in flat])
        by: dict[int, list[int]] = {}
        for x, f in enumerate(flat):
            by.setdefault(f[0], []).append(x)
        out: list = [(None, 0.0, [])] * len(batch)
        for i, xs in by.items():
            votes: Counter = Counter()
            for x in xs:
                j = int(ce[x].argmin())
                if ce[x, j] <= self.allowed(len(flat[x][2]))[j]:
                    votes[j] += flat[x][3]
            if not votes:
                continue
            main = max(votes, key=lambda j: (votes[j], -j))
            foreign = []
            for x in xs:
                z = ll[x].copy()
                z[main] += PRIOR
                j = int(z.argmax())
                if j != main and ce[x, j] <= self.allowed(len(flat[x][2]))[j]:
                    foreign.append((flat[x][1], self.models.languages[j], float(self.confidence(z)[j])))
            mine = [x for x in xs if int(ce[x].argmin()) == main]
            sure = float(self.confidence(ll[mine].sum(axis=0))[main])
            out[i] = (self.models.languages[main], sure * votes[main] / sum(votes.values()), foreign)
        return out


def code_column(name):
    """code_of as an expression, so that it stays in the JVM."""
    low = F.lower(F.trim(name))
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(names[low], names[F.split(low, "[-_ ]")[0]])


def labelled_sample(documents: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled documents a language, those with the lowest hash of their id; sent to the driver.

    The bound is languages times ``rows``. Ids are ranked without their texts.
    """
    ids = documents.select("doc_id", code_column(F.col("lang")).alias("code")).where("code is not null").dropDuplicates(["doc_id"])
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= rows).select("doc_id", "code")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "code").agg(F.min("text").alias("text"))
    return [(r["code"], r["text"]) for r in texts.where("text is not null").collect()]


def identifier_for(documents: DataFrame) -> Identifier:
    return Identifier.fit(labelled_sample(documents))


JUDGED = "recording_id string, loaded_at timestamp_ntz, label string, main string, confidence double, foreign array<struct<seg_no:int,lang:string,confidence:double>>"


def transcript_languages(transcripts: DataFrame, identifier: Identifier) -> DataFrame:
    """(recording_id, label, main, confidence, foreign), one row a recording with a text; only verdicts are shuffled."""
    shared = transcripts.sparkSession.sparkContext.broadcast(identifier)
    s = F.col("segments")
    slim = transcripts.where("recording_id is not null").select(
        "recording_id", "loaded_at", "language", "text", s.getField("text").alias("texts"), s.getField("avg_logprob").alias("logprobs"), s.getField("no_speech_prob").alias("nospeech")
    ).where("texts is not null or text is not null")
    slim = slim.withColumn("text", F.when(F.size("texts") > 0, None).otherwise(F.col("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value
        for batch in batches:
            heads, speech, size = [], [], 0
            for r, at, label, texts, nospeech, logprobs, text in zip(*(batch[c] for c in ("recording_id", "loaded_at", "language", "texts", "nospeech", "logprobs", "text"))):
                heads.append((r, at, label))
                if texts is None or not len(texts):
                    speech.append([speech_of(text)])
                else:
                    speech.append(["" if invented(n if n == n else None, lp if lp == lp else None) else speech_of(t) for t, n, lp in zip(texts, nospeech, logprobs)])
                size += sum(map(len, speech[-1]))
                if size > SLICE_CHARS:
                    yield judged_frame(heads, judge.transcripts(speech))
                    heads, speech, size = [], [], 0
            if heads:
                yield judged_frame(heads, judge.transcripts(speech))

    def judged_frame(heads, verdicts):
        rows = [(*head, main, conf, [{"seg_no": k, "lang": lang, "confidence": c} for k, lang, c in foreign]) for head, (main, conf, foreign) in zip(heads, verdicts)]
        return frames.frame(["recording_id", "loaded_at", "label", "main", "confidence", "foreign"], rows)

    judged = spread_out(slim, "recording_id").mapInPandas(run, JUDGED)
    kept = F.min_by(F.struct("label", "main", "confidence", "foreign"), "loaded_at").alias("j")
    return judged.groupBy("recording_id").agg(kept).select("recording_id", "j.label", "j.main", "j.confidence", "j.foreign").where("main is not null")


def corrections(judged: DataFrame, recordings: DataFrame, speakers: DataFrame) -> DataFrame:
    """(scope, item_id, seg_no, lang, confidence): wrong or missing transcript labels, foreign segments, languages speakers lack."""
    labels = judged.where(~code_column(F.col("label")).eqNullSafe(F.col("main"))).select(F.lit("transcript").alias("scope"), F.col("recording_id").alias("item_id"), F.lit(-1).alias("seg_no"), F.col("main").alias("lang"), "confidence")
    segments = judged.select("recording_id", F.explode("foreign").alias("f")).select(F.lit("segment").alias("scope"), F.col("recording_id").alias("item_id"), "f.seg_no", "f.lang", "f.confidence")
    spoken = (
        judged.join(recordings.select(F.col("id").alias("recording_id"), "speaker_id").where("speaker_id is not null").distinct(), "recording_id")
        .groupBy("speaker_id", F.col("main").alias("lang")).agg(F.max("confidence").alias("confidence"))
    )
    known = speakers.select(F.col("id").alias("speaker_id"), F.explode_outer("languages").alias("name")).groupBy("speaker_id").agg(F.collect_set(code_column(F.col("name"))).alias("known"))
    lacking = spoken.join(known, "speaker_id").where(~F.array_contains("known", F.col("lang"))).select(F.lit("speaker").alias("scope"), F.col("speaker_id").alias("item_id"), F.lit(-1).alias("seg_no"), "lang", "confidence")
    return labels.unionByName(segments).unionByName(lacking)


def language_report(transcripts: DataFrame, documents: DataFrame, recordings: DataFrame, speakers: DataFrame) -> DataFrame:
    judged = materialize(transcript_languages(transcripts, identifier_for(documents)), "languages")
    return corrections(judged, recordings, speakers)


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of every document; lang is null where the text is rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(identifier_for(documents))
    names = ["doc_id", "lang", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(batch["doc_id"], batch["text"]):
                ids.append(d)
                texts.append(t if isinstance(t, str) else None)
                size += len(texts[-1] or "")
                if size > SLICE_CHARS or len(ids) == 10_000:
                    yield frames.frame(names, [(d, *v) for d, v in zip(ids, shared.value.identify(texts))])
                    ids, texts, size = [], [], 0
            yield frames.frame(names, [(d, *v) for d, v in zip(ids, shared.value.identify(texts))])

    return spread_out(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, lang string, confidence double")


PIECE = re.compile(r"[^\n.!?…。！？।]*[\n.!?…。！？।]+\s*|[^\n.!?…。！？।]+$")


def stretches(text: str) -> list[tuple[int, int]]:
    """Pieces of a text, cut after lines and sentences, of STRETCH letters or more but for a last one."""
    out, begin, letters = [], 0, 0
    for m in PIECE.finditer(text):
        letters += sum(map(str.isalpha, m.group()))
        if letters >= STRETCH:
            out.append((begin, m.end()))
            begin, letters = m.end(), 0
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def document_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, start_pos, end_pos, lang, confidence): every document cut where its language changes.

    A document in one language is one segment; positions are code points and cover the text. Pieces in the main language of the
    document have its confidence. Null texts, and documents in no known language, give no row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(identifier_for(documents))
    names = ["doc_id", "seg_no", "start_pos", "end_pos", "lang", "confidence"]

    def segments(doc, places, verdict) -> list[tuple]:
        main, sure, foreign = verdict
        if main is None:
            return []
        other = {k: (lang, c) for k, lang, c in foreign}
        out: list[list] = []
        for k, (a, b) in enumerate(places):
            lang, c = other.get(k, (main, sure))
            if out and out[-1][4] == lang:
                out[-1][3], out[-1][5] = b, min(out[-1][5], c)
            else:
                out.append([doc, len(out), a, b, lang, c])
        return [tuple(r) for r in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if not isinstance(text, str) or not text:
                    continue
                held.append((doc, text, stretches(text)))
                size += len(text)
                if size > SLICE_CHARS:
                    yield judged(held)
                    held, size = [], 0
            yield judged(held)

    def judged(held: list) -> pd.DataFrame:
        verdicts = shared.value.transcripts([[text[a:b] for a, b in places] for _, text, places in held])
        return frames.frame(names, [row for (doc, _, places), v in zip(held, verdicts) for row in segments(doc, places, v)])

    return spread_out(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, seg_no int, start_pos int, end_pos int, lang string, confidence double")
