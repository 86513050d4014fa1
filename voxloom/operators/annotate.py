"""Tokens with parts of speech: a hook for any parser, and a small rule tagger where none is installed (§1.3 of the survey).

``annotate`` runs a tagger over Arrow batches. A tagger is a callable ``(text, lang) -> list[token dict]`` made once per
worker by a factory. RuleTagger is an approximation by closed word classes, endings and neighbours; numbers that depend on it
differ from those of a full parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from voxloom.functions import frames

TOKEN = "struct<i:int,text:string,lw:string,pos:string,tag:string,lemma:string,dep:string,head:int,verbform:array<string>,prontype:array<string>,is_punct:boolean,is_space:boolean,is_word:boolean>"
SPLIT = {
    "en": re.compile(r"[^\W\d_]+(?=n['’]t\b)|n['’]t\b|['’](?:s|re|ve|ll|d|m)\b|[^\W\d_]+(?:-[^\W\d_]+)*|\d+(?:[.,]\d+)*|\S", re.IGNORECASE),
    "fr": re.compile(r"(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)['’]|-(?:moi|toi|le|la|les|lui|nous|vous|leur|y|en|je|tu|il|elle|on|ils|elles|ce)\b|[^\W\d_]+(?:['’][^\W\d_]+)?(?:-(?!moi\b|toi\b|le\b|la\b|les\b|lui\b|nous\b|vous\b|leur\b|y\b|en\b|je\b|tu\b|il\b|elle\b|on\b|ils\b|elles\b|ce\b)[^\W\d_]+)*|\d+(?:[.,]\d+)*|\S", re.IGNORECASE),
}
CLOSED = {
    "en": {
        "PRON": "i you he she it we they me him her us them this that these those who what one everybody nobody everyone someone something nothing anything myself yourself",
        "DET": "the a an my your his its our their every each some any no most half all another",
        "ADP": "of in on at with without by for from to near behind under over before after because-of as during about",
        "CCONJ": "and or but nor so", "SCONJ": "because although while if when though since unless whereas whether",
        "AUX": "am is are was were be been being do does did have has had will would can could shall should may might must 's 're 've 'll 'd 'm wo ca",
        "PART": "not n't to", "ADV": "now then very really too never always often here there well just already only almost again later why how where",
        "INTJ": "oh yes no yeah um uh er hmm okay ok hey wow", "NUM": "one two three four five six seven eight nine ten",
    },
    "fr": {
        "PRON": "je j' tu il elle on nous vous ils elles me m' te t' se s' moi toi lui leur y en ce c' ça cela qui que qu' quoi dont où personne rien",
        "DET": "le la les l' un une des du mon ma mes ton ta tes son sa ses notre nos votre vos leurs ce cet cette ces chaque toute tout tous toutes aucune aucun quelques",
        "ADP": "de d' à dans sur sous avec sans par pour chez près derrière devant avant après pendant vers entre au aux",
        "CCONJ": "et ou mais donc or ni car", "SCONJ": "parce puisque lorsque quand si comme alors-que pendant-que lorsqu' puisqu' jusqu'",
        "AUX": "suis es est sommes êtes sont étais était étaient ai as a avons avez ont avais avait avaient sera serait être avoir",
        "ADV": "ne n' pas jamais plus très bien trop alors puis ensuite ici là encore toujours presque déjà maintenant", "INTJ": "oh ah euh heu hum oui non ouais bah ben hein voilà",
    },
}
RELATIVE = {"en": {"who", "which", "whom", "whose"}, "fr": {"qui", "que", "qu'", "dont", "où"}}
SUBJECTS = {"en": {"i", "you", "he", "she", "it", "we", "they", "nobody", "everybody", "who", "this", "that"}, "fr": {"je", "j'", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "ce", "c'", "qui", "ça"}}
IRREGULAR = set("found sold took went came saw said got made told kept left lost held brought thought knew felt built bought sat stood ran began gave wrote drove ate spoke broke chose grew drew threw paid met led sent spent".split())
BASE_VERBS = set("look grab take make put go come see say get tell keep leave let try ask use give find think listen stop wait watch open move start turn add mix cut pick call play run sit stand write read bring show hold check pour stir please remember imagine breathe".split())


class RuleTagger:
    def __init__(self):
        self.closed = {lang: {w: pos for pos, ws in reversed(kinds.items()) for w in ws.split()} for lang, kinds in CLOSED.items()}

    def __call__(self, text: str, lang: str) -> list[dict]:
        closed = self.closed[lang]
        out: list[dict] = []
        for m in SPLIT[lang].finditer(text):
            raw = m.group()
            low = raw.lower().replace("’", "'")
            lw = low.lstrip("-") if len(low) > 1 else low
            word = any(c.isalpha() for c in raw)
            before = out[-1] if out else None
            pos = closed.get(lw) if word else "NUM" if raw[0].isdigit() else "PUNCT"
            verbform: list[str] = []
            tag = ""
            if pos is None:
                pos, verbform, tag = self._open(raw, lw, before, lang)
            elif pos == "AUX":
                verbform = ["Inf"] if lw in ("be", "être", "avoir") else ["Part"] if lw in ("been", "being", "été") else ["Fin"]
            prontype = ["Rel"] if lw in RELATIVE[lang] and before is not None and before["pos"] in ("NOUN", "PROPN") else []
            out.append(dict(i=len(out), text=raw, lw=lw, pos=pos, tag=tag, lemma=self._lemma(lw, pos, lang), dep="punct" if not word else "dep", head=len(out), verbform=verbform, prontype=prontype, is_punct=not word and not raw[0].isdigit(), is_space=False, is_word=word))
        self._attach(out, lang)
        return out

    @staticmethod
    def _open(raw: str, lw: str, before: dict | None, lang: str) -> tuple[str, list[str], str]:
        after_det = before is not None and before["pos"] in ("DET", "ADJ", "NUM")
        after_subject = before is not None and (before["lw"] in SUBJECTS[lang] or before["pos"] == "AUX" or before["lw"] in ("n't", "not", "to", "ne", "n'"))
        if raw[0].isupper() and before is not None and not before["is_punct"]:
            return "PROPN", [], "NNP"
        if lang == "en":
            if lw in BASE_VERBS and not after_det:
                inf = before is None or before["is_punct"] or before["pos"] in ("AUX", "PART", "CCONJ", "ADV", "INTJ") or before["lw"] == "to"
                return "VERB", ["Inf"] if inf else ["Fin"], "VB" if inf else "VBP"
            if lw.endswith("ing") and len(lw) > 4 and not after_det:
                return "VERB", ["Part"], "VBG"
            if (lw.endswith("ed") or lw in IRREGULAR) and not after_det:
                participle = before is not None and before["pos"] == "AUX"
                return "VERB", ["Part"] if participle else ["Fin"], "VBN" if participle else "VBD"
            if lw.endswith("ly"):
                return "ADV", [], "RB"
            if lw.endswith(("ful", "ous", "ive", "able", "ible", "ic", "al", "y", "en", "ish", "est")):
                return "ADJ", [], "JJ"
            return ("VERB", ["Inf"], "VB") if after_subject and before["pos"] in ("AUX", "PART") else ("NOUN", [], "NN")
        if lw.endswith(("é", "ée", "és", "ées")) and before is not None and before["pos"] in ("AUX", "ADV"):
            return "VERB", ["Part"], ""
        if not after_det and (lw.endswith(("ait", "aient", "ais", "ez", "ons", "ent")) and len(lw) > 3 or after_subject):
            return "VERB", ["Inf"] if lw.endswith(("er", "ir", "re")) and before is not None and before["pos"] in ("AUX", "VERB") else ["Fin"], ""
        if lw.endswith(("er", "ir", "oir")) and not after_det and before is not None and before["pos"] in ("VERB", "ADP"):
            return "VERB", ["Inf"], ""
        if lw.endswith("ment") and not after_det:
            return "ADV", [], ""
        if lw.endswith(("eux", "euse", "if", "ive", "ible", "able", "ique", "ant", "ante")):
            return "ADJ", [], ""
        return "NOUN", [], ""

    @staticmethod
    def _lemma(lw: str, pos: str, lang: str) -> str:
        if pos == "AUX" and lang == "fr":
            return "être" if lw in "suis es est sommes êtes sont étais était étaient sera serait être".split() else "avoir"
        if pos == "AUX":
            return "be" if lw in "am is are was were be been being 's 're 'm".split() else "have" if lw in "have has had 've".split() else "do" if lw in "do does did".split() else lw
        if lang == "en" and pos == "VERB" and lw.endswith("ed") and len(lw) > 4:
            return lw[:-2]
        if lang == "en" and pos == "NOUN" and lw.endswith("s") and not lw.endswith("ss") and len(lw) > 3:
            return lw[:-1]
        return lw

    @staticmethod
    def _attach(tokens: list[dict], lang: str) -> None:
        """Auxiliaries to the next verb of their clause, subjects to the next verb form, copulas to the predicate."""
        for k, t in enumerate(tokens):
            clause = []
            for x in tokens[k + 1 :]:
                if x["is_punct"] or x["pos"] in ("SCONJ", "CCONJ"):
                    break
                clause.append(x)
            verb = next((x for x in clause if x["pos"] == "VERB"), None)
            if t["pos"] == "AUX":
                if verb is not None:
                    passive = "Part" in verb["verbform"] and t["lemma"] in ("be", "être") and verb["tag"] != "VBG"
                    t["dep"], t["head"] = ("aux:pass" if lang == "fr" else "auxpass") if passive else "aux", verb["i"]
                elif clause and t["lemma"] in ("be", "être"):
                    head = next((x for x in clause if x["pos"] in ("ADJ", "NOUN", "PROPN", "PRON")), None)
                    if head is not None:
                        t["dep"], t["head"] = "cop", head["i"]
            elif t["lw"] in SUBJECTS[lang] or t["pos"] in ("NOUN", "PROPN"):
                nxt = clause[0] if clause else None
                target = verb if nxt is not None and nxt["pos"] in ("VERB", "AUX", "PART", "ADV") else None
                if target is not None:
                    t["dep"], t["head"] = "nsubj", target["i"]


class ParserTagger:
    """spaCy models, where they are installed."""

    MODELS = {"en": "en_core_web_md", "fr": "fr_core_news_md"}

    def __init__(self):
        import spacy

        self.models = {lang: spacy.load(name, disable=["ner"]) for lang, name in self.MODELS.items()}

    def __call__(self, text: str, lang: str) -> list[dict]:
        return [
            dict(i=t.i, text=t.text, lw=t.text.lower().replace("’", "'").lstrip("-"), pos=t.pos_, tag=t.tag_, lemma=t.lemma_, dep=t.dep_, head=t.head.i, verbform=t.morph.get("VerbForm"), prontype=t.morph.get("PronType"), is_punct=t.is_punct, is_space=t.is_space, is_word=any(c.isalpha() for c in t.text))
            for t in self.models[lang](text)
        ]


def annotate(utts: DataFrame, lang: str, tagger: Callable[[], Callable[[str, str], list[dict]]] = RuleTagger) -> DataFrame:
    """``utts`` (speaker_id, recording_id, utt_id, index, text) with ``tokens``. The tagger is made once per batch iterator."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = tagger()
        names = ["speaker_id", "recording_id", "utt_id", "index", "text", "tokens"]
        for batch in batches:
            rows = []
            for *ids, text in zip(*(batch[n] for n in names[:5])):
                rows.append((*ids, text, tag(text, lang) if isinstance(text, str) else []))
                if len(rows) == 2000:
                    yield frames.frame(names, rows)
                    rows = []
            yield frames.frame(names, rows)

    # A stated number of partitions: merged ones would leave cores idle while Python works.
    parts = int(utts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return utts.select("speaker_id", "recording_id", "utt_id", "index", "text").repartition(parts, "speaker_id", "utt_id").mapInPandas(run, f"speaker_id string, recording_id string, utt_id long, index int, text string, tokens array<{TOKEN}>")
