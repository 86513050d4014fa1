"""What is not speech in a transcript: time marks, voice labels, sound notes, hesitations, invented segments."""

from __future__ import annotations

import re

from voxloom.llm import units
from voxloom.llm.canon import transducer

# 00:00:05, 00:03, 00:00:36.590 and 00:00:03,260, bare or in brackets, with or without a dash behind; <1m07s>.
CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
TIME_MARK = re.compile(rf"\s*(?:[\[(<【（［]\s*{CLOCK}\s*[\])>】）］](?:\s*[-–—](?=\s))?|<\d+m\d+(?:[.,]\d+)?s>|(?:(?<=^)|(?<=\n)){CLOCK}(?:\s*[-–—])?(?=\s|$))\s*")
NOTE = re.compile(r"\[[^\[\]]+\]|\(\([^()]+\)\)|\([^()]+\)|<[^<>]+>|\*[^*\s.!?][^*\n.!?]*\*|［[^［］]+］|（[^（）]+）|【[^【】]+】|[♪♫♩♬]+")
# Hesitations of the eleven languages.
HESITATIONS = frozenset(
    "uh uhh uhm um umm er erm hmm hm hmmm mm mmm mhm ah eh euh heu hum bah em ehm ähm äh öh öhm hã hã ã э эм э-э хм гм мм ммм эээ "
    "呃 嗯 唔 額 啊 うーん えーと えっと ええと あのー えー あー हम्म उम्म उम अं ऊं हूँ เอ่อ อืม อืมม เอิ่ม".split()
)
NO_SPEECH, LOW_LOGPROB = 0.8, -1.0
_SPOKEN = "|".join(sorted((re.escape(h) for h in HESITATIONS), key=len, reverse=True))
LOOSE_HESITATION = re.compile(rf"(?:(?<=^)|(?<=[.!?…,;] ))(?:{_SPOKEN})(?:,|\.{{3}}|…)\s*", re.IGNORECASE)


def invented(no_speech_prob: float | None, avg_logprob: float | None) -> bool:
    """A segment made up over silence; a missing value keeps it."""
    return no_speech_prob is not None and avg_logprob is not None and no_speech_prob > NO_SPEECH and avg_logprob < LOW_LOGPROB


MARKED = re.compile(r"[\[(<]\s*(?P<inner>[^\[\]()<>\s][^\[\]()<>]*?)\s*[\])>]\s*:?\s*|(?P<mark>\s*[:：]|\s+[-–—](?=\s))\s*")
NUMBERED = re.compile(r"(?:speaker|spk|s)[ _]?0*([1-9]\d?)", re.IGNORECASE).fullmatch
NO_NAME = re.compile(r"[\s。！？!?…」”»>]").match  # what a token of a name is not made of


class Labels:
    """The ways in which one recording's voices are named: full name, first or last name, initials, running number.

    A form that fits two voices names none.
    """

    def __init__(self, voices: list[tuple[int, str]]):
        forms: dict[str, set[int]] = {}
        initials: dict[str, set[int]] = {}
        for no, name in voices:
            parts = (name or "").split()
            if not parts:
                continue
            for key in {" ".join(parts), parts[0], parts[-1], f"{parts[0][0]}. {parts[-1]}"}:
                forms.setdefault(key.lower(), set()).add(no)
            if len(parts) > 1:
                initials.setdefault("".join(p[0] for p in parts).upper(), set()).add(no)
        self.forms = {k: next(iter(v)) for k, v in forms.items() if len(v) == 1}
        self.initials = {k: next(iter(v)) for k, v in initials.items() if len(v) == 1}
        self.numbers = {no for no, _ in voices}
        self.tokens = max([2, *(len(k.split()) for k in self.forms)])  # of the longest name

    def voice(self, name: str) -> int | None:
        no = self.forms.get(" ".join(name.lower().split()), self.initials.get(name))
        if no is None and (m := NUMBERED(name)) and int(m[1]) in self.numbers:
            no = int(m[1])
        return no

    def _before(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """(voice, where its label begins) of the longest name that ends at ``hi``."""
        begins, at = [], hi
        for _ in range(self.tokens):
            first = at
            while first > lo and not NO_NAME(text, first - 1):
                first -= 1
            if first == at:
                break
            begins.append(first)
            at = first
            while at > lo and NO_NAME(text, at - 1):
                at -= 1
        for first in reversed(begins):
            if (no := self.voice(text[first:hi])) is not None:
                return no, first
        return None

    def split(self, text: str) -> list[tuple[int | None, str]]:
        """[(voice named by the label before the part, or None, the part)]; labels of unknown voices stay in the text."""
        return [(voice, part) for voice, part, _ in self.placed(text)]

    def placed(self, text: str) -> list[tuple[int | None, str, int]]:
        """The parts with the position at which each begins, its label included."""
        out, voice, at, first = [], None, 0, 0
        for m in MARKED.finditer(text):
            if m["inner"] is not None:
                no, begin = self.voice(m["inner"]), m.start()
            else:
                no, begin = self._before(text, at, m.start()) or (None, 0)
            if no is None:
                continue
            out.append((voice, text[at:begin].removesuffix(" ").removesuffix(">>"), first))
            voice, at, first = no, m.end(), begin
        out.append((voice, text[at:], first))
        return out


ANY_LABEL = re.compile(r"^\s*(?:>>\s*)?(?:\[\s*(?:speaker|spk|s)[ _]?\d{1,2}\s*\]|(?:speaker|spk|s)[ _]?\d{1,2}\s*(?:[:：]|[-–—](?=\s)))\s*", re.IGNORECASE)


# A text that begins with two longer words in a row is speech whatever follows: no hesitation has five letters.
PLAIN_START = re.compile(r"\s*[^\W\d_]{5,} [^\W\d_]{5,} ").match


def without_marks(text: str) -> str:
    """The text without time marks and sound notes."""
    return NOTE.sub(" ", TIME_MARK.sub(" ", text))


def has_content(text: str) -> bool:
    """Whether anything but time marks, sound notes and hesitations is left. Labels must have been split off before."""
    if PLAIN_START(text):
        return True
    found = units.words(without_marks(text))
    return any(w not in HESITATIONS and (w.isascii() or transducer(True)(w) not in HESITATIONS) for w in found)


def clean(text: str) -> str:
    """Speech only: no time marks, sound notes and loose hesitations, single spaces."""
    return " ".join(LOOSE_HESITATION.sub("", " ".join(without_marks(text).split())).split())
