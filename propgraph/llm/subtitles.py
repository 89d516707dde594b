"""Reading subtitle text: cues, wrong encodings, markup, sound descriptions, folded spelling.

Plain functions on whole texts, called from Arrow batches. All loops over characters are in C
(``re``, ``str.translate``, ``str.replace``).
"""

from __future__ import annotations

import re
import unicodedata

CUE = "\x1e"
_LINE_ENDS = re.compile(r"\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_ARROW = "-->"
#: Markup; sound descriptions in any brackets, between asterisks (which no word or other asterisk touches: "w****e" is a masked word) or after a note sign. Of any length, but within one cue.
_NOISE = re.compile(r"<[^<>\x1e]*>|\{[^{}\x1e]*\}|\[[^\[\]\x1e]*\]|\([^()\x1e]*\)|\*(?<![\w*]\*)[^*\x1e]+\*(?![\w*])|[♪♫][^\n\x1e]*|#(?<!\S#) [^\n\x1e]*")
_SPEAKER = re.compile(r"(?m)(^|\x1e)([ \t-]*)[A-ZÀ-Þ0-9][A-ZÀ-Þ0-9' .-]+:(?=\s)")
#: Addresses, whatever their ending (no blank after the dot, a small letter follows). An "@" alone is none: it also stands for a letter ("b@st@rd").
_ADDRESS = re.compile(r"https?:|\bwww\b|(?<![\w@!$|])[\w.+-]+ ?@ ?[\w-]{3,}(?:\.[\w-]+)*\.(?-i:[a-z0-9])\w|(?-i:[\w-]{3,}\.[a-z][a-z0-9])", re.I)
#: Phrases of credits, at the beginning of a cue (of a "team" anywhere).
_CREDIT = re.compile(
    r"\A[\W_]*(?:subtitles? by|subtitled by|captions? (?:by|at|from)|(?:re-?)?sync(?:ed|hroni[sz]ed)?\b.{0,30}\bby|corrected by|translated by|ripped by|advertise your|support us|sponsored by"
    r"|untertitel (?:von|by)|sous-titr\w+ (?:par|by)|subt\w+ (?:por|de)\b)|by\s?te@(?:m|rn)\b|do not re-?post",
    re.I,
)

# ---- wrong encodings


def _misread() -> dict[str, str]:
    """What the letters and signs of Western European texts look like after UTF-8 was read as a one-byte encoding, once or twice."""
    signs = [chr(c) for c in range(0xA0, 0x180)] + list("‘’‚“”„–—…€•™♪♫﻿​")

    def wrongly(s: str, single: str) -> str:
        out = []
        for b in s.encode():
            try:
                out.append(bytes([b]).decode(single))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)

    found: dict[str, str] = {}
    for c in signs:
        for one in ("latin-1", "cp1252"):
            once = wrongly(c, one)
            found.setdefault(once, c)
            for two in ("latin-1", "cp1252"):
                found.setdefault(wrongly(once, two), c)
    return {k: v for k, v in found.items() if len(k) > 1}


_MISREAD = _misread()
_MISREAD_RE = re.compile("|".join(sorted(map(re.escape, _MISREAD), key=len, reverse=True)))
_SUSPECT = re.compile("[ÂÃÅâ][\u0080-ſˆ˜–-™]")
#: Windows-1252 bytes read as code page 437; only signs that the languages of the corpus don't use.
_CP437 = {}
for _b in range(0x91, 0x100):
    _right, _wrong = bytes([_b]).decode("cp1252", "ignore"), bytes([_b]).decode("cp437")
    if _right and (not _wrong.isalpha() or ord(_wrong) > 0x24F or _wrong in "Æ") and _wrong not in "¡¿«»°·£¥¢":
        _CP437[_wrong] = _right


def repair(text: str) -> str:
    """Undo the two ways in which encodings were mixed up."""
    if text.isascii():
        return text
    if _SUSPECT.search(text):
        text = _MISREAD_RE.sub(lambda m: _MISREAD[m[0]], text)
    return text


# ---- folding


class _Fold(dict):
    """Code point to lower-case unaccented letters or digits; apostrophes and soft hyphens vanish, all else is a blank.

    Filled as needed, with one entry per distinct character that occurs.
    """

    #: Letters of other alphabets that look like Latin ones.
    ALIKE = {"а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ѕ": "s", "ј": "j", "ԁ": "d", "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ı": "i", "ł": "l"}
    VANISH = frozenset("'’‘`´­​‌‍﻿ʼ")

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in self.VANISH or unicodedata.combining(c):
            out = ""
        elif c in (CUE, "\n"):
            out = c
        else:
            out = ""
            for x in unicodedata.normalize("NFKD", _CP437.get(c, c)).lower():
                x = self.ALIKE.get(x, x)
                if x.isascii() and x.isalnum():
                    out += x
            if not out and not (c.isalpha()):
                out = "" if _CP437.get(c) in self.VANISH else " "
        self[code] = out
        return out


FOLD = _Fold()


def fold(text: str) -> str:
    """Lower-case ASCII letters and digits, everything else blank; line ends and cue marks stay."""
    return text.translate(FOLD)


# ---- cues


def _is_number(line: str) -> bool:
    if line.isascii() and line.isdigit():
        return True
    bare = line.strip(" \t\ufeff").rstrip(" \t").removesuffix(":").removesuffix(")").removesuffix(".")
    return bare.isascii() and bare.isdigit()


def strip_times(text: str) -> str:
    """The text with a cue mark in place of each cue's number and times, encodings repaired."""
    if "\r" in text or not text.isascii():
        text = repair(_LINE_ENDS.sub("\n", text))
    if _ARROW not in text:
        return text
    out: list[str] = []
    for line in text.split("\n"):
        if _ARROW not in line:
            out.append(line)
        elif out and _is_number(out[-1]):
            out[-1] = CUE
        else:
            out.append(CUE)
    return "\n".join(out)


def without_names(text: str, aside: list[str] | None = None) -> str:
    """Without what looks like speakers' names: capitals before a colon at the beginning of a line. They are added to ``aside``."""
    if ": " not in text and ":\n" not in text and ":\t" not in text:
        return text

    def take(m: re.Match) -> str:
        if aside is not None:
            aside.append(m[0].strip(CUE))
        return m[1] + m[2]

    return _SPEAKER.sub(take, text)


def parts(text: str, names: bool = True) -> tuple[str, str]:
    """``strip_times`` without markup, sound descriptions and (with ``names``) speakers' names; and what was taken out but markup, each a cue of its own."""
    aside: list[str] = []

    def put_aside(m: re.Match) -> str:
        x = m[0]
        if not (x[0] == "<" and (" " not in x or "=" in x) or x[1:2] == "\\"):  # tags and codes say nothing
            aside.append(x)
        return " "

    clean = _NOISE.sub(put_aside, strip_times(text))
    speech = without_names(clean, aside) if names else clean
    return speech, CUE.join(aside)


def spoken(text: str) -> str:
    """The speech of ``parts``."""
    return parts(text)[0]


#: Every advert holds one of these, or a dot within a word; looking for them is quicker than the patterns.
_ADVERT_SIGNS = ("http", "www", "@", "title", "caption", "sync", "corrected", "translated", "ripped", "advertise", "support us", "re-post", "repost", "sponsored", "untertitel", "titr", "subt")
_DOT_WITHIN = re.compile(r"\.[a-z]")


def may_advertise(text: str) -> bool:
    low = text.lower()
    return any(sign in low for sign in _ADVERT_SIGNS) or _DOT_WITHIN.search(text) is not None


def is_advert(cue: str) -> bool:
    """Whether a cue holds an address or begins as credits do."""
    return may_advertise(cue) and (_ADDRESS.search(cue) is not None or _CREDIT.search(cue) is not None)
