"""Canonical forms of short texts: what stays when form is disregarded."""

from __future__ import annotations

import re
import unicodedata

# Cyrillic letters and the Latin letters that look like them, in lower case
# after capitals (whose shapes also count) were lowered.
LOOKALIKES = dict(zip("авекмнорстухіјѕ", "abekmhopctyxijs"))
# Words that introduce a question without belonging to it.
LEAD_INS = (
    "q", "question", "query", "tell me", "please tell me", "please",
    "в", "вопрос", "подскажите", "подскажи", "скажите", "скажи", "пожалуйста",
    "питання", "підкажіть", "скажіть", "будь ласка",
    "frage", "bitte", "sag mir", "pregunta", "dime", "por favor", "dis moi", "dites moi", "s il vous plaît",
)

_FOLD = str.maketrans(LOOKALIKES)
_WORD = re.compile(r"[^\W_]+(?:(?<=\w)['’ʼ](?=\w)[^\W_]+)*")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_NUMBERING = re.compile(r"^[\W_]*\d{1,4}\s*[.)\]:]+(?=\s*\D)")
# A separator: a lead-in ends with one.
_SEPARATED = re.compile(r"^[\W_]*([^\W_]+(?:[ '’\-]+[^\W_]+){0,3})\s*[:,.\-–—)]+\s*(?=\S)")


def plain(text: str) -> str:
    """Compatibility form without marks and invisible characters."""
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    return "".join(c for c in text if not unicodedata.combining(c))


def skeleton(text: str) -> str:
    """Lower case, look-alike letters folded to one shape."""
    return plain(text).lower().translate(_FOLD)


_LEAD_SKELETONS = frozenset(" ".join(_WORD.findall(skeleton(x))) for x in LEAD_INS)


def words(text: str) -> list[tuple[str, bool]]:
    """(skeleton, written as a name) of each word of a question.

    Numbering and lead-ins are taken off. A word is written as a name if it begins
    with a capital that isn't the sentence's first and goes on in lower case.
    """
    text = plain(text)
    while True:
        cut = _NUMBERING.sub("", text, count=1)
        m = _SEPARATED.match(cut)
        if m and " ".join(_WORD.findall(m.group(1).lower().translate(_FOLD))) in _LEAD_SKELETONS:
            cut = cut[m.end() :]
        if cut == text:
            break
        text = cut
    out = []
    for i, w in enumerate(_WORD.findall(text)):
        name = i > 0 and w[0].isupper() and w[1:].islower() and len(w) > 2
        out.append((w.lower().translate(_FOLD).replace("’", "'").replace("ʼ", "'"), name))
    return out
