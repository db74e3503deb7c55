"""Portuguese stemming of single words in plain Python: the published Snowball algorithm on tokens without accents.

Rules that need an accented letter cannot apply to folded tokens and are left out. `stems`
in `functions/stemmer.py` brings it to columns; the SQL steps there say the same in SQL
and serve to check it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from peneira.functions.stemmer import IDADE, IRA, IVO, LOGIA, STANDARD, VERB

_R1 = re.compile("^.*?[aeiou][^aeiou]")
_R2 = re.compile("^.*?[aeiou][^aeiou].*?[aeiou][^aeiou]")
_RV_CONSONANT = re.compile("^.[^aeiou]+[aeiou]")
_RV_VOWELS = re.compile("^[aeiou]{2,}[^aeiou]")


def _ending(suffixes: list[str]) -> re.Pattern:
    """The longest of the suffixes at a word's end: the leftmost match."""
    return re.compile(f"(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})$")


_STANDARD_END = _ending([*STANDARD, *LOGIA, "amente", "mente", *IDADE, *IVO, *IRA])
_VERB_END = _ending(VERB)
_BEFORE = {
    "amente": _ending(["ativ", "iv", "os", "ic", "ad"]),
    "mente": _ending(["ante", "avel", "ivel"]),
    **dict.fromkeys(IDADE, _ending(["abil", "ic", "iv"])),
    **dict.fromkeys(IVO, _ending(["at"])),
}
_IN_R2 = frozenset([*STANDARD, "mente", *IDADE, *IVO])


def _region(pattern: re.Pattern, word: str) -> int:
    m = pattern.match(word)
    return m.end() if m else len(word)


def _rv(word: str) -> int:
    """Where the region begins in which verb endings are looked for; the word's length if there is none."""
    if len(word) < 3:
        return len(word)
    if word[1] not in "aeiou":
        return _region(_RV_CONSONANT, word)
    return _region(_RV_VOWELS, word) if word[0] in "aeiou" else 3


def _without_standard(word: str, r1: int, r2: int, rv: int) -> str:
    m = _STANDARD_END.search(word)
    if not m:
        return word
    suffix, at = m[0], m.start()
    if suffix in LOGIA:
        return word[:at] + "log" if at >= r2 else word
    if suffix in IRA:
        return word[:at] + "ir" if at >= rv and word[:at].endswith("e") else word
    if at < (r1 if suffix == "amente" else r2):
        return word
    left = word[:at]
    before = _BEFORE[suffix].search(left) if suffix in _BEFORE else None
    if before:
        if before.start() >= r2:
            return left[: before.start()]
        if before[0] == "ativ" and len(left) - 2 >= r2:
            return left[:-2]
    return left


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """The stem of a folded token."""
    r1, r2, rv = _region(_R1, word), _region(_R2, word), _rv(word)
    out = _without_standard(word, r1, r2, rv)
    if out == word:
        m = _VERB_END.search(word[rv:])
        out = word[: rv + m.start()] if m else word
    if out != word:
        if out.endswith("ci") and len(out) - 1 >= rv:
            out = out[:-1]
    elif out.endswith("os") and len(out) - 2 >= rv:
        out = out[:-2]
    elif out[-1:] in ("a", "i", "o") and len(out) - 1 >= rv:
        out = out[:-1]
    if out.endswith("e") and len(out) - 1 >= rv:
        out = out[:-1]
        if out.endswith(("gu", "ci")) and len(out) - 1 >= rv:
            out = out[:-1]
    return out
