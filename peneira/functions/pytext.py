"""Text folding in plain Python, for the operators that already run as Arrow batches.

The column versions for the JVM are in `functions/text.py`; both follow the same rules.
"""

from __future__ import annotations

import re
import unicodedata

#: Runs of letters and digits; the underscore is neither.
WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def fold(text: str) -> str:
    """Lower case without accents: canonical decomposition, combining marks dropped."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, without regard to case and accents. None has none."""
    return WORD.findall(fold(text)) if text else []
