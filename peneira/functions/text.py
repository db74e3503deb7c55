"""Text functions as columns: folding, white space, and the two analyzers (index side and query side)."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.dims import STOPWORDS

#: White space as JavaScript's \s has it; Java's \s lacks the no-break and other Unicode spaces.
SPACE = r"[\s\u000b   -     　﻿]"
#: Combining marks as blocks.
MARKS = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]"


@cache
def fold_map() -> tuple[str, str]:
    """Two strings of equal length: each letter whose canonical decomposition is one base and marks, and that base."""
    of, to = [], []
    for cp in range(0xC0, min(0x2000, sys.maxunicode)):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) and c == c.lower():
            of.append(c)
            to.append(d[0])
    return "".join(of), "".join(to)


@cache
def _latin() -> list[tuple[str, str]]:
    """(base, its accented letters) of the letters that one byte encodes, which most accented texts are made of."""
    of, to = fold_map()
    by: dict[str, str] = {}
    for x, base in zip(of, to, strict=True):
        if x < "\u0100":
            by[base] = by.get(base, "") + x
    return sorted(by.items())


def fold(c: Column) -> Column:
    """Lower case without accents, composed or decomposed. Null stays null.

    The whole map is slow, letter by letter, so only texts with a letter beyond the common ones take it; the others take one pass a base.
    """
    of, to = fold_map()
    low = F.lower(c)
    common = low
    for base, letters in _latin():
        common = F.regexp_replace(common, f"[{letters}]", base)
    beyond = low.rlike("[\u0100-\u1fff\u20d0-\u20ff\ufe20-\ufe2f]")  # all marks among them
    return F.when(beyond, F.regexp_replace(F.translate(low, of, to), MARKS, "")).otherwise(common)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def normalized_term(c: Column) -> Column:
    """One spelling for a term: folded and trimmed; null where nothing is left."""
    # Most terms are spelled so already, and one test is cheaper than the passes of folding. \z, as $ would pass over a line's end.
    return F.when(c.rlike(r"^[a-z0-9]+\z"), c).otherwise(F.nullif(trim_all(fold(c)), F.lit("")))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts."""
    return F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]"))


# The two analyzers ------------------------------------------------------------------------------

#: Diacritics that stand alone; the index side drops them before it splits, so they join words there.
LONE_DIACRITICS = r"[\^`¨¯´·¸]"


def index_tokens(c: Column, min_length: int = 3) -> Column:
    """Index side: folded runs of a-z and 0-9 of at least min_length, stopwords included. Null gives no tokens."""
    parts = F.split(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), LONE_DIACRITICS, ""), "[^a-z0-9]+")
    return F.filter(parts, lambda t: F.length(t) >= max(2, min_length))


def normalized(c: Column) -> Column:
    """Query side: folded, everything but a-z, 0-9 and white space to blanks, collapsed. Null gives an empty text."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def query_tokens(c: Column, min_length: int = 3) -> Column:
    """Query side: words of the normalized text of at least min_length; stopwords stay."""
    return F.filter(F.split(normalized(c), " "), lambda t: F.length(t) >= max(2, min_length))


def without_stopwords(tokens: Column) -> Column:
    """The tokens that are no stopwords, repeated ones kept."""
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def lexical_summary(all_tokens: Column, kept: Column) -> Column:
    """Counts of a document's tokens, all and without stopwords: a struct of token_count, unique_token_count, stopword_count, average_token_length, lexical_density.

    Without tokens all are 0.
    """
    n, everything = F.size(kept), F.size(all_tokens)
    letters = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    return F.struct(
        n.cast("bigint").alias("token_count"),
        F.size(F.array_distinct(kept)).cast("bigint").alias("unique_token_count"),
        (everything - n).cast("bigint").alias("stopword_count"),
        F.when(n > 0, F.round(letters / n, 4)).otherwise(0.0).alias("average_token_length"),
        F.when(everything > 0, F.round(n / everything, 6)).otherwise(0.0).alias("lexical_density"),
    )


def pseudo_text(top_terms: Column) -> Column:
    """A text with each top term as often as its frequency, at least once; blank-separated."""
    n = lambda e: F.greatest(F.lit(1), F.round(F.coalesce(e["frequency"], F.lit(1))).cast("int"))
    return F.array_join(F.flatten(F.transform(top_terms, lambda e: F.array_repeat(e["term"], n(e)))), " ")
