"""Repetition inside a single document.

A word is repeated if it lies in a run of `run` words that already occurred, starting
earlier, in the same document.

Method: distribution divergence with minimum-length guards. Each document gives two
histograms: its characters by class, and its words by whether they are common words of a
language and whether they follow the same word as once before in the document ("recur").
Both are compared with the references of each language by Jensen-Shannon divergence; the
nearest language counts. A document is suspected if the mean of its two divergences
reaches a bound, or if it is shorter than the guard, as histograms of few words tell
little. Suspected documents are counted exactly, run by run.

The bound loses no document, so it isn't tuned. Of five words of a repeated run four
recur, and a word that is repeated but doesn't recur starts such a run; so a share s of
repeated words means a share of 4/5 s at least that recurs. Merging the cells of two
histograms never raises their divergence, so the divergence of the words is at least that
of (4/5 s, 1 - 4/5 s) from the reference's share of recurring words, and the mean of two
divergences, neither negative, is at least half of that.

A document is compared and counted where it is read: no shuffle, and no document is
spread over rows. Whole batches are coded as integers at once; runs are coded by pairs,
so that equal codes are equal runs, not merely equal hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.functions.pytext import fold

RUN = 5
#: Documents of fewer words are not judged by their histograms, but counted at once.
GUARD_WORDS = 20
#: Characters coded at once: bounds memory, whatever the batch holds. A longer text is coded alone, whole.
CHARACTERS = 1_500_000
_TOKEN = re.compile(r"[^\W_]+|\x00")

# The commonest words of each language in running text, folded, in order of frequency, and the share of all words that they make up.
COMMON_WORDS = {
    "pt": (0.42, "de a o que e do da em um para com no os uma na se por nao as dos mais ao das foi como mas sua tem pela pelo"),
    "es": (0.45, "de la que el en y a los se del las un por con una no su para es al lo como mas pero sus le o fue este"),
    "en": (0.43, "the of and to a in is that for it on was with as be at by he this have are not but from or his an they which"),
}
#: The classes of characters, and each language's shares of them in running text.
CLASSES = ("letter", "capital", "digit", "blank", "other")
CLASS_SHARES = {"pt": (0.78, 0.03, 0.01, 0.155, 0.025), "es": (0.78, 0.025, 0.01, 0.16, 0.025), "en": (0.775, 0.03, 0.01, 0.165, 0.02)}
#: The share of words of running text that follow the same word as once before in the same document.
RECURRING = 0.05

_COMMON = {k: frozenset(w.split()) for k, (_, w) in COMMON_WORDS.items()}
_CLASS_REFERENCE = {k: np.array(v) for k, v in CLASS_SHARES.items()}
_WORD_REFERENCE = {k: np.outer((c, 1 - c), (RECURRING, 1 - RECURRING)).ravel() for k, (c, _) in COMMON_WORDS.items()}


@cache
def _class_table() -> np.ndarray:
    """The class of each character of the basic plane; the last entry is that of all others."""
    kind = lambda c: 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4
    return np.array([*(kind(chr(k)) for k in range(0x10000)), 4], np.int8)


def entropy(p: np.ndarray) -> np.ndarray:
    """In bits, over the last axis."""
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of two histograms, or of each row of p from q."""
    return np.maximum(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0.0)


def least_divergence(share: float, run: int = RUN, recurring: float = RECURRING) -> float:
    """What the mean divergence of a document is at least of which that share of the words is repeated; 0 where nothing can be said."""
    recur = share * (run - 1) / run
    if recur <= recurring:
        return 0.0
    # A little less, so that rounding loses nothing.
    return float(divergence(np.array([recur, 1 - recur]), np.array([recurring, 1 - recurring]))) / 2 * (1 - 1e-9)


@dataclass
class Coded:
    """The words of several texts as integers: of each its document, and the code of the word, of the pair that it ends (-1: none), whether that pair recurs."""

    total: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    names: np.ndarray

    def codes_of(self, run: int, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The codes of all runs of so many words, from those of a shorter run and of what it lacks."""
        width, runs = 1, code
        while width < run:
            step = min(width, run - width)
            tail = runs if step == width else code
            step = step if step == width else 1
            n = len(code) - width - step + 1
            pair = runs[:n] * (int(tail.max()) + 1) + tail[width : width + n]
            runs, width = pd.factorize(pair)[0].astype(np.int64), width + step
        return runs

    def again(self, run: int, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where runs of so many words start that started earlier in the same document."""
        starts = len(code) - run + 1
        if starts <= 0:
            return np.zeros(0, np.int64)
        runs = self.codes_of(run, doc, code)
        at = np.flatnonzero(doc[:starts] == doc[run - 1 :])
        key = doc[at] * (int(runs.max()) + 1) + runs[at]
        return at[pd.Series(key).duplicated().to_numpy()]

    def repeated(self, run: int, chosen: np.ndarray | None = None) -> np.ndarray:
        """How many words of each document are repeated; of the chosen ones only, if given, with 0 for the others."""
        doc, code = self.doc, self.code
        if chosen is not None:
            mine = chosen[doc]
            doc, code = doc[mine], code[mine]
        again = self.again(run, doc, code)
        change = np.zeros(len(code) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + run, -1)
        return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=len(self.total))

    def word_histograms(self) -> dict[str, np.ndarray]:
        """For each language a row a document: the shares of common words and of others, each recurring and not."""
        recurs = np.zeros(len(self.code), np.int64)
        recurs[self.again(2, self.doc, self.code) + 1] = 1
        n = len(self.total)
        out = {}
        for language, common in _COMMON.items():
            other = np.fromiter((w not in common for w in self.names), np.int64, len(self.names))[self.code]
            counts = np.bincount(self.doc * 4 + other * 2 + (1 - recurs), minlength=4 * n).reshape(n, 4)
            out[language] = counts / np.maximum(self.total, 1)[:, None]
        return out


def coded(texts: Sequence[str | None]) -> Coded:
    found = _TOKEN.findall(fold("\x00".join((t or "").replace("\x00", " ") for t in texts)))
    codes, names = pd.factorize(np.array(found, dtype=object))
    ends = np.fromiter((x == "\x00" for x in names), bool, len(names))[codes]
    doc, code = np.cumsum(ends)[~ends], codes[~ends].astype(np.int64)
    return Coded(np.bincount(doc, minlength=len(texts)), doc, code, names)


def repeated_words(texts: Sequence[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its words and how many of them are repeated. None and texts without words have 0 of both."""
    c = coded(texts)
    return c.total, c.repeated(run)


def class_histograms(texts: Sequence[str | None]) -> np.ndarray:
    """A row a text: the shares of its characters by class."""
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _class_table()[np.minimum(points, 0x10000)].astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(texts)), lengths) * len(CLASSES) + kinds, minlength=len(texts) * len(CLASSES))
    return counts.reshape(len(texts), len(CLASSES)) / np.maximum(lengths, 1)[:, None]


def divergences(texts: Sequence[str | None], c: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the nearest language (an index), and the divergences of its characters and words from that language's references."""
    classes, words = class_histograms(texts), c.word_histograms()
    by_class = np.stack([divergence(classes, _CLASS_REFERENCE[k]) for k in COMMON_WORDS])
    by_word = np.stack([divergence(words[k], _WORD_REFERENCE[k]) for k in COMMON_WORDS])
    nearest = (by_class + by_word).argmin(0)
    at = np.arange(len(texts))
    return nearest, by_class[nearest, at], by_word[nearest, at]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text."""
    lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // CHARACTERS
    cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column), F.col(text_column).cast("string").alias("__text"))


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """(id, words, repeated_words, repeated_share) of every row, counted exactly; a text without words, or null, has share 0."""
    source = _source(docs, id_column, text_column)
    schema = T.StructType([source.schema[0], T.StructField("words", T.LongType(), False), T.StructField("repeated_words", T.LongType(), False)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                total, repeated = repeated_words(part.column(1).to_pylist(), run)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(repeated, pa.int64())], [id_column, "words", "repeated_words"])

    share = F.when(F.col("words") > 0, F.col("repeated_words") / F.col("words")).otherwise(F.lit(0.0))
    return source.mapInArrow(count, schema).withColumn("repeated_share", share)


def document_divergence(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = 0.3, run: int = RUN, guard: int = GUARD_WORDS) -> DataFrame:
    """(id, words, language, class_divergence, word_divergence, suspected) of every row.

    suspected: shorter than the guard, or with a mean divergence that a document of that repeated share has at least. A text without words, or null,
    has no language, no divergences, and isn't suspected.
    """
    source = _source(docs, id_column, text_column)
    names = [id_column, "words", "language", "class_divergence", "word_divergence", "suspected"]
    schema = T.StructType([source.schema[0], *(T.StructField(n, t) for n, t in zip(names[1:], (T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])
    least, languages = least_divergence(share, run), list(COMMON_WORDS)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                texts = part.column(1).to_pylist()
                c = coded(texts)
                nearest, by_class, by_word = divergences(texts, c)
                none = c.total == 0
                columns = [pa.array(c.total, pa.int64()), pa.array([None if x else languages[k] for k, x in zip(nearest, none, strict=True)], pa.string()), pa.array(by_class, mask=none), pa.array(by_word, mask=none)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(~none & _suspected(c, by_class, by_word, least, guard))], names)

    return source.mapInArrow(compare, schema)


def _suspected(c: Coded, by_class: np.ndarray, by_word: np.ndarray, least: float, guard: int) -> np.ndarray:
    return (c.total < guard) | ((by_class + by_word) / 2 >= least)


def mostly_repeated(docs: DataFrame, share: tuple[int, int] = (3, 10), id_column: str = "doc_id", text_column: str = "text", run: int = RUN, guard: int = GUARD_WORDS) -> DataFrame:
    """The ids of documents of which at least that share (a fraction, compared in integers) of the words is repeated.

    Documents are suspected by their divergence, and only suspected ones are counted. Repeated rows are each reported.
    """
    source = _source(docs, id_column, text_column)
    over, of = share
    least = least_divergence(over / of, run)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                texts = part.column(1).to_pylist()
                c = coded(texts)
                _, by_class, by_word = divergences(texts, c)
                suspected = _suspected(c, by_class, by_word, least, guard)
                repeated = c.repeated(run, suspected)
                found = suspected & (c.total > 0) & (repeated * of >= c.total * over)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(found))], [id_column])

    return source.mapInArrow(find, T.StructType([source.schema[0]]))
