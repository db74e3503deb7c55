"""Evaluation texts inside a corpus: Wu-Manber search for every run of `length` words of every item.

Patterns are all windows of `length` words of the items. The search reads the last
`BLOCK` words of a position: the shift table tells how far no window can end, so most
positions are skipped; where a window may end, the bucket of those words has the item
positions to compare directly. Symbols are words, so the comparison is exact whatever the
spelling of case, accents, punctuation and spacing.

Every document is searched where it is read, without a shuffle. The texts of the items
travel by broadcast, and each worker builds its tables of them once; their size is checked,
and items beyond the bound make further blocks, each searched against all documents. Of
several blocks each one's result is written and its broadcast freed before the next.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.functions.pytext import words
from peneira.session import durable

LENGTH = 13
BLOCK = 3
#: Words of items in one block: about 200 MB of tables.
WORDS_PER_BLOCK = 1_000_000


class Patterns:
    """Shift table and suffix buckets of the items' windows."""

    def __init__(self, items: Iterable[tuple[int, str | None]], length: int = LENGTH, block: int = BLOCK) -> None:
        self.length, self.block = length, block
        self.items: list[tuple[int, list[str]]] = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= length]
        self.shift: dict[tuple[str, ...], int] = {}
        buckets: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            for end in range(block, len(w) + 1):
                suffix = tuple(w[end - block : end])
                far = max(0, length - end)
                self.shift[suffix] = min(far, self.shift.get(suffix, far))
                if not far:
                    buckets[suffix].append((k, end - length))
        self.buckets = dict(buckets)

    def find(self, text: str | None) -> list[int]:
        """The ids of the items of which the text holds a window."""
        w = words(text)
        length, block, n = self.length, self.block, len(w)
        shift, skip = self.shift, length - block + 1
        found: set[int] = set()
        end = length
        while end <= n:
            suffix = tuple(w[end - block : end])
            far = shift.get(suffix, skip)
            if far:
                end += far
                continue
            window = w[end - length : end]
            for k, start in self.buckets[suffix]:
                if k not in found and self.items[k][1][start : start + length] == window:
                    found.add(k)
            end += 1
        return [self.items[k][0] for k in found]


def blocks(items: DataFrame, id_column: str, text_column: str, per_block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded words; an item of more words makes a block of its own."""
    block, size = [], 0
    for i, text in items.select(id_column, text_column).where(F.col(text_column).isNotNull()).toLocalIterator():
        n = len(text) // 2 + 1  # no fewer than its words
        if block and size + n > per_block * 2:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += n
    yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = LENGTH, per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least `length` consecutive words of an item.

    Texts that are null or have fewer words hold nothing; items of fewer words are never found. Repeated item texts are each reported.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("item_id", T.LongType())])
    result = None
    found = blocks(items, item_id, item_text, per_block)
    block = next(found)
    while block is not None:
        following = next(found, None)
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(shared.value, length)
            for batch in batches:
                at: list[int] = []
                ids: list[int] = []
                for i, t in enumerate(batch.column(1)):
                    hits = patterns.find(t.as_py())
                    ids += hits
                    at += [i] * len(hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64())], ["doc_id", "item_id"])

        part = source.mapInArrow(search, schema)
        if result is not None or following is not None:
            part = durable(part)
            shared.destroy()
        result = part if result is None else result.union(part)
        block = following
    return result
