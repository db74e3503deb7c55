"""Scores of many queries at once, document by document.

A batch of queries matches a large share of all documents, so that pairs of query and
document are far more than either. They are not shuffled: the queries travel to the
documents by broadcast, in blocks of a bounded number, and each document is scored there
against all queries of a block, from its own terms. What leaves a task is the best of its
documents for each query, a count for each query, or a document with its hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from peneira.config import Config
from peneira.dims import DOMAIN_BOOSTS

#: Queries in one broadcast block: some tens of MB.
QUERIES_PER_BLOCK = 25_000
#: Pairs of document and query that are scored at a time.
CELLS = 500_000
#: Documents whose words are encoded at a time, if a slice isn't larger.
ENCODED = 1000
#: Texts of which it is kept which words they contain.
SEEN = 10_000
#: Up to so many results of a query are chosen in a task already.
CHOSEN = 1000


class Asked:
    """Words with the queries that ask for them, as one array with the start of each word's part; a value goes with each query."""

    def __init__(self, pairs: Iterable[tuple[str, int, int]]):
        parts: dict[str, list[tuple[int, int]]] = {}
        for word, query, value in pairs:
            parts.setdefault(word, []).append((query, value))
        self.at = {word: i for i, word in enumerate(parts)}
        self.count = np.array([len(p) for p in parts.values()], np.int64)
        self.start = np.cumsum(self.count) - self.count
        flat = np.array([x for p in parts.values() for x in p], np.int64).reshape(-1, 2)
        self.query, self.value = flat[:, 0].copy(), flat[:, 1].copy()

    def of_queries(self, queries: np.ndarray) -> Asked:
        """The same with queries numbered by their place among some, which are all that ask."""
        out = copy(self)
        out.query = np.searchsorted(queries, self.query)
        return out

    def cells(self, rows: np.ndarray, words: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of rows: the cells (row x queries + query) of the queries that ask for them, where in the arrays these are, and how many each word has."""
        n = self.count[words]
        at = np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(rows * queries, n) + self.query[at], at, n


class Substrings:
    """Which of some words a text contains, found by their first letters."""

    def __init__(self, words: Iterable[str]):
        self.seen: dict[str, list[int]] = {}
        self.heads: dict[int, dict[str, list[tuple[str, int]]]] = {}
        for i, word in enumerate(words):
            head = next((h for h in (16, 8, 3, 1) if len(word) >= h), 0)
            self.heads.setdefault(head, {}).setdefault(word[:head], []).append((word, i))

    def of(self, text: str) -> list[int]:
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            found = self.seen[text] = sorted(i for head, words in self.heads.items() for h in words.keys() & {text[k : k + head] for k in range(max(1, len(text) - head + 1))} for word, i in words[h] if word in text)
        return found


@dataclass
class Block:
    """Some queries. terms: what is looked up in the index, with its place in the query; idf: by term. words: all words asked for, each once; teams: a query's own team words,
    with how often they are asked; title_teams: team words among all; wholes: normalized queries."""

    ids: list
    terms: Asked
    idf: np.ndarray
    words: Asked
    size: np.ndarray
    teams: Asked
    team_size: np.ndarray
    title_teams: Asked
    wholes: Asked
    average: float
    config: Config

    def __post_init__(self) -> None:
        self.in_title, self.in_domain = Substrings(self.wholes.at), Substrings(self.words.at)
        self.teams_in_title, self.teams_in_domain = Substrings(self.title_teams.at), Substrings(self.teams.at)
        #: The queries that ask for teams, and teams with these alone.
        self.asking = np.unique(self.teams.query)
        self.asked_teams = self.teams.of_queries(self.asking)


def blocks(rows: Iterable, idf_of: Callable[[list[str]], dict[str, float]], average: float, config: Config, per_block: int) -> Iterator[Block]:
    """Blocks of queries. rows: query_id, whole, teams, tokens, team_tokens, terms (ord, term)."""
    part: list = []

    def made() -> Block:
        idf = idf_of(sorted({t["term"] for r in part for t in r["terms"]}))
        terms = Asked((t["term"], q, t["ord"]) for q, r in enumerate(part) for t in r["terms"] if t["term"] in idf)
        each = lambda name: Asked((t, q, r[name].count(t)) for q, r in enumerate(part) for t in dict.fromkeys(r[name]))
        size = lambda name: np.array([max(1, len(r[name])) for r in part], np.float64)
        wholes = Asked((r["whole"], q, 1) for q, r in enumerate(part))
        return Block([r["query_id"] for r in part], terms, np.array([idf[t] for t in terms.at], np.float64), each("tokens"), size("tokens"), each("teams"), size("teams"), each("team_tokens"), wholes, average, config)

    for r in rows:
        part.append(r)
        if len(part) == per_block:
            yield made()
            part = []
    if part:
        yield made()


def _encoded(column: pa.Array, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of words a row: row and number of those that are known, and which they are."""
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().dictionary_encode()
    known = np.array([at.get(w, -1) for w in flat.dictionary.to_pylist()] + [-1], np.int64)
    numbers = known[np.array(flat.indices.fill_null(len(known) - 1), np.int64)]
    kept = numbers >= 0
    return np.repeat(np.arange(len(column)), lengths)[kept], numbers[kept], kept


def _once(rows: np.ndarray, words: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a row once."""
    both = np.unique(rows * max(1, count) + words)
    return both // max(1, count), both % max(1, count)


class Encoded:
    """Documents whose words are encoded once for all slices of them."""

    def __init__(self, block: Block, batch: pa.RecordBatch):
        self.block, self.batch = block, batch
        self.done: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        self.rows, self.terms, kept = _encoded(batch.column("terms"), block.terms.at)
        self.tf = np.array(batch.column("counts").flatten(), np.float64)[kept]

    def words(self, column: str, asked: str, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n documents from start on: document and number of each word of a field that is asked for, each once."""
        if (column, asked) not in self.done:
            at = getattr(self.block, asked).at
            rows, numbers, _ = _encoded(self.batch.column(column), at)
            self.done[column, asked] = _once(rows, numbers, len(at))
        rows, numbers = self.done[column, asked]
        first, end = np.searchsorted(rows, (start, start + n))
        return rows[first:end] - start, numbers[first:end]


class Slice:
    """Some documents against all queries of a block: base has a row a document and a column a query, 0 where nothing matches."""

    def __init__(self, encoded: Encoded, start: int, size: int):
        self.block, self.encoded, self.start, self.batch = encoded.block, encoded, start, encoded.batch.slice(start, size)
        self.n, self.q = self.batch.num_rows, len(self.block.ids)
        first, end = np.searchsorted(encoded.rows, (start, start + self.n))
        rows, words = encoded.rows[first:end] - start, encoded.terms[first:end]
        part = self._bm25(encoded.tf[first:end], rows, self.block.idf[words])
        above = part > 0
        self.cell, self.at, n = self.block.terms.cells(rows[above], words[above], self.q)
        self.base = np.bincount(self.cell, np.repeat(part[above], n), self.n * self.q)

    def _bm25(self, tf: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The operations of search.bm25, in the same order."""
        config = self.block.config
        average = self.block.average if self.block.average > 0 else 1.0
        length = np.array(self.batch.column("token_count").cast(pa.float64()).fill_null(self.block.average))
        norm = (1 - config.bm25_b) + config.bm25_b * (np.where(length > 0, length, average) / average)
        return np.where((tf > 0) & (weight > 0), weight * (tf * (config.bm25_k1 + 1) / (tf + config.bm25_k1 * norm[rows])), 0.0)

    def matched(self) -> np.ndarray:
        return np.bincount(self.cell, minlength=self.n * self.q)

    def of_cells(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many terms of the query a cell's document has, and the place of the first. cells: in ascending order."""
        asked = np.zeros(self.n * self.q, bool)
        asked[cells] = True
        chosen = np.flatnonzero(asked[self.cell])
        mine = np.searchsorted(cells, self.cell[chosen])
        first = np.full(len(cells), np.iinfo(np.int64).max)
        np.minimum.at(first, mine, self.block.terms.value[self.at[chosen]])
        return np.bincount(mine, minlength=len(cells)), first

    def coverage(self, column: str) -> np.ndarray:
        """Share of each query's words that a document's field has."""
        cell, _, _ = self.block.words.cells(*self.encoded.words(column, "words", self.start, self.n), self.q)
        return (np.bincount(cell, minlength=self.n * self.q).reshape(self.n, self.q) / self.block.size).ravel()

    def containing(self, column: str, words: Asked, substrings: Substrings, queries: int | None = None) -> np.ndarray:
        """The cells of the queries that ask for a word which a document's text contains; those of several such words are repeated."""
        rows, numbers = [], []
        for row, text in enumerate(self.batch.column(column).to_pylist()):
            if text is None:
                continue
            found = substrings.of(text)
            rows += [row] * len(found)
            numbers += found
        return words.cells(np.array(rows, np.int64), np.array(numbers, np.int64), self.q if queries is None else queries)[0]

    def team_factors(self) -> np.ndarray:
        """search.team_factor of the queries that ask for teams, a column each."""
        block, config, q = self.block, self.block.config, len(self.block.asking)
        share = []
        for column in ("title_tokens", "url_tokens"):
            cell, at, _ = block.asked_teams.cells(*self.encoded.words(column, "teams", self.start, self.n), q)
            share.append(np.bincount(cell, block.asked_teams.value[at], self.n * q).reshape(self.n, q) / block.team_size[block.asking])
        on_domain = np.zeros(self.n * q, bool)
        on_domain[self.containing("normalized_domain", block.asked_teams, block.teams_in_domain, q)] = True
        on_domain = on_domain.reshape(self.n, q)
        best = np.minimum(1.0, np.maximum(*share) + np.where(on_domain, 0.5, 0.0))
        missed = (share[0] == 0) & (share[1] == 0) & ~on_domain
        return np.where(missed, config.team_miss, 1.0 + config.team_boost * best)

    def team_factor(self) -> np.ndarray:
        """search.team_factor; queries without teams have 1."""
        out = np.ones((self.n, self.q))
        if len(self.block.asking):
            out[:, self.block.asking] = self.team_factors()
        return out.ravel()

    def boosted(self) -> np.ndarray:
        """The score after all boosts: coverage of title and address, whole query in the title, the domain's boost, team word in the title, team factor, asked word in the domain.

        Boosts that few cells have are applied to these alone; a cell that is named twice is boosted once.
        """
        block, config = self.block, self.block.config
        score, url = self.coverage("title_tokens"), self.coverage("url_tokens")
        score *= config.title_weight
        score += 1.0
        url *= config.url_weight
        score += url
        score *= self.base
        score[self.containing("normalized_title", block.wholes, block.in_title)] *= 1.5
        by_row = score.reshape(self.n, self.q)
        for row, name in enumerate(self.batch.column("domain").to_pylist()):
            if name in DOMAIN_BOOSTS:
                by_row[row] *= DOMAIN_BOOSTS[name]
        score[self.containing("normalized_title", block.title_teams, block.teams_in_title)] *= 1.1
        if len(block.asking):
            by_row[:, block.asking] *= self.team_factors()
        score[self.containing("normalized_domain", block.words, block.in_domain)] += 0.2
        return score


def millionths(scores: np.ndarray) -> np.ndarray:
    """Scores rounded to six decimals by their shortest decimal form, half up, as the JVM rounds; as whole numbers of millionths."""
    scaled = scores * 1e6
    out = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < np.maximum(1e-6, np.abs(scaled) * 1e-12)
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(scores[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Best:
    """The first documents of each query among those of a task, ordered as search.top_k orders them."""

    def __init__(self, queries: int, limit: int):
        self.queries, self.limit = queries, limit
        self.least = np.full(queries, -np.inf)
        self.docs: list[tuple] = []  # doc_id, doc_ord
        self.parts: list[tuple[np.ndarray, ...]] = []  # query, millionths, score, first place, terms matched, document
        self.held = 0

    def add(self, piece: Slice, scores: np.ndarray, least: float) -> None:
        bound = np.maximum((self.least - 1.0) / 1e6, least)
        cells = np.flatnonzero((piece.base > 0) & (scores.reshape(piece.n, piece.q) >= bound).ravel())
        if not len(cells):
            return
        matched, first = piece.of_cells(cells)
        number = len(self.docs) + cells // piece.q
        self.docs += zip(piece.batch.column("doc_id").to_pylist(), piece.batch.column("doc_ord").to_pylist(), strict=True)
        self.parts.append((cells % piece.q, millionths(scores[cells]), scores[cells], first, matched, number))
        self.held += len(cells)
        if self.held > 2 * self.queries * self.limit + CELLS:
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return ()
        query, rounded, score, first, matched, number = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        used = np.unique(number)
        docs = [self.docs[i] for i in used]
        rank = np.empty(len(docs), np.int64)
        rank[sorted(range(len(docs)), key=lambda i: (docs[i][1] is not None, docs[i][1], docs[i][0]))] = np.arange(len(docs))
        number = np.searchsorted(used, number)
        order = np.lexsort((rank[number], first, -rounded, query))
        starts = np.searchsorted(query[order], np.arange(self.queries))
        place = np.arange(len(order)) - starts[query[order]]
        order = order[place < self.limit]
        kept = tuple(x[order] for x in (query, rounded, score, first, matched, number))
        full = place[place < self.limit] == self.limit - 1
        self.least[kept[0][full]] = kept[1][full]
        self.docs, self.parts, self.held = docs, [kept], len(order)
        return kept


def _slices(block: Block, batches: Iterable[pa.RecordBatch]) -> Iterator[Slice]:
    size = max(1, CELLS // len(block.ids))
    together = max(size, ENCODED // size * size)
    for batch in batches:
        for first in range(0, batch.num_rows, together):
            encoded = Encoded(block, batch.slice(first, together))
            for start in range(0, encoded.batch.num_rows, size):
                yield Slice(encoded, start, size)


def _ids(block: Block, kind: T.DataType) -> pa.Array:
    return pa.array(block.ids, to_arrow_type(kind))


def best(documents: DataFrame, shared, query: T.DataType, limit: int, least: float) -> DataFrame:
    """(query_id, doc_id, doc_ord, raw, first_ord, terms_matched): of each task the first `limit` documents of each query of a block; all where the limit is beyond what a task holds."""
    source = documents.select("doc_id", "doc_ord", "token_count", "terms", "counts", "domain", "normalized_title", "normalized_domain", "title_tokens", "url_tokens")
    schema = T.StructType([T.StructField("query_id", query), source.schema["doc_id"], source.schema["doc_ord"], *(T.StructField(n, t) for n, t in (("raw", T.DoubleType()), ("first_ord", T.LongType()), ("terms_matched", T.LongType())))])
    kinds = [to_arrow_type(source.schema[c].dataType) for c in ("doc_id", "doc_ord")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        ids = _ids(block, query)
        found = Best(len(block.ids), limit)

        def rows() -> Iterator[pa.RecordBatch]:
            kept = found.compact()
            for start in range(0, len(kept[0]) if kept else 0, 10_000):
                at, _, score, first, matched, number = (x[start : start + 10_000] for x in kept)
                docs = [found.docs[i] for i in number]
                columns = [ids.take(pa.array(at)), *(pa.array([x[k] for x in docs], kind) for k, kind in enumerate(kinds)), pa.array(score), pa.array(first), pa.array(matched, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        for piece in _slices(block, batches):
            found.add(piece, piece.boosted(), least)
            if limit > CHOSEN:
                yield from rows()
                found = Best(len(block.ids), limit)
        yield from rows()

    return source.mapInArrow(run, schema)


def reached(documents: DataFrame, shared, query: T.DataType, least: float) -> DataFrame:
    """(query_id, kept): of each task the number of each query's matches whose boosted score reaches the least one."""
    source = documents.select("token_count", "terms", "counts", "domain", "normalized_title", "normalized_domain", "title_tokens", "url_tokens")
    schema = T.StructType([T.StructField("query_id", query), T.StructField("kept", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        kept = np.zeros(len(block.ids), np.int64)
        for piece in _slices(block, batches):
            kept += ((piece.base > 0) & (piece.boosted() >= least)).reshape(piece.n, piece.q).sum(axis=0)
        some = np.flatnonzero(kept)
        yield pa.RecordBatch.from_arrays([_ids(block, query).take(pa.array(some)), pa.array(kept[some])], schema.names)

    return source.mapInArrow(run, schema)


def hits(documents: DataFrame, shared, query: T.DataType, names: list[str], kinds: list[T.DataType], values: Callable[[Slice, np.ndarray], list[np.ndarray]], columns: list[str]) -> DataFrame:
    """(query_id, doc_id, names) of every match of a block's queries. A document leaves with the list of its hits, which are laid flat in the JVM. values: of a slice and its cells that match."""
    source = documents.select("doc_id", "token_count", "terms", "counts", *columns)
    fields = T.StructType([T.StructField(n, t) for n, t in zip(["query_id", *names], [query, *kinds], strict=True)])
    schema = T.StructType([source.schema["doc_id"], T.StructField("hits", T.ArrayType(fields))])
    arrow = [to_arrow_type(t) for t in kinds]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        ids = _ids(block, query)
        for piece in _slices(block, batches):
            cells = np.flatnonzero(piece.base > 0)
            ends = np.searchsorted(cells, np.arange(piece.n + 1) * piece.q)
            found = [pa.array(v).cast(t) for v, t in zip(values(piece, cells), arrow, strict=True)]
            struct = pa.StructArray.from_arrays([ids.take(pa.array(cells % piece.q)), *found], fields.names)
            yield pa.RecordBatch.from_arrays([piece.batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], schema.names)

    return source.mapInArrow(run, schema).selectExpr("doc_id", "inline(hits)").select("query_id", "doc_id", *names)
