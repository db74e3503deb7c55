"""Index build: deduplication, truncation, chunking, postings and statistics, as ordinary tables.

Tokens never travel: a document's text is analyzed once, its tokens stay an array on its
row, and what belongs to the document (postings of its chunks, its top terms, its stem
counts) is counted there, without a shuffle. Only numbers over documents are shuffled, by
term, one row a document and term at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.config import Config
from peneira.functions.pystem import stem
from peneira.functions.stemmer import stems
from peneira.functions.text import index_tokens, lexical_summary, without_stopwords
from peneira.session import durable


def first_of_hash(docs: DataFrame, hash_column: str, id_column: str, order_by: str) -> DataFrame:
    """The rows that came first of each content hash; rows without hash are left out, ties go to the smallest id.

    Only the hashes of several rows, found from three small columns with combining before the shuffle, are joined to the documents: a table that is
    written first, so that the planner knows its size and broadcasts it while that allows; texts aren't shuffled then.
    """
    known = docs.where(F.col(hash_column).isNotNull())
    first = known.groupBy(hash_column).agg(F.count("*").alias("__n"), F.min(F.struct(F.col(order_by), F.col(id_column))).alias("__w")).where("__n > 1")
    winners = durable(first.select(hash_column, F.col(f"__w.{id_column}").alias("__first")))
    joined = known.join(winners, hash_column, "left")
    return joined.where(F.col("__first").isNull() | (F.col("__first") == F.col(id_column))).select(*docs.columns)


def _once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: behind a generator they are not written out again in what uses them."""
    struct = F.struct(*(c.alias(name) for name, c in columns.items()))
    return rows.select(*keep, F.explode(F.array(struct)).alias("__k")).select(*keep, *(F.col(f"__k.{name}").alias(name) for name in columns))


def analyzed(docs: DataFrame, text: str = "cleaned_text", config: Config = Config()) -> DataFrame:
    """docs with kept (all tokens but stopwords), tokens (kept, truncated, for the index alone), truncated and lexical (counts before truncation); rows without tokens are left out."""
    columns = docs.columns
    out = _once(docs, columns, __all=index_tokens(F.col(text), config.min_token_length))
    out = _once(out, [*columns, "__all"], kept=without_stopwords(F.col("__all"))).where(F.size("kept") > 0)
    limit = config.max_tokens or 2**31 - 1
    return out.select(
        *columns,
        lexical_summary(F.col("__all"), F.col("kept")).alias("lexical"),
        (F.size("kept") > limit).alias("truncated"),
        "kept",
        F.when(F.size("kept") > limit, F.slice("kept", 1, limit)).otherwise(F.col("kept")).alias("tokens"),
    )


def _by_document(docs: DataFrame, doc_id: str, tokens: str, names: list[str], types: list[T.DataType], rows_of: Callable[[list[str]], Iterable[tuple]]) -> DataFrame:
    """(doc_id, names) with the rows that a function gives for each document's tokens, made where the document is."""
    source = docs.select(F.col(doc_id).alias("doc_id"), tokens)
    schema = T.StructType([source.schema[0], *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])
    arrow = [{T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}.get(t, pa.string()) for t in types]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                at: list[int] = []
                columns: list[list] = [[] for _ in names]
                for i, t in enumerate(part.column(1).to_pylist()):
                    for row in rows_of(t or []):
                        at.append(i)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], ["doc_id", *names])

    return source.mapInArrow(run, schema)


def chunk_count(n: Column, size: Column | int) -> Column:
    """Chunks of so many tokens: at least one."""
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint")


def postings(docs: DataFrame, doc_id: str, config: Config = Config(), stemmed: bool = True) -> DataFrame:
    """(chunk_size, term, doc_id, chunk_id, term_frequency) of analyzed documents, terms as stems unless told otherwise; without a shuffle."""
    sizes = config.chunk_sizes

    def rows(tokens: list[str]) -> Iterator[tuple]:
        terms = [stem(t) for t in tokens] if stemmed else tokens
        for size in sizes:
            for chunk, start in enumerate(range(0, len(terms), size)):
                for term, n in Counter(terms[start : start + size]).items():
                    yield size, term, chunk, n

    out = _by_document(docs, doc_id, "tokens", ["chunk_size", "term", "chunk_id", "term_frequency"], [T.IntegerType(), T.StringType(), T.IntegerType(), T.LongType()], rows)
    return out.select("chunk_size", "term", "doc_id", "chunk_id", "term_frequency")


def document_terms(docs: DataFrame, doc_id: str, stemmed: bool = True) -> DataFrame:
    """(doc_id, term, term_frequency): each document's terms once, over all its chunks."""
    rows = lambda tokens: Counter(map(stem, tokens) if stemmed else tokens).items()
    return _by_document(docs, doc_id, "tokens", ["term", "term_frequency"], [T.StringType(), T.LongType()], rows)


def document_vectors(docs: DataFrame, keep: list[str], stemmed: bool = True) -> DataFrame:
    """(kept columns, terms, counts): each document's terms in order and how often it has each, on its row."""
    source = docs.select(*keep, "tokens")
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [sorted(Counter(map(stem, t or []) if stemmed else t or []).items()) for t in part.column(len(keep)).to_pylist()]
                terms, counts = (pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int64())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], terms, counts], [*keep, "terms", "counts"])

    return source.mapInArrow(run, schema)


def frequencies_by_size(terms: DataFrame, config: Config = Config()) -> DataFrame:
    """(chunk_size, term, doc_frequency) of document_terms: one combined shuffle by term. A document has a term in some chunk whatever the chunks' size."""
    counted = terms.groupBy("term").agg(F.count("*").alias("doc_frequency"))
    return counted.select(F.explode(F.array(*(F.lit(s) for s in config.chunk_sizes))).alias("chunk_size"), "term", "doc_frequency")


def document_frequency(posts: DataFrame) -> DataFrame:
    """(chunk_size, term, doc_frequency), exact: distinct documents in two combined steps."""
    once = posts.groupBy("chunk_size", "term", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("chunk_size", "term").agg(F.count("*").alias("doc_frequency"))


def chunk_statistics(docs: DataFrame, frequencies: DataFrame, config: Config = Config()) -> DataFrame:
    """A row a chunk size: vocabulary_size, total_chunks, total_tokens. frequencies: a row a chunk size and term."""
    sized = docs.select(F.size("tokens").alias("n"), F.explode(F.array(*(F.lit(s) for s in config.chunk_sizes))).alias("chunk_size"))
    totals = sized.groupBy("chunk_size").agg(F.sum(chunk_count(F.col("n"), F.col("chunk_size"))).alias("total_chunks"), F.sum(F.col("n").cast("bigint")).alias("total_tokens"))
    terms = frequencies.groupBy("chunk_size").agg(F.count("*").alias("vocabulary_size"))
    return totals.join(terms, "chunk_size").select("chunk_size", "vocabulary_size", "total_chunks", "total_tokens")


def index_documents(docs: DataFrame, doc_id: str, config: Config = Config()) -> DataFrame:
    """The index's document table: token_count after truncation, the other lexical numbers before, chunk counts by size."""
    n = F.size("tokens")
    counts = F.map_from_entries(F.array(*(F.struct(F.lit(str(s)), chunk_count(n, s)) for s in config.chunk_sizes)))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        n.cast("bigint").alias("token_count"),
        "lexical.unique_token_count",
        "lexical.stopword_count",
        "lexical.lexical_density",
        "lexical.average_token_length",
        counts.alias("chunk_counts"),
        "truncated",
    )


def index_totals(entries: DataFrame) -> DataFrame:
    """One row: documents_indexed, tokens_indexed, truncated_documents."""
    return entries.agg(
        F.count("*").alias("documents_indexed"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_indexed"),
        F.count_if("truncated").alias("truncated_documents"),
    )


def average_length(lengths: DataFrame, column: str) -> DataFrame:
    """One row: the mean of the positive lengths, 1 if there are none."""
    n = F.col(column)
    return lengths.agg(F.coalesce(F.avg(F.when(n > 0, n)), F.lit(1.0)).alias("average_length"))


def vocabulary_scan(frequencies: DataFrame, patterns: tuple[str, ...], limit: int = 10) -> DataFrame:
    """For each pattern the first terms, by term, that contain it, with their document frequency and how many more there are.

    The patterns are a fixed short list. Terms are cut to the limit per pattern by a top-k report, which is what is asked for.
    """
    hits = frequencies.select("term", "doc_frequency", F.explode(F.filter(F.array(*(F.lit(p) for p in patterns)), lambda p: F.contains(F.col("term"), p))).alias("pattern"))
    totals = hits.groupBy("pattern").agg(F.count("*").alias("matches"))
    # min_by k, without a window over all terms of a pattern: slices first, then their winners.
    part = hits.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(64)))
    top = lambda c: F.slice(F.array_sort(c), 1, limit)
    local = part.groupBy("pattern", "slice").agg(top(F.collect_list(F.struct("term", "doc_frequency"))).alias("t"))
    best = local.groupBy("pattern").agg(top(F.flatten(F.collect_list("t"))).alias("t"))
    rows = best.join(totals, "pattern").select("pattern", (F.greatest(F.col("matches") - limit, F.lit(0))).alias("more"), F.posexplode("t").alias("place", "e"))
    return rows.select("pattern", "place", "e.term", "e.doc_frequency", "more")


def top_terms(docs: DataFrame, doc_id: str, config: Config = Config()) -> DataFrame:
    """(doc_id, rank, term, frequency, weight): a document's most frequent tokens, truncated by no limit, ties by first occurrence. Without a shuffle."""

    def rows(tokens: list[str]) -> Iterator[tuple]:
        for rank, (term, n) in enumerate(Counter(tokens).most_common(config.top_terms), 1):
            yield rank, term, n, n / len(tokens)

    out = _by_document(docs, doc_id, "kept", ["rank", "term", "frequency", "weight"], [T.IntegerType(), T.StringType(), T.LongType(), T.DoubleType()], rows)
    return out.withColumn("weight", F.round("weight", 6))


def stem_counts(docs: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, stem, n): for each document how often it has each stem, over all its tokens. Without a shuffle."""
    return _by_document(docs, doc_id, "kept", ["stem", "n"], [T.StringType(), T.LongType()], lambda tokens: Counter(map(stem, tokens)).items())


def vocabulary_any(frequencies: DataFrame, patterns: tuple[str, ...], limit: int = 15) -> DataFrame:
    """The first terms, by term, that contain any of the patterns: a report of so many rows."""
    any_of = reduce(or_, (F.contains(F.col("term"), F.lit(p)) for p in patterns))
    return frequencies.where(any_of).select("term", "doc_frequency").orderBy("term").limit(limit)


# Rebuild ------------------------------------------------------------------------------------------

RECORD = """struct<url:string,fetchedAt:string,status:double,title:string,lang:string,pageType:string,source:string,rawHtmlHash:string,
hash:string,contentLength:bigint,cleanedContentLength:bigint,cleanedText:string,
lexicalDetail:struct<tokens:array<string>,stemmedTokens:array<string>>,
lexical:struct<tokens:array<string>,stemmedTokens:array<string>,topTerms:array<struct<term:string,frequency:double>>>,
lexicalSummary:struct<topTerms:array<struct<term:string,frequency:double>>>,
metadata:struct<rawHtmlHash:string,url:string,cleanedText:string,
lexicalDetail:struct<tokens:array<string>,stemmedTokens:array<string>>,lexical:struct<tokens:array<string>,stemmedTokens:array<string>>,
lexicalSummary:struct<topTerms:array<struct<term:string,frequency:double>>>>>""".replace("\n", "")


def rebuild_sources(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, tokens, text, kept columns) of JSON lines of any of the accepted shapes.

    source: 'detail' (its stems are used), 'cleanedText', 'topTerms' (a text of the top terms), or 'skipped' for invalid lines, incomplete metadata
    or nothing to index. Blank lines give no row.
    """
    from peneira.functions.text import pseudo_text

    r = F.from_json(F.col(column), RECORD)
    rows = lines.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").select(*keep, r.alias("r"))
    m = F.col("r.metadata")
    hash_ = F.coalesce(F.nullif(m["rawHtmlHash"], F.lit("")), F.when((F.coalesce("r.url", F.lit("")) != "") & (F.coalesce("r.fetchedAt", F.lit("")) != "") & F.col("r.status").isNotNull(), F.coalesce("r.rawHtmlHash", "r.hash")))
    has = lambda c: c["tokens"].isNotNull() & c["stemmedTokens"].isNotNull()
    candidates = [F.col("r.lexicalDetail"), F.col("r.lexical"), m["lexicalDetail"], m["lexical"]]
    detail = F.coalesce(*(F.when(c.isNotNull(), F.when(has(c), c["stemmedTokens"]).otherwise(F.array().cast("array<string>"))) for c in candidates))
    clean = F.coalesce("r.cleanedText", m["cleanedText"])
    tops = F.coalesce("r.lexicalSummary.topTerms", "r.lexical.topTerms", m["lexicalSummary"]["topTerms"])
    pseudo = pseudo_text(tops)
    source = (
        F.when(hash_.isNull(), "skipped")
        .when(F.size(F.coalesce(detail, F.array().cast("array<string>"))) > 0, "detail")
        .when(F.trim(F.coalesce(clean, F.lit(""))) != "", "cleanedText")
        .when(F.trim(F.coalesce(pseudo, F.lit(""))) != "", "topTerms")
        .otherwise("skipped")
    )
    out = rows.select(*keep, hash_.alias("doc_id"), source.alias("source"), detail.alias("tokens"), clean.alias("clean"), pseudo.alias("pseudo"))
    text = F.when(F.col("source") == "cleanedText", F.col("clean")).when(F.col("source") == "topTerms", F.col("pseudo"))
    return out.select("doc_id", "source", F.when(F.col("source") == "detail", F.col("tokens")).alias("tokens"), text.alias("text"), *keep)


def rebuilt_postings(sources: DataFrame, order_by: str, config: Config = Config()) -> DataFrame:
    """Postings of what rebuild_sources found, the first line of each document by order_by; details are stems already, texts are analyzed."""
    usable = sources.where("source <> 'skipped'")
    first = usable.groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens", "text"), order_by).alias("s")).select("doc_id", "s.*")
    limit = config.max_tokens or 2**31 - 1
    details = first.where("source = 'detail'").select("doc_id", F.slice("tokens", 1, limit).alias("tokens"))
    texts = analyzed(first.where("source <> 'detail'").select("doc_id", "text"), "text", config)
    return postings(details, "doc_id", config, stemmed=False).unionByName(postings(texts, "doc_id", config))


def rebuild_counters(sources: DataFrame) -> DataFrame:
    """One row a source with its lines; duplicates count."""
    return sources.groupBy("source").agg(F.count("*").alias("records"))
