"""Queries of the crawl, index, search and schedule operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira import dims
from peneira.config import Config
from peneira.functions import html, text, urls
from peneira.functions.stemmer import duckdb_ctes, stems
from peneira.operators import crawl, index, kickoff, schedule, search
from peneira.session import durable, release, shared_folder, spread
from peneira.sources.files import summary_rows
from peneira.sources.tables import table

CONFIG = Config()
HASH = "raw_html_hash"

#: The batch of queries that the search queries run.
SEARCHES = [
    (1, "onde assistir Tucumanduba"),
    (2, "agenda do Fervedal"),
    (3, "calendário dos próximos jogos"),
    (4, "gol do Atlético Boqueirinha"),
    (5, "Quem enfrenta o União Guaramirá?"),
    (6, "   "),
    (7, "inter sao inter"),
    (8, "palavra-inexistente xyzzy"),
    (9, "tribuna"),
]
#: Now, for the queries about upcoming matches: 2025-03-01 00:00 UTC.
NOW_MS = 1_740_787_200_000

Q, O = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return register


# SQL parts ----------------------------------------------------------------------------------------

_FOLD = "strip_accents(lower({0}))"
_STOP = "[" + ", ".join(f"'{w}'" for w in dims.STOPWORDS) + "]"


def _sql_index_tokens(x: str) -> str:
    plain = f"regexp_replace({_FOLD.format(f'''coalesce({x}, '')''')}, '[\\^`¨¯´·¸]', '', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '[^a-z0-9]+'), lambda t: len(t) >= 3)"


def _sql_normalized(x: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(f'''coalesce({x}, '')''')}, '[^a-z0-9]+', ' ', 'g'))"


def _sql_query_tokens(x: str) -> str:
    return f"list_filter(string_split({_sql_normalized(x)}, ' '), lambda t: len(t) >= 3)"


_FIRST = "firsts as (select * from documents where raw_html_hash is not null qualify row_number() over (partition by raw_html_hash order by fetched_at, doc_id) = 1)"
_ANALYZED = f"""{_FIRST},
a0 as (select *, {_sql_index_tokens('cleaned_text')} as all_tokens from firsts),
a1 as (select *, list_filter(all_tokens, lambda t: not list_contains({_STOP}, t)) as kept from a0),
an as (select *, raw_html_hash as h, list_slice(kept, 1, 25000) as tokens from a1 where len(kept) > 0),
pos as (select h, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from an)"""
_SIZES = "(values (160), (240)) as s(chunk_size)"
_COUNTS = f"tc as (select chunk_size, h, cast(floor(pos / chunk_size) as int) as chunk_id, token, count(*) as tf from pos, {_SIZES} group by all)"
_POSTS = f"""{_ANALYZED}, {_COUNTS}, voc as (select distinct token from pos), {duckdb_ctes('voc')},
posts as (select chunk_size, stem as term, h as doc_id, chunk_id, cast(sum(tf) as bigint) as term_frequency from tc join stems using (token) group by all)"""


# Text ---------------------------------------------------------------------------------------------


def _first(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", HASH, "fetched_at", *columns))
    return index.first_of_hash(docs, HASH, "doc_id", "fetched_at")


def _analyzed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return index.analyzed(_first(spark, d, "cleaned_text", *columns), "cleaned_text", CONFIG)


@query(f"select doc_id, {_sql_normalized('title')} as normalized from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles as the query side normalizes them."""
    return table(spark, d, "documents").select("doc_id", text.normalized(F.col("title")).alias("normalized"))


@query(f"select doc_id, array_to_string({_sql_query_tokens('title')}, ' ') as tokens from documents")
def query_side_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Titles as words of the query side."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.query_tokens(F.col("title")), " ").alias("tokens"))


@query(f"select doc_id, array_to_string({_sql_index_tokens('cleaned_text')}, ' ') as tokens from documents")
def index_side_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts as words of the index side."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.index_tokens(F.col("cleaned_text")), " ").alias("tokens"))


@query(f"with t as (select doc_id, {_sql_index_tokens('cleaned_text')} as t from documents) select doc_id, array_to_string(list_filter(t, lambda x: not list_contains({_STOP}, x)), ' ') as kept from t")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    """T4: texts without stopwords."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.without_stopwords(text.index_tokens(F.col("cleaned_text"))), " ").alias("kept"))


@query(f"""with {_ANALYZED} select doc_id, cast(len(kept) as bigint) as token_count, cast(len(list_distinct(kept)) as bigint) as unique_token_count,
cast(len(all_tokens) - len(kept) as bigint) as stopword_count, round(len(array_to_string(kept, '')) / len(kept), 4) as average_token_length,
round(len(kept) / len(all_tokens), 6) as lexical_density from an""")
def lexical_summary(spark: SparkSession, d: str) -> DataFrame:
    """Lexical numbers of each distinct page."""
    return _analyzed(spark, d).select("doc_id", "lexical.*")


@query(f"""with {_ANALYZED}, f as (select h, token, count(*) as n, min(pos) as p from pos group by all),
r as (select *, row_number() over (partition by h order by n desc, p) as rank from f)
select r.h as doc_id, cast(rank as int) as rank, token as term, n as frequency, round(n / len(tokens), 6) as weight from r join an on an.h = r.h where rank <= 12""")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each page's most frequent words."""
    return index.top_terms(_analyzed(spark, d), HASH, CONFIG)


@query(f"with {_ANALYZED}, voc as (select distinct token from pos), {duckdb_ctes('voc')} select token, stem from stems")
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """T5: stems of the vocabulary."""
    return stems(_analyzed(spark, d).select(F.explode("kept").alias("token")).groupBy("token").agg(F.lit(1).alias("one")).select("token"))


@query(f"""with {_ANALYZED}, voc as (select distinct token from pos), {duckdb_ctes('voc')}
select h as doc_id, stem, count(*) as n from pos join stems using (token) group by all""")
def stem_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Stem counts of each page."""
    return index.stem_counts(_analyzed(spark, d), HASH)


@query("select doc_id, sha256(text) as text_sha256, length(cleaned_text) as cleaned_length, n_chars = length(text) as length_holds from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash and lengths of texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("cleaned_text").cast("bigint").alias("cleaned_length"), (F.col("n_chars") == F.length("text")).alias("length_holds"))


@query("select doc_id, trim(regexp_replace(text, '[\\s\\x{000B}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) as collapsed from documents")
def collapse_space(spark: SparkSession, d: str) -> DataFrame:
    """White space of every kind collapsed."""
    return table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


# Index --------------------------------------------------------------------------------------------


@query(f"with {_FIRST} select doc_id, raw_html_hash from firsts")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each content hash."""
    return _first(spark, d).select("doc_id", HASH)


@query(f"with {_POSTS} select * from posts")
def postings_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Postings of both chunk sizes."""
    return index.postings(_analyzed(spark, d), HASH, CONFIG)


@query(f"with {_POSTS} select chunk_size, term, count(distinct doc_id) as doc_frequency from posts group by all")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Exact document frequency."""
    return index.frequencies_by_size(index.document_terms(_analyzed(spark, d), HASH), CONFIG)


@query(f"""with {_POSTS}, c as (select chunk_size, cast(sum(greatest(1, ceil(len(tokens) / chunk_size))) as bigint) as total_chunks, cast(sum(len(tokens)) as bigint) as total_tokens from an, {_SIZES} group by 1),
v as (select chunk_size, count(distinct term) as vocabulary_size from posts group by 1) select chunk_size, vocabulary_size, total_chunks, total_tokens from c join v using (chunk_size)""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics by chunk size."""
    docs = durable(_analyzed(spark, d).select(HASH, "tokens"))
    return index.chunk_statistics(docs, index.frequencies_by_size(index.document_terms(docs, HASH), CONFIG), CONFIG)


@query(f"""with {_ANALYZED} select h as doc_id, cast(len(tokens) as bigint) as token_count, cast(len(list_distinct(kept)) as bigint) as unique_token_count, cast(len(all_tokens) - len(kept) as bigint) as stopword_count,
cast(greatest(1, ceil(len(tokens) / 160)) as bigint) as chunks_160, cast(greatest(1, ceil(len(tokens) / 240)) as bigint) as chunks_240 from an""")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """The index's document table."""
    entries = index.index_documents(_analyzed(spark, d), HASH, CONFIG)
    chunks = [F.col("chunk_counts")[str(s)].alias(f"chunks_{s}") for s in CONFIG.chunk_sizes]
    return entries.select("doc_id", "token_count", "unique_token_count", "stopword_count", *chunks)


@query(f"with {_ANALYZED} select count(*) as documents_indexed, cast(sum(least(len(kept), 60)) as bigint) as tokens_indexed, count(*) filter (len(kept) > 60) as truncated_documents from an")
def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Totals with a cap of 60 tokens a document."""
    from dataclasses import replace

    docs = index.analyzed(_first(spark, d, "cleaned_text"), "cleaned_text", replace(CONFIG, max_tokens=60))
    return index.index_totals(index.index_documents(docs, HASH, CONFIG))


@query(f"with {_ANALYZED} select round(avg(len(tokens)), 6) as average_length from an")
def avg_doc_length(spark: SparkSession, d: str) -> DataFrame:
    """Average length."""
    return index.average_length(_analyzed(spark, d).select(F.size("tokens").alias("n")), "n").select(F.round("average_length", 6).alias("average_length"))


_SCAN = ("assist", "tabel", "joga", "tribun", "brasil")


@query(f"""with {_POSTS}, df as (select term, count(distinct doc_id) as doc_frequency from posts where chunk_size = 160 group by 1),
m as (select pattern, term, doc_frequency, row_number() over (partition by pattern order by term) as n, count(*) over (partition by pattern) as c from df, (values {", ".join(f"('{p}')" for p in _SCAN)}) as p(pattern) where contains(term, pattern))
select pattern, cast(n - 1 as int) as place, term, doc_frequency, greatest(c - 10, 0) as more from m where n <= 10""")
def vocab_substring(spark: SparkSession, d: str) -> DataFrame:
    """Words that contain a pattern (a report of ten each)."""
    terms = index.document_terms(_analyzed(spark, d), HASH)
    return index.vocabulary_scan(index.frequencies_by_size(terms, Config(chunk_sizes=(160,))), _SCAN)


@query(f"""with {_POSTS}, df as (select term, count(distinct doc_id) as doc_frequency from posts where chunk_size = 160 group by 1)
select term, doc_frequency from df where {" or ".join(f"contains(term, '{p}')" for p in dims.VOCABULARY_ANY)} order by term limit 15""")
def vocab_any(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen words that contain any of a list of patterns."""
    terms = index.frequencies_by_size(index.document_terms(_analyzed(spark, d), HASH), Config(chunk_sizes=(160,)))
    return index.vocabulary_any(terms, dims.VOCABULARY_ANY)


_PSEUDO = "nullif(left(x, greatest(len(x) - 1, 0)), '')".replace("x", "array_to_string(list_transform(list_filter(lexical.top_terms, lambda e: e.term is not null), lambda e: repeat(e.term || ' ', greatest(1, cast(round(coalesce(e.frequency, 1)) as int)))), '')")


@query(f"select raw_html_hash, url, ingested_at, md5(coalesce({_PSEUDO}, '')) as text_md5 from crawl_summaries where len(lexical.top_terms) > 0")
def rebuild_pseudo_text(spark: SparkSession, d: str) -> DataFrame:
    """The pseudo texts of top terms, by their digests."""
    rows = table(spark, d, "crawl_summaries").where("size(lexical.top_terms) > 0")
    return rows.select(HASH, "url", "ingested_at", F.md5(text.pseudo_text(F.col("lexical.top_terms"))).alias("text_md5"))


@query("""with r as (select case when coalesce(raw_html_hash, '') = '' or coalesce(url, '') = '' or status is null then 'skipped' when lexical is not null and len(lexical.top_terms) > 0 then 'topTerms' else 'skipped' end as source from crawl_summaries)
select source, count(*) as records from r group by 1""")
def rebuild_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a rebuild from summary rows can use."""
    lines = summary_rows(table(spark, d, "crawl_summaries")).select(F.to_json(F.struct("*")).alias("value"))
    return index.rebuild_counters(index.rebuild_sources(lines))


# Search -------------------------------------------------------------------------------------------

_SYN_ROWS = [(h, k, s) for h, ss in dims.SYNONYMS.items() for k, s in enumerate(ss)]
_TEAM_LIST = "[" + ", ".join(f"'{w}'" for w in dims.TEAM_WORDS) + "]"
_EXPAND = f"""q as (select * from {dims.sql_values(SEARCHES, 'query_id, query')} union all select doc_id, coalesce(title, '') from documents where doc_id % 50 = 0),
own as (select query_id, unnest({_sql_query_tokens('query')}) as token, generate_subscripts({_sql_query_tokens('query')}, 1) - 1 as pos from q),
syn as (select head, n * 100 + k as n, synonym from (select head, n, unnest({_sql_query_tokens('txt')}) as synonym, generate_subscripts({_sql_query_tokens('txt')}, 1) - 1 as k from {dims.sql_values(_SYN_ROWS, 'head, n, txt')})),
ex as (select query_id, token, cast(min(ord) as bigint) as ord from (select query_id, pos as ord, token from own union all select query_id, 1000000 + pos * 10000 + n, synonym from own join syn on token = head) group by 1, 2)"""
_SEARCH = f"""{_ANALYZED}, {_COUNTS}, {_EXPAND}, voc as (select token from pos union select token from ex), {duckdb_ctes('voc')},
posts as (select stem as term, h as doc_id, sum(tf) as tf from tc join stems using (token) where chunk_size = 160 group by all),
terms as (select query_id, stem as term, min(ord) as ord from ex join stems using (token) where length(stem) >= 3 group by 1, 2),
feats as (select h as doc_id, doc_id as doc_ord, url, fetched_at, status, len(tokens) as token_count, case when trim(coalesce(title, '')) = '' then 'Sem titulo' else title end as title,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') as domain from an),
st as (select count(*) as documents, avg(token_count) as average from feats),
df as (select term, count(*) as df from posts where term in (select term from terms) group by 1),
parts as (select query_id, p.doc_id, ord, ln(1.0::double + (documents - df + 0.5::double) / (df + 0.5::double)) * (p.tf * 2.5::double / (p.tf + 1.5::double * (0.25::double + 0.75::double * (token_count / average)))) as part
  from terms join posts p using (term) join df using (term) join feats using (doc_id), st where documents - df + 0.5 > 0),
base as (select query_id, doc_id, sum(part) as base, count(*) as terms_matched, min(ord) as first_ord from parts group by 1, 2)"""
_MERGED = """s as (select raw_html_hash as hash, epoch_us(ingested_at) * 1000 + cast(status is null as int) as ord, title, fetched_at, status, lexical.token_count as tc from crawl_summaries where raw_html_hash is not null),
l as (select hash, arg_max(title, ord) filter (trim(coalesce(title, '')) <> '') as s_title, arg_max_null(status, ord) as s_status, arg_max_null(fetched_at, ord) as s_fetched, arg_max(tc, ord) filter (tc > 0) as s_tokens from s group by 1)"""
_COV = "case when len({0}) > 0 and len({1}) > 0 then len(list_filter({0}, lambda t: list_contains({1}, t))) / len({0}) else 0.0::double end"
_BOOSTED = f"""{_SEARCH},
qx as (select q.query_id, {_sql_normalized('query')} as whole, {_sql_query_tokens('query')} as own, tokens as toks from q join (select query_id, list(token order by ord) as tokens from ex group by 1) using (query_id)),
f2 as (select *, {_sql_normalized('title')} as nt, {_sql_normalized('domain')} as nd, {_sql_query_tokens('title')} as tt, {_sql_query_tokens('url')} as ut from feats),
j as (select *, list_filter(own, lambda t: list_contains({_TEAM_LIST}, t)) as teams from base join qx using (query_id) join f2 using (doc_id) left join {dims.sql_values(list(dims.DOMAIN_BOOSTS.items()), 'domain, boost')} using (domain)),
c as (select *, {_COV.format('toks', 'tt')} as c1, {_COV.format('toks', 'ut')} as c2, {_COV.format('teams', 'tt')} as t1, {_COV.format('teams', 'ut')} as t2, len(list_filter(teams, lambda t: contains(nd, t))) > 0 as td from j),
tf as (select *, case when len(teams) = 0 then 1.0::double when t1 = 0 and t2 = 0 and not td then 0.2::double else 1 + 1.2::double * least(1, greatest(t1, t2) + case when td then 0.5::double else 0 end) end as team_factor from c),
sc as (select *, base * (1 + 2 * c1 + 0.7::double * c2) * case when contains(nt, whole) then 1.5::double else 1 end * coalesce(boost::double, 1)
  * case when len(list_filter(toks, lambda t: list_contains({_TEAM_LIST}, t) and contains(nt, t))) > 0 then 1.1::double else 1 end * team_factor + case when len(list_filter(toks, lambda t: contains(nd, t))) > 0 then 0.2::double else 0 end as raw from tf)"""


# The same over documents with what their summary rows add.
_ENRICHED = f"{_MERGED}, " + _BOOSTED.replace(
    "len(tokens) as token_count, case when trim(coalesce(title, '')) = '' then 'Sem titulo' else title end as title,",
    "len(tokens) as token_count, coalesce(s_title, case when trim(coalesce(title, '')) = '' then 'Sem titulo' else title end) as title,",
).replace("feats as (select h as doc_id, doc_id as doc_ord, url, fetched_at, status,", "feats as (select h as doc_id, doc_id as doc_ord, url, coalesce(s_fetched, fetched_at) as fetched_at, coalesce(s_status, status) as status,").replace(
    "as domain from an),", "as domain from an left join l on l.hash = an.h),"
)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The fixed queries, and the title of every document whose id is divisible by 50."""
    fixed = dims.frame(spark, [(int(i), q) for i, q in SEARCHES], "query_id bigint, query string")
    titles = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"))
    return fixed.unionByName(titles)


def _one_query(spark: SparkSession) -> DataFrame:
    return dims.frame(spark, [SEARCHES[0]], "query_id bigint, query string")


_indexes: dict[tuple[str, str], search.StoredIndex] = {}
_by_document: dict[tuple[str, str, bool], search.DocumentIndex] = {}


def _index(spark: SparkSession, d: str) -> search.StoredIndex:
    """The index by term of a data folder, for a single query; built by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        docs = durable(_analyzed(spark, d, "url", "title", "status").select("doc_id", HASH, "url", "title", "fetched_at", "status", "tokens"))
        features = docs.select(F.col(HASH).alias("doc_id"), "url", "title", F.size("tokens").cast("bigint").alias("token_count"), F.col("doc_id").alias("doc_ord"), "fetched_at", "status")
        _indexes[key] = search.store(index.document_terms(docs, HASH), search.search_documents(features, CONFIG), shared_folder(spark, "index"))
        release(docs)
    return _indexes[key]


def _documents(spark: SparkSession, d: str, enriched: bool = False) -> search.DocumentIndex:
    """The index by document of a data folder, for batches of queries, likewise; enriched: of documents with what their summary rows add."""
    key = (spark.sparkContext.applicationId, d, enriched)
    if key not in _by_document:
        docs = _analyzed(spark, d, "url", "title", "status").select(F.col(HASH).alias("doc_id"), "url", "title", F.size("tokens").cast("bigint").alias("token_count"), F.col("doc_id").alias("doc_ord"), "fetched_at", "status", "tokens")
        vectors = index.document_vectors(docs, docs.columns[:-1])
        if enriched:
            vectors = durable(vectors)
            merged = search.merged_summaries(vectors.select("doc_id", "title", "fetched_at", "status", "token_count"), _summaries(spark, d))
            features = vectors.select("doc_id", "url", "doc_ord", "terms", "counts").join(merged, "doc_id")
            _by_document[key] = search.by_document(search.search_documents(features, CONFIG))
            release(vectors)
        else:
            _by_document[key] = search.by_document(search.search_documents(vectors, CONFIG))
    return _by_document[key]


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summary rows in the order in which they came; of rows of one moment one with a status is the earlier."""
    ord_ = F.unix_micros(F.col("ingested_at").cast("timestamp")) * 1000 + F.col("status").isNull().cast("int")
    return table(spark, d, "crawl_summaries").select(F.col(HASH).alias("hash"), ord_.alias("ord"), "title", "fetched_at", "status", F.col("lexical.token_count").alias("token_count"))


@query(f"with {_POSTS} select count(distinct doc_id) as documents, count(distinct term) as terms, count(*) as rows_, cast(sum(tf) as bigint) as tokens from (select doc_id, term, sum(term_frequency) as tf from posts where chunk_size = 160 group by all)")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored index, written anew and read again, in numbers."""
    _indexes.pop((spark.sparkContext.applicationId, d), None)
    return _index(spark, d).terms.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("term").alias("terms"), F.count("*").alias("rows_"), F.sum("term_frequency").alias("tokens"))


@query(f"with {_EXPAND} select query_id, ord, token from ex")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    """Q1: the words of each query and their synonyms."""
    return search.expanded_tokens(_queries(spark, d), CONFIG)


@query(f"with {_SEARCH} select query_id, doc_id, round(base, 6) as base, terms_matched from base")
def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Q2-Q7: base scores of every match of a batch of queries."""
    return search.batch_scores(_queries(spark, d), _documents(spark, d), CONFIG)


@query(f"""with {_SEARCH}, r as (select *, round(base, 6) as score from base join feats using (doc_id) where query_id = 1)
select doc_id, score, terms_matched from r order by score desc, first_ord, doc_ord limit 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the ten best documents of one query by BM25 alone."""
    stored = _index(spark, d)
    terms = search.query_terms(search.expanded_tokens(_one_query(spark), CONFIG), CONFIG)
    scores = search.base_scores(terms, stored.terms, stored.features, CONFIG, (stored.known, stored.average))
    scored = scores.join(stored.features.select("doc_id", "doc_ord"), "doc_id").withColumn("score", F.round("base", 6))
    return search.top_k(scored, 10).select("doc_id", "score", "terms_matched")


_PLACES = "r as (select *, round(raw, 6) as score from sc), p as (select *, row_number() over (partition by query_id order by score desc, first_ord, doc_ord) as place from r)"


@query(f"""with {_BOOSTED}, {_PLACES} select query_id, cast(place as int) as place, doc_id, url, title, score, terms_matched, token_count, fetched_at, status from p where place <= 20""")
def search_boosted(spark: SparkSession, d: str) -> DataFrame:
    """The whole search of a batch of queries, twenty results each."""
    return search.batch_search(_queries(spark, d), _documents(spark, d), CONFIG)


@query(f"""with {_ENRICHED}, {_PLACES} select query_id, cast(place as int) as place, doc_id, url, title, score, terms_matched, token_count, fetched_at, status from p where place <= 20""")
def search_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Q13 with Q14, P14: the same where documents have what their summary rows add."""
    return search.batch_search(_queries(spark, d), _documents(spark, d, enriched=True), CONFIG)


@query(f"with {_BOOSTED} select query_id, count(*) as kept from sc where raw >= 3 group by 1")
def min_score(spark: SparkSession, d: str) -> DataFrame:
    """How many results of each query reach a least score."""
    return search.reached(_queries(spark, d), _documents(spark, d), 3.0, CONFIG)


@query(f"""with {_BOOSTED} select query_id, doc_id, round(c1, 6) as title_coverage, round(c2, 6) as url_coverage, round(team_factor, 6) as team_factor from sc""")
def coverage_and_team_factor(spark: SparkSession, d: str) -> DataFrame:
    """Q8, Q10, Q11: coverage and team factor of every match."""
    return search.batch_factors(_queries(spark, d), _documents(spark, d), CONFIG)


_WEIGHTED = [(1, "Jogo do Flamengo feminino"), (2, "agenda do brasileirao para assistir"), (3, "")]


@query(f"""with q as (select * from {dims.sql_values(_WEIGHTED, 'query_id, query')}),
w as (select query_id, list_filter({_sql_index_tokens('query')}, lambda t: not list_contains({_STOP}, t)) as ws from q),
o as (select query_id, unnest(ws) as word, cast(generate_subscripts(ws, 1) - 1 as int) as pos from w),
g as (select query_id, pos, word, coalesce(given::double, 1.0::double) as weight from o left join {dims.sql_values(list(dims.TERM_WEIGHTS.items()), 'word, given')} using (word)),
e as (select query_id, pos, 0 as n, word as term, weight from g union all select query_id, pos, n, term, round(weight * 0.7::double, 6) from g join {dims.sql_values([(h, k + 1, s) for h, ss in dims.WEIGHTED_SYNONYMS.items() for k, s in enumerate(ss)], 'word, n, term')} using (word)),
voc as (select distinct term as token from e), {duckdb_ctes('voc')} select query_id, pos, n, term, stem as stemmed, weight from e join stems on token = term""")
def query_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weighted query form."""
    return search.weighted_terms(dims.frame(spark, _WEIGHTED, "query_id int, query string"), CONFIG)


@query(f"with {_MERGED}," + _FIRST + """ select firsts.raw_html_hash as doc_id, coalesce(s_title, title) as title, coalesce(s_status, status) as status, s_tokens as token_count from firsts left join l on l.hash = firsts.raw_html_hash""")
def jsonl_merge(spark: SparkSession, d: str) -> DataFrame:
    """Q13: pages with what their summary rows add."""
    docs = _first(spark, d, "title", "status").select(F.col(HASH).alias("doc_id"), "title", "fetched_at", "status", F.lit(None).cast("bigint").alias("token_count"))
    return search.merged_summaries(docs, _summaries(spark, d)).select("doc_id", "title", "status", "token_count")


# URLs and HTML ------------------------------------------------------------------------------------

_VARIANT = """case doc_id % 6 when 0 then url when 1 then url || '?utm_source=x&b=2&a=1' when 2 then url || '///#topo' when 3 then replace(url, 'https://', 'HTTPS://WWW.')
when 4 then replace(url, 'https://', 'https://suporte.') else url || '/foto.PNG?gclid=9' end"""
_U = f"select doc_id, {_VARIANT} as u from documents"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(_VARIANT).alias("u"))


_PARTS = """p as (select doc_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as proto, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]+)', 1)) as host,
regexp_extract(u, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(u, '\\?([^#]*)', 1) as query from v),
c as (select *, proto || '://' || host || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end as stem_,
array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(split_part(x, '=', 1), '(?i)^(utm_.*|gclid|fbclid)$'))), '&') as rest from p),
k as (select *, stem_ || case when rest = '' then '' else '?' || rest end as canonical from c)"""


def _sql_list(patterns: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{p}'" for p in patterns) + "]"


def _sql_blocked(host: str, path: str, endings: bool = True) -> str:
    """Whether one of the fixed patterns or endings holds, each tried by itself."""
    hit = lambda x, patterns: f"len(list_filter({_sql_list(patterns)}, lambda p: regexp_matches({x}, p))) > 0"
    ending = f"len(list_filter({_sql_list(dims.BLOCKED_ENDINGS)}, lambda p: ends_with(lower({path}), p))) > 0"
    return f"({hit(host, dims.BLOCKED_HOSTS)} or {hit(f'lower({path})', dims.BLOCKED_PATHS)}" + (f" or {ending})" if endings else ")")


@query(f"with v as ({_U}), {_PARTS} select doc_id, canonical from k")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical addresses."""
    return _variants(spark, d).select("doc_id", urls.canonical(F.col("u")).alias("canonical"))


@query(f"""with v as ({_U}), {_PARTS} select doc_id, {_sql_blocked('host', 'path')} or {_sql_blocked("''", 'canonical', endings=False)} as blocked from k""")
def url_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that are not crawled."""
    return _variants(spark, d).select("doc_id", urls.is_blocked(F.col("u")).alias("blocked"))


@query(f"with v as ({_U}), {_PARTS} select doc_id, regexp_replace(host, '^www\\.', '') as domain, host, proto in ('http', 'https') as is_http from k")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and domains."""
    u = F.col("u")
    return _variants(spark, d).select("doc_id", urls.domain(u).alias("domain"), urls.hostname_or_unknown(u).alias("host"), urls.is_http(u).alias("is_http"))


_HTML = """'<!doctype html><html lang="' || coalesce(lang, '') || '"><head><title> ' || coalesce(title, '') || ' </title><script>var a = "</p>";</script></head><body><!-- x --><h1>' || coalesce(title, '') || '</h1><p>' || text || '</p><script>if (1) {}</script><style>p {}</style>
<a href="/secao/' || cast(doc_id % 7 as string) || '">a</a><a class="x" href="/secao/' || cast(doc_id % 3 as string) || '">b</a><a href=''/secao/página ' || cast(doc_id % 7 as string) || '''>c</a><a href="//outro.example/x?utm_source=a">d</a><a href="mailto:a@b.example">e</a><a href="/logo.png">f</a></body></html>'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "url", "status", F.expr(_HTML).alias("html"))


_SPACES = "[\\s\\x{000B}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def _sql_entities(x: str) -> str:
    for entity, char in html.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_body(x: str) -> str:
    b = f"regexp_replace({x}, '(?is)^.*?<body[^>]*>|</body>.*$', '', 'g')"
    for tag in html.DROPPED:
        b = f"regexp_replace({b}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    b = f"regexp_replace(regexp_replace({b}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    return f"trim(regexp_replace({_sql_entities(b)}, '{_SPACES}', ' ', 'g'))"


@query(f"select doc_id, {_sql_body('html')} as body from (select doc_id, {_HTML} as html from documents)")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Body text."""
    return _pages(spark, d).select("doc_id", html.body_text(F.col("html")).alias("body"))


@query(f"""select doc_id, nullif(trim({_sql_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') as title, nullif(regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1), '') as lang from (select doc_id, {_HTML} as html from documents)""")
def html_meta(spark: SparkSession, d: str) -> DataFrame:
    """Title and language."""
    return _pages(spark, d).select("doc_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))


_LINKS = """pg as (select url, raw_html_hash, doc_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) as root from documents qualify row_number() over (partition by url order by doc_id) = 1),
l0 as (select url as page, [root || '/secao/' || doc_id % 7, root || '/secao/' || doc_id % 3, root || '/secao/p%C3%A1gina%20' || doc_id % 7, 'https://outro.example/x?utm_source=a', 'mailto:a@b.example', root || '/logo.png'] as ls from pg),
l1 as (select page, unnest(ls) as url, generate_subscripts(ls, 1) - 1 as n from l0),
l2 as (select page, url, min(n) as n from l1 group by 1, 2), links as (select page, cast(row_number() over (partition by page order by n) - 1 as int) as pos, url from l2)"""


def _one_page_an_address(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.groupBy("url").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select("doc_id", "url", F.expr(_HTML).alias("html"))


@query(f"with {_LINKS} select page, pos, url from links")
def links_unique(spark: SparkSession, d: str) -> DataFrame:
    """Each page's links."""
    return crawl.page_links(_one_page_an_address(spark, d))


@query(f"""with {_LINKS}, ok as (select *, row_number() over (partition by page order by pos) as r from links where url like 'http%' and url not like '%.png')
select page, url, 1 as depth, case when r <= 2 then 99.0::double else 99 - (r - 2) end as priority from ok""")
def link_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of links with a budget of two a page."""
    pages = _one_page_an_address(spark, d).withColumns({"depth": F.lit(0), "priority": F.lit(100.0)})
    links = crawl.page_links(pages, keep=("depth", "priority"))
    return crawl.link_tasks(links, Config(link_limit=2))


_SOFT = "|".join(dims.SOFT_404)


@query(f"select doc_id, case when status is null or status >= 400 then 'status' when doc_id % 5 in (1, 2) then 'content_type' when regexp_matches(lower(html), '{_SOFT}') then 'soft_404' else 'ok' end as outcome from (select doc_id, status, {_HTML} as html from documents)")
def fetch_filters(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each response."""
    types = F.array(*(F.lit(t) for t in ("text/html; charset=utf-8", "application/pdf", "image/png", None, "TEXT/HTML")))
    return _pages(spark, d).select("doc_id", crawl.fetch_outcome(F.col("status"), F.get(types, F.col("doc_id").cast("int") % 5), F.col("html")).alias("outcome"))


_ROBOTS = [("disallow", "/noticia/"), ("allow", "/noticia/agenda"), ("disallow", "/*-vence-*custam$"), ("disallow", "/noticia*-1$"), ("disallow", "/team")]


_ROBOTS_SQL = """[{'n': 9, 'allow': false, 'p': '^/noticia/'}, {'n': 15, 'allow': true, 'p': '^/noticia/agenda'}, {'n': 17, 'allow': false, 'p': '^/.*-vence-.*custam$'}, {'n': 12, 'allow': false, 'p': '^/noticia.*-1$'}, {'n': 5, 'allow': false, 'p': '^/team'}]"""


@query(f"""with p as (select doc_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as path from documents),
h as (select doc_id, list_filter({_ROBOTS_SQL}, lambda r: regexp_matches(path, r.p)) as hits from p)
select doc_id, coalesce((list_sort(hits, 'DESC')[1]).allow, true) as allowed from h""")
def robots_gate(spark: SparkSession, d: str) -> DataFrame:
    """What robots rules allow."""
    pages = table(spark, d, "documents").select("doc_id", "url")
    origins = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("origin")).groupBy("origin").agg(F.lit(1).alias("one")).select("origin")
    rules = origins.select("origin", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("path")) for k, p in _ROBOTS))).alias("r")).select("origin", "r.*")
    return crawl.robots_allowed(pages, rules).select("doc_id", "allowed")


# Frontier and metrics -----------------------------------------------------------------------------

_HEAP = """l as (select a.url as page, b.url as url from documents a join documents b on b.doc_id in (2 * a.doc_id, 2 * a.doc_id + 1))"""


@query(f"""with recursive l as (select a.url as page, b.url as url from documents a join documents b on b.doc_id = 2 * a.doc_id union all select a.url, b.url from documents a join documents b on b.doc_id = 2 * a.doc_id + 1),
g as (select distinct page, url from l where not {_sql_blocked("''", 'url')} and not {_sql_blocked("''", 'page')}),
w as (select url, 0 as level from documents where doc_id = 1 union select g.url, level + 1 from w join g on g.page = w.url where level < 10)
select url, min(level) as level from w group by 1""")
def frontier_levels(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by level from one seed, over a link table in which page n links to pages 2n and 2n + 1."""
    docs = table(spark, d, "documents").select("doc_id", "url")
    out = docs.select(F.col("url").alias("page"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("doc_id"))
    links = out.join(docs, "doc_id").select("page", "url").where(~urls.is_blocked(F.col("page")))
    return crawl.crawl_levels(docs.where("doc_id = 1").select("url"), links, CONFIG)


@query("select url, doc_id as ord, 100.0::double - doc_id % 10 as priority from (select url, min(doc_id) as doc_id from documents group by 1) order by 100 - doc_id % 10 desc, doc_id limit 50")
def frontier_pop(spark: SparkSession, d: str) -> DataFrame:
    """The fifty tasks to crawl next, by priority."""
    tasks = table(spark, d, "documents").groupBy("url").agg(F.min("doc_id").alias("ord")).withColumn("priority", F.lit(100.0) - F.col("ord") % 10)
    return crawl.pop(tasks, 50).select("url", "ord", "priority")


@query("select lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as host, count(*) as pages from documents group by 1")
def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages by host."""
    return crawl.source_breakdown(table(spark, d, "documents"))


@query("""select count(*) as pages_processed, count(*) filter (coalesce(status, 0) >= 400) as error_count, 0 as matches_found, round(greatest(1.0::double, (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1000000), 3) as seconds,
round(count(*) / greatest(1.0::double, (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1000000), 6) as pages_per_second from documents""")
def crawl_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The crawl in numbers."""
    docs = table(spark, d, "documents").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return crawl.crawl_metrics(docs, failed=F.coalesce("status", F.lit(0)) >= 400)


@query("select doc_id, site, cast(floor((row_number() over (partition by site order by doc_id) - 1) / 15) as bigint) as second from documents")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    """S3: the second in which each host's limit lets a request start."""
    return crawl.rate_schedule(table(spark, d, "documents").select("doc_id", "site"), "site", "doc_id")


# Schedules ----------------------------------------------------------------------------------------


def _iso_millis(c):  # noqa: ANN001, ANN202
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.unix_millis(F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms)))


def _kickoffs(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, home_team, kickoff_ms) of every match record, as p3 reads kickoffs; null where none can be read.

    Readings are whole seconds; the two forms that _iso_millis reads keep their milliseconds.
    """
    matches = table(spark, d, "match_records")
    values = kickoff.kickoff_values(matches, table(spark, d, "raw_schedules"), table(spark, d, "feed_catalog"))
    read = kickoff.normalised_kickoffs(values.where("record_table = 'match_records'")).select("record_id", "epoch")
    ms = F.coalesce(_iso_millis(F.col("kickoff_iso")), F.col("epoch") * 1000)
    return matches.join(read, "record_id", "left").select("record_id", "home_team", ms.alias("kickoff_ms"))


@query()
def upcoming_matches(spark: SparkSession, d: str) -> DataFrame:
    """M1, P10: each home team's next three kickoffs within two weeks."""
    rows = _kickoffs(spark, d).where("home_team is not null")
    return schedule.upcoming(rows, "home_team", "kickoff_ms", NOW_MS).select("home_team", "place", "kickoff_ms")


@query()
def kickoff_display(spark: SparkSession, d: str) -> DataFrame:
    """Kickoffs as they are shown."""
    day, hour, _ = schedule.displayed(F.col("kickoff_ms"), CONFIG.time_zone)
    return _kickoffs(spark, d).select("record_id", day.alias("match_date"), hour.alias("match_time"))


@query("""select record_id, coalesce(array_to_string(list_filter(list_transform(broadcasters, lambda b, i: case when list_position(list_transform(broadcasters, lambda x: trim(coalesce(x, ''))), trim(coalesce(b, ''))) = i then trim(coalesce(b, '')) else '' end), lambda b: b <> ''), '|'), '') as broadcasters from match_records""")
def broadcaster_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Broadcasters, each once."""
    entries = F.transform("broadcasters", lambda b: F.struct(b.alias("name"), F.lit(None).cast("string").alias("officialLogoUrl"), F.lit(None).cast("string").alias("highlightLogoUrl")))
    return table(spark, d, "match_records").select("record_id", F.array_join(schedule.broadcasters(entries), "|").alias("broadcasters"))


@query("""with b as (select record_id, nullif(trim(location_stadium), '') as s, nullif(trim(location_city), '') as c, nullif(trim(location_state), '') as u from match_records)
select record_id, coalesce(nullif(concat_ws(' • ', s, nullif(concat_ws(' - ', c, u), '')), ''), 'Local a definir') as location from b""")
def location_text(spark: SparkSession, d: str) -> DataFrame:
    """Locations as they are shown."""
    return table(spark, d, "match_records").select("record_id", schedule.location_text(F.col("location_stadium"), F.col("location_city"), F.col("location_state")).alias("location"))


_SLUG = "nullif(replace(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), '')"
_LOGO_NAMES = "select distinct unnest([home_team, away_team]) as name from match_records union select unnest(['São Paulo', 'VASCO DA GAMA', 'Vasco', 'Red Bull Bragantino', 'Atlético Mineiro', 'Copa do Brasil', '?'])"


@query(f"""with n as ({_LOGO_NAMES}) select name, case {_SLUG.format('name')} when 'vasco-da-gama' then 'vasco' when 'red-bull-bragantino' then 'bragantino' else {_SLUG.format('name')} end as slug,
logo from n left join {dims.sql_values(list(dims.LOGOS.items()), 's, logo')} on s = {_SLUG.format('name')} where name is not null""")
def team_slug_and_logo(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and logo files of typed names."""
    extra = dims.frame(spark, [(n,) for n in ("São Paulo", "VASCO DA GAMA", "Vasco", "Red Bull Bragantino", "Atlético Mineiro", "Copa do Brasil", "?")], "name string")
    typed = table(spark, d, "match_records").select(F.explode(F.array("home_team", "away_team")).alias("name"))
    names = typed.unionByName(extra).where("name is not null").groupBy("name").agg(F.lit(1).alias("one")).select("name")
    return schedule.team_logo(spark, names).select("name", schedule.team_slug(F.col("name")).alias("slug"), "logo")


_ALIAS_NAMES = ["Mengão", "furacao", " CRUZEIRO ", "Galo Doido", "Tricolor de Aço", "Clube Atlético Mineiro de BH", "Sport Clube Corinthians Paulista", "ju", "Xiquebom", "Leão", "São Paulo FC"]
_ALIASES = [(n * 100 + k, i, a) for n, (i, name, aliases) in enumerate(dims.TEAMS) for k, a in enumerate((name, *aliases))]


@query(f"""with n as (select * from {dims.sql_values([(x,) for x in _ALIAS_NAMES], 'name')} union select unnest([home_team, away_team]) from match_records), a as (select ord, team_id, strip_accents(lower(raw)) as alias from {dims.sql_values(_ALIASES, 'ord, team_id, raw')}),
m as (select name, team_id, row_number() over (partition by name order by case when strip_accents(lower(trim(name))) = alias then 0 else 1 end, ord) as r from n join a on strip_accents(lower(trim(name))) = alias or contains(strip_accents(lower(trim(name))), alias) or contains(alias, strip_accents(lower(trim(name)))))
select n.name, team_id from n left join m on m.name = n.name and r = 1""")
def team_alias(spark: SparkSession, d: str) -> DataFrame:
    """Team identifiers of names."""
    typed = table(spark, d, "match_records").select(F.explode(F.array("home_team", "away_team")).alias("name"))
    names = typed.unionByName(dims.frame(spark, [(x,) for x in _ALIAS_NAMES], "name string"))
    return schedule.team_ids(names.groupBy("name").agg(F.lit(1).alias("one")).select("name"))


_DATES = [
    ("2025-03-09T16:00:00-03:00", 1741546800), ("2025-03-09 16:00", 1741546800), ("2025-03-09", 1741489200), ("9 de março às 16:00", 1741546800), ("09/03 16:00", 1741546800),
    ("09/03/2024 - 21:30", 1710030600), ("dia 9 de março de 2024, 21:30", 1710030600), ("jogo em 2024-03-09T21:30 no estádio", 1710030600), ("amanhã", None), ("31/02/2025 10:00", None),
]


@query(f"select * from {dims.sql_values(_DATES, 'written, epoch')}")
def ptbr_datetime(spark: SparkSession, d: str) -> DataFrame:
    """Dates in Portuguese, against instants worked out by hand."""
    rows = dims.frame(spark, [(t,) for t, _ in _DATES], "written string")
    return rows.select("written", F.unix_seconds(schedule.ptbr_instant(F.col("written"), 2025)).alias("epoch"))


@query(f"select * from {dims.sql_values([(t,) for t in dims.SCHEDULE_TEAMS], 'team')}")
def team_list(spark: SparkSession, d: str) -> DataFrame:
    """M4: the schedule service's teams."""
    return schedule.team_list(spark)


@query(f"with {_POSTS} select chunk_size, count(*) as batch_rows, count(*) as stream_rows, 0 as differing from posts group by 1")
def stream_index_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The index built as a stream against the batch build: by chunk size, postings of both and those in one only (none)."""
    from uuid import uuid4

    from peneira.session import ensure_checkpoint_dir
    from peneira.streaming.incremental import index_stream, stream_postings

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", HASH, "fetched_at", "cleaned_text")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]")  # a pattern, as the table may be one file or a folder
    index_stream(stream, folder, f"{folder}/checkpoint").awaitTermination()
    key = ["chunk_size", "term", "doc_id", "chunk_id", "term_frequency"]
    batch = index.postings(_analyzed(spark, d), HASH, CONFIG).select(*key, F.lit(1).alias("b"), F.lit(0).alias("s"))
    streamed = stream_postings(spark, folder).select(*key, F.lit(0).alias("b"), F.lit(1).alias("s"))
    each = batch.unionByName(streamed).groupBy(*key).agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    return each.groupBy("chunk_size").agg(F.sum("b").alias("batch_rows"), F.sum("s").alias("stream_rows"), F.count_if(F.col("b") != F.col("s")).alias("differing"))


QUERIES, ORACLE = Q, O
