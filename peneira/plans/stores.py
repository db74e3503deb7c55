"""Queries that write with a sink and read with a source, and those of the frontier's state, with their SQL."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira import dims
from peneira.operators import crawl, index, search
from peneira.plans import core
from peneira.session import durable, shared_folder
from peneira.sources import files
from peneira.sources.tables import table

CONFIG = core.CONFIG
HASH = core.HASH


def seed_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The seeds of two files that list a start page for each team, nested and repeated. Seed files are small, whatever is crawled."""
    sites = [f"https://{t.lower().replace(' ', '-')}.example/" for t in dims.SCHEDULE_TEAMS]
    texts = [json.dumps({"a": {"b": {"urls": [f" {s} " for s in sites[:12]] + ["", 3]}}, "note": "no seed"}), json.dumps({"all": sites}), "broken"]
    return dims.frame(spark, list(enumerate(files.seeds(folder_texts=texts))), "place int, url string")


def summaries_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows appended as JSON lines, and read again; rows without hash are skipped."""
    path = shared_folder(spark, "summaries")
    files.append_summaries(files.summary_rows(table(spark, d, "crawl_summaries")), path)
    back = files.read_summaries(spark, path)
    return back.select("hash", "url", "fetchedAt", "status", "title", "lang", "pageType", "source", "contentLength", "cleanedContentLength", F.size("lexical.topTerms").alias("terms"), "lexical.tokenCount")


def matches_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Matches appended as quoted CSV with header, and read again; empty texts and nulls are the same there."""
    path = shared_folder(spark, "matches")
    columns = ["home_team", "away_team", "match_date", "match_time", "kickoff_iso", "competition", "broadcasters", "source_url"]
    rows = table(spark, d, "match_records").select("record_id", *(F.array_join("broadcasters", "|").alias(c) if c == "broadcasters" else c for c in columns))
    files.append_csv(rows, path)
    back = files.read_csv(spark, path, f"record_id bigint, {files.MATCHES}")
    return back.select("record_id", *(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """An index's description, written as JSON and read again, a row a chunk size."""
    path = shared_folder(spark, "metadata")
    docs = durable(core._analyzed(spark, d).select(HASH, "lexical", "truncated", "tokens"))
    stats = index.chunk_statistics(docs, index.frequencies_by_size(index.document_terms(docs, HASH), CONFIG), CONFIG)
    files.write_metadata(index.index_totals(index.index_documents(docs, HASH, CONFIG)), stats, path)
    back = spark.read.json(path)
    return back.select("documents_indexed", "tokens_indexed", "truncated_documents", F.explode("chunkSizeStats").alias("s")).select("documents_indexed", "tokens_indexed", "truncated_documents", "s.*")


def stored_postings(spark: SparkSession, d: str) -> DataFrame:
    """The index written as tables; the postings of one chunk size read again."""
    path = shared_folder(spark, "postings")
    docs = durable(core._analyzed(spark, d).select(HASH, "lexical", "truncated", "tokens"))
    posts = index.postings(docs, HASH, CONFIG)
    files.write_index(posts, index.index_documents(docs, HASH, CONFIG), index.frequencies_by_size(index.document_terms(docs, HASH), CONFIG), path)
    back, _ = files.read_index(spark, path, 240)
    return back.select("term", "doc_id", "chunk_id", "term_frequency")


def rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings built again from summary lines, the first line of each document."""
    rows = table(spark, d, "crawl_summaries")
    ordered = rows.where("lexical is not null").select("ingested_at", "url", "fetched_at", "status", HASH, "lexical")
    lexical = F.struct(F.transform("lexical.top_terms", lambda e: F.struct(e["term"].alias("term"), e["frequency"].cast("double").alias("frequency"))).alias("topTerms"))
    lines = ordered.select(
        F.struct("ingested_at", "url", F.to_json("lexical.top_terms")).alias("ord"),
        F.to_json(F.struct("url", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetchedAt"), "status", F.col(HASH).alias("hash"), lexical.alias("lexical"))).alias("value"),
    )
    return index.rebuilt_postings(index.rebuild_sources(lines, "value", keep=("ord",)), "ord", CONFIG)


def metrics_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A crawl's metrics with the pages of each host, written as JSON and read again."""
    path = shared_folder(spark, "metrics")
    docs = table(spark, d, "documents").select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "status")
    by_host = crawl.source_breakdown(docs)
    breakdown = by_host.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", "pages")))).alias("sourceBreakdown"))  # a row a host
    numbers = crawl.crawl_metrics(docs, failed=F.coalesce("status", F.lit(0)) >= 400).first()
    files.write_metrics(
        breakdown.select(F.lit(numbers.pages_processed).alias("pagesProcessed"), F.lit(numbers.matches_found).alias("matchesFound"), F.lit(numbers.error_count).alias("errorCount"), "sourceBreakdown", F.lit("frontier_empty").alias("stopReason")),
        path,
    )
    back = files.read_metrics(spark, path)
    return back.select("pagesProcessed", "errorCount", "stopReason", F.explode("sourceBreakdown").alias("host", "pages"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Address variants as tasks: each document's, at depths of 0 to 12."""
    return core._variants(spark, d).select(F.col("u").alias("url"), (F.col("doc_id") % 13).cast("int").alias("depth"), (100.0 - F.col("doc_id") % 13).alias("priority"), F.col("doc_id").alias("ord"))


def frontier_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """The tasks that enter a frontier which knows every fifth document's address: the first for each address."""
    known = table(spark, d, "documents").where("doc_id % 5 = 0").select("url")
    return crawl.enqueue(_tasks(spark, d), known, CONFIG).select("url", "depth", "priority", "ord")


def frontier_restored(spark: SparkSession, d: str) -> DataFrame:
    """A frontier from its snapshot: addresses canonical, blocked ones dropped, repeated ones kept in the queue and once among the visited."""
    path = shared_folder(spark, "frontier")
    visited = core._variants(spark, d).select(F.col("u").alias("url"))
    crawl.snapshot(_tasks(spark, d), visited, path)
    queue, seen = crawl.restored(spark.read.parquet(f"{path}/queue"), spark.read.parquet(f"{path}/visited"))
    return queue.select("url", "ord").unionByName(seen.select("url", F.lit(None).cast("bigint").alias("ord")))


def frontier_pop_dfs(spark: SparkSession, d: str) -> DataFrame:
    """The fifty tasks to crawl next, the newest first."""
    tasks = table(spark, d, "documents").groupBy("url").agg(F.min("doc_id").alias("ord")).withColumn("priority", F.lit(100.0))
    return crawl.pop(tasks, 50, "dfs").select("url", "ord")


def crawl_to_page_limit(spark: SparkSession, d: str) -> DataFrame:
    """A crawl that ends by its page limit, over a link table in which page n links to pages 2n and 2n + 1."""
    docs = table(spark, d, "documents").select("doc_id", "url")
    out = docs.select(F.col("url").alias("page"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("doc_id"))
    pages, reason = crawl.crawl_run(docs.where("doc_id = 1").select("url"), out.join(docs, "doc_id").select("page", "url"), replace(CONFIG, max_pages=300))
    return pages.select("url", "level", F.lit(reason).alias("stop_reason"))


def score_display(spark: SparkSession, d: str) -> DataFrame:
    """Results as they are shown: host without www. and score to four decimals."""
    found = core.search_boosted(spark, d)
    return found.select("query_id", "doc_id", core.urls.domain(F.col("url")).alias("host"), search.score_text(F.col("score")).alias("score_text"))


QUERIES = {
    f.__name__: f
    for f in (seed_addresses, summaries_round_trip, matches_csv_round_trip, index_metadata, stored_postings, rebuilt_index, metrics_round_trip, frontier_enqueue, frontier_restored, frontier_pop_dfs, crawl_to_page_limit, score_display)
}

_KEYS = f"with v as ({core._U}), {core._PARTS}"
_OK = f"not ({core._sql_blocked('host', 'path')}) and not ({core._sql_blocked(chr(39) * 2, 'canonical', endings=False)})"
_REBUILT = f"""with r as (select *, {core._PSEUDO} as text, row_number() over (partition by raw_html_hash order by ingested_at, url, to_json(lexical.top_terms)) as n from crawl_summaries
  where lexical is not null and coalesce(raw_html_hash, '') <> '' and coalesce(url, '') <> '' and fetched_at is not null and status is not null and trim(coalesce({core._PSEUDO}, '')) <> ''),
a1 as (select raw_html_hash as h, list_filter({core._sql_index_tokens('text')}, lambda t: not list_contains({core._STOP}, t)) as tokens from r where n = 1),
pos as (select h, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from a1), {core._COUNTS}, voc as (select distinct token from pos), {core.duckdb_ctes('voc')}
select chunk_size, stem as term, h as doc_id, chunk_id, cast(sum(tf) as bigint) as term_frequency from tc join stems using (token) group by all"""
_SEEDS = [(k, f"https://{t.lower().replace(' ', '-')}.example/") for k, t in enumerate(dims.SCHEDULE_TEAMS)]

ORACLE = {
    "seed_addresses": f"select * from {dims.sql_values(_SEEDS, 'place, url')}",
    "summaries_round_trip": """select raw_html_hash as hash, url, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%gZ') as fetchedAt, status, title, lang, page_type as pageType, source, content_length as contentLength,
cleaned_content_length as cleanedContentLength, cast(len(lexical.top_terms) as int) as terms, lexical.token_count as tokenCount from crawl_summaries where coalesce(raw_html_hash, '') <> ''""",
    "matches_csv_round_trip": "select record_id, " + ", ".join(f"coalesce({c}, '') as {c}" for c in ("home_team", "away_team", "match_date", "match_time", "kickoff_iso", "competition", "source_url")) + ", coalesce(array_to_string(broadcasters, '|'), '') as broadcasters from match_records",
    "index_metadata": f"""with {core._POSTS}, t as (select count(*) as documents_indexed, cast(sum(len(tokens)) as bigint) as tokens_indexed, count(*) filter (len(kept) > 25000) as truncated_documents from an),
c as (select chunk_size, cast(sum(greatest(1, ceil(len(tokens) / chunk_size))) as bigint) as total_chunks, cast(sum(len(tokens)) as bigint) as total_tokens from an, {core._SIZES} group by 1),
w as (select chunk_size, count(distinct term) as vocabulary_size from posts group by 1) select t.*, cast(chunk_size as bigint) as chunk_size, vocabulary_size, total_chunks, total_tokens from t, c join w using (chunk_size)""",
    "stored_postings": f"with {core._POSTS} select term, doc_id, chunk_id, term_frequency from posts where chunk_size = 240",
    "rebuilt_index": _REBUILT,
    "metrics_round_trip": """with h as (select lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as host, count(*) as pages from documents group by 1),
t as (select count(*) as pagesProcessed, count(*) filter (coalesce(status, 0) >= 400) as errorCount from documents) select pagesProcessed, errorCount, 'frontier_empty' as stopReason, host, pages from t, h""",
    "frontier_enqueue": f"""{_KEYS}, e as (select canonical as url, cast(doc_id % 13 as int) as depth, 100.0::double - doc_id % 13 as priority, doc_id as ord from k where {_OK} and doc_id % 13 <= 10),
f as (select * from e qualify row_number() over (partition by url order by ord) = 1) select * from f where url not in (select url from documents where doc_id % 5 = 0)""",
    "frontier_restored": f"{_KEYS} select canonical as url, doc_id as ord from k where {_OK} union all select distinct canonical, null from k where {_OK}",
    "frontier_pop_dfs": "select url, min(doc_id) as ord from documents group by 1 order by 2 desc limit 50",
    "crawl_to_page_limit": core.ORACLE["frontier_levels"].replace("select url, min(level) as level from w group by 1", "x as (select url, min(level) as level from w group by 1) ").replace(")\nx as", "),\nx as")
    + "select url, level, 'max_pages' as stop_reason from x order by level, url limit 300",
    "score_display": f"""with {core._BOOSTED}, {core._PLACES} select query_id, doc_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') as host, printf('%.4f', score) as score_text from p where place <= 20""",
}
