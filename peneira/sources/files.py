"""Files of the original system as Spark sources and sinks: JSON lines, CSV, seeds, index, metrics, frontier."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = """url string, fetchedAt string, status int, title string, lang string, hash string, pageType string, source string,
contentLength bigint, cleanedContentLength bigint,
lexical struct<tokenCount:bigint,uniqueTokenCount:bigint,stopwordCount:bigint,averageTokenLength:double,lexicalDensity:double,
topTerms:array<struct<term:string,frequency:bigint,weight:double>>,processingMs:double>""".replace("\n", "")
MATCHES = "home_team string, away_team string, match_date string, match_time string, kickoff_iso string, competition string, broadcasters string, source_url string"
PLAYERS = "name string, position string, team string, sourceUrl string"
TEAM_STATS = "teamName string, wins int, draws int, losses int, goalsFor int, goalsAgainst int, sourceUrl string"
METRICS = "startTime string, endTime string, pagesProcessed bigint, matchesFound bigint, errorCount bigint, sourceBreakdown map<string,bigint>, stopReason string, pagesPerSecond double"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Document summaries of a JSON lines file; blank and invalid lines and rows without hash are skipped."""
    rows = spark.read.schema(f"{SUMMARY}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.coalesce("hash", F.lit("")) != "")).drop("_corrupt_record")


def summary_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of the summary file: the fixed columns under their names there. docs: the crawl summary table."""
    lex = F.col("lexical")
    tops = F.transform(lex["top_terms"], lambda e: F.struct(e["term"].alias("term"), e["frequency"].alias("frequency"), e["weight"].alias("weight")))
    lexical = F.when(
        lex.isNotNull(),
        F.struct(
            lex["token_count"].alias("tokenCount"),
            lex["unique_token_count"].alias("uniqueTokenCount"),
            lex["stopword_count"].alias("stopwordCount"),
            lex["average_token_length"].alias("averageTokenLength"),
            lex["lexical_density"].alias("lexicalDensity"),
            tops.alias("topTerms"),
        ),
    )
    return docs.select(
        "url",
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("fetchedAt"),
        "status",
        "title",
        "lang",
        F.col("raw_html_hash").alias("hash"),
        F.col("page_type").alias("pageType"),
        "source",
        F.col("content_length").alias("contentLength"),
        F.col("cleaned_content_length").alias("cleanedContentLength"),
        lexical.alias("lexical"),
    )


def append_summaries(docs: DataFrame, path: str) -> None:
    """Append summary rows as JSON lines, without deduplication."""
    docs.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, for readers of several shapes."""
    return spark.read.text(path)


def write_index(posts: DataFrame, documents: DataFrame, frequencies: DataFrame, path: str) -> None:
    """The index as tables: postings in a folder for each chunk size, sorted by term within files, so that a query's terms are found by their statistics."""
    ranged = posts.repartitionByRange("chunk_size", "term").sortWithinPartitions("chunk_size", "term")
    ranged.write.mode("overwrite").partitionBy("chunk_size").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    frequencies.write.mode("overwrite").partitionBy("chunk_size").parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str, chunk_size: int) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of one chunk size; other sizes are pruned."""
    return spark.read.parquet(f"{path}/postings").where(F.col("chunk_size") == chunk_size), spark.read.parquet(f"{path}/documents")


def index_as_json(posts: DataFrame) -> DataFrame:
    """(chunk_size, term, entry): each term's entry of the nested index file, as JSON; one row a term, so it has no size limit but a term's own."""
    listed = posts.groupBy("chunk_size", "term").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("docId"), F.col("chunk_id").alias("chunkId"), F.col("term_frequency").alias("termFrequency")))).alias("postings"))
    entry = F.struct(F.size(F.array_distinct(F.transform("postings", lambda p: p["docId"]))).alias("docFrequency"), F.col("postings"))
    return listed.select("chunk_size", "term", F.to_json(entry).alias("entry"))


def write_metadata(totals: DataFrame, statistics: DataFrame, path: str) -> None:
    """The one-row description of an index, with its statistics by chunk size."""
    listed = statistics.agg(F.array_sort(F.collect_list(F.struct(*statistics.columns))).alias("chunkSizeStats"))
    numbers = totals.first().asDict()
    listed.select(*(F.lit(v).alias(k) for k, v in numbers.items()), "chunkSizeStats").coalesce(1).write.mode("overwrite").json(path)


def string_leaves(value: object) -> list[str]:
    """The strings of lists at any depth of objects, trimmed, without empty ones. Strings elsewhere, a list at the top and objects within lists are passed over."""
    if not isinstance(value, dict):
        return []
    out: list[str] = []
    for v in value.values():
        if isinstance(v, list):
            out += [x.strip() for x in v if isinstance(x, str) and x.strip()]
        elif isinstance(v, dict):
            out += string_leaves(v)
    return out


def seeds(file_text: str | None = None, listed: str | None = None, folder_texts: Iterable[str] = ()) -> list[str]:
    """Seed addresses, each once: of one seed file, else of a comma-separated list, else of all files of a folder. Unreadable files give none."""

    def read(text: str) -> list[str]:
        try:
            return string_leaves(json.loads(text))
        except ValueError:
            return []

    if file_text is not None:
        found = read(file_text)
    elif listed:
        found = [s.strip() for s in listed.split(",")]
    else:
        found = [s for t in folder_texts for s in read(t)]
    return list(dict.fromkeys(s for s in found if s))


def read_matches_csv(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a CSV file without header; broadcasters as an array, empty if there are none."""
    rows = spark.read.schema(MATCHES).csv(path)
    return rows.withColumn("broadcasters", F.filter(F.split(F.coalesce("broadcasters", F.lit("")), "\\|"), lambda b: b != ""))


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV folder with header; all text quoted, quotes within it escaped, blanks at its ends kept."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("append").options(header=True, quoteAll=True, escape='"', **kept).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The metrics of a path, or None if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(METRICS).json(path)
    except AnalysisException:
        return None
