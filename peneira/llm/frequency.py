"""Frequency of every distinct term: occurrences, records, and a mark for the too rare and the too common.

Method: last-seen counters. Occurrences are hash-partitioned by term and ordered by
record, so a counter needs to remember only the last record (and part) that it saw: a new
one raises the record count, a repeated part is a second delivery and counts nothing. No
set of records is ever held.

A term that holds a third of all rows would end in one task; its records are therefore
spread over slices by a hash of the record, as many as there are shuffle partitions at
least. A record lies in one slice only, so the slices' counts add up. Records travel as
128 bits of hash, not as the text of their identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peneira.functions.text import normalized_term

#: Least number of slices.
SLICES = 256
RARE_BELOW = 5
COMMON_SHARE = (1, 5)


def posting_occurrences(postings: DataFrame, chunk_size: int = 160) -> DataFrame:
    """(origin, record, part, term, occurrences) of the postings of one chunk size; term is null where it is null or blank."""
    return postings.where((F.col("chunk_size") == chunk_size) & F.col("doc_hash").isNotNull()).select(
        F.lit("postings").alias("origin"),
        F.col("doc_hash").alias("record"),
        F.col("chunk_id").cast("bigint").alias("part"),
        normalized_term(F.col("term")).alias("term"),
        F.col("term_frequency").cast("bigint").alias("occurrences"),
    )


def top_term_occurrences(summaries: DataFrame) -> DataFrame:
    """The same of the summaries' top terms; rows without hash or lexical are left out.

    Spellings of one term add up within a summary, in the row itself, so that a second delivery of the row repeats the
    same (record, part) and counts nothing. A summary without terms gives one row of null term.
    """
    entries = F.transform(
        F.filter("lexical.top_terms", lambda e: e.isNotNull()),
        lambda e: F.struct(normalized_term(e["term"]).alias("term"), F.coalesce(e["frequency"], F.lit(0)).alias("n")),
    )
    rows = summaries.where(F.col("raw_html_hash").isNotNull() & F.col("lexical").isNotNull())
    rows = rows.select(F.col("raw_html_hash").alias("record"), entries.alias("entries"))
    summed = F.transform(
        F.array_distinct(F.transform("entries", lambda e: e["term"])),
        lambda t: F.struct(t.alias("term"), F.aggregate(F.filter("entries", lambda e: e["term"] == t), F.lit(0).cast("bigint"), lambda a, e: a + e["n"]).alias("n")),
    )
    rows = rows.select("record", F.explode_outer(summed).alias("e"))
    return rows.select(F.lit("top_terms").alias("origin"), "record", F.lit(0).cast("bigint").alias("part"), F.col("e.term").alias("term"), F.col("e.n").alias("occurrences"))


def term_statistics(occurrences: DataFrame, slices: int | None = None, rare_below: int = RARE_BELOW, common_share: tuple[int, int] = COMMON_SHARE) -> DataFrame:
    """One row for each origin and term: total_frequency, pages, verdict ('rare', 'common' or null).

    A (record, part) of a term counts once; of differing deliveries the largest count holds. Null terms do not count,
    but their records do among the origin's. Rare: total below rare_below. Common: not rare, in more than the share of the origin's records.
    Null occurrences count 0, null records are one record.
    """
    n = slices or max(SLICES, int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first, second = F.xxhash64("record"), F.xxhash64(F.lit("second"), "record")
    spread = occurrences.where(F.col("term").isNotNull()).select("origin", "term", F.pmod(first, F.lit(n)).cast("smallint" if n < 2**15 else "int").alias("slice"), first.alias("r1"), second.alias("r2"), "part", "occurrences")
    by = W.partitionBy("origin", "term", "slice").orderBy("r1", "r2", "part", F.col("occurrences").desc_nulls_last())
    seen = spread.select(
        "origin",
        "term",
        "slice",
        "occurrences",
        ((F.lag("r1").over(by) != F.col("r1")) | (F.lag("r2").over(by) != F.col("r2"))).alias("other_record"),
        (~F.lag("part").over(by).eqNullSafe(F.col("part"))).alias("new_part"),
    )
    seen = seen.withColumn("new_record", F.coalesce("other_record", F.lit(True)))  # the first row of all has none before it
    counts = F.when(F.col("new_record") | F.col("new_part"), F.coalesce("occurrences", F.lit(0))).otherwise(0)
    parts = seen.groupBy("origin", "term", "slice").agg(F.sum(counts).alias("n"), F.sum(F.col("new_record").cast("bigint")).alias("records"))
    totals = parts.groupBy("origin", "term").agg(F.sum("n").alias("total_frequency"), F.sum("records").alias("pages"))
    all_records = occurrences.select("origin", first.alias("r1"), second.alias("r2")).groupBy("origin", "r1", "r2").agg(F.lit(1).alias("one")).groupBy("origin").agg(F.count("*").alias("all_pages"))
    over, of = common_share
    verdict = F.when(F.col("total_frequency") < rare_below, "rare").when(F.col("pages") * of > F.col("all_pages") * over, "common")
    # One row an origin: broadcast, as its size does not depend on the data.
    return totals.join(F.broadcast(all_records), "origin").select("origin", "term", "total_frequency", "pages", verdict.alias("verdict"))
