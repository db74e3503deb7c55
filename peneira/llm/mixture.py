"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. A source's expected copies a record follow from
its share of the mixture, at most its max_repeats. Copies are drawn by systematic
sampling: prefix sums of the expected copies within the source, one random offset, and a
copy for each integer crossed, so counts are off by less than one record a source.

A prefix sum over a source that holds a third of all rows would run in one task. Records
are therefore hashed to buckets within their source: sums of buckets are added up first
(a small table), then each bucket runs its own sums from its start. Expected copies are
whole billionths, so sums are exact in any order.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pattern by which byte-level BPE vocabularies of this kind cut a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNIT = 1_000_000_000
#: Least number of buckets of a source, and the records that a bucket holds on average at most.
BUCKETS, RECORDS_PER_BUCKET = 512, 1_000_000

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of every row; null texts have 0 tokens. Whole texts are counted, without a shuffle."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("tokens", T.LongType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return source.mapInArrow(run, schema)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target source: target_share, max_repeats, available tokens and records, wanted tokens, and copies, the expected ones a record in billionths.

    total_tokens: the mixture's size; the tokens of all rows unless given. A source that documents lack has nothing available.
    Null shares and repeats count as 0 and 1; a repeated target source counts once, with its largest share.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("records"))
    if total_tokens is None:
        total_tokens = sizes.agg(F.sum("tokens")).first()[0] or 0
    want = targets.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    joined = want.join(have, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("records", F.lit(0)).alias("records"),
        (F.col("target_share") * F.lit(total_tokens)).alias("wanted"),
    )
    copies = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.withColumn("copies", F.floor(copies * UNIT).cast("bigint"))


def systematic(sizes: DataFrame, planned: DataFrame, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of the records drawn at least once. The same seed draws the same; buckets follow from the records, not from the session."""
    if buckets is None:
        most = planned.agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
        buckets = max(BUCKETS, 1 << math.ceil(math.log2(max(most / RECORDS_PER_BUCKET, 1))))
    # One row a target source: its copies go along with each record.
    rated = sizes.join(F.broadcast(planned.where("copies > 0").select("source", F.col("copies").alias("expected"))), "source")
    placed = rated.withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))).withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("expected").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(UNIT))
    starts = sums.select("source", "bucket", (F.coalesce(F.sum("in_bucket").over(before), F.lit(0)) + offset).alias("start"))
    own = W.partitionBy("source", "bucket").orderBy("tokens", "place", F.col("doc_id").cast("string")).rowsBetween(W.unboundedPreceding, 0)
    running = placed.withColumn("upto", F.sum("expected").over(own)).join(F.broadcast(starts), ["source", "bucket"])  # sources x buckets rows at most
    crossed = F.expr(f"(start + upto) div {UNIT} - (start + upto - expected) div {UNIT}")
    return running.select("doc_id", "source", "tokens", crossed.cast("int").alias("copies")).where("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies), and its report: a row a source with target_share, reached_share, tokens, and whether it falls short.

    A source falls short if all its records, each max_repeats times, have fewer tokens than it should give.
    Null sources and sources without a target are left out. Tokens are counted once and written, as several steps read them.
    """
    sizes = durable(token_counts(docs, tokenizer))
    planned = durable(plan(sizes, targets, total_tokens))
    drawn = durable(systematic(sizes, planned, seed))
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("bigint").alias("drawn"))
    every = F.sum("tokens").over(W.partitionBy())  # over one row a target source
    report = planned.join(got, "source", "left").select(
        "source",
        "target_share",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("drawn", F.lit(0)).alias("records_drawn"),
        "wanted",
        (F.col("wanted") > F.col("available") * F.col("max_repeats")).alias("falls_short"),
    )
    report = report.withColumn("reached_share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0))
    return drawn, report
