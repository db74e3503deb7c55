import pytest
from pyspark.sql import functions as F

from peneira.llm.mixture import mixture, plan, systematic, token_counts

TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a", "Olá, mundo! 2025"), (2, None, None), (3, "a", ""), (4, "a", "x" * 300_000), (5, "a", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in token_counts(docs).collect()}
    assert got[1] > 3 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1
    assert token_counts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("buckets", [1, 16])
def test_shares_caps_and_a_hot_source(spark, buckets):
    rows = [(k, "hot", 10 + k % 7) for k in range(3000)] + [(10_000 + k, "small", 12) for k in range(40)] + [(20_000 + k, None, 5) for k in range(30)] + [(30_000 + k, "untargeted", 5) for k in range(30)]
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), ("hot", 0.5, 1)], TARGETS)
    s = sizes(spark, rows)
    planned = plan(s, targets, 20_000)
    drawn = systematic(s, planned, buckets=buckets)
    got = {r.source: r for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m"), F.sum("copies").alias("n")).collect()}
    assert set(got) == {"hot", "small"}
    assert abs(got["hot"].t - 10_000) < 200 and got["hot"].m == 1
    assert got["small"].n == 120 and got["small"].m == 3
    # Systematic: the number drawn is off by less than one.
    copies = next(r.copies for r in planned.collect() if r.source == "hot") / 1e9
    assert abs(got["hot"].n - copies * 3000) < 1


def test_same_seed_same_draw(spark):
    s = sizes(spark, [(k, "a", 1 + k % 3) for k in range(500)])
    p = plan(s, spark.createDataFrame([("a", 0.4, 1)], TARGETS))
    draw = lambda seed: sorted(r.doc_id for r in systematic(s.repartition(3), p, seed).collect())
    assert draw(1) == draw(1) != draw(2)


def test_report_and_edge_tables(spark):
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b", "uma frase qualquer sobre futebol", 9) for k in range(40)], "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 1), ("c", 0.1, 5), (None, 0.5, 1), ("d", None, None)], TARGETS)
    drawn, report = mixture(docs, targets)
    r = {x.source: x for x in report.collect()}
    assert {s for s in r if r[s].falls_short} == {"b", "c"} and abs(sum(x.reached_share for x in r.values()) - 1) < 1e-9
    assert {x.source for x in drawn.collect()} == {"a", "b"}
    none, report = mixture(docs.limit(0), targets)
    assert none.collect() == [] and all(x.tokens == 0 and x.reached_share == 0.0 for x in report.collect())
