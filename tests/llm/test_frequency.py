from collections import defaultdict

import pytest

from peneira.llm.frequency import posting_occurrences, term_statistics, top_term_occurrences

POSTINGS = "chunk_size int, term string, doc_hash string, chunk_id int, term_frequency bigint, origin string, record string"
LEXICAL = "raw_html_hash string, ingested_at timestamp, fetched_at timestamp, lexical struct<token_count:bigint,top_terms:array<struct<term:string,frequency:bigint,weight:double>>>"


def stats(df, **options):
    return {(r.origin, r.term): (r.total_frequency, r.pages, r.verdict) for r in term_statistics(df, **options).collect()}


def test_spellings_deliveries_and_nulls(spark):
    rows = [
        (160, "Água", "a", 0, 3, "clash", "x"),
        (160, "água ", "a", 0, 3, None, None),  # the same posting, delivered twice
        (160, " AGUA", "a", 1, 2, None, None),
        (160, "agua", "b", 0, 1, None, None),
        (240, "agua", "c", 0, 9, None, None),
        (160, None, "d", 0, 1, None, None),
        (160, "  ", "e", 0, 1, None, None),
        (160, "sol", None, 0, 1, None, None),
        (160, "sol", "a", None, None, None, None),
    ]
    got = stats(posting_occurrences(spark.createDataFrame(rows, POSTINGS)))
    assert got == {("postings", "agua"): (6, 2, "common"), ("postings", "sol"): (0, 1, "rare")}


def test_line_ends_at_the_end_of_a_term_are_trimmed(spark):
    rows = [(160, f"gol{end}", str(k), 0, 1, None, None) for k, end in enumerate(("", "\n", "\r", "\r\n", "\u2028"))]
    got = stats(posting_occurrences(spark.createDataFrame(rows, POSTINGS)))
    assert got == {("postings", "gol"): (5, 5, "common")}


def test_top_terms_count_a_hash_once(spark):
    t = [{"term": "Gol", "frequency": 4, "weight": 0.1}, {"term": "gol ", "frequency": 2, "weight": 0.1}, None, {"term": None, "frequency": 3, "weight": None}]
    rows = [("a", None, None, (1, t)), ("a", None, None, (1, t)), ("b", None, None, None), (None, None, None, (1, t)), ("c", None, None, (1, [])), ("d", None, None, (1, None))]
    got = stats(top_term_occurrences(spark.createDataFrame(rows, LEXICAL)))
    assert got == {("top_terms", "gol"): (6, 1, "common")}  # one of three pages


def test_empty(spark):
    assert stats(posting_occurrences(spark.createDataFrame([], POSTINGS))) == {}
    assert stats(top_term_occurrences(spark.createDataFrame([], LEXICAL))) == {}


@pytest.mark.parametrize("slices", [1, 7])
def test_against_sets_with_a_hot_term(spark, slices):
    rows = [(160, "hot" if k % 3 else f"t{k % 40}", f"d{k % 90}", k % 4, k % 5, None, None) for k in range(3000)]
    by = defaultdict(dict)
    for _, term, doc, chunk, tf, *_ in rows:
        by[term][doc, chunk] = max(tf, by[term].get((doc, chunk), 0))
    expected = {("postings", t): (sum(x.values()), len({d for d, _ in x})) for t, x in by.items()}
    got = stats(posting_occurrences(spark.createDataFrame(rows, POSTINGS)), slices=slices)
    assert {k: v[:2] for k, v in got.items()} == expected
