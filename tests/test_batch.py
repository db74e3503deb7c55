import re

import pytest
from pyspark.sql import functions as F

from peneira.operators import batch, index, search
from peneira.plans import core, stores
from tests.test_index_search import analyzed

TEXTS = [
    ("Flamengo joga hoje no Maracanã e o Flamengo vence", "https://ge.globo.com/flamengo", "Flamengo vence"),
    ("Agenda da semana com jogos da rodada, inter e santos", "https://www.x.com/agenda", None),
    ("bola " * 40 + "flamengo", "https://santos.example/bola", "Bola do Santos"),
    ("Santos e Inter jogam hoje, agenda e bola", "https://y.com/santos-inter", "Inter recebe o Santos hoje"),
    ("Onde assistir ao jogo do Vasco hoje", "https://vasco.example/jogo", "Jogo do Vasco"),
]
PAGES = [(50 * k, f"h{k}", k, *TEXTS[k % len(TEXTS)]) for k in range(40)]
QUERIES = [(1, "flamengo hoje"), (2, "agenda do santos"), (3, ""), (4, "Inter recebe o Santos hoje"), (5, "xyzzy"), (6, "inter sao inter bola"), (7, "vasco jogo")]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    docs = spark.createDataFrame(PAGES, "doc_id bigint, raw_html_hash string, fetched_at bigint, cleaned_text string, url string, title string")
    docs.withColumn("fetched_at", F.timestamp_seconds("fetched_at")).withColumn("status", F.lit(200)).repartition(6).write.parquet(f"{path}/documents.parquet")
    rows = "title string, raw_html_hash string, ingested_at timestamp, fetched_at timestamp, status int, lexical struct<token_count: bigint>"
    spark.createDataFrame([("Outro título", "h1", None, None, 201, None)], rows).withColumn("ingested_at", F.timestamp_seconds(F.lit(9))).write.parquet(f"{path}/crawl_summaries.parquet")
    return path


@pytest.fixture(scope="module")
def parts(spark):
    docs = analyzed(spark, rows=PAGES)
    feats = docs.select(F.col("raw_html_hash").alias("doc_id"), "url", "title", F.size("tokens").alias("token_count"), F.col("doc_id").alias("doc_ord"), "tokens")
    vectors = search.search_documents(index.document_vectors(feats, feats.columns[:-1]))
    return spark.createDataFrame(QUERIES, "query_id int, query string"), docs, search.by_document(vectors)


def plan(df):
    # The plan of the query itself: tables that are written first are scans.
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\((\w+)", plan(df))


def test_bm25_multi_query_shuffles_no_matches(spark, data):
    df = core.bm25_multi_query(spark, data)
    assert shuffled(df) == [] and df.count() > 500


def test_coverage_and_team_factor_shuffles_no_matches(spark, data):
    df = core.coverage_and_team_factor(spark, data)
    assert shuffled(df) == [] and df.count() > 500


def test_min_score_shuffles_counts(spark, data):
    df = core.min_score(spark, data)
    assert "Window" not in plan(df) and shuffled(df) == ["query_id"]
    ranked = search.batch_search(core._queries(spark, data), core._documents(spark, data), core.CONFIG, limit=2**31 - 2, min_score=3.0)
    assert sorted(df.collect()) == sorted(ranked.groupBy("query_id").agg(F.count("*").alias("kept")).collect()) != []


@pytest.mark.parametrize("name", ["search_boosted", "score_display", "search_enriched"])
def test_results_are_chosen_at_the_documents(spark, data, name):
    df = (stores.score_display if name == "score_display" else getattr(core, name))(spark, data)
    # Matches were joined to queries and documents, and ranked in slices, by shuffles of all of them.
    assert "MapInArrow" in plan(df) and "slice" not in plan(df) and set(shuffled(df)) <= {"query_id", "doc_id"}
    assert df.count() > 500


def test_scores_are_those_of_the_index_by_term(spark, parts):
    queries, docs, by_document = parts
    terms = search.query_terms(search.expanded_tokens(queries))
    expected = search.base_scores(terms, index.document_terms(docs, "raw_html_hash"), by_document.documents).select("query_id", "doc_id", F.round("base", 6).alias("base"), "terms_matched")
    got = search.batch_scores(queries, by_document)
    assert got.dtypes == expected.dtypes
    assert sorted(got.collect()) == sorted(expected.collect()) != []


def test_factors_are_those_of_columns(spark, parts):
    queries, _, by_document = parts
    words = search.expanded_tokens(queries).groupBy("query_id").agg(F.collect_list("token").alias("tokens"))
    own = queries.select("query_id", search.query_tokens(F.col("query")).alias("own"))
    pairs = search.batch_scores(queries, by_document).select("query_id", "doc_id").join(words, "query_id").join(own, "query_id").join(by_document.documents, "doc_id")
    six = lambda c: F.round(c, 6)
    expected = pairs.select("query_id", "doc_id", six(search.coverage(F.col("tokens"), F.col("title_tokens"))), six(search.coverage(F.col("tokens"), F.col("url_tokens"))), six(search.team_factor(F.col("own"), F.col("title_tokens"), F.col("url_tokens"), F.col("normalized_domain"))))
    assert sorted(map(tuple, search.batch_factors(queries, by_document).collect())) == sorted(map(tuple, expected.collect()))


def test_results_do_not_depend_on_blocks_and_slices(spark, parts, monkeypatch):
    queries, _, by_document = parts
    ask = lambda: [sorted(f(queries, by_document).collect()) for f in (search.batch_scores, search.batch_factors, lambda q, d: search.batch_search(q, d, limit=3), lambda q, d: search.reached(q, d, 2.0))]
    expected = ask()
    assert all(expected) and {r.place for r in expected[2]} == {1, 2, 3}
    monkeypatch.setattr(batch, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(batch, "CELLS", 5)
    assert ask() == expected


def test_words_are_encoded_once_for_all_slices(spark, parts, monkeypatch):
    queries, _, by_document = parts
    held = []
    search._by_block(queries, by_document, search.Config(), True, lambda d, b, k: held.append(b.value) or d.limit(0))
    documents = by_document.documents.toArrow().combine_chunks().to_batches()
    encode, calls = batch._encoded, []
    monkeypatch.setattr(batch, "_encoded", lambda *a: calls.append(a) or encode(*a))

    def scores(cells):
        monkeypatch.setattr(batch, "CELLS", cells)
        calls.clear()
        found = [(len(piece.batch), piece.boosted()) for piece in batch._slices(held[0], documents)]
        return batch.np.concatenate([x for _, x in found]).tolist(), len(found), len(calls)

    whole, narrow = scores(500_000), scores(3 * len(held[0].ids))
    assert whole[0] == narrow[0] and max(whole[0]) > 0
    # It grew with the slices, which are more the more queries a block has.
    assert whole[1:] == (1, 5) and narrow[1] > 10 and narrow[2] == 5


def test_no_queries(spark, parts):
    queries, _, by_document = parts
    for none in (queries.limit(0), queries.where("query = ''")):
        assert search.batch_scores(none, by_document).collect() == search.batch_search(none, by_document).collect() == search.reached(none, by_document, 0.0).collect() == []


def test_substrings():
    words = ["sao", "sa", "santos", "ge globo com", "a", "inter recebe o santos hoje"]
    found = batch.Substrings(words)
    for text in ("", "a", "sao", "inter recebe o santos hoje e amanha", "ge globo com", "xsantosx", "s a"):
        assert [words[i] for i in found.of(text)] == [w for w in words if w in text]


def test_rounding_is_that_of_the_jvm(spark):
    values = [0.0000005, 1.0000005, 2.6750005, 0.1234565, 0.12345649999999999, 12345.6789125, 3.0, 1 / 3, 7.0000015]
    expected = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").sort("k").select(F.round("v", 6)).collect()]
    assert (batch.millionths(batch.np.array(values)) / 1e6).tolist() == expected
