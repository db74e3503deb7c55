import math
from dataclasses import replace

from pyspark.sql import functions as F

from peneira.config import Config
from peneira.operators import index, search
from peneira.plans import core
from peneira.sources import files
from peneira.streaming.incremental import index_stream, stream_postings

DOCS = "doc_id bigint, raw_html_hash string, fetched_at bigint, cleaned_text string, url string, title string"
ROWS = [
    (1, "h1", 5, "Flamengo joga hoje no Maracanã e o Flamengo vence", "https://ge.globo.com/flamengo", "Flamengo vence"),
    (2, "h1", 1, "Flamengo joga hoje no Maracanã e o Flamengo vence", "https://ge.globo.com/flamengo", "Flamengo vence"),
    (3, "h2", 2, "Agenda da semana com jogos da rodada", "https://www.x.com/agenda", None),
    (4, "h3", 3, None, "https://x.com/vazio", "Vazio"),
    (5, "h4", 4, "de e que para", "https://x.com/so-stopwords", "Stop"),
    (6, None, 4, "sem hash nenhum", "https://x.com/sem", "Sem"),
    (7, "h5", 9, "bola " * 500, "https://y.com/bola", "Bola"),
]


def analyzed(spark, config=Config(), rows=ROWS):
    docs = spark.createDataFrame(rows, DOCS)
    return index.analyzed(index.first_of_hash(docs, "raw_html_hash", "doc_id", "fetched_at"), "cleaned_text", config)


def test_first_of_each_hash_and_documents_without_tokens(spark):
    assert sorted(r.doc_id for r in analyzed(spark).collect()) == [2, 3, 7]
    assert analyzed(spark, rows=[]).count() == 0


def test_invariants_of_the_index(spark):
    config = Config(chunk_sizes=(3, 160))
    docs = analyzed(spark, config)
    posts = index.postings(docs, "raw_html_hash", config)
    stats = {r.chunk_size: r for r in index.chunk_statistics(docs, index.document_frequency(posts), config).collect()}
    assert stats[3].total_tokens == stats[160].total_tokens == sum(r.n for r in docs.select(F.size("tokens").alias("n")).collect())
    assert stats[3].vocabulary_size == stats[160].vocabulary_size
    assert stats[160].total_chunks == 2 + math.ceil(500 / 160)
    by_size = index.frequencies_by_size(index.document_terms(docs, "raw_html_hash"), config)
    assert sorted(by_size.collect()) == sorted(index.document_frequency(posts).collect())
    per_doc = posts.where("chunk_size = 3").groupBy("doc_id").agg(F.sum("term_frequency").alias("n"))
    assert {r.doc_id: r.n for r in per_doc.collect()} == {r.raw_html_hash: len(r.tokens) for r in docs.collect()}


def test_one_analysis_of_a_text_and_no_shuffle_of_tokens(spark):
    plan = index.postings(analyzed(spark), "raw_html_hash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("MapInArrow") == 1
    assert "Exchange hashpartitioning(token" not in plan and "Exchange hashpartitioning(term" not in plan


def test_hashes_of_many_rows_and_ties(spark):
    rows = [(k, "hot", 5 if k else 7, "t", "u", "x") for k in range(200)] + [(500, "x", None, "t", "u", "x"), (501, "x", 1, "t", "u", "x"), (502, None, 1, "t", "u", "x")]
    got = index.first_of_hash(spark.createDataFrame(rows, DOCS), "raw_html_hash", "doc_id", "fetched_at").collect()
    # A null time comes before all others.
    assert sorted((r.raw_html_hash, r.doc_id) for r in got) == [("hot", 1), ("x", 500)]


def test_truncation_and_totals(spark):
    config = replace(Config(), max_tokens=100)
    entries = index.index_documents(analyzed(spark, config), "raw_html_hash", config)
    total = index.index_totals(entries).first()
    assert (total.documents_indexed, total.truncated_documents) == (3, 1)
    assert {r.doc_id: r.token_count for r in entries.collect()}["h5"] == 100
    assert tuple(index.index_totals(entries.limit(0)).first()) == (0, 0, 0)


def test_top_terms_ties_by_first_place(spark):
    rows = [(1, "h", 1, "zico bola zico bola ala", "u", "t")]
    got = index.top_terms(analyzed(spark, rows=rows), "raw_html_hash").sort("rank").collect()
    assert [(r.term, r.frequency) for r in got] == [("zico", 2), ("bola", 2), ("ala", 1)]


def test_lexical_queries_count_beyond_what_the_index_keeps(spark, tmp_path):
    # 25,000 tokens fill the index; what follows still counts in terms, stems and vocabulary.
    rows = [(1, "h", 1, "bola " * 25_000 + "gol " * 30_000 + "jogadores", "https://y.com/longo", "Longo")]
    docs = analyzed(spark, rows=rows)
    assert docs.select(F.size("kept"), F.size("tokens"), "truncated").collect() == [(55_001, 25_000, True)]
    assert {r.term for r in index.postings(docs, "raw_html_hash").select("term").distinct().collect()} == {"bol"}
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = core.top_terms(spark, str(tmp_path)).sort("rank").collect()
    assert [(r.term, r.frequency, r.weight) for r in got] == [("gol", 30_000, 0.545445), ("bola", 25_000, 0.454537), ("jogadores", 1, 1.8e-05)]
    stems = {r.token: r.stem for r in core.stem_vocabulary(spark, str(tmp_path)).collect()}
    assert set(stems) == {"bola", "gol", "jogadores"}
    assert {r.stem: r.n for r in core.stem_frequencies(spark, str(tmp_path)).collect()} == {stems["gol"]: 30_000, stems["bola"]: 25_000, stems["jogadores"]: 1}


def parts(spark, size=160):
    config = Config(chunk_sizes=(size,))
    docs = analyzed(spark, config)
    feats = docs.select(F.col("raw_html_hash").alias("doc_id"), "url", "title", F.size("tokens").alias("token_count"), F.col("doc_id").alias("doc_ord"))
    return index.postings(docs, "raw_html_hash", config).select("term", "doc_id", "term_frequency"), search.search_documents(feats)


def run(spark, *queries, size=160, **options):
    posts, feats = parts(spark, size)
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    return search.search(qs, posts, feats, **options).sort("query_id", "place").collect()


def test_score_by_hand(spark):
    r = run(spark, "flamengo")[0]
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    average = (6 + 4 + 500) / 3
    n = 6
    base = idf * (2 * 2.5) / (2 + 1.5 * (0.25 + 0.75 * n / average))
    # title and address name the word: coverage, the whole query in the title, host, team word in the title, team factor.
    assert r.score == round(base * (1 + 2 + 0.7) * 1.5 * 1.3 * 1.1 * 2.2, 6)


def test_blank_unknown_and_synonym_queries(spark):
    assert run(spark, "", "   ", "xyzzy") == []
    got = run(spark, "calendario")
    assert [r.doc_id for r in got] == ["h2"] and got[0].title == "Sem titulo"


def test_score_does_not_depend_on_chunks(spark):
    a, b = (run(spark, "flamengo hoje", "bola", size=s) for s in (2, 160))
    assert [(r.doc_id, r.score) for r in a] == [(r.doc_id, r.score) for r in b]


def test_limit_and_least_score(spark):
    assert len(run(spark, "flamengo bola agenda", limit=2)) == 2
    assert run(spark, "flamengo", min_score=1e9) == []


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    source = str(tmp_path / "in")
    docs.where("doc_id in (2, 3)").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(source)
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        docs.where("doc_id not in (2, 3)").write.mode("append").parquet(source)
    # The second append has not been read yet.
    index_stream(spark.readStream.schema(docs.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = index.postings(analyzed(spark), "raw_html_hash")
    key = lambda df: sorted((r.chunk_size, r.term, r.doc_id, r.chunk_id, r.term_frequency) for r in df.collect())
    assert key(stream_postings(spark, str(tmp_path / "out"))) == key(batch)


def test_index_files(spark, tmp_path):
    docs = analyzed(spark)
    posts = index.postings(docs, "raw_html_hash")
    files.write_index(posts, index.index_documents(docs, "raw_html_hash"), index.document_frequency(posts), str(tmp_path / "i"))
    back, entries = files.read_index(spark, str(tmp_path / "i"), 240)
    assert back.count() == posts.where("chunk_size = 240").count() and entries.count() == 3
    assert '"docFrequency":1' in files.index_as_json(posts.where("term = 'bol'")).first().entry


def test_a_stored_index_is_read_by_term_and_answers_as_the_built_one(spark, tmp_path):
    config = Config(chunk_sizes=(160,))
    docs = analyzed(spark, config)
    _, feats = parts(spark)
    stored = search.store(index.document_terms(docs, "raw_html_hash"), feats, str(tmp_path / "s"))
    again = search.stored(spark, str(tmp_path / "s"))
    assert (again.known, again.average) == (stored.known, stored.average) == (3, (6 + 4 + 500) / 3)
    qs = spark.createDataFrame([(1, "flamengo hoje"), (2, "bola"), (3, ""), (4, "agenda da semana")], "query_id int, query string")
    ask = lambda **k: sorted((r.query_id, r.place, r.doc_id, r.score) for r in search.search(qs, **k).collect())
    posts, _ = parts(spark)
    assert ask(posts=again.terms, features=again.features, totals=(again.known, again.average)) == ask(posts=posts, features=feats)
    plan = search.base_scores(search.query_terms(search.expanded_tokens(qs)), again.terms, again.features)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_more_query_terms_than_a_filter_takes(spark, monkeypatch):
    expected = run(spark, "flamengo hoje", "bola")
    monkeypatch.setattr(search, "PUSHED_TERMS", 1)
    assert run(spark, "flamengo hoje", "bola") == expected


def test_rebuild_shapes(spark):
    base = '"url":"u","fetchedAt":"f","status":200'
    lines = [
        "",
        "{broken",
        '{"url":"u"}',
        f"{{{base}}}",
        f'{{{base},"hash":"a","lexicalDetail":{{"tokens":["x"],"stemmedTokens":["y","z"]}}}}',
        f'{{{base},"hash":"b","cleanedText":"bola na rede"}}',
        f'{{{base},"rawHtmlHash":"c","lexical":{{"topTerms":[{{"term":"gol","frequency":2}}]}}}}',
        '{"metadata":{"rawHtmlHash":"d","cleanedText":" texto "}}',
        f'{{{base},"hash":"e"}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = index.rebuild_sources(df)
    assert {r.source: r.records for r in index.rebuild_counters(got).collect()} == {"skipped": 4, "detail": 1, "cleanedText": 2, "topTerms": 1}
    assert {r.doc_id: (r.tokens or r.text) for r in got.collect() if r.source != "skipped"} == {"a": ["y", "z"], "b": "bola na rede", "c": "gol gol", "d": " texto "}


def test_merged_summaries(spark):
    feats = spark.createDataFrame([("a", None, "f0", None, 0), ("b", "B", "f1", 200, 7)], "doc_id string, title string, fetched_at string, status int, token_count bigint")
    rows = [("a", 1, "one", "f", 200, 5), ("a", 2, " ", None, 404, None), ("a", 3, None, "g", None, 0), (None, 9, "x", "x", 1, 1)]
    s = spark.createDataFrame(rows, "hash string, ord int, title string, fetched_at string, status int, token_count bigint")
    got = {r.doc_id: tuple(r)[1:] for r in search.merged_summaries(feats, s).collect()}
    assert got == {"a": ("one", "g", None, 5), "b": ("B", "f1", 200, 7)}
