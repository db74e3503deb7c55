import pytest
from pyspark.sql import functions as F

from peneira.config import Config, match_limit, number_list, search_limit
from peneira.functions import html, text, urls
from peneira.functions.stemmer import stems


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


def test_two_analyzers_differ_on_lone_diacritics(spark):
    v = F.col("v")
    assert one(spark, text.index_tokens(v), "Avaí^fc a·bcd É-x joão") == ["avaifc", "abcd", "joao"]
    assert one(spark, text.query_tokens(v), "Avaí^fc a·bcd É-x joão") == ["avai", "bcd", "joao"]
    assert one(spark, text.index_tokens(v), None) == [] and one(spark, text.normalized(v), None) == ""


def test_fold_composed_and_decomposed_alike(spark):
    assert one(spark, text.fold(F.col("v")), "São SÃO ÇÉ") == "sao sao ce"
    assert one(spark, text.normalized_term(F.col("v")), "   ") is None
    assert one(spark, text.normalized_term(F.col("v")), " Ãgua \n") == "agua"
    assert one(spark, text.fold(F.col("v")), None) is None


def test_lexical_summary_of_nothing(spark):
    r = spark.createDataFrame([([],)], "v array<string>").select(text.lexical_summary(F.col("v"), F.col("v")).alias("r")).first().r
    assert tuple(r) == (0, 0, 0, 0.0, 0.0)


def test_pseudo_text(spark):
    r = one(spark, text.pseudo_text(F.col("v")), [("gol", 2.4), ("bola", None), ("x", 0.0)], "v array<struct<term:string,frequency:double>>")
    assert r == "gol gol bola x"


@pytest.mark.parametrize(("token", "stem"), [("flamengo", "flameng"), ("tabela", "tabel"), ("corinthians", "corinthians"), ("rapidamente", "rapid"), ("jogando", "jog"), ("felicidade", "felic"), ("gol", "gol"), ("a", "a"), ("futebol", "futebol")])
def test_stems(spark, token, stem):
    assert stems(spark.createDataFrame([(token,)], "token string")).first().stem == stem


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://WWW.Ge.Globo.com/Futebol/?utm_source=x&b=2&a=1#topo", "https://www.ge.globo.com/Futebol?a=1&b=2"),
        ("http://a.com", "http://a.com/"),
        ("http://a.com:80/x//", "http://a.com/x"),
        ("http://a.com:8080/x", "http://a.com:8080/x"),
        ("http://a.com/?GCLID=1&fbclid=2", "http://a.com/"),
        ("http://a.com/a b", "http://a.com/a%20b"),
        ("not an address", None),
        (None, None),
    ],
)
def test_canonical(spark, url, canonical):
    got = one(spark, urls.canonical(F.col("v")), url)
    assert got == canonical
    assert canonical is None or one(spark, urls.canonical(F.col("v")), got) == got


@pytest.mark.parametrize(
    ("url", "blocked"),
    [("https://www.facebook.com/x", True), ("https://notfacebook.com/x", False), ("https://x.com/ads/1", True), ("https://x.com/A.PDF", True), ("https://contato.x/", True), ("https://x.com/noticia", False), ("mailto:a@b", True), (None, True), ("https://nba.globo.com/", True), ("https://x.com/supporters", False)],
)
def test_blocked(spark, url, blocked):
    assert one(spark, urls.is_blocked(F.col("v")), url) is blocked


@pytest.mark.parametrize(
    ("href", "full"),
    [("/a", "https://s.com/a"), ("b", "https://s.com/x/b"), ("//t.com/c", "https://t.com/c"), ("#f", "https://s.com/x/p?q=1#f"), ("?z", "https://s.com/x/p?z"), ("http://u.com", "http://u.com"), ("/é", "https://s.com/%C3%A9")],
)
def test_resolve(spark, href, full):
    assert one(spark, urls.resolve(F.lit("https://s.com/x/p?q=1"), F.col("v")), href) == full


PAGE = "<html lang='pt'><head><title> A &amp; B </title></head><body><ul><li>a</li><li>b</li></ul><script>x('</p>')</script> caf&quot;é <!-- c --><a class=k href='/l'>l</a></body></html>"


def test_html(spark):
    v = F.col("v")
    assert one(spark, html.title(v), PAGE) == "A & B" and one(spark, html.language(v), PAGE) == "pt"
    assert one(spark, html.body_text(v), PAGE) == one(spark, html.body_text_faithful(v), PAGE) == 'ab caf"é l'
    assert one(spark, html.hrefs(v), PAGE) == ["/l"]
    assert one(spark, html.body_text(v), None) is None and one(spark, html.title(v), "") is None


def test_config():
    assert number_list("160, x, 240,160,-1", (1,)) == (160, 240) and number_list("", (1,)) == (1,)
    assert Config.from_env({"INDEX_MIN_TOKEN_LENGTH": "1", "LEXICAL_TOP_TERMS": "2", "CRAWLER_STRATEGY": "DFS"}) == Config(min_token_length=2, top_terms=5, strategy="dfs")
    assert [search_limit(x) for x in (None, "", "7", "0", "abc", "12x")] == [10, 10, 7, 20, 20, 12]
    assert [match_limit(x) for x in (None, "5", "0", "abc")] == [3, 5, 1, None]


def test_python_stems_equal_the_sql_steps_and_worked_examples(spark):
    import duckdb

    from peneira.functions.pystem import stem
    from peneira.functions.stemmer import IDADE, IRA, IVO, LOGIA, STANDARD, VERB, duckdb_ctes

    ends = sorted({*STANDARD, *LOGIA, *IDADE, *IVO, *IRA, *VERB, "amente", "mente", "ativamente", "avelmente", "abilidade", "icidade", "ivas", "ativos", "os", "e", "guie", "cie", "ci", "a", ""})
    words = sorted({b + e for b in ("", "a", "be", "gol", "conc", "segu", "preced", "oeste", "aut", "rapid", "estr", "necess") for e in ends} - {""})
    values = ", ".join(f"('{w}')" for w in words)
    expected = dict(duckdb.sql(f"with v as (select * from (values {values}) as t(token)), {duckdb_ctes('v')} select token, stem from stems").fetchall())
    assert {w: stem(w) for w in words} == expected
    # Examples worked by the rules; no copy of the published sample vocabulary was at hand to compare with.
    examples = {"boa": "boa", "boate": "boat", "bobagem": "bobag", "bobagens": "bobagens", "bobalhoes": "bobalho", "quilometros": "quilometr", "quilos": "quil", "quinta": "quint", "quintal": "quintal", "quiser": "quis", "jogadores": "jogador", "jogando": "jog", "rapidamente": "rapid", "felicidade": "felic"}
    assert {w: stem(w) for w in examples} == examples
