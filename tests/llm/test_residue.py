import pytest
from pyspark.sql import functions as F

from peneira.llm.residue import has_placeholder, residue

NAV = "Início | Futebol | Notícias | Onde assistir\nMais Futebol\n"
FOOT = "\nMapa do site · Política de privacidade © gazeta-livre"
NEWS = "\nO goleiro Zivroleu defendeu o pênalti de Piuguileu e saiu carregado nos ombros. A equipe viaja de ônibus até Monte Garoa, trajeto de 86 horas pela serra. Choveu 72 milímetros em Caiapuã do Norte, e a bola parava nas poças da grande área. O regulamento da Copa das Bacias prevê prorrogação só na decisão de 15 de agosto."
DOCS = "doc_id bigint, url string, site string, title string, text string, cleaned_text string, placeholder int"


def page(i, text, title="Caiapuã vence", slug="caiapua-vence", site="s.example"):
    return (i, f"https://{site}/noticia/{slug}-{i}", site, title, text, " ".join(text.split()) if text else text, 1)


def found(spark, rows, **options):
    return {r.doc_id: r.reason for r in residue(spark.createDataFrame(rows, DOCS), **options).collect()}


@pytest.mark.parametrize(
    "text",
    ["{{mandante_slug}} vence", "Agenda do {visitante}", "<%= team %> x", "por ${autor}", "#{headline}", "$[slug]", "[[mandante]]", "%(mandante)s", "@@rodada@@", "__MANDANTE__", "TIME_HORA_PLACEHOLDER", "&lt;TIME_AQUI&gt;", "<JOGADOR> ainda", "%AUTOR_SLUG% vence", "[INSERIR TIME]", "[object Object]", "placar NaN", "Agenda do null", "equipe de undefined ainda", "{% block autor %}", "faz %s horas"],
)
def test_placeholders(spark, text):
    assert spark.createDataFrame([(text,)], "v string").select(has_placeholder(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text", ["a 50% do público", "was declared null and void by", "His role remains undefined, yet", "R$ 82", "nota [1]", "user@host.example", None, "", "x > 3 e y < 4", "Nanda e Nullo"])
def test_no_placeholders(spark, text):
    assert not spark.createDataFrame([(text,)], "v string").select(has_placeholder(F.col("v")).alias("r")).first().r


def test_messages_are_found_and_mentions_are_not(spark):
    headline = "Caiapuã vence\n"
    rows = [
        page(1, NAV + "Página não encontrada. Ela pode ter mudado de lugar." + FOOT),
        page(2, NAV + headline + "You need to enable JavaScript to run this app." + FOOT),
        page(3, NAV + headline + "Lorem ipsum dolor futeb amet consecti ludora pila et arbiter. Insira aqui a descrição do clube." + FOOT),
        page(4, NAV + headline + NEWS + " O site do clube saiu do ar e exibia erro 500 durante 20 minutos." + FOOT),
        page(5, NAV + headline + "Ative o JavaScript para ver a enquete desta matéria." + NEWS + FOOT, title="404"),
        page(6, NAV + "Conteúdo em breve.\nMais lidas: Araucema demite técnico após 9 derrotas; Embiruçu vence o líder" + FOOT, title=None),
        page(7, NAV + headline + NEWS + FOOT),
    ]
    assert found(spark, rows) == {1: "notice", 2: "notice", 3: "notice", 6: "notice"}


def test_served_to_several_pages(spark):
    unknown = NAV + "O gato subiu no telhado do servidor." + FOOT
    about = ("rodada", "mercado", "arbitragem", "estadio", "torcida")
    rows = [page(k, unknown, title="Aviso", slug=w, site=f"h{k % 2}.example") for k, w in enumerate(about)] + [page(9, NAV + "Outra frase que ninguém mais tem." + FOOT)]
    assert found(spark, rows) == dict.fromkeys(range(5), "served")
    # Two subjects are enough on two hosts, on one it takes three; one subject, however often, is no evidence.
    assert found(spark, rows[:2]) == dict.fromkeys(range(2), "served")
    assert found(spark, [rows[0], rows[2]]) == {} and len(found(spark, [rows[0], rows[2], rows[4]])) == 3
    assert found(spark, [page(k, unknown, title="Aviso", slug="rodada", site=f"h{k}.example") for k in range(6)]) == {}


def test_what_speaks_of_its_subject_is_not_served(spark):
    about = ("rodada", "mercado", "arbitragem", "estadio")
    same = "O {0} teve um dia calmo.\nTudo sobre isso amanhã cedo."
    rows = [page(k, NAV + same.format(w) + FOOT, title=None, slug=w, site=f"h{k}.example") for k, w in enumerate(about)]
    assert found(spark, rows) == {}
    # The second sentence stands on mismatched pages, too, but mostly on others.
    rows += [page(10 + k, NAV + "Tudo sobre isso amanhã cedo." + FOOT, title=None, slug=w, site=f"h{k}.example") for k, w in enumerate(("gramado", "torcida"))]
    assert found(spark, rows) == {}
    rows += [page(20 + k, NAV + "Tudo sobre isso amanhã cedo." + FOOT, title=None, slug=w, site=f"h{k}.example") for k, w in enumerate(("arquibancada", "vestiario"))]
    assert found(spark, rows) == dict.fromkeys((10, 11, 20, 21), "served")


def test_the_title_counts_only_where_it_agrees_with_the_address():
    from peneira.llm.residue import page_evidence

    body = NAV + "O pedido do leitor parou no portão.\nO portão fica na rua." + FOOT
    assert page_evidence("https://s.example/noticia/mercado-da-bola-7", "Portão", body)[1]
    assert not page_evidence("https://s.example/noticia/portao-da-bola-7", "Portão", body)[1]
    assert not page_evidence(None, "Portão", body)[1]
    assert page_evidence(None, None, None) == (False, True, page_evidence("", "", "")[2], [])


def test_a_sentence_is_searched_for_every_notice_that_it_may_be():
    import re

    from peneira.llm.residue import NOTICES, is_notice

    every = re.compile("|".join(p for _, p in NOTICES))
    said = ["pagina nao encontrada", "erro 503", "503 - servico", "at a.b(c)", 'file "x.py", line 3', "#3 /srv/x", "java.io.ioexception: x", "in /srv/a.php:118", "xxx xxxx", "teste 12 teste", "ray f5ea40e5", "voce nao e um robo", "ad blocker", "o gol saiu cedo", "... 12 more", "warning: mysql", "url nao leva", "asdf"]
    assert [is_notice(s) for s in said] == [every.search(s) is not None for s in said]


def test_nulls_empty_long_and_repeated_rows(spark):
    empty = (1, None, None, None, None, None, None)
    long = page(2, NAV + NEWS * 3000)
    bad = page(3, NAV + "Acesso negado." + FOOT)
    df = spark.createDataFrame([empty, page(4, ""), page(5, NAV + FOOT), long, bad, bad], DOCS)
    assert sorted((r.doc_id, r.reason) for r in residue(df).collect()) == [(3, "notice")]
    assert residue(df.limit(0)).collect() == []


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
TRACE = "Fatal error: Uncaught TypeError in /srv/www/app/render.php:118\n" + "".join(f"#{k} /srv/www/app/view_{k}.php({k}): View->draw()\n" for k in range(40))
UNKNOWN = "O roteador interno perdeu a rota do pedido e devolveu este aviso ao leitor, que pode anotar o horário, sair com calma e contar tudo depois ao balcão da portaria."


def test_long_filler_dumps_and_served_responses_are_found(spark):
    words = ("rodada", "mercado", "arbitragem", "estadio", "torcida")
    served = [page(k, NAV + UNKNOWN + FOOT, title=None, slug=f"sobre-{w}") for k, w in enumerate(words, 10)]
    # One report on five sites, and five reports that share their sentences, are content.
    shared = [page(k, NAV + NEWS + FOOT, site=f"h{k}.example") for k in range(20, 25)]
    mixed = [page(30 + k, NAV + " ".join(x.strip() for x in NEWS.split(".")[k:] + NEWS.split(".")[:k] if x.strip()) + FOOT, slug=f"sobre-{w}") for k, w in enumerate(words[:4])]
    rows = [page(1, NAV + "\n".join([LOREM] * 4) + FOOT), page(2, NAV + TRACE + FOOT), page(3, NAV + NEWS + "\n" + LOREM + FOOT), *served, *shared, *mixed]
    assert found(spark, rows) == {1: "notice", 2: "notice", **dict.fromkeys(range(10, 15), "served")}
