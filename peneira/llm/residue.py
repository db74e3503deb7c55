"""Pages that are template residue, filler or an error message instead of content.

Three kinds of evidence are combined, each page's own read in one pass where it is read:

* placeholders that were never filled, in the title or the cleaned text;
* mismatch: the terms of the address slug, the title and the body are compared. The
  subject is what slug and title say; where they share no term, the address decides, as a
  message brings its own title. A page whose body, beside its headline, has no term of its
  subject is mismatched: it doesn't speak of what it was asked for;
* duplication over hosts: mismatched pages that say only what other mismatched pages say,
  too, are of low information. What these share is a served response if it stands mostly
  on them, and under two subjects on two hosts, or under three. Shares and independent
  witnesses decide, not the size of the corpus or of the page. One text taken over by
  several hosts has one subject and is none.

A page of any length is residue if it has a placeholder; if it is mismatched and all its
sentences are served responses; or if a detector of notices (failures, refusals, demands
for scripts, announcements, filler) knows all that it says but for a few words. A page
with content of its own that mentions or carries a notice is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.pytext import fold
from peneira.llm.repetition import COMMON_WORDS
from peneira.session import durable

# Placeholder notations of template languages, and values that programs print as missing. Words that follow None or null in English
# prose, or come before undefined, are no missing value.
PLACEHOLDERS = (
    r"\{\{[^{}]*\}\}",
    r"\{%[^%]*%\}",
    r"<%[^%]*%>",
    r"[$#]\{[^{}]+\}",
    r"\$\[[A-Za-z_.]+\]",
    r"\[\[[^\[\]]+\]\]",
    r"\{ ?[A-Za-z_][A-Za-z0-9_.]* ?\}",
    r"%\([A-Za-z_]\w*\)[sdif]",
    r"(?<![\w%])%[sd](?!\w)",
    r"(?<!\w)%[A-Z][A-Z0-9_]+%(?!\w)",
    r"@@\w+@@",
    r"(?<!\w)__[A-Za-z](?:[^\W_]|_(?!_))*__(?!\w)",
    r"\b[A-Z0-9]+(?:_[A-Z0-9]+)*_PLACEHOLDER\b",
    r"(?:<|&lt;)[A-Z][A-Z0-9_ ]+(?:>|&gt;)",
    r"\[(?:INSERIR|INSERIR AQUI|INSERT|INSERTAR|PREENCHER|TODO)\b[^\[\]]*\]",
    r"\[object Object\]",
    r"(?<![\w\"“'])NaN(?!\w)",
    r"(?<!\w)null(?!\w)(?! (?:and void|hypothesis|result|set|string|value)\b)",
    r"(?<!\w)undefined(?!\w)" + "".join(f"(?<!{w} undefined)" for w in ("remains", "remain", "remained", "is", "are", "was", "were", "left", "still", "be")),
    r"(?<!\w)None(?!\w)(?! (?:of|are|is|was|were|has|have|had|do|does|did|can|could|will|would|should|may|might|the|in|on|at|for|to|that|who|but|too|so|other|more|less|came|went|played|scored|took|made|left|found)\b)",
)

# The labels of navigation, taglines and footers, folded.
FURNITURE = (
    "termos de uso", "todos os direitos reservados", "trabalhe conosco", "fale com a redacao", "mapa do site",
    "politica de privacidade", "futebol: siga nas redes", "futebol todo dia", "futebol de perto", "futebol brasileiro",
    "tudo de futebol", "mais futebol", "onde assistir", "futebol", "noticias", "agenda", "clubes", "tabela", "mercado",
    "videos", "inicio", "entrar", "assine", "contato", "colunas", "podcast", "palpites", "anuncie", "cookies",
)
FOOTER = (*FURNITURE[:8], "anuncie", "cookies")
TEASERS = ("mais lidas", "leia tambem", "veja tambem", "veja as mais lidas", "leia mais")


_BAR = r"[\s\ufeff|•·]*"
#: A run of labels at the start of a page; at its end with the copyright line, matched backwards; a list of other pages.
_NAVIGATION = re.compile(rf"{_BAR}(?:(?:{'|'.join(map(re.escape, FURNITURE))})(?![^\W_]){_BAR})++")
_FOOTER = re.compile(rf"{_BAR}(?:(?:(?:{'|'.join(re.escape(x[::-1]) for x in FOOTER)})(?![^\W_])|[\w.-]++ ?©){_BAR})++")
_TEASER = re.compile(rf"(?:^|[\n.!?] *)(?:{'|'.join(TEASERS)})\b[^\n]*")

# What notices say, folded. Each stands for a kind of message in Portuguese, Spanish and English, after the beginnings of words of which it
# needs one: a sentence that has none of them isn't searched for it. '#' stands for a figure of 400 to 599, '^' for the marks of a stack trace.
NOTICES = (
    # demands for scripts, cookies or a browser check
    ("java scri cook", r"(?:ative|habilite|active|habilita|activa|permita|enable|turn|requer|requires?|precisa|necesita|need|without|sem)\b[^.!?]{0,60}\b(?:javascript|scripts?|cookies)\b"),
    ("java scri cook", r"\b(?:javascript|scripts?|cookies)\b[^.!?]{0,40}\b(?:desligad|desativad|desabilitad|disabled|bloquead|required|necessari|on and reload)"),
    ("bloq adbl bloc", r"\b(?:bloqueador de anuncios|ad ?blocker)\b"),
    ("chec veri mome", r"\bchecking your browser\b|\bverificando (?:o )?seu navegador\b|\bjust a moment\b"),
    ("rob capt", r"\b(?:nao e|not|no (?:eres|es)) (?:um |a |un )?robo?t?o?\b|\bcaptcha\b"),
    ("conf", r"\b(?:ligar|ativar|habilitar) (?:o javascript )?nas configuracoes\b"),
    ("carr load carg reca", r"\bcarregando\b|\bloading\b|\bcargando\b|\brecarregue\b"),
    # failures
    ("erro http gate stat", r"\b(?:erro|error|http|gateway time-?out|status) ?\(?[45]\d\d\b"),
    ("# gate upst inte", r"\b[45]\d\d\)? ?[-–:] ?\w|\bbad gateway\b|\bgateway time-?out\b|\bupstream\b|\binternal server error\b"),
    ("enco foun exis long saiu movi remo avai leva", r"\b(?:pagina|page|noticia|materia|conteudo|link|endereco|url)\b[^.!?]{0,40}\b(?:nao encontrad|not found|nao existe|ya no existe|no longer|saiu do ar|foi movid|foi removid|removido|isn'?t available|nao leva)"),
    ("foun acha poss enco", r"\b(?:not found|nao achamos o que|nao foi possivel carregar|no se encontr)\b"),
    ("remo", r"\b(?:removido|removida) a pedido\b"),
    ("some algo fata warn stac falh conn", r"\bsomething went wrong\b|\balgo deu errado\b|\balgo salio mal\b|\bfatal error\b|\bwarning: \w+|\bstack trace\b|\bfalha interna\b|\bconnection refused\b"),
    ("temp serv", r"\b(?:temporariamente|temporarily) (?:indisponivel|unavailable)\b|\bservico indisponivel\b|\bservice unavailable\b"),
    ("requ agua", r"\bmuitas requisicoes\b|\btoo many requests\b|\baguarde \d+ segundos\b"),
    ("requ ray prot inci", r"\b(?:request|ray|protocolo|incident) ?(?:id)? ?:? ?#?[0-9a-f]{5,}"),
    ("resu tent agai avis brok back volt busc muda canc", r"\bnenhum resultado para\b|\btente (?:novamente|mais tarde)\b|\btry again\b|\bequipe ja foi avisada\b|\blink may be broken\b|\bgo back home\b|\bvolt(?:ar|e) (?:para a capa|ao comeco)\b|\buse a busca\b|\bmudado de lugar\b|\bcancelada do sistema\b"),
    ("manu main", r"\bmanutencao (?:programada|ate)\b|\bem manutencao\b|\bunder maintenance\b"),
    # refusals
    ("aces acce bloq forb", r"\b(?:acesso|access|acceso) (?:negado|denied|denegado)\b|\bendereco foi bloqueado\b|\bforbidden\b"),
    ("sess entr", r"\bsessao (?:terminou|expirou)\b|\bsession (?:has )?expired\b|\bentre de novo\b"),
    # announcements of content to come
    ("brev cons comi prox volt", r"\b(?:conteudo|pagina|materia|noticia|contenido|content) em (?:breve|construcao)\b|\bem breve\b|\bem construcao\b|\bunder construction\b|\bcoming soon\b|\bproximamente\b|\bvolte depois\b"),
    # filler
    ("lore ipsu dolo", r"\blorem\b|\bipsum\b|\bdolor sit\b"),
    ("bla xxx asdf qwer test", r"\b(?:bla )+bla\b|\bx{3,}(?: x{3,})+|\basdf\b|\bqwer(?:ty)?\b|\bteste(?: teste)+\b|\bteste \d+ teste\b"),
    ("exem test samp plac goes aqui", r"\b(?:texto|paragrafo|pagina) de (?:exemplo|teste)\b|\bsample (?:page|text)\b|\bplaceholder text\b|\byour (?:content|text) goes here\b|\b(?:vai|va) aqui\b|\baqui vai\b|\binsira aqui\b|\binserte aqui\b"),
    ("perm auto unau", r"\b(?:nao tem|sem|no tiene|don'?t have) (?:permiss|permis)|\b(?:nao autorizad|unauthorized|not authorized)"),
    # the lines of a stack trace
    ("^ trac caus more", r"^at [\w$.<>/]+ ?\(|^file \"[^\"]+\", line \d+|^#\d+ (?:/|\{main\}|\[internal)|^traceback \(most recent|^caused by: [\w.$]+|^\.\.\. \d+ more\b"),
    ("^ unca", r"\buncaught \w*(?:exception|error)\b|^(?:exception in thread .*|(?:[\w$]+\.)*\w*(?:exception|error)(?::.*|$))|\bin /[\w./-]+(?: on line |:)\d+"),
    ("subs dele publ prov repl", r"\bsubstitua este\b|\bedit or delete it\b|\btrocar antes de publicar\b|\blegenda provisoria\b|\breplace this\b"),
)
_NOTICES = tuple(re.compile(p) for _, p in NOTICES)
_NEEDED = {b: tuple(k for k, (bs, _) in enumerate(NOTICES) if b in bs.split()) for bs, _ in NOTICES for b in bs.split()}

# The words of the usual filler, of three and more letters. A sentence mostly of these is filler, too.
FILLER = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum"
).split()

_FILLER = frozenset(FILLER)
# What the subject of a page can't be told by.
_FUNCTION_WORDS = frozenset(w for _, words in COMMON_WORDS.values() for w in words.split())

#: Words beside its notices that a page may have and still say nothing: the rest of a message, a button; or a fifth of all its words.
REST_WORDS = 14
REST_SHARE = 5
#: A served response stands under so many subjects, or under one less on two hosts, and at least half of its subjects are mismatched.
SUBJECTS = 3

#: Every placeholder holds one of these; a text that holds none needs no pattern.
_TRIGGERS = ("{", "%", "<", "&lt;", "[", "@@", "__", "_PLACEHOLDER", "NaN", "null", "undefined", "None")
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))


def has_placeholder(c: Column) -> Column:
    """Whether a text holds a placeholder that was never filled. Null has none."""
    may = reduce(or_, (F.contains(c, F.lit(t)) for t in _TRIGGERS))
    return F.coalesce(F.when(may, c.rlike("|".join(PLACEHOLDERS))), F.lit(False))


def holds_placeholder(text: str | None) -> bool:
    return bool(text) and any(t in text for t in _TRIGGERS) and _PLACEHOLDER.search(text) is not None


_SENTENCE = re.compile(r"(?<=[.!?…])[ \t]+|\n")
_PLACE = re.compile(r'(file "[^"\n]+", line \d+[^\n]*)\n')
_WORD = re.compile(r"[^\W_]+")
_SLUG = re.compile(r"://[^/]+/(?:[^?#]*/)?([^/?#]+)")

def own_text(folded: str) -> str:
    """A folded text without navigation at its start, footer at its end and teasers; lines are kept."""
    if m := _NAVIGATION.match(folded):
        folded = folded[m.end() :]
    if m := _FOOTER.match(folded[::-1]):
        folded = folded[: len(folded) - m.end()]
    if any(t in folded for t in TEASERS):
        folded = _TEASER.sub("\n", folded)
    return folded


def sentences(text: str) -> list[str]:
    """The sentences and lines that a page says itself, folded."""
    folded = fold(text).replace("\r\n", "\n").replace("\r", "\n").replace("\u00a0", " ").replace("\ufeff", " ")
    own = own_text(folded)
    if 'file "' in own:
        own = _PLACE.sub(r"\1 ", own)  # a stack trace's line of code belongs to its place
    return [s for s in map(str.strip, _SENTENCE.split(own)) if s]


def _subject_terms(words: Iterable[str]) -> set[str]:
    return {w for w in words if len(w) >= 3 and w not in _FUNCTION_WORDS and not w.isdigit()}


def is_notice(s: str, words: list[str] | None = None) -> bool:
    """Whether a folded sentence is a notice or filler."""
    words = _WORD.findall(s) if words is None else words
    may: set[int] = set()
    for w in words:
        if len(w) == 3 and w[0] in "45" and w.isdigit():
            may.update(_NEEDED["#"])
        may.update(_NEEDED.get(w[:4], ()))
        may.update(_NEEDED.get(w[:3], ()))
    if s.startswith(("at ", 'file "', "#", "...")) or "in /" in s or "exception" in s or "error" in s:
        may.update(_NEEDED["^"])
    if any(_NOTICES[k].search(s) for k in may):
        return True
    own = {w for w in words if len(w) >= 3}
    return len(own) >= 3 and len(own & _FILLER) * 5 >= len(own) * 3


def _digest(words: Iterable[str], *more: str) -> int:
    """64 bits of the words, those with figures masked."""
    x = xxhash.xxh3_64_intdigest("\n".join((" ".join([w if w.isalpha() else "9" for w in words]), *more)))
    return x - 2**64 if x >= 2**63 else x


def page_evidence(url: str | None, title: str | None, text: str | None) -> tuple[bool, bool, int, list[int]]:
    """Of one page: whether notices are all that it says, whether it is mismatched, a digest of its subject, and those of its sentences but the headline."""
    in_slug = _WORD.findall(fold(m[1])) if (m := _SLUG.search(url or "")) else []
    in_title = _WORD.findall(fold(title or ""))
    slug, named = _subject_terms(in_slug), _subject_terms(in_title)
    subject = slug if slug and not slug & named else slug | named
    head = slug | named | set(in_title)
    headlines, body, speaks = [], [], False
    for s in sentences(text or ""):
        words = _WORD.findall(s)
        own = {w for w in words if len(w) >= 3}
        if len(own) >= 2 and len(own & head) * 5 >= len(own) * 3:
            headlines.append((s, words))
        else:
            body.append((len(words), s, words))
            speaks = speaks or not subject.isdisjoint(own)
    # The longest first: a page with content shows it soonest there.
    bound = max(REST_WORDS, sum(b[0] for b in body) // REST_SHARE)
    rest, notices = 0, False
    for n, s, words in sorted(body, reverse=True):
        if is_notice(s, words):
            notices = True
        else:
            rest += n
            if rest > bound:
                break
    known = rest <= bound and (notices or any(is_notice(*h) for h in headlines))
    keys = {_digest(words) for _, _, words in body}
    return known, not speaks, _digest(in_slug, title or ""), sorted(keys)


EVIDENCE = "doc_id bigint, site string, placeholder boolean, known boolean, mismatched boolean, subject bigint, keys array<bigint>"


def evidence(docs: DataFrame) -> DataFrame:
    """One row a page: doc_id, site, placeholder, known, mismatched, subject and keys, as page_evidence tells. Null columns count as empty.

    Digests have 64 bits. Runs in the scan's tasks; the rows are small and written once, as several steps read them.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), "site", "url", "title", F.coalesce("text", "cleaned_text").alias("text"), "cleaned_text")
    names = [c.split()[0] for c in EVIDENCE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placeholder, found = [], []
            for url, title, text, cleaned in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                title = title.as_py()
                filled = not (holds_placeholder(title) or holds_placeholder(cleaned.as_py()))
                placeholder.append(not filled)
                found.append(page_evidence(url.as_py(), title, text.as_py()))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(placeholder, pa.bool_()), *columns], names)

    return durable(source.mapInArrow(run, EVIDENCE))


def served_pages(pages: DataFrame, subjects: int = SUBJECTS) -> DataFrame:
    """(doc_id) of the mismatched pages all of whose sentences are served responses, by the rows of evidence.

    A sentence is shared if mismatched pages of so many subjects have it, or of one less on two hosts. A mismatched page of shared sentences alone is of
    low information. A shared sentence is a served response if it has as many subjects on such pages, and these are half of all its subjects at least.
    Counted in steps, each combined before its shuffle, so no sentence gathers in one task; pages that speak of their subject are looked up only for
    what mismatched pages share.
    """
    enough = lambda n, hosts: (n >= subjects) | ((n >= subjects - 1) & F.coalesce(hosts, F.lit(False)))
    two_hosts = F.min("low") != F.max("high")
    said = pages.select("doc_id", "site", "subject", "mismatched", F.explode("keys").alias("key"))
    lost = said.where("mismatched")
    by_subject = lost.groupBy("key", "subject").agg(F.min("site").alias("low"), F.max("site").alias("high"))
    shared = by_subject.groupBy("key").agg(F.count("*").alias("n"), two_hosts.alias("hosts")).where(enough(F.col("n"), F.col("hosts"))).select("key")
    shared = durable(shared)

    def made_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
        known = rows.join(keys.withColumn("known", F.lit(True)), "key", "left")
        return known.groupBy("doc_id").agg(F.count_if(F.col("known").isNull()).alias("own")).where("own = 0").select("doc_id")

    low = durable(made_of(lost, shared))
    flagged = said.join(shared, "key", "left_semi").join(low.withColumn("is_low", F.lit(True)), "doc_id", "left")
    where_low = lambda f: f(F.when(F.col("is_low"), F.col("site")))
    by_subject = flagged.groupBy("key", "subject").agg(F.max("is_low").alias("is_low"), where_low(F.min).alias("low"), where_low(F.max).alias("high"))
    counts = by_subject.groupBy("key").agg(F.count("*").alias("n"), F.count("is_low").alias("n_low"), two_hosts.alias("hosts"))
    served = counts.where(enough(F.col("n_low"), F.col("hosts")) & (F.col("n_low") * 2 >= F.col("n"))).select("key")
    return made_of(lost.join(low, "doc_id", "left_semi"), served)


def residue(docs: DataFrame, subjects: int = SUBJECTS) -> DataFrame:
    """(doc_id, reason) of the pages that are residue, each id once; reason is 'placeholder', 'served' or 'notice', the first that holds.

    'served': mismatched, and all that it says are served responses. 'notice': a known notice, and no more than REST_WORDS words, or a fifth of its
    words, beside such and the headline. A page that says nothing at all is neither.
    """
    pages = evidence(docs)
    other = pages.where("not placeholder")
    by_service = served_pages(other, subjects)
    found = pages.where("placeholder").select("doc_id", F.lit(0).alias("rank"))
    found = found.unionByName(by_service.select("doc_id", F.lit(1).alias("rank"))).unionByName(other.where("known").select("doc_id", F.lit(2).alias("rank")))
    reasons = F.array(*(F.lit(r) for r in ("placeholder", "served", "notice")))
    return found.groupBy("doc_id").agg(F.min("rank").alias("rank")).select("doc_id", F.get(reasons, F.col("rank")).alias("reason"))
