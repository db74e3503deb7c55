"""The queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.llm import canonical, frequency, leakage, mixture, repetition, residue
from peneira.sources.tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    occurrences = frequency.posting_occurrences(table(spark, d, "postings")).unionByName(frequency.top_term_occurrences(table(spark, d, "crawl_summaries")))
    return frequency.term_statistics(occurrences)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common."""
    return _terms(spark, d).where("verdict is not null").select("origin", "term", "verdict")


def p1_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its total frequency, pages and verdict ('' if neither)."""
    return _terms(spark, d).select("origin", "term", "total_frequency", "pages", F.coalesce("verdict", F.lit("")).alias("verdict"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are template residue, filler or messages."""
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of the documents that remain when residue is excluded."""
    docs = table(spark, d, "documents").select("doc_id", "url")
    return docs.join(p2_found(spark, d), "doc_id", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed club names with the club meant."""
    return canonical.canonical_names(table(spark, d, "match_records"), table(spark, d, "raw_schedules"), table(spark, d, "team_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each document drawn, with its copies."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, and the sources that fall short."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mostly repeat themselves."""
    return repetition.mostly_repeated(table(spark, d, "documents"))


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    found = repetition.repetition(table(spark, d, "documents"))
    return found.select("doc_id", "words", "repeated_words", F.round("repeated_share", 6).alias("repeated_share"))


def p8_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Every document's nearest language, its divergences from that language's references, and whether it is to be counted."""
    found = repetition.document_divergence(table(spark, d, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_divergence", "word_divergence")})


QUERIES = {f.__name__: f for f in (p1_found, p1_term_frequencies, p2_found, p2_kept, p5_found, p6_found, p7_mixture, p7_shares, p8_found, p8_repetition, p8_divergence)}

_TERM = "nullif(trim(replace(replace(lower(strip_accents(nfc_normalize({0}))), chr(160), ' '), chr(65279), ' '), e' \\t\\r\\n'), '')"
_TERM_CTE = f"""
with p as (
  select 'postings' as origin, {_TERM.format('term')} as term, doc_hash as record, chunk_id as part, max(term_frequency) as n
  from postings where chunk_size = 160 and doc_hash is not null group by 1, 2, 3, 4),
rows_ as (
  select raw_html_hash as record, any_value(lexical.top_terms) as tt from crawl_summaries
  where raw_html_hash is not null and lexical is not null group by 1),
e as (select record, unnest(tt) as e from rows_),
t as (select 'top_terms' as origin, {_TERM.format('e.term')} as term, record, 0 as part, sum(e.frequency) as n from e group by 1, 2, 3, 4),
u as (select * from p union all select * from t),
docs as (select 'postings' as origin, count(distinct record) as all_pages from p union all select 'top_terms', count(*) from rows_),
s as (select origin, term, cast(sum(n) as bigint) as total_frequency, count(distinct record) as pages from u where term is not null group by 1, 2),
r as (select s.*, case when total_frequency < 5 then 'rare' when pages * 5 > all_pages then 'common' else '' end as verdict from s join docs using (origin))
"""
_WORDS = r"regexp_extract_all(strip_accents(lower(nfc_normalize({0}))), '[\p{{L}}\p{{N}}]+')"
_REPETITION_CTE = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
k as (select doc_id, i, array_to_string(w[i:i+4], ' ') as gram from g),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, gram order by i) as rn from k) where rn > 1),
marked as (select doc_id, count(distinct i + o) as n from again, (select unnest(range(0, 5)) as o) group by 1),
r as (select w.doc_id, cast(len(w.w) as bigint) as words, cast(coalesce(n, 0) as bigint) as repeated_words from w left join marked using (doc_id))
"""



def _entropy(x: str) -> str:
    return f"(-list_sum(list_transform({x}, lambda v: case when v > 0 then v * log2(v) else 0.0::double end)))"


def _js(p: str, q: str) -> str:
    mean = f"list_transform(list_zip({p}, {q}), lambda z: (z[1] + z[2]) / 2)"
    return f"greatest({_entropy(mean)} - ({_entropy(p)} + {_entropy(q)}) / 2, 0.0::double)"


def _doubles(values: tuple[float, ...]) -> str:
    return "[" + ", ".join(f"{v}::double" for v in values) + "]"


# The share of words that recur is 4/5 of the share that is repeated at least; a document of 30 % is as far from the reference at least.
_LANGUAGES = ", ".join(
    f"({k}, '{name}', {share}::double, string_split('{words}', ' '), {_doubles(repetition.CLASS_SHARES[name])})" for k, (name, (share, words)) in enumerate(repetition.COMMON_WORDS.items())
)
_DIVERGENCE = f"""
with g(k, name, share, common, shares) as (values {_LANGUAGES}),
w as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
v as (select doc_id, i, x, lag(x) over (partition by doc_id order by i) as before from u),
r as (select doc_id, x, before is not null and row_number() over (partition by doc_id, before, x order by i) > 1 as recurs from v),
c as (select doc_id, k, list_contains(common, x) as c, recurs from r, g),
h as (select doc_id, k, count(*) as n, [count(*) filter (c and recurs) / count(*), count(*) filter (c and not recurs) / count(*), count(*) filter (not c and recurs) / count(*), count(*) filter (not c and not recurs) / count(*)] as cells from c group by 1, 2),
q as (select doc_id, length(text) as n, len(regexp_extract_all(text, '\\p{{L}}')) as letters, len(regexp_extract_all(text, '\\p{{Lu}}')) as capitals, len(regexp_extract_all(text, '\\p{{Nd}}')) as digits,
  len(regexp_extract_all(text, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]')) as blanks from w where text <> ''),
s as (select doc_id, [(letters - capitals) / n, capitals / n, digits / n, blanks / n, (n - letters - digits - blanks) / n] as classes from q),
j as (select h.doc_id, h.n, k, name, {_js('classes', 'shares')} as cd, {_js('cells', f'[share * {repetition.RECURRING}::double, share * (1 - {repetition.RECURRING}::double), (1 - share) * {repetition.RECURRING}::double, (1 - share) * (1 - {repetition.RECURRING}::double)]')} as wd
  from h join s using (doc_id) join g using (k)),
b as (select * from j qualify row_number() over (partition by doc_id order by cd + wd, k) = 1)
select w.doc_id, cast(len(w.w) as bigint) as words, name as language, round(cd, 6) as class_divergence, round(wd, 6) as word_divergence,
coalesce(len(w.w) > 0 and (len(w.w) < 20 or (cd + wd) / 2 >= {_js('[0.24::double, 0.76::double]', f'[{repetition.RECURRING}::double, 1 - {repetition.RECURRING}::double]')} / 2), false) as suspected from w left join b using (doc_id)"""

ORACLE = {
    "p8_divergence": _DIVERGENCE,
    "p1_found": _TERM_CTE + "select origin, term, verdict from r where verdict <> ''",
    "p1_term_frequencies": _TERM_CTE + "select origin, term, total_frequency, cast(pages as bigint) as pages, verdict from r",
    "p6_found": f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
i as (select item_id, {_WORDS.format('text')} as w from eval_items where text is not null),
dg as (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13),
ig as (select item_id, w, unnest(range(1, len(w) - 11)) as k from i where len(w) >= 13),
dk as (select doc_id, array_to_string(w[k:k+12], ' ') as gram from dg),
ik as (select item_id, array_to_string(w[k:k+12], ' ') as gram from ig)
select distinct doc_id, item_id from dk join ik using (gram)""",
    "p8_found": _REPETITION_CTE + "select doc_id from r where words > 0 and repeated_words * 10 >= words * 3",
    "p8_repetition": _REPETITION_CTE + "select doc_id, words, repeated_words, round(case when words > 0 then repeated_words::double / words else 0.0 end, 6) as repeated_share from r",
}
