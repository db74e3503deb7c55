"""Portuguese stemming: the published Snowball algorithm on tokens without accents.

Rules that need an accented letter cannot apply to folded tokens and are left out. Spark
runs `pystem.stem` on Arrow batches; the SQL steps are a second statement of the algorithm,
by which the first is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_V, _C = "[aeiou]", "[^aeiou]"
#: A region's start is the length of what comes before it.
_REGIONS = (
    ("r1", f"length(regexp_extract({{w}}, '^.*?{_V}{_C}', 0))"),
    ("r2", f"length(regexp_extract({{w}}, '^.*?{_V}{_C}.*?{_V}{_C}', 0))"),
    (
        "rv",
        f"case when length({{w}}) < 3 then 0 when regexp_like({{w}}, '^.{_C}') then length(regexp_extract({{w}}, '^.{_C}{_C}*{_V}', 0)) "
        f"when regexp_like({{w}}, '^{_V}{_V}') then length(regexp_extract({{w}}, '^{_V}{_V}+{_C}', 0)) else 3 end",
    ),
)

# The suffixes of the published algorithm that bear no accent.
STANDARD = "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes".split()
LOGIA = "logia logias".split()
IDADE = "idade idades".split()
IVO = "iva ivo ivas ivos".split()
IRA = "ira iras".split()
VERB = """
    ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram
    eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ar er ir as adas idas ias arias erias irias
    aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis
    ados idos iamos emos aremos eremos iremos imos armos ermos irmos eu iu ou
""".split()


def _longest(word: str, suffixes: list[str]) -> str:
    """The longest of the suffixes that a word ends with: the leftmost match at its end."""
    return f"regexp_extract({word}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 0)"


def _cut(word: str, suffix: str) -> str:
    return f"substr({word}, 1, length({word}) - length({suffix}))"


def steps() -> list[dict[str, str]]:
    """The columns to add, step by step, to a table with the column token; the last adds stem."""
    all_standard = [*STANDARD, *LOGIA, "amente", "mente", *IDADE, *IVO, *IRA]
    in_list = lambda c, xs: f"{c} in (" + ", ".join(f"'{x}'" for x in xs) + ")"
    at = lambda word, suffix: f"length({word}) - length({suffix})"
    return [
        {"len_": "length(token)"},
        {name: f"coalesce(nullif({expr.format(w='token')}, 0), len_)" for name, expr in _REGIONS},
        {"s1": _longest("token", all_standard)},
        {
            "w1": "case"
            f" when {in_list('s1', STANDARD)} and {at('token', 's1')} >= r2 then {_cut('token', 's1')}"
            f" when {in_list('s1', LOGIA)} and {at('token', 's1')} >= r2 then {_cut('token', 's1')} || 'log'"
            f" when s1 = 'amente' and {at('token', 's1')} >= r1 then {_cut('token', 's1')}"
            f" when s1 in ('mente', 'idade', 'idades', 'iva', 'ivo', 'ivas', 'ivos') and {at('token', 's1')} >= r2 then {_cut('token', 's1')}"
            f" when {in_list('s1', IRA)} and {at('token', 's1')} >= rv and substr(token, length(token) - length(s1), 1) = 'e' then {_cut('token', 's1')} || 'ir'"
            " else token end"
        },
        {
            "s1b": "case when w1 = token then ''"
            " when s1 = 'amente' then regexp_extract(w1, '(ativ|iv|os|ic|ad)$', 0)"
            " when s1 = 'mente' then regexp_extract(w1, '(ante|avel|ivel)$', 0)"
            " when s1 in ('idade', 'idades') then regexp_extract(w1, '(abil|ic|iv)$', 0)"
            " when s1 in ('iva', 'ivo', 'ivas', 'ivos') then regexp_extract(w1, '(at)$', 0) else '' end"
        },
        {
            "w1b": f"case when s1b = '' then w1 when {at('w1', 's1b')} >= r2 then {_cut('w1', 's1b')}"
            " when s1b = 'ativ' and length(w1) - 2 >= r2 then substr(w1, 1, length(w1) - 2) else w1 end"
        },
        {"rv_tail": "substr(w1b, cast(rv as int) + 1)"},
        {"s2": f"case when w1b <> token then '' else {_longest('rv_tail', VERB)} end"},
        {"w2": _cut("w1b", "s2")},
        {
            "w3": "case when w2 <> token then (case when regexp_like(w2, 'ci$') and length(w2) - 1 >= rv then substr(w2, 1, length(w2) - 1) else w2 end)"
            " when regexp_like(w2, 'os$') and length(w2) - 2 >= rv then substr(w2, 1, length(w2) - 2)"
            " when regexp_like(w2, '[aio]$') and length(w2) - 1 >= rv then substr(w2, 1, length(w2) - 1) else w2 end"
        },
        {"w4": "case when regexp_like(w3, 'e$') and length(w3) - 1 >= rv then substr(w3, 1, length(w3) - 1) else w3 end"},
        {"stem": "case when w4 <> w3 and regexp_like(w4, '(gu|ci)$') and length(w4) - 1 >= rv then substr(w4, 1, length(w4) - 1) else w4 end"},
    ]


def stems(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (column token, among others) with the column stem; a null token has none."""
    from peneira.functions.pystem import stem

    columns = vocabulary.columns
    schema = T.StructType([*vocabulary.schema.fields, T.StructField("stem", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("token")
        for batch in batches:
            found = [None if t is None else stem(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*columns, "stem"])

    return vocabulary.mapInArrow(run, schema)


def duckdb_ctes(vocabulary: str) -> str:
    """The same as a chain of common table expressions, the last named stems(token, stem)."""
    out, last = [], vocabulary
    for k, step in enumerate(steps()):
        columns = ", ".join(f"{expr} as {name}" for name, expr in step.items())
        out.append(f"st{k} as (select *, {columns.replace('regexp_like', 'regexp_matches')} from {last})")
        last = f"st{k}"
    return ", ".join([*out, f"stems as (select token, stem from {last})"])
