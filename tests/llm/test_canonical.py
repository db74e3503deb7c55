import random

import pytest

from peneira.llm.canonical import UNMATCHED, canonical_names, catalog_spellings, cleaned, match_names, tokens

TEAMS = [
    ("ACM", "Araucema", "Araucema", "PR", ["Esporte Clube Araucema", "Gralha Teimosa"]),
    ("ABQ", "Atlético Boqueirinha", "Boqueirinha", "BA", ["Clube Atlético Boqueirinha", "Jangada Veloz"]),
    ("IPB", "Ipirunga-BA", "Ipirunga", "BA", ["Ipirunga Futebol Clube da Bahia"]),
    ("IPS", "Ipirunga-RS", "Ipirunga do Sul", "RS", None),
]
SCHEMA = "team_id string, name string, city string, state_code string, aliases array<string>"


def match(spark, names, threshold=0.5, teams=TEAMS):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {r.name: r.id for r in match_names(df, catalog_spellings(spark.createDataFrame(teams, SCHEMA)), threshold).collect()}


def test_damaged_and_decorated_names(spark):
    expected = {
        "Ar@ucema": "ACM", "araucema fc": "ACM", "Time do Araucema": "ACM", "Aruacema": "ACM", "Araucema [PR]": "ACM", "o Gralha Teimosa": "ACM",
        "AtlÃ©tico Boqueirinha": "ABQ", "Atl&eacute;tico Boqueirinha": "ABQ", "A. Boqueirinha": "ABQ", "Atl. Boqueirinha": "ABQ", "Boqueirinha, Atlético": "ABQ", "JANGADA VELOZ": "ABQ",
        "Ipirunga/BA": "IPB", "Ipirunga - RS": "IPS", "Ipirunga–RS": "IPS",
        "Juventus di Olmarossa": UNMATCHED, "A definir": UNMATCHED, "?": UNMATCHED, "Vencedor do jogo 5": UNMATCHED, "Ipirunga": UNMATCHED,
    }
    assert match(spark, expected) == expected


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_prefix_join_loses_no_pair(spark, threshold):
    """Against the best of all pairs by brute force."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(6, 9)))
    teams = [(f"T{k}", word(), None, None, []) for k in range(25)]
    names = {t[1] for t in teams} | {word() for _ in range(60)}
    for t in teams:
        k = rng.randrange(len(t[1]))
        names.add(t[1][:k] + t[1][k + 1 :])
    sets = {t[0]: set(tokens(cleaned(t[1]))) for t in teams}
    expected = {}
    for n in names:
        x = set(tokens(cleaned(n)))
        by = sorted(((len(x & y) / len(x | y), i) for i, y in sets.items()), reverse=True)
        ok = by[0][0] >= threshold and by[0][0] > by[1][0]
        expected[n] = by[0] if ok else (by[0][0], UNMATCHED)
    got = match(spark, names, threshold, teams)
    # Below 0.6 the longest words must be near, too: these short words are within the edits or not, so only certain cases are compared.
    sure = {n for n, (j, _) in expected.items() if j >= max(threshold, 0.6) or j < threshold}
    assert {n: got[n] for n in sure} == {n: expected[n][1] for n in sure}


def test_tables(spark):
    teams = spark.createDataFrame(TEAMS, SCHEMA)
    matches = spark.createDataFrame(
        [(1, "Araucema", "araucema", 9), (2, None, "  ", 9), (3, "TBD", "Araucema FC", 9), (3, "TBD", "Araucema FC", 9)] + [(100 + k, "Aruacema", "Araucema", 9) for k in range(50)],
        "record_id bigint, home_team string, away_team string, salt int",
    )
    raw = spark.createDataFrame([(7, '{"scheduleTeam":{"teamAgenda":{"future":{"match":{"firstContestant":"Ipirunga RS","secondContestant":{"name":"x"}}}}}}'), (8, None)], "raw_id bigint, payload string")
    got = sorted(tuple(r) for r in canonical_names(matches, raw, teams).collect())
    expected = [("away_team", 1, 0, "ACM"), *[("away_team", 3, 0, "ACM")] * 2, ("first_contestant", 7, 0, "IPS"), *[("home_team", 3, 0, UNMATCHED)] * 2, *[("home_team", 100 + k, 0, "ACM") for k in range(50)]]
    assert got == sorted(expected)
    assert canonical_names(matches.limit(0), raw.limit(0), teams).collect() == []
    assert {r.team_id for r in canonical_names(matches, raw, teams.limit(0)).collect()} == {UNMATCHED}


def test_few_candidates_and_none_lost():
    from collections import Counter

    from peneira.llm.canonical import PrefixIndex

    rng = random.Random(5)
    syllables = [a + b for a in "bcdfgjlmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 5)))
    entries = [(str(k), x, tokens(x)) for k, x in enumerate({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(4000)})]
    index = PrefixIndex(entries, Counter(t for e in entries for t in e[2]), 0.5)
    share = []
    for _, x, _ in rng.sample(entries, 40):
        k = rng.randrange(len(x) - 1)
        mine = tokens(x[:k] + x[k + 1] + x[k] + x[k + 2 :])
        near = {k for k, s in enumerate(index.sets) if len(s & set(mine)) / len(s | set(mine)) >= 0.5}
        found = set(index.candidates(mine).tolist())
        assert near <= found
        share.append(len(found) / len(entries))
    assert sum(share) / len(share) < 0.01
