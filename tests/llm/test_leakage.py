import random

from peneira.functions.pytext import words
from peneira.llm.leakage import Patterns, leaked


def brute(text, items, n):
    w = words(text)
    grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {i for i, t in items for x in [words(t)] for k in range(len(x) - n + 1) if tuple(x[k : k + n]) in grams}


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(3, 6)
        vocabulary = "abcdef"[: rng.randint(2, 6)]
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 15)))) for i in range(5)]
        patterns = Patterns(items, n)
        for _ in range(5):
            text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
            found = patterns.find(text)
            assert len(found) == len(set(found)) and set(found) == brute(text, items, n)


ITEM = "Qual foi o Placar da decisão, segundo o árbitro que apitou em 1931: dois a zero?"


def test_spelling_nulls_and_blocks(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "curto demais"), (3, None), (4, ITEM), (5, "x")], "item_id bigint, text string")
    clean = ITEM.replace(",", " - ").replace("ã", "a").upper()
    rows = [(10, f"antes {clean} depois"), (11, " ".join(ITEM.split()[:12])), (12, None), (13, ""), (14, ITEM + " " + ITEM), (14, ITEM), (15, "z " * 300_000 + ITEM)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, item_id int")
    expected = sorted([(10, 1), (10, 4), (14, 1), (14, 4), (14, 1), (14, 4), (15, 1), (15, 4)])
    for per_block in (1_000_000, 10):
        assert sorted(map(tuple, leaked(docs, items, per_block=per_block).collect())) == expected
    assert leaked(docs.limit(0), items).collect() == [] and leaked(docs, items.limit(0)).collect() == []
