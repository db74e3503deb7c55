from hypothesis import given, settings
from hypothesis import strategies as st

from peneira.functions.pytext import words
from peneira.llm.repetition import mostly_repeated, repeated_words, repetition


def brute(text, run=5):
    w = words(text)
    seen, marked = set(), set()
    for k in range(len(w) - run + 1):
        gram = tuple(w[k : k + run])
        if gram in seen:
            marked.update(range(k, k + run))
        seen.add(gram)
    return len(w), len(marked)


texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "É", "é", "c\x00d", "_", "1,5"]), max_size=40).map(" ".join)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 7))
def test_against_brute_force(batch, run):
    total, repeated = repeated_words(batch, run)
    expected = [brute((t or "").replace("\x00", " "), run) for t in batch]
    assert list(zip(total.tolist(), repeated.tolist())) == expected


def test_table_with_null_empty_long_and_repeated_rows(spark):
    long = "palavra diferente a cada vez " + " ".join(f"w{k}" for k in range(400_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "um dois tres quatro cinco " * 3), (4, "um dois tres quatro cinco " * 3), (5, long), (6, "bla bla bla bla bla bla")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, words int")
    got = {r.doc_id: (r.words, r.repeated_words, r.repeated_share) for r in repetition(df).collect()}
    assert got == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (15, 10, 10 / 15), 5: (400_005, 0, 0.0), 6: (6, 5, 5 / 6)}
    assert sorted(r.doc_id for r in mostly_repeated(df).collect()) == [4, 4, 6]
    assert repetition(df.limit(0)).collect() == []


def test_exactly_the_least_share_counts(spark):
    # 20 words, of which a run of six is repeated: 30 %.
    text = "a b c d e f g h i j k l m n a b c d e f"
    df = spark.createDataFrame([(1, text), (2, text + " z")], "doc_id bigint, text string")
    assert [r.doc_id for r in mostly_repeated(df).collect()] == [1]


def js(p, q):
    from math import log2

    h = lambda x: -sum(v * log2(v) for v in x if v > 0)
    return h([(a + b) / 2 for a, b in zip(p, q)]) - (h(p) + h(q)) / 2


def test_divergences_against_a_plain_count():
    from peneira.llm.repetition import CLASS_SHARES, COMMON_WORDS, RECURRING, coded, divergences

    batch = ["O time venceu e o time perdeu 2 jogos, e o time venceu.", "THE 9 of and to", None, "a b a b a b", "xx" * 40]
    nearest, by_class, by_word = divergences(batch, coded(batch))
    for k, text in enumerate(batch):
        text, w = text or "", words(text)
        chars = [0] * 5
        for c in text:
            chars[1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4] += 1
        best = []
        for share, common in COMMON_WORDS.values():
            cells, seen = [0] * 4, set()
            for at, x in enumerate(w):
                recurs = at > 0 and (w[at - 1], x) in seen
                if at:
                    seen.add((w[at - 1], x))
                cells[(x not in common.split()) * 2 + (not recurs)] += 1
            reference = [share * RECURRING, share * (1 - RECURRING), (1 - share) * RECURRING, (1 - share) * (1 - RECURRING)]
            best.append(js([x / max(len(w), 1) for x in cells], reference))
        classes = [js([x / max(len(text), 1) for x in chars], q) for q in CLASS_SHARES.values()]
        both = [a + b for a, b in zip(best, classes)]
        assert abs(by_class[k] + by_word[k] - min(both)) < 1e-9 and abs(both[nearest[k]] - min(both)) < 1e-9


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("de a o que gol bola time joga e vence um dois tres".split()), min_size=1, max_size=80), max_size=5), st.integers(1, 4))
def test_the_bound_on_the_divergence_loses_nothing(batch, times):
    from peneira.llm.repetition import coded, divergences, least_divergence

    texts = [" ".join(w * times) for w in batch]
    if texts:
        c = coded(texts)
        _, by_class, by_word = divergences(texts, c)
        for share in (0.1, 0.3, 0.6, 0.9):
            over = c.repeated(5) >= c.total * share
            assert ((by_class + by_word) / 2 >= least_divergence(share))[over & (c.total > 0)].all()


def test_only_suspected_documents_are_counted(spark, monkeypatch):
    from peneira.llm import repetition as module

    plain = " ".join(f"palavra{k} de" for k in range(60))
    rows = [(1, "o gol foi bonito demais ontem " * 30), (2, plain), (3, None), (4, "curto"), (5, "um dois tres quatro cinco um dois tres quatro cinco")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in mostly_repeated(df).collect()) == [1, 5]
    got = {r.doc_id: r for r in module.document_divergence(df).collect()}
    assert got[1].suspected and got[4].suspected and got[5].suspected and not got[3].suspected
    assert got[3].language is None and got[3].word_divergence is None and got[1].language == "pt"
    # A bound that nothing reaches leaves only what is below the guard: the rows come by way of the divergence.
    monkeypatch.setattr(module, "least_divergence", lambda *a, **k: 2.0)
    assert sorted(r.doc_id for r in mostly_repeated(df).collect()) == [5]
