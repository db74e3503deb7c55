import json

from hypothesis import given
from hypothesis import strategies as st

from peneira.operators.nested import AGENDA, FIRST, WATCH, Shape, agenda_children, agenda_nodes, held, node_table, parse, shred, shred_json


def payload(future):
    return json.dumps({"x": 1, "scheduleTeam": {"teamAgenda": {"future": future}}})


def children(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "raw_id bigint, payload string")
    return sorted(tuple(r) for r in agenda_children(df).collect())


def test_kinds_places_and_labels(spark):
    event = {
        "editorialData": {"url": "u", "extra": {"deep": 1}},
        "match": {"firstContestant": {"popularName": " A ", "name": "B"}, "liveWatchSources": [{"name": "T"}, None, {}, "bare", {"name": None}]},
    }
    assert children(spark, [payload([None, event])]) == [
        (0, 1, "editorial", 0, "u"),
        (0, 1, "first_contestant", 0, " A "),
        (0, 1, "watch_source", 0, "T"),
        (0, 1, "watch_source", 2, ""),
        (0, 1, "watch_source", 4, ""),
    ]


def test_one_object_bare_string_and_json_text(spark):
    match = json.dumps({"firstContestant": "Fervedal", "liveWatchSources": json.dumps({"name": "T"})})
    one = payload({"editorialData": json.dumps({}), "match": match})
    assert children(spark, [one, json.dumps(one)]) == [
        row for k in (0, 1) for row in ((k, 0, "editorial", 0, ""), (k, 0, "first_contestant", 0, "Fervedal"), (k, 0, "watch_source", 0, "T"))
    ]


def test_nothing_from_null_cut_off_and_foreign_payloads(spark):
    good = payload([{"editorialData": {}}])
    assert children(spark, [None, "", "   ", good[:-3], good + "x", "[]", "3", "null", '{"scheduleTeam": null}', payload(None), payload("soon"), payload([[]])]) == []
    assert children(spark, ["[" * 100_000]) == []
    assert children(spark, ['{"a": NaN}']) == []


def test_empty_table_extra_columns_and_clash(spark):
    df = spark.createDataFrame([], "raw_id bigint, payload string, event_no int, dewey string")
    assert agenda_children(df).collect() == []
    try:
        shred_json(df, "payload", ["dewey"], AGENDA)
    except ValueError:
        pass
    else:
        raise AssertionError("a clash of names is refused")


def test_repeated_rows_and_long_payload(spark):
    long = payload([{"editorialData": {"url": "x" * 2_000_000}}])
    df = spark.createDataFrame([(1, long), (1, long)], "raw_id bigint, payload string")
    assert [len(r.child_label) for r in agenda_children(df).collect()] == [2_000_000] * 2


def test_parent_by_truncation(spark):
    df = spark.createDataFrame([(7, payload([{"match": {"liveWatchSources": [{"name": "a"}, {"name": "b"}]}}]))], "raw_id bigint, payload string")
    nodes = agenda_nodes(df, (WATCH,))
    rows = sorted(node_table(nodes, WATCH, ["raw_id"], {"name": "name"}).collect())
    assert [r.name for r in rows] == ["a", "b"] and len({r.parent for r in rows}) == 1
    assert all(r.node.startswith(r.parent + ".") for r in rows)


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@given(json_values)
def test_labels_lead_back_to_the_objects(value):
    """Following a label from the root reaches the object that the row describes."""
    # Strings that look like JSON text are decoded by the shredder, so the walk decodes them, too.
    for dewey, _, fields in shred(json.dumps(value), Shape()):
        at = held(parse(json.dumps(value)))
        for n in dewey:
            at = held(list(at.values())[n] if isinstance(at, dict) else at[n])
        assert [k for k, v in at.items() if not isinstance(v, (dict, list))] == [k for k, _ in fields]


def test_bare_path_of_first_contestant():
    rows = list(shred(payload([{"match": {"firstContestant": '"Quoted"'}}]), Shape((FIRST,), AGENDA.lists, AGENDA.bare)))
    assert rows[0][2] == [("popularName", "Quoted")]


def test_json_text_wrapped_any_number_of_times(spark):
    one = payload([{"match": {"firstContestant": {"popularName": "A"}}}])
    value = {"match": {"liveWatchSources": [{"name": "T"}]}}
    for _ in range(7):
        one, value = json.dumps(one), json.dumps(value)
    assert children(spark, [one, payload([value])]) == [(0, 0, "first_contestant", 0, "A"), (1, 0, "watch_source", 0, "T")]


def test_payload_nested_beyond_the_usual_parser(spark):
    deep = '{"x": ' + "[" * 200_000 + "1" + "]" * 200_000 + ', "scheduleTeam": {"teamAgenda": {"future": [null, {"editorialData": {"url": "u"}}]}}}'
    assert children(spark, [deep, deep[:-1]]) == [(0, 1, "editorial", 0, "u")]


@given(json_values, st.integers(0, 4))
def test_the_deep_parser_reads_what_the_usual_one_does(value, cut):
    from peneira.operators.nested import _deeply_parsed

    text = json.dumps(value, indent=1 if cut % 2 else None)
    text = text[: len(text) - cut]
    try:
        expected = parse(text)
    except ValueError:
        expected = ValueError
    try:
        got = _deeply_parsed(text)
    except ValueError:
        got = ValueError
    assert got == expected


def test_labels_of_large_ordinals_differ_and_sort_as_numbers(spark):
    labels = [[3], [3, 7], [3, 10], [3, 123_456], [3, 999_999], [3, 1_000_000], [3, 1_234_567], [3, 2_147_483_647], [4], [20]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "k int, dewey array<int>")
    from pyspark.sql import functions as F

    from peneira.operators.nested import label_text, parent_label

    rows = df.select("k", label_text(F.col("dewey")).alias("t"), label_text(parent_label(F.col("dewey"))).alias("p")).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.t)] == list(range(len(labels))) and len({r.t for r in rows}) == len(labels)
    assert {r.p for r in rows if len(labels[r.k]) == 2} == {next(r.t for r in rows if r.k == 0)}
