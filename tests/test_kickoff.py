import itertools
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from peneira.operators.kickoff import best_path, clock, interpretations, join_runs, kickoff_values, normalised_kickoffs, run_matrix, step_cost, utc_text, viterbi, with_candidates

SP = "America/Sao_Paulo"


def read(whole=None, day=None, time=None, order="dmy", zone=SP):
    found = interpretations(whole, day, time, order, zone)
    return [datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for _, t in found]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"whole": "2017-12-09T22:00:00-03:00[America/Argentina/Buenos_Aires]"}, "2017-12-10T01:00:00Z"),
        ({"whole": "2017-06-13 19:30 GMT-4"}, "2017-06-13T23:30:00Z"),
        ({"whole": "20260106T000000Z"}, "2026-01-06T00:00:00Z"),
        ({"whole": "Fri, 08 Aug 2025 01:00:00 GMT"}, "2025-08-08T01:00:00Z"),
        ({"whole": "05/03/2017 20:00 BRST"}, "2017-03-05T22:00:00Z"),
        ({"whole": "1739489400"}, "2025-02-13T23:30:00Z"),
        ({"whole": "1739489400000"}, "2025-02-13T23:30:00Z"),
        ({"whole": "1739489400000000"}, "2025-02-13T23:30:00Z"),
        ({"whole": "Invalid Date", "day": "13/12/2018", "time": "após o jogo das 16h", "zone": "Europe/Lisbon"}, "2018-12-13T00:00:00Z"),
        ({"day": "5/10/25", "time": "8:30 PM", "order": "mdy", "zone": "America/New_York"}, "2025-05-11T00:30:00Z"),
        ({"day": "4 de Março de 2017", "time": "21h45"}, "2017-03-05T00:45:00Z"),
        ({"day": "Sáb., 05/08/2017", "time": "14:30 - horário de Brasília", "zone": "Europe/Lisbon"}, "2017-08-05T17:30:00Z"),
        ({"day": "12-fev-2019", "time": "às 19:30 (de Brasília)", "zone": "UTC"}, "2019-02-12T21:30:00Z"),
        ({"day": "20260124", "time": " 16h00min"}, "2026-01-24T19:00:00Z"),
        ({"day": "Mar 9, 2025", "time": "9:00 AM", "order": "mdy", "zone": "America/New_York"}, "2025-03-09T13:00:00Z"),
        ({"day": "2018-11-04", "time": "00:30"}, "2018-11-04T03:30:00Z"),  # skipped: the offset before the change
        ({"day": "17/02/2018", "time": "23:30"}, "2018-02-18T01:30:00Z"),  # repeated: the offset before the change
        ({"day": "2017-03-05T21:00:00.000-03:00", "time": "10h"}, "2017-03-06T00:00:00Z"),
        ({"day": "01/02/2020", "time": "12:00 AM"}, "2020-02-01T03:00:00Z"),
    ],
)
def test_readings(values, expected):
    assert read(**values) == [expected]


@pytest.mark.parametrize("values", [{"day": "31/02/2025", "time": "10:00"}, {"day": "00/00/0000"}, {"day": "adiado"}, {}, {"day": ""}, {"whole": "  "}, {"whole": "123"}, {"day": "rodada 12"}, {"day": "13/25/2017"}])
def test_unreadable(values):
    assert read(**values) == []


def test_all_readings_without_a_declared_order():
    assert read(day="03/04/2018", time="20:00", order=None) == ["2018-04-03T23:00:00Z", "2018-03-04T23:00:00Z"]
    assert read(day="25/04/2018", order=None) == ["2018-04-25T03:00:00Z"]
    assert clock("--:--") is None and clock("24:00")[0] == 86_400 and clock("25:00") is None and clock(None) is None


def brute(run):
    cost = lambda p: sum(step_cost(run[k][p[k]], run[k + 1][p[k + 1]]) for k in range(len(run) - 1))
    return min(cost(p) for p in itertools.product(*(range(len(c)) for c in run)))


def path_cost(run, path):
    return sum(step_cost(run[k][path[k]], run[k + 1][path[k + 1]]) for k in range(len(run) - 1))


def random_run(rng, n):
    return [[(f, rng.randrange(50)) for f in rng.sample(["dmy", "mdy", "ymd", "named"], rng.randint(1, 3))] for _ in range(n)]


def test_viterbi_is_optimal_whole_and_in_blocks():
    rng = random.Random(1)
    for _ in range(150):
        run = random_run(rng, rng.randint(1, 8))
        assert path_cost(run, best_path(run)) == brute(run)
        cuts = sorted(rng.sample(range(1, len(run)), min(len(run) - 1, rng.randint(0, 3)))) if len(run) > 1 else []
        parts = [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)])]
        ends = join_runs([(p[0], p[-1], run_matrix(p)) for p in parts])
        path = [k for p, e in zip(parts, ends) for k in best_path(p, *e)]
        assert path_cost(run, path) == brute(run)


def test_distributed_viterbi_equals_the_plain_one(spark):
    rng = random.Random(2)
    rows, runs = [], {}
    for s, n in (("hot", 120), ("b", 3), ("c", 1), (None, 7)):
        run = random_run(rng, n)
        runs[s] = run
        rows += [(s, k, [{"format": f, "epoch": t} for f, t in c]) for k, c in enumerate(run)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, seq int, candidates array<struct<format:string,epoch:bigint>>")
    got = viterbi(df, "source", ["seq"], blocks=6).collect()
    assert len(got) == len(rows)
    for s, run in runs.items():
        mine = sorted((r.seq, (r.chosen.format, r.chosen.epoch)) for r in got if r.source == s)
        assert path_cost(run, [run[k].index(c) for k, c in mine]) == path_cost(run, best_path(run))


def test_a_source_in_time_order_settles_its_dates(spark):
    days = ["03/04/2018", "05/04/2018", "25/04/2018", "02/05/2018", "04/06/2018"]
    df = spark.createDataFrame([("f", k, None, d, None, None, "UTC") for k, d in enumerate(days)], "source string, seq int, whole string, day string, time string, date_order string, zone_id string")
    chosen = viterbi(with_candidates(df, ["source", "seq"]), "source", ["seq"]).select("seq", utc_text(F.col("chosen.epoch")).alias("t")).sort("seq").collect()
    assert [r.t[:10] for r in chosen] == ["2018-04-03", "2018-04-05", "2018-04-25", "2018-05-02", "2018-06-04"]


MATCHES = "record_id bigint, feed string, kickoff_iso string, match_date string, match_time string, fetched_at timestamp_ntz, zone_id string"


def test_tables_with_nulls_and_an_unlisted_feed(spark):
    feeds = spark.createDataFrame([("a", SP, "dmy")], "feed string, zone_id string, date_order string")
    raw = spark.createDataFrame([(1, '{"scheduleTeam":{"teamAgenda":{"future":[null,{"match":{"startDate":1739489400000}}]}}}', None), (2, None, None)], "raw_id bigint, payload string, fetched_at timestamp_ntz")
    rows = [(1, "a", None, "03/04/2018", "20:00", None, "x"), (2, None, None, "25/04/2018", None, None, None), (3, "a", None, None, None, None, None)]
    found = normalised_kickoffs(kickoff_values(spark.createDataFrame(rows, MATCHES), raw, feeds))
    got = sorted(tuple(r) for r in found.select("record_table", "record_id", "event_no", utc_text(F.col("epoch"))).collect())
    assert got == [("match_records", 1, 0, "2018-04-03T23:00:00Z"), ("match_records", 2, 0, "2018-04-25T00:00:00Z"), ("raw_schedules", 1, 1, "2025-02-13T23:30:00Z")]


def test_empty_tables(spark):
    feeds = spark.createDataFrame([], "feed string, zone_id string, date_order string")
    raw = spark.createDataFrame([], "raw_id bigint, payload string, fetched_at timestamp_ntz")
    assert normalised_kickoffs(kickoff_values(spark.createDataFrame([], MATCHES), raw, feeds)).collect() == []


def test_every_record_passes_through_viterbi(spark, monkeypatch):
    from peneira.operators import kickoff

    given = []

    def spied(df, source, order_by, blocks=None):
        given.append({r.record_id: [(c.format, c.fits) for c in r.candidates] for r in df.collect()})
        return viterbi(df, source, order_by, blocks)

    monkeypatch.setattr(kickoff, "viterbi", spied)
    feeds = spark.createDataFrame([("a", SP, "dmy"), ("b", "UTC", "mdy"), ("c", "UTC", "ymd"), ("d", "UTC", None)], "feed string, zone_id string, date_order string")
    raw = spark.createDataFrame([], "raw_id bigint, payload string, fetched_at timestamp_ntz")
    rows = [(1, "a", "03/04/2018"), (2, "b", "03/04/2018"), (3, "c", "03/04/2018"), (4, "c", "18/04/03"), (5, "a", "04/25/2018"), (6, "b", "05/05/2018"), (7, "d", "03/04/2018"), (8, "a", "2018-04-03")]
    found = kickoff.normalised_kickoffs(kickoff_values(spark.createDataFrame([(i, f, None, d, None, None, None) for i, f, d in rows], MATCHES), raw, feeds))
    got = {r.record_id: r.t[:10] for r in found.select("record_id", utc_text(F.col("epoch")).alias("t")).collect()}
    assert len(given) == 1 and sorted(given[0]) == [i for i, _, _ in rows]
    assert given[0][1] == [("dmy", True), ("mdy", False)] and given[0][2] == [("mdy", True), ("dmy", False)] and given[0][5] == [("mdy", False)]
    assert given[0][6] == [("mdy", True)] and [f for f, fits in given[0][4]] == ["ymd", "dmy"]
    assert got == {1: "2018-04-03", 2: "2018-03-04", 3: "2018-03-04", 4: "2018-04-03", 6: "2018-05-05", 7: "2018-04-03", 8: "2018-04-03"}


def test_a_declared_order_outweighs_any_neighbours():
    # Read against its order, the middle record would save two switches and a jump backward.
    run = [[("mdy", 10, True)], [("dmy", 5, True), ("mdy", 20, False)], [("mdy", 30, True)]]
    assert best_path(run) == [0, 0, 0]
    assert best_path([run[0], [c[:2] for c in run[1]], run[2]]) == [0, 1, 0]
