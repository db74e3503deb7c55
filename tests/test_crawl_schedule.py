import json

from pyspark.sql import functions as F

from peneira.config import Config
from peneira.operators import crawl, schedule
from peneira.plans import matches
from peneira.sources import files


def test_fetch_outcome(spark):
    rows = [(200, "text/html", "ok"), (404, None, "x"), (200, "application/pdf", ""), (200, None, "<p>Erro 404</p>"), (None, None, "x"), (200, None, None)]
    df = spark.createDataFrame(rows, "status int, ct string, html string")
    assert [r.r for r in df.select(crawl.fetch_outcome(F.col("status"), F.col("ct"), F.col("html")).alias("r")).collect()] == ["ok", "status", "content_type", "soft_404", "status", "ok"]


def test_robots(spark):
    pages = spark.createDataFrame([(u,) for u in ("https://a.com/x/1", "https://a.com/x/ok", "https://a.com/y.php", "https://b.com/x/1", None)], "url string")
    rules = spark.createDataFrame([("https://a.com", "disallow", "/x/"), ("https://a.com", "allow", "/x/ok"), ("https://a.com", "disallow", "/*.php$"), ("https://a.com", "disallow", "")], "origin string, kind string, path string")
    assert {r.url: r.allowed for r in crawl.robots_allowed(pages, rules).collect()} == {"https://a.com/x/1": False, "https://a.com/x/ok": True, "https://a.com/y.php": False, "https://b.com/x/1": True, None: True}


def test_link_budget(spark):
    page = "https://s.com/p"
    body = "".join(f"<a href='/l{k}'>x</a>" for k in (1, 2, 1, 3)) + "<a href='/x.png'>i</a><a href='mailto:a@b'>m</a>"
    pages = spark.createDataFrame([(page, body, 3, 50.0), ("https://s.com/none", None, 0, None)], "url string, html string, depth int, priority double")
    links = crawl.page_links(pages, keep=("depth", "priority"))
    got = sorted((r.url, r.depth, r.priority) for r in crawl.link_tasks(links, Config(link_limit=1)).collect())
    assert got == [("https://s.com/l1", 4, 49.0), ("https://s.com/l2", 4, 48.0), ("https://s.com/l3", 4, 47.0)]
    assert crawl.link_tasks(links, Config(link_limit=1, process_all_links=False)).count() == 1
    assert crawl.link_tasks(links, Config(link_limit=0)).where("priority = 49").count() == 3


def test_enqueue_first_writer_wins_and_pop(spark):
    tasks = spark.createDataFrame([("https://a.com/1/", 0, 1.0, 2), ("https://A.com/1", 0, 9.0, 1), ("https://a.com/2", 11, 1.0, 3), ("https://a.com/3", 0, 1.0, 4), ("bad", 0, 1.0, 5)], "url string, depth int, priority double, ord int")
    known = spark.createDataFrame([("https://a.com/3",)], "url string")
    queue = crawl.enqueue(tasks, known)
    assert [(r.url, r.priority) for r in queue.collect()] == [("https://a.com/1", 9.0)]
    many = spark.createDataFrame([("a", 1.0, 1), ("b", 5.0, 2), ("c", None, 3), ("d", 5.0, 4)], "url string, priority double, ord int")
    assert ["".join(r.url for r in crawl.pop(many, 3, s).collect()) for s in ("priority", "dfs", "bfs")] == ["bda", "dcb", "abc"]


def test_levels_with_a_cycle(spark):
    u = "https://s.com/"
    links = spark.createDataFrame([(u + a, u + b) for a, b in ("ab", "bc", "ca", "ad", "dd")] + [(u + "a", None)], "page string, url string")
    seeds = spark.createDataFrame([(u + "a",), (u + "a/",)], "url string")
    assert {r.url[-1]: r.level for r in crawl.crawl_levels(seeds, links).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert crawl.crawl_levels(seeds.limit(0), links).count() == 0


def test_rate_schedule_and_metrics(spark):
    df = spark.createDataFrame([("h", k) for k in range(40)] + [("g", 1)], "host string, seq bigint")
    got = crawl.rate_schedule(df, "host", "seq", 15).groupBy("host", "second").count().collect()
    assert sorted((r.host, r.second, r["count"]) for r in got) == [("g", 0, 1), ("h", 0, 15), ("h", 1, 15), ("h", 2, 10)]
    tasks = spark.sql("select 'https://a.com/x' as url, timestamp'2025-01-01 00:00:00' as fetched_at")
    assert crawl.crawl_metrics(tasks).first().pages_per_second == 1.0
    assert crawl.source_breakdown(tasks).first().host == "a.com"


def test_frontier_snapshot(spark, tmp_path):
    q = spark.createDataFrame([("https://a.com/x/", 1.0), ("https://facebook.com/", 1.0)], "url string, priority double")
    crawl.snapshot(q, q.select("url"), str(tmp_path))
    queue, visited = crawl.restored(spark.read.parquet(f"{tmp_path}/queue"), spark.read.parquet(f"{tmp_path}/visited"))
    assert [r.url for r in queue.collect()] == [r.url for r in visited.collect()] == ["https://a.com/x"]


PAYLOAD = """{scheduleTeam:{teamAgenda:{future:[
{editorialData:{url:'',title:'T'},match:{firstContestant:{popularName:'',name:'A',badgePng:'//l/a.png'},secondContestant:{popularName:'B'},startDate:'2025-03-09',startHour:'16:00:00',
liveWatchSources:[{name:' TV '},{name:'TV'},{name:''}],transmission:{url:'https://t'},location:{popularName:'P',stadium:{name:''}}}},
{match:{firstContestant:{name:'A'}}},{editorialData:{}}]}}}"""


def test_schedule_page(spark):
    page = f"<script>window.dataSportsSchedule = {PAYLOAD};\n</script>"
    df = spark.createDataFrame([("x", page), ("y", "none"), ("z", None)], "team string, html string").withColumn("payload", schedule.embedded_block(F.col("html")))
    rows = schedule.schedule_matches(df, ["team"], fallback_url=F.lit("https://f"))
    (r,) = rows.collect()
    assert (r.home_team, r.away_team, r.home_logo, r.broadcasters, r.venue, r.source_url, r.kickoff_ms) == ("A", "B", "https://l/a.png", ["TV"], "P", "https://t", 1741546800000)
    shown = schedule.enriched(rows).first()
    assert (shown.match_date, shown.match_time, shown.kickoff_iso, shown.competition) == ("09/03/2025", "16:00", "2025-03-09T19:00:00.000Z", "Competicao nao informada")


def test_schedule_matches_of_irregular_payloads(spark, tmp_path):
    one = {"match": {"firstContestant": "A", "secondContestant": {"name": "B"}, "startDate": "2025-03-09", "startHour": "16:00", "liveWatchSources": {"name": "TV"}}}
    two = {"match": json.dumps({"firstContestant": {"popularName": "C"}, "secondContestant": json.dumps({"popularName": "D"}), "location": "x"})}
    agenda = lambda future: json.dumps({"scheduleTeam": {"teamAgenda": {"future": future}}})
    payloads = [
        agenda(one),
        agenda([None, two, one, {"match": {"firstContestant": "A"}}, {}, 7]),
        json.dumps({"scheduleTeam": agenda(two)[len('{"scheduleTeam": ') : -1]}),
        agenda([one])[:-9],
        None,
        "{scheduleTeam:{teamAgenda:{future:{match:{firstContestant:'It\\'s \"E\"',secondContestant:{name:'F'}}}}}}",
    ]
    rows = [(n, f"p{n}", p) for n, p in enumerate(payloads)]
    spark.createDataFrame(rows, "raw_id bigint, page_url string, payload string").write.parquet(f"{tmp_path}/raw_schedules.parquet")
    got = matches.schedule_matches(spark, str(tmp_path)).collect()
    assert sorted((r.raw_id, r.event_no, r.home_team, r.away_team, r.broadcasters, r.source_url) for r in got) == [
        (0, 0, "A", "B", "TV", "p0"),
        (1, 1, "C", "D", "", "p1"),
        (1, 2, "A", "B", "TV", "p1"),
        (2, 0, "C", "D", "", "p2"),
        (5, 0, 'It\'s "E"', "F", "", "p5"),
    ]


def test_upcoming_bounds_are_included(spark):
    day = 86_400_000
    df = spark.createDataFrame([("t", k) for k in (-1, 0, 5, 5, 14 * day, 14 * day + 1)] + [("u", 3), (None, None)], "team string, ms bigint")
    got = schedule.upcoming(df, "team", "ms", 0, 10).collect()
    assert sorted((r.team, r.place, r.ms) for r in got) == [("t", 1, 0), ("t", 2, 5), ("t", 3, 5), ("t", 4, 14 * day), ("u", 1, 3)]
    assert schedule.upcoming(df, "team", "ms", 0, None).count() == 0


def test_team_names(spark):
    names = spark.createDataFrame([("Mengão",), ("zzzzzz",), (None,), ("Mengão",)], "name string")
    assert sorted((str(r.name), r.team_id) for r in schedule.team_ids(names).collect()) == [("Mengão", "FLA"), ("Mengão", "FLA"), ("None", None), ("zzzzzz", None)]


def test_seeds_and_csv(spark, tmp_path):
    nested = '{"a": {"b": [" https://x ", 3, "", {"c": ["no"]}]}, "d": "no"}'
    assert files.seeds(nested) == ["https://x"] and files.seeds('["top"]') == [] and files.seeds("broken") == []
    assert files.seeds(None, "a, b,,a") == ["a", "b"] and files.seeds(folder_texts=[nested, nested]) == ["https://x"]
    path = str(tmp_path / "m.csv")
    open(path, "w").write("A,B,09/03/2025,16:00,2025-03-09T19:00:00Z,C,TV|Rádio,u\nA,B,,,,,,u\n")
    assert [r.broadcasters for r in files.read_matches_csv(spark, path).collect()] == [["TV", "Rádio"], []]
    players = spark.createDataFrame([('O "Rei"', "ata", "t", "u")], files.PLAYERS)
    files.append_csv(players, str(tmp_path / "p"))
    files.append_csv(players, str(tmp_path / "p"))
    assert [r.name for r in files.read_csv(spark, str(tmp_path / "p"), files.PLAYERS).collect()] == ['O "Rei"'] * 2
    assert files.read_metrics(spark, str(tmp_path / "none")) is None


def test_summaries_file(spark, tmp_path):
    path = str(tmp_path / "d.jsonl")
    open(path, "w").write('{"hash":"a","url":"u"}\n\n{broken\n{"url":"no hash"}\n')
    assert [r.hash for r in files.read_summaries(spark, path).collect()] == ["a"]


def test_a_crawl_ends_for_one_of_three_reasons(spark):
    links = spark.createDataFrame([(f"https://s.com/{k}", f"https://s.com/{j}") for k in range(1, 20) for j in (2 * k, 2 * k + 1)], "page string, url string")
    seeds = spark.createDataFrame([("https://s.com/1",), ("https://s.com/1/",), (None,)], "url string")
    ticks = iter(range(100))
    for config, seconds, reason, pages in ((Config(), 0, "frontier_empty", 39), (Config(max_pages=10), 0, "max_pages", 10), (Config(max_pages=15), 0, "max_pages", 15), (Config(max_depth=2), 0, "frontier_empty", 7), (Config(), 3, "runtime_limit", 3)):
        found, why = crawl.crawl_run(seeds, links, config, seconds, lambda: next(ticks))
        assert (why, found.count()) == (reason, pages), (why, reason)
    assert crawl.crawl_run(seeds.limit(0), links)[1] == "frontier_empty"


def test_schedule_kickoffs_are_those_of_the_kickoff_operator(spark, tmp_path):
    from peneira.operators import kickoff

    days = [("2025-03-09", "16:00"), ("09/03/2025", "16h"), ("9 de março de 2025", None), ("1741546800000", "x"), ("31/02/2025", "10:00"), (None, "10:00"), ("2018-11-04", "00:30"), ("10/12/25 20:00 BRST", "09:00")]
    future = [{"match": {"firstContestant": "A", "secondContestant": "B", "startDate": a, "startHour": b}} for a, b in days]
    raw = spark.createDataFrame([(1, "p", json.dumps({"scheduleTeam": {"teamAgenda": {"future": future}}}), None)], "raw_id bigint, page_url string, payload string, fetched_at timestamp_ntz")
    raw.write.parquet(f"{tmp_path}/raw_schedules.parquet")
    feeds = spark.createDataFrame([], "feed string, zone_id string, date_order string")
    records = spark.createDataFrame([], "record_id bigint, feed string, kickoff_iso string, match_date string, match_time string, fetched_at timestamp_ntz")
    expected = {r.event_no: r.epoch * 1000 for r in kickoff.normalised_kickoffs(kickoff.kickoff_values(records, raw, feeds)).collect()}
    got = {r.event_no: r.kickoff_ms for r in matches.schedule_kickoffs(spark, str(tmp_path)).collect()}
    assert got == {k: expected.get(k, schedule.UNKNOWN) for k in range(len(days))} and len(expected) == 6
    shown = matches.schedule_display(spark, str(tmp_path)).collect()
    assert [(r.match_date, r.match_time) for r in shown[:3]] == [("09/03/2025", "16:00"), ("09/03/2025", "16:00"), ("09/03/2025", "00:00")] and shown[4].match_date == "Data a definir"


def test_client_timestamps(spark):
    rows = [("2025-03-09T16:00-03:00", "x", "x", 1741546800000), ("2025-03-09T19:00:00.250Z", None, None, 1741546800250), ("", "09/03/2025", "16:30", 1741537800000), (None, "31/02/2025", "25:00", 1741050000000), ("a definir", "Data a definir", "Horario a definir", -2208988800000), (None, None, None, -2208988800000), (None, "1/13/25", "7h", -1388509200000)]
    df = spark.createDataFrame([r[:3] for r in rows], "i string, d string, h string")
    assert [r.t for r in df.select(schedule.client_timestamp(F.col("i"), F.col("d"), F.col("h")).alias("t")).collect()] == [r[3] for r in rows]


def test_scores_are_rounded_by_their_exact_value(spark):
    from peneira.operators.search import score_text

    df = spark.createDataFrame([(10.24705,), (0.03125,), (2.0,), (None,)], "v double")
    assert [r.t for r in df.select(score_text(F.col("v")).alias("t")).collect()] == ["10.2470", "0.0313", "2.0000", None]


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'say "x"', "c,d", "e")], "name string, position string, team string, sourceUrl string")
    for _ in range(2):
        files.append_csv(df, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", files.PLAYERS).collect() == df.collect() * 2
