from collections import defaultdict
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from peneira.plans import core

NOW = core.NOW_MS
SP = ZoneInfo("America/Sao_Paulo")

# (kickoff_iso, match_date, match_time, instant in UTC worked out by hand)
VALUES = [
    ("2025-03-05T19:00:00Z", None, None, "2025-03-05T19:00:00"),
    ("2025-03-05T19:00:00.250Z", None, None, "2025-03-05T19:00:00.250"),
    ("2025-03-06T16:00:00-03:00", None, None, "2025-03-06T19:00:00"),
    ("2025-03-07T19:00:00.000000Z", None, None, "2025-03-07T19:00:00"),
    ("20250308T190000Z", None, None, "2025-03-08T19:00:00"),
    ("1741546800", None, None, "2025-03-09T19:00:00"),
    ("1741546800000", None, None, "2025-03-09T19:00:00"),
    ("2025-03-02 16:00", None, None, "2025-03-02T19:00:00"),
    ("03/03/2025 16:00 BRT", None, None, "2025-03-03T19:00:00"),
    ("a definir", "04/03/2025", "16h", "2025-03-04T19:00:00"),
    (None, "2025-03-10", None, "2025-03-10T03:00:00"),
    ("2025-03-15T00:00:00+00:00", None, None, "2025-03-15T00:00:00"),
    ("2025-03-15T00:00:01+00:00", None, None, "2025-03-15T00:00:01"),
    ("2025-02-28T20:59:59-03:00", None, None, "2025-02-28T23:59:59"),
    ("Invalid Date", "31/02/2025", "16:00", None),
    (None, None, None, None),
]


def fixture(spark, path):
    records, millis = [], {}
    for n, (iso, day, time, utc) in enumerate(VALUES * 2):
        team = None if n == 3 else f"team {n % 3}"
        records.append((n, "f", team, day, time, iso, datetime(2025, 1, 1)))
        millis[n] = (team, None if utc is None else round(datetime.fromisoformat(utc).replace(tzinfo=UTC).timestamp() * 1000))
    schema = "record_id bigint, feed string, home_team string, match_date string, match_time string, kickoff_iso string, fetched_at timestamp"
    spark.createDataFrame(records, schema).write.parquet(f"{path}/match_records.parquet")
    spark.createDataFrame([("f", "America/Sao_Paulo", "dmy")], "feed string, zone_id string, date_order string").write.parquet(f"{path}/feed_catalog.parquet")
    spark.createDataFrame([], "raw_id bigint, fetched_at timestamp, payload string").write.parquet(f"{path}/raw_schedules.parquet")
    return millis


def test_upcoming_and_display_read_every_written_form(spark, tmp_path):
    millis = fixture(spark, tmp_path)
    by_team = defaultdict(list)
    for team, ms in millis.values():
        if team is not None and ms is not None and NOW <= ms <= NOW + 14 * 86_400_000:
            by_team[team].append(ms)
    expected = sorted((team, k + 1, ms) for team, all_ms in by_team.items() for k, ms in enumerate(sorted(all_ms)[:3]))
    got = core.upcoming_matches(spark, str(tmp_path)).collect()
    assert sorted((r.home_team, r.place, r.kickoff_ms) for r in got) == expected

    def shown(ms):
        local = None if ms is None else datetime.fromtimestamp(ms / 1000, SP)
        return ("Data a definir", "Horario a definir") if local is None else (local.strftime("%d/%m/%Y"), local.strftime("%H:%M"))

    got = core.kickoff_display(spark, str(tmp_path)).collect()
    assert {r.record_id: (r.match_date, r.match_time) for r in got} == {n: shown(ms) for n, (_, ms) in millis.items()}
