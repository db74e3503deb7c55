"""Queries of schedules, from payloads to what is shown, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peneira.config import Config
from peneira.operators import schedule
from peneira.plans.general import _EVENTS, _held, _listed
from peneira.sources.tables import table

CONFIG = Config()


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return schedule.schedule_matches(table(spark, d, "raw_schedules"), ["raw_id"], fallback_url=F.col("page_url"), config=CONFIG)


def schedule_matches(spark: SparkSession, d: str) -> DataFrame:
    """Flat matches of all payloads, whatever their form; the kickoff is in schedule_kickoffs."""
    return _matches(spark, d).select(
        "raw_id", "event_no", "home_team", "away_team", "home_logo", "away_logo", "start_date", "start_hour", "competition",
        F.array_join("broadcasters", "|").alias("broadcasters"), "venue", "city", "state", "phase", "source_url", "source_title", "source_subtitle",
    )


def schedule_kickoffs(spark: SparkSession, d: str) -> DataFrame:
    """M2: the kickoff of each flat match in epoch milliseconds, read in every written form."""
    return _matches(spark, d).select("raw_id", "event_no", "kickoff_ms")


def schedule_display(spark: SparkSession, d: str) -> DataFrame:
    """Schedules end to end, from payloads to the texts that are shown."""
    rows = schedule.enriched(_matches(spark, d), CONFIG)
    place = schedule.location_text(F.col("location_stadium"), F.col("location_city"), F.col("location_state"))
    detailed = F.array_join(F.transform("broadcasters_detailed", lambda b: F.concat_ws("@", b["name"], b["logo"])), "|")
    return rows.select(
        "home_team", "away_team", "match_date", "match_time", "kickoff_iso", "competition", F.array_join("broadcasters", "|").alias("broadcasters"),
        detailed.alias("broadcasters_detailed"), "source_url", "source_headline", "source_summary", "home_logo", place.alias("location"),
    )


def client_order(spark: SparkSession, d: str) -> DataFrame:
    """The timestamp by which a client sorts the matches that it was given, and their places for each home team (a report of four)."""
    rows = table(spark, d, "match_records").select("record_id", "home_team", schedule.client_timestamp(F.col("kickoff_iso"), F.col("match_date"), F.col("match_time")).alias("sort_ms"))
    # Two steps, as one team may hold a large part of all rows.
    order = [F.col("sort_ms").asc_nulls_last(), F.col("record_id")]
    sliced = rows.withColumn("s", F.pmod(F.xxhash64("record_id"), F.lit(64)))
    local = sliced.withColumn("n", F.row_number().over(W.partitionBy("home_team", "s").orderBy(*order))).where("n <= 4")
    return local.withColumn("place", F.row_number().over(W.partitionBy("home_team").orderBy(*order))).where("place <= 4").select("home_team", "place", "record_id", "sort_ms")


QUERIES = {f.__name__: f for f in (schedule_matches, schedule_kickoffs, schedule_display, client_order)}


def _text(x: str, key: str) -> str:
    """The scalar at a key as text; objects, lists and null are none."""
    return f"(case when json_type({x}, '$.{key}') in ('OBJECT', 'ARRAY') then null else {x}->>'$.{key}' end)"


def _below(x: str, key: str) -> str:
    return _held(f"json_extract({x}, '$.{key}')")


def _club(x: str) -> str:
    return f"(case json_type({x}) when 'VARCHAR' then nullif({x}->>'$', '') when 'OBJECT' then coalesce(nullif({_text(x, 'popularName')}, ''), nullif({_text(x, 'name')}, '')) end)"


def _logo(x: str) -> str:
    raw = f"trim(coalesce(nullif({_text(x, 'badgePng')}, ''), {_text(x, 'badgeSvg')}))"
    full = f"(case when starts_with({raw}, '//') then 'https:' || {raw} else {raw} end)"
    return f"(case when json_type({x}) = 'OBJECT' and regexp_matches({full}, '(?i)^https?://') then {full} end)"


_MATCHES = f"""{_EVENTS},
m0 as (select c.raw_id, event_no, page_url, ed, m, {_below('m', 'firstContestant')} as a, {_below('m', 'secondContestant')} as b, {_below('m', 'location')} as loc, {_below('m', 'phase')} as ph,
  {_below('m', 'transmission')} as tr, {_below('m', 'liveWatchSources')} as w from c join raw_schedules r on r.raw_id = c.raw_id where json_type(m) = 'OBJECT'),
m1 as (select *, {_below('loc', 'stadium')} as sta, {_below('loc', 'city')} as cit, {_below('loc', 'state')} as ste, {_below('ph', 'championshipEdition')} as edi, {_listed('w')} as ws from m0),
m2 as (select *, {_below('edi', 'championship')} as cha, list_transform(ws, lambda x: trim(coalesce(case when json_type({_held('x')}) = 'OBJECT' then {_text(_held('x'), 'name')} end, ''))) as names from m1),
m3 as (select *, list_filter(list_transform(names, lambda x, i: case when list_position(names, x) = i then x else '' end), lambda x: x <> '') as bs from m2),
m4 as (select raw_id, cast(event_no as int) as event_no, {_club('a')} as home_team, {_club('b')} as away_team, {_logo('a')} as home_logo, {_logo('b')} as away_logo, {_text('m', 'startDate')} as start_date,
  coalesce({_text('m', 'startHour')}, '00:00:00') as start_hour, {_text('cha', 'name')} as competition, coalesce(array_to_string(bs, '|'), '') as broadcasters,
  coalesce(nullif({_text('sta', 'name')}, ''), {_text('loc', 'popularName')}) as venue, {_text('cit', 'name')} as city, {_text('ste', 'name')} as state, {_text('ph', 'name')} as phase,
  coalesce(nullif({_text('ed', 'url')}, ''), nullif({_text('tr', 'url')}, ''), page_url, '') as source_url, {_text('ed', 'title')} as source_title, {_text('ed', 'subtitle')} as source_subtitle from m3)
"""

_INT = "try_cast(nullif(regexp_extract(coalesce(string_split(coalesce({0}, ''), '{1}')[{2}], ''), '^\\s*([+-]?[0-9]{{1,6}})', 1), '') as bigint)"
_CLIENT = f"""
with p as (select record_id, home_team, kickoff_iso, nullif({_INT.format('match_date', '/', 3)}, 0) as y, nullif({_INT.format('match_date', '/', 2)}, 0) as mo, nullif({_INT.format('match_date', '/', 1)}, 0) as d,
  coalesce({_INT.format('match_time', ':', 1)}, 0) * 60 + coalesce({_INT.format('match_time', ':', 2)}, 0) as minutes from match_records),
q as (select *, (case when coalesce(y, 0) between 0 and 99 then 1900 + coalesce(y, 0) else y end) * 12 + coalesce(mo, 1) - 1 as months from p),
s as (select record_id, home_team, case when regexp_matches(kickoff_iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then epoch_ms(try_cast(kickoff_iso as timestamptz)) end as iso_ms,
  case when months between 12 and 119999 then (date_diff('day', date '1970-01-01', make_date(months // 12, months % 12 + 1, 1)) + coalesce(d, 1) - 1) * 86400000 + minutes * 60000 end as other_ms from q),
r as (select home_team, record_id, coalesce(iso_ms, other_ms) as sort_ms, row_number() over (partition by home_team order by coalesce(iso_ms, other_ms) nulls last, record_id) as place from s)
select home_team, cast(place as int) as place, record_id, sort_ms from r where place <= 4"""

ORACLE = {
    "schedule_matches": _MATCHES + "select * from m4 where home_team is not null and away_team is not null",
    "client_order": _CLIENT,
}
