"""Queries of the general data problems: timestamps and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.operators import kickoff, nested
from peneira.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each record's kickoff as one UTC instant."""
    values = kickoff.kickoff_values(table(spark, d, "match_records"), table(spark, d, "raw_schedules"), table(spark, d, "feed_catalog"))
    return kickoff.normalised_kickoffs(values).select(*kickoff.KEYS, kickoff.utc_text(F.col("epoch")).alias("kickoff_utc"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Editorials, first contestants and watch sources of the payloads' events, each with its place."""
    return nested.agenda_children(table(spark, d, "raw_schedules"))


def p4_watch_sources(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of watch sources with Dewey labels of node and parent."""
    nodes = nested.agenda_nodes(table(spark, d, "raw_schedules"), (nested.WATCH,))
    return nested.node_table(nodes, nested.WATCH, ["raw_id", "event_no"], {"name": "name", "official_logo_url": "officialLogoUrl", "highlight_logo_url": "highlightLogoUrl"})


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_watch_sources)}


def _held(x: str) -> str:
    return f"(case when json_type({x}) = 'VARCHAR' and json_valid({x}->>'$') then cast({x}->>'$' as json) else {x} end)"


def _listed(x: str) -> str:
    return f"(case json_type({x}) when 'ARRAY' then from_json({x}, '[\"JSON\"]') when 'OBJECT' then [{x}] else [] end)"


def _key(x: str, name: str) -> str:
    return f"list_position(json_keys({x}), '{name}') - 1"


def _label(*ordinals: str) -> str:
    return " || '.' || ".join(f"chr(cast(96 + len(cast({x} as varchar)) as int)) || cast({x} as varchar)" for x in ordinals)


_EVENTS = f"""
with p as (select raw_id, cast(payload as json) as j from raw_schedules where json_valid(payload)),
p1 as (select raw_id, {_held('j')} as j from p),
s as (select raw_id, {_key('j', 'scheduleTeam')} as n0, {_held("json_extract(j, '$.scheduleTeam')")} as s from p1 where json_type(j) = 'OBJECT'),
a as (select raw_id, n0, {_key('s', 'teamAgenda')} as n1, {_held("json_extract(s, '$.teamAgenda')")} as a from s where json_type(s) = 'OBJECT'),
f as (select raw_id, n0, n1, {_key('a', 'future')} as n2, {_held("json_extract(a, '$.future')")} as f from a where json_type(a) = 'OBJECT'),
l as (select raw_id, n0, n1, n2, {_listed('f')} as l from f),
u as (select raw_id, n0, n1, n2, unnest(l) as e, generate_subscripts(l, 1) - 1 as event_no from l),
ev as (select raw_id, n0, n1, n2, event_no, {_held('e')} as e from u),
c as (select raw_id, n0, n1, n2, event_no, {_key('e', 'match')} as n4, {_held("json_extract(e, '$.editorialData')")} as ed, {_held("json_extract(e, '$.match')")} as m from ev where json_type(e) = 'OBJECT'),
k as (select raw_id, n0, n1, n2, event_no, n4, case when json_type(m) = 'OBJECT' then {_key('m', 'liveWatchSources')} end as n5, ed, {_held("json_extract(m, '$.firstContestant')")} as fc, {_held("json_extract(m, '$.liveWatchSources')")} as w from c),
wl as (select raw_id, n0, n1, n2, event_no, n4, n5, {_listed('w')} as w from k),
wu as (select raw_id, n0, n1, n2, event_no, n4, n5, unnest(w) as x, generate_subscripts(w, 1) - 1 as child_no from wl),
wx as (select raw_id, n0, n1, n2, event_no, n4, n5, child_no, {_held('x')} as x from wu)
"""

ORACLE = {
    "p4_found": _EVENTS
    + f"""select raw_id, event_no, 'editorial' as child_kind, 0 as child_no, coalesce(ed->>'$.url', '') as child_label from k where json_type(ed) = 'OBJECT'
union all select raw_id, event_no, 'first_contestant', 0, coalesce(case json_type(fc) when 'VARCHAR' then fc->>'$' else fc->>'$.popularName' end, '') from k where json_type(fc) in ('OBJECT', 'VARCHAR')
union all select raw_id, event_no, 'watch_source', child_no, coalesce(x->>'$.name', '') from wx where json_type(x) = 'OBJECT'""",
    "p4_watch_sources": _EVENTS
    + f"""select raw_id, event_no, {_label('n0', 'n1', 'n2', 'event_no', 'n4', 'n5', 'child_no')} as node, {_label('n0', 'n1', 'n2', 'event_no', 'n4', 'n5')} as parent,
x->>'$.name' as name, x->>'$.officialLogoUrl' as official_logo_url, x->>'$.highlightLogoUrl' as highlight_logo_url from wx where json_type(x) = 'OBJECT'""",
}
