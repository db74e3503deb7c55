"""Schedules: pages with an embedded block, flat matches, the upcoming ones, and how they are shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peneira.config import Config
from peneira.dims import LOGOS, SCHEDULE_TEAMS, SLUG_OVERRIDES, TEAMS, frame
from peneira.functions.pytext import fold as plain_fold
from peneira.functions.text import fold
from peneira.operators.kickoff import interpretations
from peneira.operators.nested import AGENDA, fitted_json

#: An unknown kickoff, after all known ones.
UNKNOWN = 9_007_199_254_740_991

PAYLOAD = """struct<scheduleTeam:struct<teamAgenda:struct<future:array<struct<
editorialData:struct<url:string,title:string,subtitle:string>,
match:struct<firstContestant:struct<popularName:string,name:string,badgePng:string,badgeSvg:string>,
secondContestant:struct<popularName:string,name:string,badgePng:string,badgeSvg:string>,
startDate:string,startHour:string,
liveWatchSources:array<struct<name:string,officialLogoUrl:string,highlightLogoUrl:string>>,
transmission:struct<url:string,broadcastStatus:struct<label:string>>,
location:struct<popularName:string,stadium:struct<name:string>,city:struct<name:string>,state:struct<name:string>>,
phase:struct<name:string,championshipEdition:struct<championship:struct<name:string>>>>>>>>>""".replace("\n", "")


def text_or_null(c: Column) -> Column:
    """Null for the empty text, as falsy values are passed over."""
    return F.nullif(c, F.lit(""))


def embedded_block(html: Column) -> Column:
    """The data block of a schedule page's script, as text; null if there is none. Never run as code."""
    return F.nullif(F.regexp_extract(html, r"window\.dataSportsSchedule\s*=\s*(\{[\s\S]*?\});", 1), F.lit(""))


def parsed_payloads(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The kept columns and `parsed`, a payload as a struct, whatever its form: a single object in place of a list, bare contestants, JSON text
    inside, unquoted names and single quotes are read. Runs in the scan's tasks, without a shuffle."""
    kind = payloads.sparkSession.range(0).select(F.from_json(F.lit(None).cast("string"), PAYLOAD).alias("p")).schema["p"].dataType
    return fitted_json(payloads, column, keep, kind, AGENDA, "parsed")


def logo_url(c: Column) -> Column:
    """A trimmed http or https address, // completed to https; else null."""
    t = F.trim(c)
    full = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    return F.when(full.rlike("(?i)^https?://"), full)


def contestant(c: Column) -> Column:
    """popularName, else name; empty ones passed over."""
    return F.coalesce(text_or_null(c["popularName"]), text_or_null(c["name"]))


def kickoff_millis(day: Column, hour: Column, zone: str, order: str = "dmy") -> Column:
    """Epoch milliseconds of a date and an hour in any written form (midnight if the hour is missing); UNKNOWN where they cannot be read.

    Read as `kickoff` reads them: the order is declared, so the reading that fits it is the one that its search would choose.
    """

    @F.pandas_udf("bigint")
    def read(days: pd.Series, hours: pd.Series) -> pd.Series:
        found = (interpretations(None, d, h, order, zone) for d, h in zip(days, hours, strict=True))
        return pd.Series([f[0][1] * 1000 if f else UNKNOWN for f in found], dtype="int64")

    return read(day, hour)


def broadcasters(sources: Column) -> Column:
    """Trimmed names that aren't empty, each once, in order."""
    names = F.transform(F.coalesce(sources, F.array().cast("array<struct<name:string,officialLogoUrl:string,highlightLogoUrl:string>>")), lambda s: F.trim(F.coalesce(s["name"], F.lit(""))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def schedule_matches(payloads: DataFrame, keep: list[str], payload: str = "payload", fallback_url: Column | None = None, config: Config = Config()) -> DataFrame:
    """Flat matches of all payloads, well-formed or not; events without a match or without either name are left out."""
    paged = payloads.withColumn("__page", fallback_url if fallback_url is not None else F.lit(""))
    parsed = parsed_payloads(paged, payload, [*keep, "__page"])
    events = parsed.select(*keep, "__page", F.posexplode("parsed.scheduleTeam.teamAgenda.future").alias("event_no", "e"))
    m, ed = F.col("e.match"), F.col("e.editorialData")
    entries = F.transform(m["liveWatchSources"], lambda s: F.struct(F.trim(F.coalesce(s["name"], F.lit(""))).alias("name"), logo_url(F.coalesce(text_or_null(s["officialLogoUrl"]), s["highlightLogoUrl"])).alias("logo")))
    rows = events.where(m.isNotNull()).select(
        *keep,
        "event_no",
        contestant(m["firstContestant"]).alias("home_team"),
        contestant(m["secondContestant"]).alias("away_team"),
        logo_url(F.coalesce(text_or_null(m["firstContestant"]["badgePng"]), m["firstContestant"]["badgeSvg"])).alias("home_logo"),
        logo_url(F.coalesce(text_or_null(m["secondContestant"]["badgePng"]), m["secondContestant"]["badgeSvg"])).alias("away_logo"),
        m["startDate"].alias("start_date"),
        F.coalesce(m["startHour"], F.lit("00:00:00")).alias("start_hour"),
        m["phase"]["championshipEdition"]["championship"]["name"].alias("competition"),
        broadcasters(m["liveWatchSources"]).alias("broadcasters"),
        F.filter(entries, lambda x: x["name"] != "").alias("broadcaster_entries"),
        F.coalesce(text_or_null(m["location"]["stadium"]["name"]), m["location"]["popularName"]).alias("venue"),
        m["location"]["city"]["name"].alias("city"),
        m["location"]["state"]["name"].alias("state"),
        m["phase"]["name"].alias("phase"),
        F.coalesce(text_or_null(ed["url"]), text_or_null(m["transmission"]["url"]), F.col("__page")).alias("source_url"),
        ed["title"].alias("source_title"),
        ed["subtitle"].alias("source_subtitle"),
        kickoff_millis(m["startDate"], m["startHour"], config.time_zone).alias("kickoff_ms"),
    )
    return rows.where("home_team is not null and away_team is not null")


def upcoming(matches: DataFrame, team: str, kickoff_ms: str, now_ms: int, limit: int | None = 3, days: int = 14) -> DataFrame:
    """Each team's next matches from now to the end of the window, both included, soonest first; no row if limit is None.

    The window filter is pushed to the scan and bounds what a team can have before it is ranked.
    """
    if limit is None:
        return matches.limit(0).withColumn("place", F.lit(1))
    within = matches.where(F.col(kickoff_ms).between(now_ms, now_ms + days * 86_400_000))
    tie = F.xxhash64(*[F.col(c).cast("string") for c in matches.columns])
    order = [F.col(kickoff_ms), tie]
    sliced = within.withColumn("__s", F.pmod(tie, F.lit(32)))
    local = sliced.withColumn("__n", F.row_number().over(W.partitionBy(team, "__s").orderBy(*order))).where(F.col("__n") <= max(1, limit))
    return local.withColumn("place", F.row_number().over(W.partitionBy(team).orderBy(*order))).where(F.col("place") <= max(1, limit)).drop("__s", "__n")


def displayed(kickoff_ms: Column, zone: str) -> tuple[Column, Column, Column]:
    """(date dd/MM/yyyy, time HH:mm, ISO in UTC) of a kickoff; the texts for an unknown one."""
    known = kickoff_ms.isNotNull() & (kickoff_ms != UNKNOWN)
    utc = F.timestamp_millis(kickoff_ms)
    local = F.from_utc_timestamp(utc, zone)
    iso = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return (
        F.when(known, F.date_format(local, "dd/MM/yyyy")).otherwise("Data a definir"),
        F.when(known, F.date_format(local, "HH:mm")).otherwise("Horario a definir"),
        F.when(known, iso).otherwise(""),
    )


def enriched(matches: DataFrame, config: Config = Config()) -> DataFrame:
    """Matches as they are shown, with defaults where something is missing."""
    day, hour, iso = displayed(F.col("kickoff_ms"), config.time_zone)
    named = F.transform("broadcasters", lambda b: F.struct(b.alias("name"), F.lit(None).cast("string").alias("logo")))
    return matches.select(
        "home_team",
        "away_team",
        day.alias("match_date"),
        hour.alias("match_time"),
        iso.alias("kickoff_iso"),
        F.coalesce("competition", F.lit("Competicao nao informada")).alias("competition"),
        F.when(F.size("broadcasters") > 0, F.col("broadcasters")).otherwise(F.array(F.lit("Nao informado"))).alias("broadcasters"),
        F.when(F.size("broadcaster_entries") > 0, F.col("broadcaster_entries")).otherwise(named).alias("broadcasters_detailed"),
        "source_url",
        F.col("source_title").alias("source_headline"),
        F.col("source_subtitle").alias("source_summary"),
        "home_logo",
        "away_logo",
        F.col("city").alias("location_city"),
        F.col("state").alias("location_state"),
        F.col("venue").alias("location_stadium"),
    )


def client_timestamp(iso: Column, day: Column, hour: Column) -> Column:
    """Epoch milliseconds by which a client sorts matches: an ISO instant with zone, else dd/mm/yyyy and hh:mm as UTC; missing parts are the year 1900, January, the first, and 0.

    Parts are the whole numbers with which they begin; months, days and times beyond their range run over.
    """
    known = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})\z")
    part = lambda c, sep, k: F.nullif(F.regexp_extract(F.get(F.split(F.coalesce(c, F.lit("")), sep), F.lit(k)), r"^\s*([+-]?\d{1,6})", 1), F.lit("")).cast("bigint")
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit(0)), F.lit(other)).cast("bigint")
    y, mo, d = or_else(part(day, "/", 2), 0), or_else(part(day, "/", 1), 1), or_else(part(day, "/", 0), 1)
    y = F.when(y.between(0, 99), y + 1900).otherwise(y)
    months = y * 12 + mo - 1
    first = F.unix_date(F.try_make_timestamp(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    minutes = or_else(part(hour, ":", 0), 0) * 60 + or_else(part(hour, ":", 1), 0)
    return F.coalesce(F.when(known, F.unix_millis(F.try_to_timestamp(F.regexp_replace(iso, "^(.{16})(?=[Z+-])", "$1:00")))), ((first + d - 1) * 1440 + minutes) * 60_000)


def location_text(stadium: Column, city: Column, state: Column) -> Column:
    """'stadium • city - state' of what isn't blank; a default if nothing is left."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    place = F.nullif(F.concat_ws(" - ", blank(city), blank(state)), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" • ", blank(stadium), place), F.lit("")), F.lit("Local a definir"))


# Teams --------------------------------------------------------------------------------------------


def team_slug(name: Column) -> Column:
    """A team's slug: an override, or its folded name with dashes; null if nothing is left."""
    plain = F.trim(F.regexp_replace(fold(name), "[^a-z0-9]+", " "))
    override = F.coalesce(*(F.when(plain == k, v) for k, v in SLUG_OVERRIDES.items()))
    return F.coalesce(override, F.nullif(F.regexp_replace(plain, " ", "-"), F.lit("")))


def team_logo(spark: SparkSession, names: DataFrame, column: str = "name") -> DataFrame:
    """names with slug and logo, the file of a team's logo, or null."""
    logos = frame(spark, list(LOGOS.items()), "slug string, logo string")
    slug = F.regexp_replace(F.trim(F.regexp_replace(fold(F.col(column)), "[^a-z0-9]+", " ")), " ", "-")
    return names.withColumn("slug", slug).join(logos, "slug", "left").select(*names.columns, "slug", "logo")


def team_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """names with team_id: of an equal alias, else of the first that contains the name or is contained in it; null if none.

    The fixed list is a constant of the expression, in order of precedence, so nothing is joined.
    """
    aliases = [(team, plain_fold(a)) for team, name, more in TEAMS for a in (name, *more)]
    listed = F.array(*(F.struct(F.lit(t).alias("team_id"), F.lit(a).alias("alias")) for t, a in aliases))
    rows = names.withColumn("__plain", fold(F.trim(F.col(column)))).withColumn("__all", listed)
    equal = F.filter("__all", lambda a: a["alias"] == F.col("__plain"))
    part = F.filter("__all", lambda a: F.contains(F.col("__plain"), a["alias"]) | F.contains(a["alias"], F.col("__plain")))
    return rows.select(*names.columns, F.coalesce(F.get(equal, F.lit(0))["team_id"], F.get(part, F.lit(0))["team_id"]).alias("team_id"))


def team_list(spark: SparkSession) -> DataFrame:
    """The schedule service's teams, sorted."""
    return frame(spark, [(t,) for t in SCHEDULE_TEAMS], "team string").orderBy("team")


# Dates in Portuguese ------------------------------------------------------------------------------

# The months.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def ptbr_instant(text: Column, default_year: int, zone: str = Config.time_zone) -> Column:
    """A date and time in Portuguese as a UTC timestamp; null if it cannot be read.

    Read in this order: ISO with or without zone, dd/mm[/yyyy] hh:mm, d month hh:mm, an ISO date within the text (midnight if it has no time).
    Without a year the default counts; without a zone the named one.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"\s+", " "), r"\bde ", ""))
    g = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    num = lambda p, k: g(p, k).cast("int")
    made = lambda y, mo, d, h, mi, s: F.try_make_timestamp(y, mo, d, h, mi, s)
    zero = F.lit(0)
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:[ t](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?(z|[+-]\d{2}:?\d{2})?$"
    iso_local = made(num(iso, 1), num(iso, 2), num(iso, 3), F.coalesce(num(iso, 4), zero), F.coalesce(num(iso, 5), zero), F.coalesce(num(iso, 6), zero))
    offset = g(iso, 7)
    minutes = F.when(offset == "z", 0).otherwise(
        F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * (F.regexp_extract(offset, r"^[+-](\d{2})", 1).cast("int") * 60 + F.regexp_extract(offset, r"(\d{2})$", 1).cast("int"))
    )
    utc = lambda local: F.to_utc_timestamp(local, zone)
    shifted = F.timestamp_seconds(F.unix_seconds(iso_local) - minutes * 60)
    figures = r"(\d{1,2})[/-](\d{1,2})(?:[/-](\d{4}))?(?: +| ?- ?)(\d{1,2}):(\d{2})"
    by_figures = made(F.coalesce(num(figures, 3), F.lit(default_year)), num(figures, 2), num(figures, 1), num(figures, 4), num(figures, 5), zero)
    named = r"(\d{1,2}) ([a-z]+)(?: (\d{4}))?.*?(\d{1,2}):(\d{2})"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), g(named, 2)).cast("int")
    by_name = made(F.coalesce(num(named, 3), F.lit(default_year)), F.nullif(month, F.lit(0)), num(named, 1), num(named, 4), num(named, 5), zero)
    inner = r"(\d{4})-(\d{2})-(\d{2})(?:[ t](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    by_inner = made(num(inner, 1), num(inner, 2), num(inner, 3), F.coalesce(num(inner, 4), zero), F.coalesce(num(inner, 5), zero), F.coalesce(num(inner, 6), zero))
    return F.coalesce(F.when(offset.isNotNull(), shifted).otherwise(utc(iso_local)), utc(by_figures), utc(by_name), utc(by_inner))
