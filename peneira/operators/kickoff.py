"""Mixed timestamp formats and time zones to one UTC instant.

Every value gives the array of all its valid interpretations, each a format, an instant
and whether it fits the order of day and month that its source declares. Viterbi over
each source's record order chooses among them: a switch of format and a jump backward in
time cost, and a reading against the declared order costs more than any switches and
jumps that it could save. So a declared order decides, and a source that declares none
but writes its records in time order settles its own ambiguous dates.

The search is exact at any size. A source's records are cut into blocks by range
partitioning, however many of all rows it holds; each block reports the least cost
between the interpretations of its first and last record (a matrix of a few numbers), the
driver joins these (two rows a block at most), and each block then follows the best path
between its fixed ends.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from datetime import UTC, date, datetime, timedelta
from functools import cache, lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.operators.nested import MATCH, agenda_nodes
from peneira.session import durable, durable_in_order, release

BRASILIA = "America/Sao_Paulo"

# Month names and their beginnings in Portuguese, Spanish and English, folded.
MONTHS = {
    "jan": 1, "janeiro": 1, "january": 1, "ene": 1, "enero": 1,
    "fev": 2, "fevereiro": 2, "feb": 2, "february": 2, "febrero": 2,
    "mar": 3, "marco": 3, "march": 3, "marzo": 3,
    "abr": 4, "abril": 4, "apr": 4, "april": 4,
    "mai": 5, "maio": 5, "may": 5, "mayo": 5,
    "jun": 6, "junho": 6, "june": 6, "junio": 6,
    "jul": 7, "julho": 7, "july": 7, "julio": 7,
    "ago": 8, "agosto": 8, "aug": 8, "august": 8,
    "set": 9, "setembro": 9, "sep": 9, "sept": 9, "september": 9, "septiembre": 9,
    "out": 10, "outubro": 10, "oct": 10, "october": 10, "octubre": 10,
    "nov": 11, "novembro": 11, "november": 11, "noviembre": 11,
    "dez": 12, "dezembro": 12, "dec": 12, "december": 12, "dic": 12, "diciembre": 12,
}
# Zone abbreviations, in minutes from UTC.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "brt": -180, "brst": -120, "art": -180, "amt": -240, "est": -300, "edt": -240}

_WEEKDAY = re.compile(r"^(?:seg|ter|qua|qui|sex|sab|dom|segunda|terca|quarta|quinta|sexta|sabado|domingo|mon|tue|wed|thu|fri|sat|sun|lun|mie|jue|vie)[a-z]*(?:-feira)?\.?,?\s+(?=[\da-z])")
_DATES = (
    ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)")),
    ("num", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")),
    ("compact", re.compile(r"(\d{4})(\d{2})(\d{2})(?!\d)")),
    ("dmonthy", re.compile(r"(\d{1,2})[oº]?(?:\s+de\s+|[-\s.]+)([a-z]{3,})\.?(?:\s+de\s+|[-\s,.]+)(\d{4}|\d{2})(?!\d)")),
    ("monthdy", re.compile(r"([a-z]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)")),
)
_TIME = r"(?:(\d{1,2})\s*[:h]\s*(\d{2})(?:\s*min)?(?::(\d{2})(?:[.,]\d+)?)?|(\d{1,2})\s*h(?:oras)?|(\d{2})(\d{2})(\d{2})?)\s*([ap])?(?:\.?m\.?)?"
_ZONE = r"\s*(?:-\s*)?(z|utc|gmt|wes?t|brs?t|art|amt|e[sd]t)?\s*([+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[([^\]]+)\])?\s*(?:[-(]?\s*(?:horario )?de brasilia\)?)?\s*"
_AFTER = re.compile(r"(?:\s*t\s*|,?\s+(?:as\s+|a las\s+|at\s+|-\s+)?)" + _TIME + f"({_ZONE})")
_CLOCK = re.compile(r"(?:as\s+|a las\s+|at\s+)?" + _TIME + f"({_ZONE})")
_EPOCH = re.compile(r"-?\d{9,19}(?:\.\d+)?")
_FLOOR = datetime(1, 1, 2, tzinfo=UTC)


def _plain(text: str) -> str:
    """Folded, with plain blanks."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).replace("–", "-").split())


@cache
def zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ValueError, OSError):
        return None


Reading = tuple[str, int, bool]
Cand = Sequence[tuple]


@lru_cache(maxsize=100_000)
def dates(plain: str, order: str | None) -> tuple[tuple[tuple[str, date, bool], ...], int]:
    """All valid readings of the date at the start of a folded text, as (format, date, whether it fits the order), and where it ends; () if none.

    Without an order every reading fits. Readings of one date are one, a fitting one if there is any.
    """
    start = m.end() if (m := _WEEKDAY.match(plain)) else 0
    for kind, pattern in _DATES:
        if not (m := pattern.match(plain, start)):
            continue
        g = m.groups()
        if kind == "ymd":
            found = [("ymd", g[0], g[2], g[3], True)]
        elif kind == "compact":
            found = [("ymd", *g, True)]
        elif kind == "num":
            a, b, c = g[0], g[2], g[3]
            readings = {"dmy": (c, b, a), "mdy": (c, a, b)}
            if len(c) == 2:
                readings["ymd"] = (a, b, c)
            # A declared order that cannot stand, as ymd with the year last, leaves month before day.
            meant = order if order in readings else "mdy"
            found = [(f, *r, order is None or f == meant) for f, r in readings.items()]
            found.sort(key=lambda r: not r[4])
        else:
            d, name, y = g if kind == "dmonthy" else (g[1], g[0], g[2])
            if name not in MONTHS:
                continue
            found = [("named", y, str(MONTHS[name]), d, True)]
        valid = []
        for f, y, mo, d, fits in found:
            try:
                one = (f, date(int(y) + (2000 if len(y) <= 2 else 0), int(mo), int(d)), fits)
            except ValueError:
                continue
            if all(one[1] != x[1] for x in valid):
                valid.append(one)
        return tuple(valid), m.end()
    return (), 0


def _clock(g: Sequence[str | None]) -> int | None:
    """Seconds of the day from the groups of _TIME; None if there is no such time."""
    h, mi, s = (g[0], g[1], g[2]) if g[0] else (g[3], "0", "0") if g[3] else (g[4], g[5], g[6])
    hour, minute, second = int(h), int(mi or 0), int(s or 0)
    if g[7]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g[7] == "p" else 0)
    if hour > 24 or minute > 59 or second > 60 or (hour == 24 and (minute or second)):
        return None
    return hour * 3600 + minute * 60 + second


def _zone(g: Sequence[str | None], text: str, raw: str):
    """Of the groups of _ZONE: minutes from UTC, a ZoneInfo, or None where no zone is stated. An offset goes before a zone's name."""
    word, offset, name = g
    if offset:
        sign = -1 if offset[0] == "-" else 1
        digits = offset[1:].replace(":", "")
        hours, minutes = (digits, "0") if len(digits) <= 2 else (digits[:-2], digits[-2:])
        if int(hours) <= 15 and int(minutes) < 60:
            return sign * (int(hours) * 60 + int(minutes))
    if name:
        # Zone names are case-sensitive: taken from the value as written.
        m = re.search(r"\[([^\]]+)\]", raw)
        if m and (z := zone(m[1])):
            return z
    if word:
        return ABBREVIATIONS[word]
    return zone(BRASILIA) if "brasilia" in text else None


def instant(day: date, seconds: int, where) -> int | None:
    """Epoch seconds of a local time. Skipped and repeated local times take the offset in force before the change."""
    try:
        local = datetime(day.year, day.month, day.day) + timedelta(seconds=seconds)
        if isinstance(where, int):
            return int((local.replace(tzinfo=UTC) - timedelta(minutes=where)).timestamp())
        return int((local - local.replace(tzinfo=where, fold=0).utcoffset()).replace(tzinfo=UTC).timestamp())
    except (OverflowError, ValueError):
        return None


def _at(days: Iterable[tuple[str, date, bool]], seconds: int, where) -> list[Reading]:
    return [(f, t, fits) for f, d, fits in days if (t := instant(d, seconds, where)) is not None]


def moments(raw: str | None, order: str | None, default) -> tuple[list[Reading], list[tuple[str, date, bool]], bool]:
    """Readings of one value: instants as (format, epoch seconds, fits), dates as (format, date, fits), and whether a time of day is stated."""
    if raw is None or not raw.strip():
        return [], [], False
    text = _plain(raw)
    if re.fullmatch(r"-?\d+(?:\.\d+)?", text) and not re.fullmatch(r"\d{8}", text):
        if not _EPOCH.fullmatch(text):
            return [], [], False
        n = int(text.partition(".")[0])
        size = abs(n)
        seconds = n if size < 10**11 else n // 1000 if size < 10**14 else n // 10**6 if size < 10**17 else n // 10**9
        return [("epoch", seconds, True)], [], True
    found, end = dates(text, order)
    if not found:
        return [], [], False
    if end == len(text):
        return _at(found, 0, default), list(found), False
    m = _AFTER.fullmatch(text, end)
    if not m:
        return [], [], False
    g = m.groups()
    seconds = _clock(g[:8])
    if seconds is None:
        return [], [], False
    where = _zone(g[9:], text, raw)
    return _at(found, seconds, default if where is None else where), list(found), True


def clock(raw: str | None):
    """Seconds of the day and zone (or None) that a time of day states; None where it states none."""
    if raw is None:
        return None
    text = _plain(raw)
    m = _CLOCK.fullmatch(text)
    if not m:
        return None
    g = m.groups()
    seconds = _clock(g[:8])
    return None if seconds is None else (seconds, _zone(g[9:], text, raw))


def readings(whole: str | None, day: str | None, time: str | None, order: str | None, zone_id: str | None) -> list[Reading]:
    """All valid interpretations of a kickoff as (format, epoch seconds, whether it fits the declared order).

    A readable `whole` decides: one with a reading that fits. Otherwise `day` with a time of day decides, else `day` with `time`; a time that is
    missing or states none is midnight.
    """
    default = zone(zone_id) or zone("UTC")
    found, _, _ = moments(whole, order, default)
    if any(r[2] for r in found):
        return found
    found, days, timed = moments(day, order, default)
    if not days or timed:
        return found
    seconds, where = clock(time) or (0, None)
    return _at(days, seconds, default if where is None else where)


def interpretations(whole: str | None, day: str | None, time: str | None, order: str | None, zone_id: str | None) -> list[tuple[str, int]]:
    """The interpretations that fit the declared order, as (format, epoch seconds)."""
    return [(f, t) for f, t, fits in readings(whole, day, time, order, zone_id) if fits]


CANDIDATES = T.ArrayType(T.StructType([T.StructField("format", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("fits", T.BooleanType())]))
_CANDIDATES = pa.list_(pa.struct([("format", pa.string()), ("epoch", pa.int64()), ("fits", pa.bool_())]))


def with_candidates(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and `candidates`, read from whole, day, time, date_order and zone_id. Runs in the scan's tasks, without a shuffle."""
    inputs = ["whole", "day", "time", "date_order", "zone_id"]
    source = df.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)), *(F.col(c).cast("string") for c in inputs))
    kept = [f"k{n}" for n in range(len(keep))]
    schema = T.StructType([*(source.schema[k] for k in kept), T.StructField("candidates", CANDIDATES)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, formats, epochs, fit = [0], [], [], []
            for row in zip(*(batch.column(len(kept) + k).to_pylist() for k in range(len(inputs))), strict=True):
                for f, t, fits in readings(*row):
                    formats.append(f)
                    epochs.append(t)
                    fit.append(fits)
                offsets.append(len(formats))
            flat = pa.StructArray.from_arrays([pa.array(formats, pa.string()), pa.array(epochs, pa.int64()), pa.array(fit, pa.bool_())], fields=list(_CANDIDATES.value_type))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), found], [*kept, "candidates"])

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(keep)), "candidates")


# Viterbi -----------------------------------------------------------------------------------------

#: A reading has two neighbours, so k readings in a row save (k + 1) (SWITCH + BACKWARD) at most by going against the declared order: less than k DECLARED.
SWITCH, BACKWARD, DECLARED = 1.0, 2.0, 8.0
_FIGURES = frozenset(("dmy", "mdy", "ymd"))


def step_cost(a: tuple, b: tuple, switch: float = SWITCH, backward: float = BACKWARD) -> float:
    """What it costs to read one record as a and the next as b. Formats without an order of day and month switch nothing."""
    changed = a[0] != b[0] and a[0] in _FIGURES and b[0] in _FIGURES
    return switch * changed + backward * (b[1] < a[1])


def own_cost(a: tuple) -> float:
    """What a reading costs by itself: (format, epoch) nothing, (format, epoch, fits) DECLARED if it doesn't fit."""
    return 0.0 if len(a) == 2 or a[2] else DECLARED


def advance(costs: list[float], a: Cand, b: Cand, own: bool = True) -> tuple[list[float], list[int]]:
    """Least costs of reaching each reading of b, and from which of a; ties go to the first."""
    if len(a) == len(b) == 1:
        return [costs[0] + step_cost(a[0], b[0]) + own * own_cost(b[0])], [0]
    out, back = [], []
    for y in b:
        each = [c + step_cost(x, y) for c, x in zip(costs, a, strict=True)]
        k = min(range(len(each)), key=each.__getitem__)
        out.append(each[k] + own * own_cost(y))
        back.append(k)
    return out, back


def _start(first: Cand, only: int | None) -> list[float]:
    return [own_cost(x) if only is None or k == only else float("inf") for k, x in enumerate(first)]


def best_path(run: Sequence[Cand], first: int | None = None, last: int | None = None) -> list[int]:
    """The readings of least total cost, with the first and last fixed where given."""
    costs = _start(run[0], first)
    backs = []
    for a, b in zip(run, run[1:]):
        costs, back = advance(costs, a, b)
        backs.append(back)
    k = min(range(len(costs)), key=costs.__getitem__) if last is None else last
    path = [k]
    for back in reversed(backs):
        path.append(k := back[k])
    return path[::-1]


def run_matrix(run: Sequence[Cand]) -> list[list[float]]:
    """Least cost from each reading of the first record to each of the last, both included."""
    rows = []
    for first in range(len(run[0])):
        costs = _start(run[0], first)
        for a, b in zip(run, run[1:]):
            costs, _ = advance(costs, a, b)
        rows.append(costs)
    return rows


def join_runs(runs: Sequence[tuple[Cand, Cand, list[list[float]]]]) -> list[tuple[int, int]]:
    """For the runs of one source in order, each (first readings, last readings, matrix), the best readings at both ends."""
    costs = [0.0] * len(runs[0][0])
    backs = []
    for n, (first, last, matrix) in enumerate(runs):
        if n:
            costs, back = advance(costs, runs[n - 1][1], first, own=False)  # the matrix has the readings' own costs
            backs.append(back)
        reach, back = [], []
        for j in range(len(last)):
            each = [costs[i] + matrix[i][j] for i in range(len(first))]
            k = min(range(len(each)), key=each.__getitem__)
            reach.append(each[k])
            back.append(k)
        costs = reach
        backs.append(back)
    k = min(range(len(costs)), key=costs.__getitem__)
    path = [k]
    for back in reversed(backs):
        path.append(k := back[k])
    path.reverse()
    return list(zip(path[::2], path[1::2], strict=True))


def _records(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple]]]:
    """(source, readings) of each row of a batch."""
    column = batch.column(batch.schema.get_field_index("candidates"))
    flat = list(zip(*(part.to_pylist() for part in column.values.flatten()), strict=True))
    offsets = column.offsets.to_pylist()
    sources = batch.column(batch.schema.get_field_index("__source")).to_pylist()
    return ((s, flat[a:b]) for s, a, b in zip(sources, offsets[:-1], offsets[1:], strict=True))


def block_ends(batches: Iterable[pa.RecordBatch]) -> list[tuple[str, list[tuple], list[tuple], list[list[float]]]]:
    """(source, first readings, last readings, matrix) of a block's first and last source, which alone may go on outside it."""
    out: list = []
    current = first = last = rows = None
    for batch in batches:
        for s, c in _records(batch):
            if rows is not None and s == current:
                rows = [advance(r, last, c)[0] for r in rows]
            else:
                if rows is not None:
                    out[1:] = [(current, first, last, rows)] if out else []
                    out = out or [(current, first, last, rows)]
                current, first = s, c
                rows = [_start(c, k) for k in range(len(c))]
            last = c
    if rows is not None:
        out[1:] = [(current, first, last, rows)] if out else []
        out = out or [(current, first, last, rows)]
    return out


def block_choices(batches: Iterable[pa.RecordBatch], fixed: Mapping[str, tuple[int, int]]) -> Iterator[tuple[list[pa.RecordBatch], list[int]]]:
    """Batches of a block with the index of the reading chosen for each of their rows.

    A record of one reading cuts the path: what comes before it is settled without what comes after, so no more is held than lies between two of these.
    """
    held: list[pa.RecordBatch] = []
    chosen: list[int] = []
    run: list[list[tuple]] = []
    current, start, given = None, None, 0  # given: how many of the run have been given out

    def settle(last: int | None) -> None:
        chosen.extend(best_path(run, start, last)[given:])

    for batch in batches:
        for s, c in _records(batch):
            if not run or s != current:
                if run:
                    settle(fixed.get(current, (None, None))[1])
                    run.clear()
                current, start, given = s, fixed.get(s, (None, None))[0], 0
            run.append(c)
            if len(c) == 1:
                if len(run) == 1 + given:
                    chosen.append(0)
                else:
                    settle(0)
                run[:], start, given = [c], 0, 1
        held.append(batch)
        if len(run) == given:
            yield held, chosen
            held, chosen = [], []
    if run:
        settle(fixed.get(current, (None, None))[1])
    if held:
        yield held, chosen


def viterbi(df: DataFrame, source: str, order_by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """df with candidates replaced by `chosen`, one reading a record; records without candidates are left out.

    Columns source and order_by tell the sequence; a null source is a source of its own. Exact, whatever the blocks.
    Candidates are written before they are ranged, as the ranges are sampled, and once more in order, as two passes read them.
    """
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = durable(df.where(F.size("candidates") > 0).withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("\x00"))))
    ranged = read.repartitionByRange(n, "__source", *order_by).sortWithinPartitions("__source", *order_by)
    cut = durable_in_order(ranged)
    release(read)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = block_ends(batches)
        block = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int32()), pa.array([json.dumps(x) for x in found], pa.string())], ["block", "ends"])

    by_source: dict[str, list] = {}
    for block, text in sorted(cut.select("__source", "candidates").mapInArrow(ends, "block int, ends string").collect(), key=lambda r: r[0]):  # two rows a block at most
        s, *run = json.loads(text)
        by_source.setdefault(s, []).append((block, run))
    fixed: dict[int, dict[str, tuple[int, int]]] = {}
    for s, runs in by_source.items():
        for (block, _), pick in zip(runs, join_runs([r for _, r in runs]), strict=True):
            fixed.setdefault(block, {})[s] = pick
    shared = spark.sparkContext.broadcast(fixed)
    kept = [f for f in cut.schema if f.name not in ("__source", "candidates")]
    out_schema = T.StructType([*kept, T.StructField("chosen", cut.schema["candidates"].dataType.elementType)])

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, chosen in block_choices(batches, shared.value.get(TaskContext.get().partitionId(), {})):
            done = 0
            for batch in held:
                column = batch.column(batch.schema.get_field_index("candidates"))
                at = pc.add(column.offsets.slice(0, batch.num_rows), pa.array(chosen[done : done + batch.num_rows], pa.int32()))
                done += batch.num_rows
                picked = column.values.take(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), picked], [f.name for f in out_schema])

    return cut.mapInArrow(follow, out_schema)


# Kickoffs ----------------------------------------------------------------------------------------

KEYS = ("record_table", "record_id", "event_no")


def kickoff_values(matches: DataFrame, raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """The values to read, one row a record: keys, source, seen_at (its place in the source), whole, day, time, date_order, zone_id.

    A feed that the catalog lacks has UTC and no declared order. Payloads are dmy in Brasília time.
    """
    feeds = feeds.select("feed", F.col("zone_id").alias("zone"), F.col("date_order").alias("order"))
    records = matches.join(feeds, "feed", "left").select(
        F.lit("match_records").alias("record_table"),
        "record_id",
        F.lit(0).cast("bigint").alias("event_no"),
        F.col("feed").alias("source"),
        F.col("fetched_at").alias("seen_at"),
        F.col("kickoff_iso").alias("whole"),
        F.col("match_date").alias("day"),
        F.col("match_time").alias("time"),
        F.col("order").alias("date_order"),
        F.coalesce("zone", F.lit("UTC")).alias("zone_id"),
    )
    nodes = agenda_nodes(raw, (MATCH,), ("raw_id", "fetched_at"))
    events = nodes.select(
        F.lit("raw_schedules").alias("record_table"),
        F.col("raw_id").alias("record_id"),
        "event_no",
        F.lit("payload").alias("source"),
        F.col("fetched_at").alias("seen_at"),
        F.lit(None).cast("string").alias("whole"),
        F.col("fields")["startDate"].alias("day"),
        F.col("fields")["startHour"].alias("time"),
        F.lit("dmy").alias("date_order"),
        F.lit(BRASILIA).alias("zone_id"),
    )
    return records.unionByName(events)


def utc_text(epoch: Column) -> Column:
    """Epoch seconds as yyyy-MM-ddTHH:mm:ssZ, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    second = F.pmod(epoch, F.lit(86400))
    part = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(second / 3600), F.lit(":"), part(F.pmod(second, F.lit(3600)) / 60), F.lit(":"), part(F.pmod(second, F.lit(60))), F.lit("Z"))


def normalised_kickoffs(values: DataFrame) -> DataFrame:
    """(keys, epoch, format) of each record with a readable kickoff: every record is chosen by Viterbi over (source, seen_at, keys).

    A record whose chosen reading goes against the declared order has none that fits it: the date does not exist, so it is left out.
    """
    chosen = viterbi(with_candidates(values, (*KEYS, "source", "seen_at")), "source", ["seen_at", *KEYS])
    return chosen.where("chosen.fits").select(*KEYS, F.col("chosen.epoch").alias("epoch"), F.col("chosen.format").alias("format"))
