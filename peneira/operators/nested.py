"""Deeply nested records to flat tables that keep their parent-child links.

Every node gets a Dewey label: the ordinals on the way from the root to it. The label of
a parent is the label of its child with the last parts cut off, so links need no
generated keys and no second pass. Nodes of one schema path form one table.

The shredder is an Arrow batch function: real payloads hold JSON text inside JSON, one
object where a list belongs and bare strings where an object belongs, so no fixed schema
describes them, and a parse that fails must cost one record only. It runs in the scan's
own tasks: no shuffle, whatever the skew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("dewey", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("schema_path", T.StringType(), False),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType(), True), False),
    ]
)
_ARROW = [("dewey", pa.list_(pa.int32())), ("schema_path", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]


class _Number(str):
    """A number of the JSON text, as written."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|true|false|null")


def _deeply_parsed(text: str):
    """The value of a JSON text nested deeper than the usual parser can follow: its open objects and lists are kept in a list."""
    skip = lambda i: _BLANK.match(text, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        key, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no value")
        return key, skip(i + 1)

    open_: list[tuple[dict | list, str | None]] = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, i = key_at(i)
                    open_.append(({}, key))
                else:
                    open_.append(([], None))
                continue
            value, i = {} if c == "{" else [], i + 1
        elif c == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
        elif m := _ATOM.match(text, i):
            value, i = _Number(m[1]) if m[1] else {"true": True, "false": False, "null": None}[m[0]], m.end()
        else:
            raise ValueError("no value")
        while True:
            i = skip(i)
            if not open_:
                if i != len(text):
                    raise ValueError("more than one value")
                return value
            box, key = open_[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c, i = text[i : i + 1], i + 1
            if c == ",":
                i = skip(i)
                if isinstance(box, dict):
                    key, i = key_at(i)
                    open_[-1] = (box, key)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not closed")
            value = open_.pop()[0]


def parse(text: str | None):
    """The value of a JSON text, numbers as written, nested as deep as may be; raises ValueError where it isn't valid JSON."""
    if text is None:
        raise ValueError("no text")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deeply_parsed(text)


def held(value):
    """What a value holds: JSON text counts as its content, however often it is wrapped, other values as themselves."""
    while type(value) is str and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = parse(value)
        except ValueError:
            break
    return value


def scalar_text(value) -> str | None:
    """A scalar as it stands in a table; None for null, objects and lists."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class Shape:
    """What is known of a payload.

    tables: schema paths to give rows for; none for all objects. `a.b[]` is an element of the list at a.b.
    lists: paths where a list belongs, so that one object counts as a list of one.
    bare: for a path where an object belongs, the field that a bare string stands for.
    """

    tables: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    bare: Mapping[str, str] = field(default_factory=dict)

    def ways(self) -> set[str]:
        """All paths on the way to a table."""
        out = set()
        for t in self.tables:
            parts = t.replace("[]", ".[]").split(".")
            for k in range(1, len(parts) + 1):
                out.add(".".join(parts[:k]).replace(".[]", "[]"))
        return out


def shred(text: str | None, shape: Shape, ways: set[str] | None = None) -> Iterator[tuple[list[int], str, list[tuple[str, str | None]]]]:
    """(Dewey label, schema path, scalar fields) of each object in one JSON text; nothing where it isn't valid JSON.

    A null gives no row but keeps its ordinal. Of an object's repeated keys the last counts.
    """
    try:
        root = held(parse(text))
    except ValueError:
        return
    if ways is None:
        ways = shape.ways()
    stack = [([], "", root)]
    while stack:
        dewey, path, value = stack.pop()
        if path in shape.lists and isinstance(value, dict):
            value = [value]
        if type(value) is str and path in shape.bare:
            value = {shape.bare[path]: value}
        if isinstance(value, dict):
            if not ways or path in shape.tables:
                yield dewey, path, [(k, scalar_text(v)) for k, v in value.items() if not isinstance(v, (dict, list))]
            children: Iterable = ((f"{path}.{k}" if path else k, v) for k, v in value.items())
        elif isinstance(value, list):
            children = ((f"{path}[]", v) for v in value)
        else:
            continue
        for n, (below, v) in enumerate(children):
            if v is not None and (not ways or below in ways):
                v = held(v) if below not in shape.bare or str(v).lstrip()[:1] in ("{", "[", '"') else v
                if isinstance(v, (dict, list)) or below in shape.bare:
                    stack.append(([*dewey, n], below, v))


def shred_json(df: DataFrame, json_column: str, keep: Sequence[str], shape: Shape) -> DataFrame:
    """One row (kept columns, dewey, schema_path, fields) for each object in the JSON column.

    Null, invalid and cut-off JSON gives no rows. Kept columns may hold any type and nulls; other columns are not read.
    """
    for name in keep:
        if name in NODE_SCHEMA.fieldNames():
            raise ValueError(f"rename the column {name}: the result has one of that name")
    source = df.select(*keep, F.col(json_column).cast("string").alias("__json"))
    schema = T.StructType([*source.select(*keep).schema.fields, *NODE_SCHEMA.fields])
    ways = shape.ways()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema(_ARROW)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__json"))
            at, rows = [], []
            size = 0

            def flush() -> pa.RecordBatch:
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in keep]
                nodes = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                return pa.RecordBatch.from_arrays([*kept, *nodes], [*keep, *arrow.names])

            for i in range(batch.num_rows):
                text = column[i].as_py()
                for row in shred(text, shape, ways):
                    at.append(i)
                    rows.append(row)
                size += len(text or "")
                if size > 8_000_000:
                    yield flush()
                    at, rows, size = [], [], 0
            if rows:
                yield flush()

    return source.mapInArrow(run, schema)


# Loose JSON: strings of either quotes, and bare names before a colon.
_LOOSE = re.compile(r"""("(?:[^"\\]|\\.)*")|'((?:[^'\\]|\\.)*)'|([A-Za-z_$][\w$]*)(?=\s*:)""", re.S)


def loosely_parsed(text: str | None):
    """The value of a JSON text, else of one with unquoted names or single quotes, as scripts have; raises ValueError where it is neither."""
    try:
        return parse(text)
    except ValueError:
        if text is None:
            raise

    def strict(m: re.Match) -> str:
        if m[1]:
            return m[1]
        if m[3]:
            return f'"{m[3]}"'
        return '"' + re.sub(r"\\.|\"", lambda e: {"\\'": "'", '"': '\\"'}.get(e[0], e[0]), m[2], flags=re.S) + '"'

    return parse(_LOOSE.sub(strict, text))


def fitted(value, kind: T.DataType, shape: Shape, path: str = ""):
    """A value in the form of a type of structs, arrays and strings: JSON text opened, one object as a list of one, bare strings as objects.

    What can't stand at its place is null, and costs nothing beside it; null elements keep their position.
    """
    if isinstance(kind, T.StringType):
        return scalar_text(value)
    value = held(value)
    if isinstance(kind, T.ArrayType):
        if isinstance(value, dict) and path in shape.lists:
            value = [value]
        return [fitted(v, kind.elementType, shape, f"{path}[]") for v in value] if isinstance(value, list) else None
    if type(value) is str and path in shape.bare:
        value = {shape.bare[path]: value}
    if not isinstance(value, dict):
        return None
    return {f.name: fitted(value.get(f.name), f.dataType, shape, f"{path}.{f.name}" if path else f.name) for f in kind.fields}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields]) if isinstance(kind, T.StructType) else pa.string()


def fitted_json(df: DataFrame, json_column: str, keep: Sequence[str], kind: T.StructType, shape: Shape, out: str) -> DataFrame:
    """The kept columns and `out`, the JSON column's value in the form of the type; null where it isn't valid JSON, even loosely."""
    source = df.select(*keep, F.col(json_column).cast("string").alias("__json"))
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField(out, kind)])

    def read(text: str | None):
        try:
            return fitted(loosely_parsed(text), kind, shape)
        except ValueError:
            return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                values = pa.array([read(x.as_py()) for x in part.column(len(keep))], _arrow(kind))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), values], [*keep, out])

    return source.mapInArrow(run, schema)


def parent_label(dewey: Column, levels: int = 1) -> Column:
    """The label of the ancestor that many levels up, by truncation."""
    return F.slice(dewey, F.lit(1), F.size(dewey) - F.lit(levels))


def label_text(dewey: Column) -> Column:
    """A label as text that sorts as the document does: a letter for each ordinal's number of digits goes before it, so none is cut or padded."""
    digits = lambda x: F.chr(F.length(x.cast("string")) + 96)
    return F.array_join(F.transform(dewey, lambda x: F.concat(digits(x), x.cast("string"))), ".")


def node_table(nodes: DataFrame, path: str, keep: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """The flat table of one schema path: its key, its parent's key, and the named fields as columns."""
    mine = nodes.where(F.col("schema_path") == path)
    return mine.select(
        *keep,
        label_text(F.col("dewey")).alias("node"),
        label_text(parent_label(F.col("dewey"))).alias("parent"),
        *(F.col("fields")[key].alias(name) for name, key in columns.items()),
    )


FUTURE = "scheduleTeam.teamAgenda.future"
EVENT = f"{FUTURE}[]"
EDITORIAL = f"{EVENT}.editorialData"
MATCH = f"{EVENT}.match"
FIRST, SECOND = f"{MATCH}.firstContestant", f"{MATCH}.secondContestant"
WATCH = f"{MATCH}.liveWatchSources[]"

#: A team's agenda page.
AGENDA = Shape(
    tables=(EVENT, EDITORIAL, MATCH, FIRST, SECOND, WATCH),
    lists=(FUTURE, f"{MATCH}.liveWatchSources"),
    bare={FIRST: "popularName", SECOND: "popularName"},
)


def agenda_nodes(raw: DataFrame, tables: Sequence[str] = AGENDA.tables, keep: Sequence[str] = ("raw_id",)) -> DataFrame:
    """The objects of agenda payloads, with event_no, the position of their event."""
    shape = Shape(tuple(tables), AGENDA.lists, AGENDA.bare)
    return shred_json(raw, "payload", keep, shape).withColumn("event_no", F.col("dewey")[3].cast("bigint"))


def agenda_children(raw: DataFrame) -> DataFrame:
    """One row for each editorial, first contestant and watch source: raw_id, event_no, child_kind, child_no, child_label."""
    nodes = agenda_nodes(raw, (EDITORIAL, FIRST, WATCH))
    path, fields = F.col("schema_path"), F.col("fields")
    return nodes.select(
        "raw_id",
        "event_no",
        F.when(path == EDITORIAL, "editorial").when(path == FIRST, "first_contestant").otherwise("watch_source").alias("child_kind"),
        F.when(path == WATCH, F.element_at("dewey", -1)).otherwise(0).cast("bigint").alias("child_no"),
        F.coalesce(F.when(path == EDITORIAL, fields["url"]).when(path == FIRST, fields["popularName"]).otherwise(fields["name"]), F.lit("")).alias("child_label"),
    )
