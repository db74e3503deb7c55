"""Free-entered names to the entries of a canonical list, by a prefix-filter set-similarity join.

A cleaned name is a set of tokens: its letters and its pairs of letters, each numbered by
occurrence, so that repeated ones count. All tokens are ordered by global rarity. Of a
name x only the rarest |x| - ceil(t|x|) + 1 tokens, its prefix, are looked up. An entry y of
Jaccard similarity t shares at least t/(1+t) (|x|+|y|) tokens, of which the rest of x can
give no more than |x| - |prefix|; so it must share so many of the prefix that few entries
do. Sizes rule out more, Jaccard decides what remains exactly, and the best entry is kept.
No pair of the least similarity is lost.

Names are matched once each, however many rows bear one. The result goes back to the rows
by a join; the names that a large share of all rows bears, few by definition, are
broadcast for it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.functions.pytext import fold
from peneira.operators.nested import FIRST, SECOND, agenda_nodes
from peneira.session import durable

#: Least Jaccard similarity of a match.
THRESHOLD = 0.5
#: Below this similarity the longest words must be within so many edits, too.
SURE, EDITS = 0.6, 4
#: Catalog entries in one broadcast index: some tens of MB.
ENTRIES_PER_BLOCK = 50_000
#: The share of the tokens beyond the prefix that is looked up, too, which leaves fewer candidates to be verified; any share gives the same matches.
LONGER = 0.5
#: A name borne by more rows than an even partition holds, divided by this, goes back to its rows by broadcast.
HOT = 4
UNMATCHED = "UNMATCHED"

_MOJIBAKE = re.compile("[ÃÂ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
# Generic words of club names and remarks beside them, folded.
_BEFORE = re.compile(r"^(?:o|time do|time da|time|clube|ec|e c|fc|f c|sc|s c|ac|a c(?= \w{4}))\s+(?=\w{3})")
_AFTER = re.compile(r"(?<=\w{3})\s+(?:fc|f c|ec|e c|sc|s c(?!\w)|ac|mandante|visitante|casa|fora)$")


def cleaned(name: str) -> str:
    """A name without damage and ornament: entities and broken encoding restored, figures in place of letters read as letters, folded, without generic words."""
    s = html.unescape(name)
    if _MOJIBAKE.search(s):
        for codec in ("latin-1", "cp1252"):
            try:
                s = s.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                continue
    s = s.replace("@", "a")
    s = re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "o", s)
    s = " ".join(re.findall(r"[a-z0-9]+", fold(s)))
    before = None
    while before != s:
        before = s
        s = _AFTER.sub("", _BEFORE.sub("", s))
    return s


def tokens(clean: str) -> list[str]:
    """The numbered letters and pairs of letters of each word, with its bounds."""
    seen: Counter[str] = Counter()
    out = []
    for w in clean.split():
        bounded = f"^{w}$"
        for t in (*w, *(bounded[i : i + 2] for i in range(len(bounded) - 1))):
            seen[t] += 1
            out.append(f"{t}{seen[t]}" if seen[t] > 1 else t)
    return out


_FORM = T.StructType([T.StructField("clean", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FORM)
def _form(names: pd.Series) -> pd.DataFrame:
    clean = [cleaned(n) for n in names]
    return pd.DataFrame({"clean": clean, "tokens": [tokens(c) for c in clean]})


def catalog_spellings(teams: DataFrame) -> DataFrame:
    """(team_id, spelling): each name and alias, alone and with the state's code, and each name with its first word cut to one and to three letters; repeated ones once."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    cut = [F.regexp_replace("name", rf"^(\S{{{n}}})\S*\s+(?=\S)", "$1 ") for n in (1, 3)]
    each = teams.select("team_id", "state_code", F.explode(F.array_union(names, F.array(*cut))).alias("s")).where("s is not null and trim(s) <> ''")
    with_state = F.when(F.col("state_code").isNotNull(), F.array("s", F.concat_ws(" ", "s", "state_code"))).otherwise(F.array("s"))
    return each.select("team_id", F.explode(with_state).alias("spelling")).distinct()


class PrefixIndex:
    """A block of catalog entries by token, ready to be joined to names by their rare prefixes."""

    def __init__(self, entries: Sequence[tuple[str, str, list[str]]], ranks: Mapping[str, int], threshold: float) -> None:
        self.ranks, self.threshold = ranks, threshold
        self.teams = [e[0] for e in entries]
        self.longest = [longest_word(e[1]) for e in entries]
        self.sets = [frozenset(e[2]) for e in entries]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        holders: dict[str, list[int]] = {}
        for k, s in enumerate(self.sets):
            for t in s:
                holders.setdefault(t, []).append(k)
        self.holders = {t: np.array(ks, np.int32) for t, ks in holders.items()}

    def prefix(self, found: Sequence[str], longer: float = 0.0) -> list[str]:
        """The rarest tokens, among which two sets of the least similarity must share one. A token without rank is rarer than all that have one."""
        ordered = sorted(found, key=lambda t: (self.ranks.get(t, 0), t))
        beyond = math.ceil(self.threshold * len(ordered) - 1e-9) - 1
        return ordered[: len(ordered) - math.ceil(beyond * (1 - longer))]

    def candidates(self, found: Sequence[str]) -> np.ndarray:
        """The entries that share enough of the rarest tokens, and are neither too small nor too large, for the least similarity.

        The prefix, lengthened by LONGER of the tokens beyond it: the fewer are left out, the more of those counted an entry must share.
        """
        n, t = len(found), self.threshold
        prefix = self.prefix(found, LONGER)
        lists = [self.holders[x] for x in prefix if x in self.holders]
        if not lists:
            return np.zeros(0, np.int64)
        shared = np.bincount(np.concatenate(lists), minlength=len(self.sets))
        need = np.ceil(t / (1 + t) * (n + self.sizes) - 1e-9) - (n - len(prefix))
        return np.flatnonzero((shared >= np.maximum(need, 1)) & (self.sizes >= t * n) & (self.sizes * t <= n))

    def matches(self, clean: str, found: Sequence[str]) -> dict[str, float]:
        """The teams at least as similar as the threshold, each with the similarity of its nearest entry."""
        n, mine = len(found), frozenset(found)
        longest = longest_word(clean)
        best: dict[str, float] = {}
        for k in self.candidates(found):
            shared = len(mine & self.sets[k])
            j = shared / (n + len(self.sets[k]) - shared)
            if j < self.threshold or j <= best.get(self.teams[k], 0.0):
                continue
            if j >= SURE or within(longest, self.longest[k], EDITS):
                best[self.teams[k]] = j
        return best


def longest_word(clean: str) -> str:
    return max(clean.split(), key=len, default="")


def within(a: str, b: str, edits: int) -> bool:
    """Whether two words are at most so many insertions, deletions and substitutions apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        if min(row) > edits:
            return False
    return row[-1] <= edits


def match_names(names: DataFrame, spellings: DataFrame, threshold: float = THRESHOLD, per_block: int = ENTRIES_PER_BLOCK) -> DataFrame:
    """(name, id, similarity) of every distinct name; id is UNMATCHED where no entry reaches the threshold, or two entries are equally near.

    names: column name, distinct and not null. spellings: team_id, spelling. The join runs where the names are, against the prefix index of the
    catalog, which travels by broadcast; entries beyond the bound make further blocks, each joined to all names.
    """
    spark = names.sparkSession
    # Matching costs far more than a name's bytes tell, so the partitions are not left to their size.
    spread = names.select("name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = durable(spread.select("name", _form("name").alias("f")).select("name", "f.clean", "f.tokens"))
    right = spellings.select("team_id", _form("spelling").alias("f")).select("team_id", "f.clean", "f.tokens").where(F.size("tokens") > 0).distinct()
    right = durable(right)
    # Letters and pairs of letters with their occurrence: as many as alphabet and name lengths allow, whatever the rows.
    counts = left.select("tokens").unionByName(right.select("tokens")).select(F.explode("tokens").alias("t")).groupBy("t").count()
    ranks = {r["t"]: r["count"] for r in counts.toLocalIterator()}
    found = None
    for number, block in enumerate(_blocks(right, per_block)):
        shared = spark.sparkContext.broadcast((block, ranks, threshold))

        def join(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PrefixIndex(*shared.value)
            for batch in batches:
                at, ids, similarity = [], [], []
                for i, (clean, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    best = index.matches(clean, t)
                    top = max(best.values(), default=0.0)
                    for team, j in best.items():
                        if j == top:  # others can't be the nearest
                            at.append(i)
                            ids.append(team)
                            similarity.append(j)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(similarity, pa.float64())], ["name", "team_id", "j"])

        part = left.where(F.size("tokens") > 0).mapInArrow(join, "name string, team_id string, j double")
        if number or len(block) == per_block:
            # One of several blocks: its matches are written, so that one block at a time is held.
            part = durable(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return left.select("name", F.lit(UNMATCHED).alias("id"), F.lit(None).cast("double").alias("similarity"))
    # The nearest with the last and with the first identifier: the same where one entry alone is nearest.
    nearest = found.groupBy("name").agg(F.max(F.struct("j", "team_id")).alias("last"), F.min(F.struct((-F.col("j")).alias("j"), "team_id")).alias("first"))
    best = nearest.select("name", F.when(F.col("last.team_id") == F.col("first.team_id"), F.col("last.team_id")).alias("id"), F.col("last.j").alias("similarity"))
    return left.select("name").join(best, "name", "left").select("name", F.coalesce("id", F.lit(UNMATCHED)).alias("id"), "similarity")


def _blocks(right: DataFrame, per_block: int) -> Iterator[list[tuple[str, str, list[str]]]]:
    """The catalog's entries in blocks of bounded number."""
    block = []
    for r in right.toLocalIterator():
        block.append((r["team_id"], r["clean"], list(r["tokens"])))
        if len(block) == per_block:
            yield block
            block = []
    if block:
        yield block


def typed_names(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """(name_field, record_id, event_no, name) of the club names typed in both tables, null and blank ones left out."""
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("name_field"), F.col(c).alias("name")) for c in ("home_team", "away_team")))).alias("e")
    typed = matches.select("record_id", sides).select("e.name_field", "record_id", F.lit(0).cast("bigint").alias("event_no"), "e.name")
    nodes = agenda_nodes(raw, (FIRST, SECOND))
    side = F.when(F.col("schema_path") == FIRST, "first_contestant").otherwise("second_contestant")
    listed = nodes.select(side.alias("name_field"), F.col("raw_id").alias("record_id"), "event_no", F.col("fields")["popularName"].alias("name"))
    return typed.unionByName(listed).where(F.col("name").isNotNull() & F.col("name").rlike(r"[^\s ﻿]"))


def canonical_names(matches: DataFrame, raw: DataFrame, teams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name_field, record_id, event_no, team_id) of each typed name that isn't letter for letter a canonical one."""
    rows = typed_names(matches, raw).join(teams.select("name").distinct(), "name", "left_anti")
    rows = durable(rows)
    counted = durable(rows.groupBy("name").agg(F.count("*").alias("n")))
    mapping = match_names(counted.select("name"), catalog_spellings(teams), threshold).select("name", F.col("id").alias("team_id"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    even = total / (HOT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Fewer names than HOT times the partitions can be borne by more than an even share of the rows.
    mapping = durable(mapping.join(counted, "name").select("name", "team_id", (F.col("n") > even).alias("hot")))
    hot = mapping.where("hot").select("name", F.col("team_id").alias("of_hot"))
    rest = mapping.where("not hot").select("name", "team_id")
    marked = rows.join(F.broadcast(hot), "name", "left")
    columns = ["name_field", "record_id", "event_no", "team_id"]
    done = marked.where("of_hot is not null").select(*columns[:3], F.col("of_hot").alias("team_id"))
    return done.unionByName(marked.where("of_hot is null").join(rest, "name").select(*columns))
