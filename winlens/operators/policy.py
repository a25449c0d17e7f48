"""The incident policy: which attack windows open, join, close and reopen incidents of a capture.

The rules are a fold over a capture's windows in order. What reaches it is small: attack windows with their busiest addresses, and each
stretch of benign windows as one row (see `stretches`).

A capture of any length is folded in segments. After a silence and after a slow window nothing is open and nothing is pending, so a
segment that begins there depends on earlier ones in two ways only: it may reopen an incident that closed shortly before, and the
capture has room for so many incidents. `decide` folds segments side by side as if neither mattered, joins what each tried to open with
what earlier segments had closed, folds anew, as one, the segments between which something would have been reopened, and then those
that the room does not suffice for. It ends when nothing changes; the result is that of the fold from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from winlens.operators.ordered import running
from winlens.sources.scratch import materialize

BENIGN = "Benign"
ADDRESSES = "array<struct<addr:bigint,n:bigint>>"
DECISIONS = "capture bigint, first_win bigint, last_win bigint, kind string, incident bigint, benign_before bigint, at_win bigint"
#: What a fold tells besides: of an attempt to open when it began, and of an incident when it ended (kind `held`); its leading category and busiest addresses.
TOLD = "ts double, leader string, busiest array<bigint>"
#: Windows of a capture that are one task's work where it can be cut.
SEGMENT = 200_000


@dataclass(frozen=True)
class Policy:
    """in_a_row windows open an incident; close_after foreign windows close it; times in seconds."""

    in_a_row: int = 4
    close_after: int = 10
    silence: float = 60.0
    longest: float = 60.0
    reopen_within: float = 300.0
    most: int = 20
    top: int = 3
    refresh: int = 64
    keep_counters: int = 5_000
    counter_limit: int = 20_000


def add(votes: dict, more: dict) -> dict:
    """votes with those of more; keys stay in the order in which they were first seen."""
    for key, n in more.items():
        votes[key] = votes.get(key, 0) + n
    return votes


def leading(votes: dict, n: int) -> list:
    """The n keys with most votes, the first seen of equal ones."""
    if n == 1 and votes:
        return [max(votes, key=votes.get)]
    return sorted(votes, key=votes.get, reverse=True)[:n]


class Case:
    """An incident: votes for its category, source and target. It is open until the fold's clock reaches `due`."""

    def __init__(self, number: int):
        self.number, self.size, self.end = number, 0, 0.0
        self.votes: tuple[dict, dict, dict] = ({}, {}, {})
        self.due = self.calm_at = 0
        self.ranked_at, self.ranking = -1, frozenset()

    def leader(self) -> str:
        return leading(self.votes[0], 1)[0]

    def busiest(self, policy: Policy) -> frozenset:
        """Its top addresses, as they were ranked last; ranked anew after policy.refresh more windows."""
        if self.ranked_at < 0 or self.size >= self.ranked_at + policy.refresh:
            self.ranked_at, self.ranking = self.size, top_of(self.votes[1], self.votes[2], policy.top)
        return self.ranking


def top_of(sources: dict, targets: dict, n: int) -> frozenset:
    return frozenset(leading(add(dict(sources), targets), n))


class Sight:
    """One attack window: its row, votes, and the two addresses that lead it."""

    def __init__(self, row):
        self.row, self.category = row, row["category"]
        self.sources, self.targets = (x if isinstance(x := row[side], dict) else {y["addr"]: y["n"] for y in x} for side in ("sources", "targets"))
        self.ends = frozenset(a for side in (self.sources, self.targets) for a in leading(side, 1))


class Fold:
    """State of one segment; feed() takes rows of `stretches` in order.

    Time is a clock of judged windows: an incident's deadline is set at its last window, so those of others need not be counted for
    it one by one, and benign windows since then are the difference of two readings of `calm`.
    """

    def __init__(self, policy: Policy, room: int | None = None):
        self.policy, self.room = policy, policy.most if room is None else room
        self.cases: list[Case] = []
        self.open: list[Case] = []
        self.pending: list[Sight] = []
        self.clock = self.calm = 0
        self.deaf = False

    def feed(self, row) -> list[tuple]:
        """Decisions (first window, last window, kind, incident, benign windows that join, window at which it was taken, and what is told)."""
        first, last = row["first_win"], row["last_win"]
        if row["breaks"]:
            self.open = []
        if row["breaks"] or row["category"] == BENIGN:
            self.pending, self.deaf = [], False
        if row["unjudged"]:
            return [(first, last, "unjudged", None, 0, first, None, None, None)]
        if row["category"] != BENIGN:
            return self.attack(Sight(row))
        busy = max((c.due for c in self.open), default=self.clock) - self.clock  # windows until the last one is closed
        self.pass_by(last - first + 1)
        self.calm += last - first + 1
        return [(first + busy, last, "background", None, 0, first, None, None, None)] if first + busy <= last else []

    def pass_by(self, n: int) -> None:
        self.clock += n
        self.open = [c for c in self.open if c.due > self.clock]

    def attack(self, sight: Sight) -> list[tuple]:
        owner = self.owner_of(sight)
        if owner is not None:
            owner.due = self.clock + 1 + self.policy.close_after
        self.pass_by(1)
        if owner is not None:
            return [self.join(owner, sight, sight)]
        if self.deaf:
            return []
        self.pending = [*self.pending, sight][-self.policy.in_a_row :]
        return self.settle(sight) if len(self.pending) == self.policy.in_a_row else []

    def owner_of(self, sight: Sight) -> Case | None:
        for case in self.open:
            if case.leader() == sight.category:
                return case
        for case in self.open:
            if sight.ends & case.busiest(self.policy):
                return case
        return None

    def settle(self, now: Sight) -> list[tuple]:
        """The pending windows are enough: the related ones go to a closed incident, to a new one, or, without room, nowhere."""
        votes: dict = {}
        for s in self.pending:
            add(votes, {s.category: 1})
        leader = leading(votes, 1)[0]
        shared = frozenset().union(*(s.ends for s in self.pending if s.category == leader))
        related = [s for s in self.pending if s.category == leader or s.ends & shared]
        self.pending = [s for s in self.pending if s not in related]
        sources, targets, categories = {}, {}, {}
        for s in related:
            add(sources, s.sources), add(targets, s.targets), add(categories, {s.category: 1})
        leader, busiest = leading(categories, 1)[0], top_of(sources, targets, self.policy.top)
        began, at = related[0].row["start_ts"], now.row["first_win"]
        told = began, leader, sorted(busiest)
        case, kind = self.closed_before(began, leader, busiest), "reopen"
        if case is None:
            if len(self.cases) >= self.room:
                self.deaf = True
                return [(at, at, "over cap", None, 0, at, *told)]
            case, kind = Case(len(self.cases)), "open"
            self.cases.append(case)
        case.calm_at, case.due = self.calm, self.clock + self.policy.close_after
        self.open.append(case)
        return [(related[0].row["first_win"], at, kind, case.number, 0, at, *told), *(self.join(case, s, now) for s in related)]

    def closed_before(self, began: float, leader: str, busiest: frozenset) -> Case | None:
        """The closed incident that ended last, if that is not long ago, of those with this leader and one of these addresses."""
        found = None
        for case in self.cases:
            near = case not in self.open and began - case.end <= self.policy.reopen_within
            if near and (found is None or case.end > found.end) and case.leader() == leader and busiest & case.busiest(self.policy):
                found = case
        return found

    def join(self, case: Case, sight: Sight, now: Sight) -> tuple:
        benign = self.calm - case.calm_at
        for votes, more in zip(case.votes, ({sight.category: 1}, sight.sources, sight.targets), strict=True):
            add(votes, more)
        case.votes = (case.votes[0], *(v if len(v) <= self.policy.counter_limit else {a: v[a] for a in leading(v, self.policy.keep_counters)} for v in case.votes[1:]))
        case.size, case.end, case.calm_at = case.size + 1, sight.row["end_ts"], self.calm
        return sight.row["first_win"], sight.row["first_win"], "attack", case.number, benign, now.row["first_win"], None, None, None

    def held(self) -> list[tuple]:
        """All incidents as they are at the end."""
        return [(None, None, "held", c.number, 0, None, c.end, c.leader(), sorted(c.busiest(self.policy))) for c in self.cases]


def stretches(windows: DataFrame, policy: Policy, by: list[str] = ("capture",), chunk: int = SEGMENT) -> DataFrame:
    """Windows (by, win, start_ts, end_ts, category, sources, targets) with benign stretches run-length coded.

    A row breaks if silence precedes its first window or that window is slow; a slow window is a row of its own. Stretches end at multiples
    of chunk, so a capture of any length is spread over many tasks; what a chunk's first window follows comes from a table of chunks.
    """
    slow = F.col("end_ts") - F.col("start_ts") > policy.longest
    alone = slow | (F.col("category") != BENIGN)
    rows = windows.withColumns({"chunk": F.floor(F.col("win") / chunk), "unjudged": slow, "alone": alone})
    ends = rows.groupBy(*by, "chunk").agg(F.max_by("end_ts", "win").alias("end_"))
    before = ends.select(*by, "chunk", F.lag("end_").over(Window.partitionBy(*by).orderBy("chunk")).alias("end_before"))
    w = Window.partitionBy(*by, "chunk").orderBy("win")
    last_end = F.coalesce(F.lag("end_ts").over(w), F.col("end_before"))
    silent = F.coalesce(F.col("start_ts") - last_end > policy.silence, F.lit(False))
    rows = rows.join(before, [*by, "chunk"]).withColumn("breaks", silent | F.col("unjudged"))
    begins = F.col("breaks") | F.col("alone") | F.lag("alone", 1, True).over(w)
    rows = rows.withColumn("part", F.sum(begins.cast("int")).over(w))
    one = lambda c: F.min_by(c, "win").alias(c)
    return rows.groupBy(*by, "chunk", "part").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), one("category"), one("breaks"), one("unjudged"), one("sources"), one("targets")).drop("chunk", "part").withColumns(
        {c: F.when((F.col("category") != BENIGN) & ~F.col("unjudged"), F.col(c)).otherwise(F.array().cast(ADDRESSES)) for c in ("sources", "targets")})


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of `stretches` with sources and targets as counts by address; flat columns are converted, not a record for each address."""
    columns = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name in ("sources", "targets"):
            ends, addrs, counts = column.offsets.to_pylist(), column.values.field(0).to_pylist(), column.values.field(1).to_pylist()
            columns[name] = [dict(zip(addrs[a:b], counts[a:b], strict=True)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            columns[name] = column.to_pylist()
    names = list(columns)
    for values in zip(*columns.values(), strict=True):
        yield dict(zip(names, values, strict=True))


def fold_all(parts: DataFrame, policy: Policy, by: list[str], group: str | None = None, told: bool = False) -> DataFrame:
    """Decisions of each key (and group, where parts have a column of it, and room); with told, all that a fold tells."""
    keys = [*by, *([group] if group else [])]
    decided = [f for f in DECISIONS.split(", ")[1:]]
    schema = ", ".join([*(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys), *decided, *([TOLD] if told else [])])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    width = len(decided) + (3 if told else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, found = None, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)] if found else [pa.array([], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for row in rows_of(batch):
                key = tuple(row[k] for k in keys)
                if key != now:
                    if told and state:
                        found += [(*now, *d) for d in state.held()]
                    now, state = key, Fold(policy, row.get("room"))
                found += [(*key, *d[:width]) for d in state.feed(row)]
            yield table()
            found = []
        if told and state:
            found += [(*now, *d) for d in state.held()]
        yield table()

    return parts.repartition(*keys).sortWithinPartitions(*keys, "first_win").mapInArrow(run, schema)


def decide(parts: DataFrame, policy: Policy, by: tuple[str, ...] = ("capture",), segment: int | None = SEGMENT) -> DataFrame:
    """Decisions of all captures (or of all keys in `by`, the first of which is the capture).

    Captures with more than `segment` rows are folded in segments; without one, each capture is one task's work.
    """
    by = list(by)
    if segment is None:
        return fold_all(parts, policy, by)
    parts = materialize(parts, "stretches")
    long = materialize(parts.groupBy(*by).count().filter(F.col("count") > segment).select(*by), "long-captures")
    if not long.limit(1).count():
        return fold_all(parts, policy, by)
    whole = fold_all(parts.join(long, by, "left_anti"), policy, by)
    return whole.unionByName(decide_segments(parts.join(long, by, "left_semi"), policy, by))


def decide_segments(parts: DataFrame, policy: Policy, by: list[str]) -> DataFrame:
    """Decisions of captures that are folded in segments, glued where one would reopen what another had closed."""
    parts = materialize(running(parts.withColumn("_b", F.col("breaks").cast("int")), by, ["first_win"], {"segment": "_b"}).drop("_b", "row"), "segments")
    groups = parts.select(*by, "segment").distinct().withColumns({"grp": F.col("segment"), "room": F.lit(policy.most)})
    groups, told = materialize(groups, "groups"), None
    changed = groups.select(*by, "grp").distinct()
    while True:
        todo = parts.join(groups, [*by, "segment"]).join(changed, [*by, "grp"], "left_semi")
        fresh = fold_all(todo, policy, by, "grp", True)
        if told is not None:  # what was told of groups that are no more, or are folded again, goes
            same = groups.select(*by, "grp").distinct().join(changed, [*by, "grp"], "left_anti")
            fresh = told.join(same, [*by, "grp"], "left_semi").unionByName(fresh)
        told = materialize(fresh, "told")
        glued = materialize(conflicts(told, policy, by), "glued")
        new = groups
        if glued.limit(1).count():
            into = new.join(glued, by, "left").filter(F.col("from_grp").isNull() | F.col("grp").between(F.col("from_grp"), F.col("to_grp")))
            into = into.select(*by, "segment", F.col("from_grp").alias("into")).filter("into is not null")
            new = new.join(into, [*by, "segment"], "left").select(*by, "segment", F.coalesce("into", "grp").alias("grp"), F.when(F.col("into").isNull(), F.col("room")).otherwise(policy.most).alias("room"))
        else:
            opened = told.filter("kind = 'open'").groupBy(*by, "grp").agg(F.count("*").alias("opened"))
            each = new.select(*by, "grp", "room").distinct().join(opened, [*by, "grp"], "left").fillna(0, ["opened"])
            before = running(each, by, ["grp"], {"until": "opened"}).withColumn("left", F.greatest(F.lit(0), policy.most - (F.col("until") - F.col("opened"))))
            rooms = before.select(*by, "grp", F.when((F.col("opened") > F.col("left")) | (F.col("room") < policy.most), F.col("left")).otherwise(F.col("room")).cast("int").alias("now"))
            new = new.join(rooms, [*by, "grp"]).select(*by, "segment", "grp", F.col("now").alias("room"))
        new = materialize(new, "groups")
        changed = materialize(new.select(*by, "grp", "room").distinct().join(groups.groupBy(*by, "grp", "room").agg(F.count("*").alias("n")).join(new.groupBy(*by, "grp", "room").agg(F.count("*").alias("n")), [*by, "grp", "room", "n"]), [*by, "grp", "room"], "left_anti").select(*by, "grp"), "changed")
        groups = new
        if not changed.limit(1).count():
            break
    opened = told.filter("kind <> 'held'").groupBy(*by, "grp").agg(F.count_if(F.col("kind") == "open").alias("opened"))
    before = running(opened, by, ["grp"], {"until": "opened"}).select(*by, "grp", (F.col("until") - F.col("opened")).alias("_before"))
    out = told.filter("kind <> 'held'").join(before, [*by, "grp"])
    return out.select(*by, "first_win", "last_win", "kind", (F.col("incident") + F.col("_before")).alias("incident"), "benign_before", "at_win")


def conflicts(told: DataFrame, policy: Policy, by: list[str]) -> DataFrame:
    """(by, from_grp, to_grp): runs of groups that must be one, as an incident of one would be reopened in a later one.

    Times meet in spans of policy.reopen_within, so a join key has few incidents.
    """
    span = lambda c: F.floor(c / policy.reopen_within)
    held = told.filter("kind = 'held'").select(*by, F.col("grp").alias("from_grp"), F.col("ts").alias("end_"), "leader", F.col("busiest").alias("theirs"), F.explode(F.array(span(F.col("ts")), span(F.col("ts")) + 1)).alias("span"))
    tried = told.filter("kind in ('open', 'over cap')").select(*by, F.col("grp").alias("to_grp"), "ts", "leader", "busiest", span(F.col("ts")).alias("span"))
    met = tried.join(held, [*by, "leader", "span"]).filter((F.col("from_grp") < F.col("to_grp")) & (F.col("ts") - F.col("end_") <= policy.reopen_within) & F.arrays_overlap("busiest", "theirs"))
    spans = met.groupBy(*by, "to_grp").agg(F.min("from_grp").alias("from_grp"))
    w = Window.partitionBy(*by).orderBy("from_grp", "to_grp")
    reach = F.max("to_grp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("from_grp") > reach, F.lit(True)).cast("int")
    islands = spans.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*by, "_island").agg(F.min("from_grp").alias("from_grp"), F.max("to_grp").alias("to_grp")).drop("_island")


def background_windows(decisions: DataFrame) -> DataFrame:
    """(capture, win) of benign windows seen while no incident was open."""
    return decisions.filter("kind = 'background'").select("capture", F.explode(F.sequence("first_win", "last_win")).alias("win"))


def incident_windows(decisions: DataFrame, by: tuple[str, ...] = ("capture",)) -> DataFrame:
    """(capture, incident, win, at_win, benign_before): at_win is the window at which it joined."""
    return decisions.filter("kind = 'attack'").select(*by, "incident", F.col("first_win").alias("win"), "at_win", "benign_before")


def snapshot(decisions: DataFrame) -> DataFrame:
    """incident_windows as they were when the incident opened."""
    opened = decisions.filter("kind = 'open'").select("capture", "incident", F.col("at_win").alias("opened_at"))
    return incident_windows(decisions).join(opened, ["capture", "incident"]).filter(F.col("at_win") <= F.col("opened_at"))
