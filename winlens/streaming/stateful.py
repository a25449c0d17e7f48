"""Stateful streaming operators, one state per capture or log. Each equals a batch operator, and tests hold them together.

Order within a key is that of its sequence column. A key that gets no rows for `idle` seconds of processing time is over: what it holds
open comes out where the operator has a use for it, and its state goes, so state is bounded by the captures and logs that are alive. What comes
later under that key begins anew. Spark looks for idle keys in every batch, and makes batches without rows for that; with a trigger that
ends (availableNow), switch these off by spark.sql.streaming.noDataMicroBatches.enabled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from winlens.operators.policy import BENIGN, DECISIONS, Fold, Policy

_STATE = "state binary"
#: Seconds without rows after which a key is over.
IDLE = 3600.0
_EXPIRES = GroupStateTimeout.ProcessingTimeTimeout


def _load(state: GroupState, fresh):
    return pickle.loads(state.get[0]) if state.exists else fresh()


def _save(state: GroupState, value, idle: float) -> None:
    state.update((pickle.dumps(value),))
    state.setTimeoutDuration(int(idle * 1000))


def count_windows(frames: DataFrame, sizes: tuple[int, ...], means: list[str], end: str | None = None, idle: float = IDLE) -> DataFrame:
    """Kept frames (capture, o, ts, size, protocol, means) to windows of each size as they fill; o orders a capture's frames.

    Several sizes share one pass. The open window and the last instant are carried over. A row whose boolean column `end` is true is no
    frame: it tells that its capture is over, and the windows that are open then come out incomplete, as do those of an idle capture.
    """
    columns = ["ts", "size", "protocol", *means]

    def close(capture, size: int, win: int, rows: np.ndarray) -> tuple:
        ts, length, protocol = rows[:, 0], rows[:, 1], rows[:, 2]
        values, counts = np.unique(protocol, return_counts=True)
        span = ts.max() - ts.min()
        spread = float(length.var(ddof=1)) if len(rows) > 1 else None
        return (capture, size, win, len(rows), ts.min(), ts.max(), int(values[counts.argmax()]), len(rows) / span if span else float("inf"), int(length.sum()), float(length.mean()), spread, float(rows[:, -1].mean()), *rows[:, 3:-1].mean(0).tolist())

    names = ["capture", "window_size", "win", "number", "start_ts", "end_ts", "protocol_type", "rate", "tot_sum", "avg_size", "variance", "iat", *means]
    schema = "capture bigint, window_size int, win bigint, number bigint, start_ts double, end_ts double, protocol_type bigint, rate double, tot_sum bigint, avg_size double, variance double, iat double, " + ", ".join(f"`{m}` double" for m in means)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state, lambda: {"last": None, **{s: (0, np.zeros((0, len(columns) + 1))) for s in sizes}})
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([close(key[0], s, *held[s]) for s in sizes if len(held[s][1])], columns=names)
            return
        pdf = pd.concat(list(batches)).sort_values("o")
        over = end is not None and bool(pdf[end].any())
        pdf = pdf if end is None else pdf[~pdf[end].astype(bool)]
        rows = pdf[columns].to_numpy(float)
        if len(rows):
            before = np.concatenate([[rows[0, 0] if held["last"] is None else held["last"]], rows[:-1, 0]])
            held["last"] = float(rows[-1, 0])
        rows = np.column_stack([rows, rows[:, 0] - before]) if len(rows) else np.zeros((0, len(columns) + 1))
        out = []
        for s in sizes:
            win, left = held[s]
            left = np.concatenate([left, rows])
            while len(left) >= s:
                out.append(close(key[0], s, win, left[:s]))
                win, left = win + 1, left[s:]
            if over and len(left):
                out.append(close(key[0], s, win, left))
                win, left = win + 1, left[:0]
            held[s] = (win, left)
        if over:
            state.remove()
        else:
            _save(state, held, idle)
        yield pd.DataFrame(out, columns=names)

    return frames.groupBy("capture").applyInPandasWithState(run, schema, _STATE, "append", _EXPIRES)


def watch(windows: DataFrame, in_a_row: int, idle: float = IDLE) -> DataFrame:
    """(capture, win, category) to (.., opens): does this window complete a run of in_a_row attack windows?"""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        length = _load(state, int)
        pdf = pd.concat(list(batches)).sort_values("win")
        opens = []
        for c in pdf["category"]:
            length = 0 if c == BENIGN else length + 1
            opens.append(length == in_a_row)
        _save(state, length, idle)
        yield pdf.assign(opens=opens)[["capture", "win", "category", "opens"]]

    return windows.groupBy("capture").applyInPandasWithState(run, "capture bigint, win bigint, category string, opens boolean", _STATE, "append", _EXPIRES)


def score_stream(windows: DataFrame, predict, classes: tuple[str, ...], columns: list[str], threshold: float | None = None, lot: int = 512) -> DataFrame:
    """Windows with their category and its probability, scored as they arrive in lots of at most `lot`.

    predict gives an array (rows, classes) of probabilities for an array (rows, columns); it is sent to the tasks. With a threshold
    a window is an attack from that much probability outside the benign class, of the likeliest category of attack; else the
    likeliest class wins. Order is that of arrival; decide_stream puts a capture's windows in their order.
    """
    benign = classes.index(BENIGN)
    attacks = [i for i in range(len(classes)) if i != benign]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), lot):
                part = pdf.iloc[at : at + lot]
                p = np.asarray(predict(part[columns].to_numpy(np.float32)))
                best = p.argmax(1)
                if threshold is not None:
                    best = np.where(1 - p[:, benign] >= threshold - 1e-12, np.array(attacks)[p[:, attacks].argmax(1)], benign)
                yield part.assign(category=np.array(classes)[best], confidence=p[np.arange(len(part)), best])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return windows.mapInPandas(run, f"{schema}, category string, confidence double")


def decide_stream(windows: DataFrame, policy: Policy, idle: float = IDLE) -> DataFrame:
    """The incident policy over a stream of windows (capture, win, start_ts, end_ts, category, sources, targets)."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold, last = _load(state, lambda: (Fold(policy), None))
        out = []
        for r in pd.concat(list(batches)).sort_values("win").to_dict("records"):
            slow = r["end_ts"] - r["start_ts"] > policy.longest
            silent = last is not None and r["start_ts"] - last > policy.silence
            last = r["end_ts"]
            row = {**r, "first_win": r["win"], "last_win": r["win"], "unjudged": slow, "breaks": slow or silent, "sources": list(r["sources"] if r["sources"] is not None else []), "targets": list(r["targets"] if r["targets"] is not None else [])}
            out += [(key[0], *d[:6]) for d in fold.feed(row)]
        _save(state, (fold, last), idle)
        yield pd.DataFrame(out, columns=["capture", "first_win", "last_win", "kind", "incident", "benign_before", "at_win"]).astype({"incident": "Int64"})

    return windows.groupBy("capture").applyInPandasWithState(run, DECISIONS, _STATE, "append", _EXPIRES)


def answered(waiting: int, kind: str) -> int:
    """Proposals that wait after an event; an answer that nothing waits for changes nothing."""
    return max(0, waiting + {"proposed": 1, "executed": -1}.get(kind, 0))


_QUEUE = "log bigint, incident bigint, first_seq bigint, last_seq bigint, state string, windows bigint, tokens bigint, waiting bigint"


class Queue(StatefulProcessor):
    """Map state with an entry for each incident of a log, so an event reads and writes that of its own incident alone."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incidents = handle.getMapState("incidents", "incident bigint", _QUEUE.split(", ", 2)[2])
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[int, tuple] = {}
        for r in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            i = int(r["incident"])
            held = changed.get(i) or (self.incidents.getValue((i,)) if self.incidents.containsKey((i,)) else (int(r["seq"]), 0, "", 0, 0, 0))
            first, _, _, windows, tokens, waiting = held
            changed[i] = (first, int(r["seq"]), r["type"], windows + int(r["windows"]), tokens + int(r["tokens"]), answered(waiting, r["type"]))
        for i, value in changed.items():
            self.incidents.updateValue((i,), value)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000)
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame([(key[0], i, *v) for i, v in changed.items()], columns=[c.split()[0] for c in _QUEUE.split(", ")])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.incidents.clear()
        self.timer.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in _QUEUE.split(", ")])

    def close(self) -> None:
        pass


def incident_queue(events: DataFrame, idle: float = IDLE) -> DataFrame:
    """(log, incident, seq, type, windows, tokens) to the queue: after each batch a row for every incident that the batch has
    an event of, with its first and last event, its last type as state, totals so far, and the proposals that wait for an answer.

    The session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass), as Spark asks of map state.
    """
    return events.groupBy("log").transformWithStateInPandas(Queue(idle), StructType.fromDDL(_QUEUE), "Update", "ProcessingTime")


def running_log(events: DataFrame, idle: float = IDLE) -> DataFrame:
    """(log, seq, type, tokens) to totals after each batch: the last seq, events, tokens, proposals waiting."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, n, tokens, waiting = _load(state, lambda: (0, 0, 0, 0))
        pdf = pd.concat(list(batches)).sort_values("seq")
        seq, n, tokens = max(seq, int(pdf["seq"].max())), n + len(pdf), tokens + int(pdf["tokens"].sum())
        for kind in pdf["type"]:
            waiting = answered(waiting, kind)
        _save(state, (seq, n, tokens, waiting), idle)
        yield pd.DataFrame([(key[0], seq, n, tokens, waiting)], columns=["log", "seq", "n_events", "tokens", "waiting"])

    return events.groupBy("log").applyInPandasWithState(run, "log bigint, seq bigint, n_events bigint, tokens bigint, waiting bigint", _STATE, "update", _EXPIRES)
