"""Random forests over tables of any size, grown level by level and handed over as Spark ML's models.

The method is that of Spark ML's RandomForestClassifier: bags by Poisson draws, at most 32 bins a feature, Gini gains, as many features at
a node as the square root of all, leaves of one parent merged where they predict alike. What differs is how rows are kept and visited: in
blocks of one byte for each feature, and of each tree only the rows of its bag that have not reached a leaf.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.sources.scratch import delete, discard, materialize, shared_dir

BINS = 32
#: Rows of a block; a tree's work on a block stays in a core's cache.
BLOCK = 1 << 14
#: Points that a sketch of a feature's values keeps inside a task, and hands over.
POINTS, SENT_POINTS = 4096, 1024
#: Cells of histograms that a task adds up at once, 8 bytes each; trees that need more are dealt to several passes.
CELLS = 1 << 24
#: Nodes whose histograms are added up together after the shuffle.
CHUNK = 256
#: The nodes that rows have reached are written down when no more than this share of those in the table, of that many rows or more, are not in
#: leaves; others go down from where they were, which takes less time than reading where they are.
SETTLE_SHARE, SETTLE_ROWS = 0.4, 1 << 20
TABLE = ["block", "n", "codes", "weights", "reached"]
TABLE_SCHEMA = "block long, n int, codes binary, weights binary, reached binary"
#: A row of the table may have megabytes, so its writer looks at its buffers after each.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: How often a row is drawn, by 16 random bits: the Poisson distribution of mean 1.
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def condensed(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their weights; of more than `points` the last of each share of 1 / points of all weight stands for it."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    if not len(v):
        return v, w
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    v, w = v[first], np.add.reduceat(w, first)
    if len(v) > points:
        up_to = np.cumsum(w)
        share = ((up_to - w / 2) * (points / max(up_to[-1], 1e-300))).astype(np.int64)
        last = np.flatnonzero(np.r_[share[1:] != share[:-1], True])
        v, w = v[last], np.diff(up_to[last], prepend=0.0)
    return v, w


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between bins: between all values if they are few, and else, as Spark ML has it, where shares of equal weight end; a value that
    outweighs several shares leaves their thresholds to the values after it.
    """
    n = bins - 1
    at = np.arange(len(values) - 1)
    if len(at) > n:
        up_to = np.cumsum(weights).tolist()
        stride = up_to[-1] / (n + 1)
        at, want = [], stride
        for i in range(1, len(up_to)):
            if abs(up_to[i - 1] - want) < abs(up_to[i] - want):
                at.append(i - 1)
                want += stride
        at = np.array(at, np.int64)
    return (values[at] + values[at + 1]) / 2


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    """Rows by the part that they were dealt to, which leads their id: whether a part begins, ids and the other columns. What is made of a part
    does not depend on the parts that a task reads with it.
    """
    now = None
    for b in batches:
        ids, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        part = ids >> 33
        ends = [0, *(np.flatnonzero(np.diff(part)) + 1), len(ids)]
        for a, e in zip(ends, ends[1:], strict=False):
            if a < e:
                yield part[a] != now, ids[a:e], [c[a:e].astype(np.float64) for c in x]
                now = part[a]


def survey(rows: DataFrame, columns: list[str], label: str, weight: str | None) -> tuple[list[np.ndarray], int, int]:
    """Thresholds of every column from sketches of all rows, the number of classes, and of rows."""
    names, of = ["id", *columns, label, *([weight] if weight else [])], range(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n_waiting, top, n = None, [], 0, -1, 0

        def condense():
            nonlocal kept, waiting, n_waiting
            held = kept or [(np.empty(0), np.empty(0))] * len(columns)
            kept = [condensed(np.concatenate([held[i][0], *(x[i] for x, _ in waiting)]), np.concatenate([held[i][1], *(w for _, w in waiting)]), POINTS) for i in of]
            waiting, n_waiting = [], 0

        def told():
            condense()
            out = [condensed(*k, SENT_POINTS) for k in kept]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([v.tobytes() for v, _ in out], pa.binary()), pa.array([w.tobytes() for _, w in out], pa.binary()), pa.array([top] * len(columns), pa.int32()), pa.array([n] * len(columns))], ["column", "v", "w", "top", "n"])

        for begins, _, x in runs(batches):
            if begins and top >= 0:
                yield told()
                kept, n = None, 0
            y, w = x[len(columns)], x[-1] if weight else np.ones(len(x[0]))
            if not (np.isfinite(y).all() and (y >= 0).all() and (y == np.floor(y)).all()):
                raise ValueError("labels of a forest are numbers of classes from 0")
            if not (np.isfinite(w).all() and (w >= 0).all()):
                raise ValueError("weights of a forest are no less than 0")
            top = max(top, int(y.max()))
            waiting.append((x, w))
            n_waiting, n = n_waiting + len(y), n + len(y)
            if n_waiting >= 1 << 18:
                condense()
        if top >= 0:
            yield told()

    found = rows.select(*names).mapInArrow(run, "column int, v binary, w binary, top int, n long").collect()
    n_classes = max((r["top"] for r in found), default=-1) + 1
    if not n_classes:
        raise ValueError("a forest needs rows to train on")
    cuts = []
    for i in of:
        mine = [r for r in found if r["column"] == i]
        cuts.append(cut_points(*condensed(*(np.concatenate([np.frombuffer(r[k]) for r in mine]) for k in "vw"), POINTS)))
    return cuts, n_classes, sum(r["n"] for r in found if not r["column"])


def blocks(rows: DataFrame, columns: list[str], cuts: list[np.ndarray], label: str, n_classes: int, weight: str | None) -> DataFrame:
    """(block, n, codes, weights, reached): of each of n rows and each column bin * n_classes + label, column by column. A block has the id
    of its first row; reached is what `settled` fills in."""
    kind, names = code_type(cuts, n_classes), ["id", *columns, label, *([weight] if weight else [])]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def packed(least):
            nonlocal held, n_held
            ids, codes, w = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
            at = 0
            while n_held - at >= least:
                c, v = codes[:, at : at + BLOCK], w[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 1]), pa.array([c.shape[1]], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([v.tobytes() if weight else None], pa.binary()), pa.array([None], pa.binary())], TABLE)
                at += c.shape[1]
            held, n_held = [(ids[at:], codes[:, at:], w[at:])], n_held - at

        for begins, ids, x in runs(batches):
            if begins and n_held:
                yield from packed(1)
                held = []
            codes = np.empty((len(columns), len(ids)), kind)
            for i, c in enumerate(cuts):
                codes[i] = np.searchsorted(c, x[i]) * n_classes + x[len(columns)]
            held.append((ids, codes, x[-1] if weight else np.empty(len(ids))))
            n_held += len(ids)
            if n_held >= BLOCK:
                yield from packed(BLOCK)
        if n_held:
            yield from packed(1)

    return rows.select(*names).mapInArrow(run, TABLE_SCHEMA)


def code_type(cuts: list[np.ndarray], n_classes: int) -> type:
    return np.min_scalar_type((max(map(len, cuts), default=0) + 1) * n_classes).type


class Level:
    """The nodes of all trees that are tried at a depth, by tree, and what is drawn for them; `next` tells where their rows go on."""

    def __init__(self, trees: int, tree: np.ndarray, chosen: np.ndarray):
        """chosen: of each node and column whether the node may use it; every node has one."""
        self.tree, self.start = tree, np.searchsorted(tree, np.arange(trees + 1))
        at, self.pair_column = np.nonzero(chosen)
        self.n_pairs = chosen.sum(axis=1)
        self.pair_start = np.r_[0, np.cumsum(self.n_pairs)]
        self.column = self.threshold = self.next = None

    def pairs(self, t: int, chunk: int | None = None) -> tuple[int, int, int, int]:
        """Begin and end of the nodes of a tree, or of a chunk of them, and of their pairs of node and column."""
        a, b = self.start[t], self.start[t + 1]
        if chunk is not None:
            a, b = a + chunk * CHUNK, min(b, a + (chunk + 1) * CHUNK)
        return a, b, self.pair_start[a], self.pair_start[b]

    def route(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.start[t], self.start[t + 1]
        return self.column[a:b], self.threshold[a:b], self.next[2 * a : 2 * b]

    def tried(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first pair of each node of a tree, the columns of its pairs, and whether the next pair is of the same node."""
        a, b, p, q = self.pairs(t)
        more = np.ones(q - p, bool)
        more[self.pair_start[a + 1 : b + 1] - p - 1] = False
        return self.pair_start[a:b] - p, self.pair_column[p:q], more


def bag(seed: int, tree: int, block: int, n: int, bagged: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that a tree has drawn, and how often."""
    if not bagged:
        return np.arange(n), np.ones(n)
    bits = np.random.SFC64([seed % (1 << 64), tree, block]).random_raw(n // 4 + 1).view(np.uint16)[:n]
    times = DRAWS.take(bits)
    rows = np.flatnonzero(times != 0)
    return rows, times.take(rows).astype(np.float64)


def visits(batches: Iterator[pa.RecordBatch], routes: dict[int, list], seed: int, kind: type, bagged: bool) -> Iterator[tuple]:
    """Of every block and tree of routes: the place of the block in its batch, tree, codes, the rows of the bag that are not in a leaf, how often they
    were drawn, and their nodes. Routes begin at the root, or where the block's rows were settled.
    """
    for b in batches:
        for i in range(b.num_rows):
            block, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            codes = np.frombuffer(b.column(2)[i].as_buffer(), kind)
            held = unpacked(b.column(4)[i].as_buffer()) if b.column(4)[i].is_valid else None
            for t, route in routes.items():
                if held:
                    rows, times, node = held(t)
                else:
                    rows, times = bag(seed, t, block, n, bagged)
                    node = np.zeros(len(rows), np.int64)
                for column, threshold, goes_on in route:
                    node = goes_on.take(2 * node + (codes.take((column * n).take(node) + rows) >= threshold.take(node)))
                    on = np.flatnonzero(node >= 0)
                    if len(on) < len(node):
                        rows, times, node = rows.take(on), times.take(on), node.take(on)
                yield b, i, t, n, codes, rows, times, node


def unpacked(raw) -> Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Reads what `settled` packs: rows, times drawn and nodes of a tree."""
    trees = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.r_[0, np.cumsum(np.frombuffer(raw, np.int64, trees, 8))]
    at, n = 8 * (trees + 1), ends[-1]
    row, node, times = np.frombuffer(raw, np.uint16, n, at), np.frombuffer(raw, np.uint16, n, at + 2 * n), np.frombuffer(raw, np.uint8, n, at + 4 * n)
    return lambda t: (row[ends[t] : ends[t + 1]].astype(np.int64), times[ends[t] : ends[t + 1]].astype(np.float64), node[ends[t] : ends[t + 1]].astype(np.int64))


def settled(table: DataFrame, levels: list[Level], trees: int, seed: int, kind: type, bagged: bool) -> DataFrame:
    """The table with the nodes of the last level that the rows of each tree have reached."""
    routes = {t: [x.route(t) for x in levels[:-1]] for t in range(trees)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b, i, t, _, _, rows, times, node in visits(batches, routes, seed, kind, bagged):
            held.append((rows.astype(np.uint16), node.astype(np.uint16), times.astype(np.uint8)))
            if t == trees - 1:
                raw = b"".join([np.array([trees, *(len(h[0]) for h in held)], np.int64).tobytes(), *(h[k].tobytes() for k in range(3) for h in held)])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(4)), pa.array([raw], pa.binary())], TABLE)
                held = []

    return table.mapInArrow(run, TABLE_SCHEMA)


def histograms(table: DataFrame, levels: list[Level], group: list[int], seed: int, cells: int, kind: type, bagged: bool) -> DataFrame:
    """(tree, chunk, at, n): weights of all that reaches the nodes of the last level, by pair of node and column, bin and class; of each task
    those cells that are not empty. `cells` is the number of bins and classes of a pair; levels begin with the one at which the table is settled.
    """
    routes = {t: [x.route(t) for x in levels[:-1]] for t in group}
    tried = {t: levels[-1].tried(t) for t in group}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros(len(tried[t][1]) * cells) for t in group}
        for b, i, t, n, codes, rows, times, node in visits(batches, routes, seed, kind, bagged):
            first, columns, more = tried[t]
            w = times * np.frombuffer(b.column(3)[i].as_buffer()).take(rows) if b.column(3)[i].is_valid else times
            count(sums[t], codes, rows, w, first.take(node), columns * n, more, cells)
        for t in group:
            first, columns, _ = tried[t]
            for chunk, a in enumerate(range(0, len(first), CHUNK)):
                p, q = first[a] * cells, (first[a + CHUNK] if a + CHUNK < len(first) else len(columns)) * cells
                at = np.flatnonzero(sums[t][p:q])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([chunk], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([sums[t][p:q][at].tobytes()], pa.binary())], ["tree", "chunk", "at", "n"])

    return table.mapInArrow(run, "tree int, chunk int, at binary, n binary")


def count(sums: np.ndarray, codes: np.ndarray, rows: np.ndarray, w: np.ndarray, pair: np.ndarray, begin: np.ndarray, more: np.ndarray, cells: int) -> None:
    """Adds rows to the cells of the pairs of their node, from its first on; begin: where a pair's column begins, more: whether another pair follows."""
    while len(rows):
        np.add.at(sums, pair * cells + codes.take(begin.take(pair) + rows), w)
        on = np.flatnonzero(more.take(pair))
        if len(on) < len(pair):
            rows, w, pair = rows.take(on), w.take(on), pair.take(on)
        pair = pair + 1


def best_splits(found: DataFrame, level: Level, n_bins: int, n_classes: int) -> pa.Table:
    """(node, column, bin, gain, below, above) of each node: its best split, and class weights on both sides of it."""
    schema = "node long, column int, bin int, gain double, below array<double>, above array<double>"

    def gini(x):
        with np.errstate(all="ignore"):
            return 1 - ((x / x.sum(axis=-1, keepdims=True)) ** 2).sum(axis=-1)

    def run(rows: pa.Table) -> pa.Table:
        a, b, p, q = level.pairs(rows.column("tree")[0].as_py(), rows.column("chunk")[0].as_py())
        cells = np.zeros((q - p) * n_bins * n_classes)
        for at, n in zip(rows.column("at"), rows.column("n"), strict=True):
            cells[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer())
        up_to = cells.reshape(q - p, n_bins, n_classes).cumsum(axis=1)
        below, whole = up_to[:, :-1], up_to[:, -1:]
        above = np.maximum(whole - below, 0)
        n_below, n_above, n = below.sum(axis=2), above.sum(axis=2), whole.sum(axis=2)
        with np.errstate(all="ignore"):
            gain = gini(whole) - n_below / n * gini(below) - n_above / n * gini(above)
        gain[(n_below <= 1e-12 * n) | (n_above <= 1e-12 * n)] = -1.0
        cut = gain.argmax(axis=1)
        pair = np.arange(q - p)
        top, node = gain[pair, cut], np.repeat(np.arange(a, b), level.n_pairs[a:b])
        order = np.lexsort((-top, node))  # stable: of equal gains the first column's
        best = order[np.searchsorted(node[order], np.arange(a, b))]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[best, cut[best]].ravel()), n_classes).cast(pa.list_(pa.float64())) for x in (below, above)]
        return pa.table([pa.array(np.arange(a, b)), pa.array(level.pair_column[p:q][best].astype(np.int32)), pa.array(cut[best].astype(np.int32)), pa.array(top[best]), *lists], ["node", "column", "bin", "gain", "below", "above"])

    return found.groupBy("tree", "chunk").applyInArrow(run, schema).toArrow().sort_by("node")


def grow(table: DataFrame, cuts: list[np.ndarray], n_columns: int, n_classes: int, trees: int, seed: int, depth: int, bagged: bool, settle: bool) -> dict[str, np.ndarray]:
    """Nodes of all trees, parents before their children: tree, level, column (-1 in a leaf), cut, gain, left, right and classes.

    cuts are those of the columns that have any; n_columns counts those without, which are drawn for a node as well and give no split.
    settle: whether the nodes that rows have reached are written down now and then.
    """
    n_bins, kind = max(2, max(map(len, cuts), default=0) + 1), code_type(cuts, n_classes)
    at_once = n_columns if trees == 1 else math.ceil(math.sqrt(n_columns))

    def drawn(level, n):
        """Of each of n nodes the columns that it may use, of those with cuts."""
        u = np.random.default_rng([seed % (1 << 64), level]).random((n, n_columns))
        return (u.argsort(axis=1).argsort(axis=1) < at_once)[:, : len(cuts)]

    made = {k: [] for k in ("tree", "level", "column", "cut", "gain", "left", "right", "classes")}

    def add(level, tree, classes):
        n = len(tree)
        for k, v in (("tree", tree), ("level", np.full(n, level)), ("column", np.full(n, -1)), ("cut", np.zeros(n, np.int64)), ("gain", np.full(n, -1.0)), ("left", np.full(n, -1)), ("right", np.full(n, -1)), ("classes", classes)):
            made[k].append(v)

    roots = np.arange(trees)
    add(0, roots, np.zeros((trees, n_classes)))
    chosen = drawn(0, trees)
    barren = ~chosen.any(axis=1)
    if not cuts:
        chosen = np.ones((trees, 1), bool)
    chosen[barren, 0] = True  # counted for their classes alone
    levels, places, n_nodes, held = [Level(trees, roots, chosen)], roots, trees, 0.0
    for level in range(max(depth, 1)):
        now = levels[-1]
        parts, at = [], 0
        pairs = np.diff(now.pair_start[now.start])
        while at < trees:  # trees whose histograms fit in a task
            end = at + max(1, int(np.searchsorted(np.cumsum(pairs[at:]) * n_bins * n_classes, CELLS, "right")))
            group = [t for t in range(at, min(end, trees)) if pairs[t]]
            if group:
                parts.append(best_splits(histograms(table, levels, group, seed, n_bins * n_classes, kind, bagged), now, n_bins, n_classes))
            at = end
        best = pa.concat_tables(parts).sort_by("node")
        column, cut, gain = (best.column(k).to_numpy().astype(t) for k, t in (("column", np.int64), ("bin", np.int64), ("gain", np.float64)))
        sides = [np.array(best.column(k).combine_chunks().flatten()).reshape(-1, n_classes) for k in ("below", "above")]
        if not level:
            made["classes"][0] = sides[0] + sides[1]
            gain[barren] = -1.0
        split = (gain > 0) & (level < depth)
        now.column, now.threshold, now.next = column, ((cut + 1) * n_classes).astype(kind), np.full(2 * len(gain), -1)
        # children of all nodes that are split, left and right beside each other
        tree, classes = np.repeat(now.tree[split], 2), np.stack(sides, axis=1)[split].reshape(-1, n_classes)
        child = n_nodes + np.arange(len(tree))
        of_split = places[split] - (n_nodes - len(made["tree"][-1]))
        for k, v in (("column", column[split]), ("cut", cut[split]), ("gain", gain[split]), ("left", child[::2]), ("right", child[1::2])):
            made[k][-1][of_split] = v
        add(level + 1, tree, classes)
        chosen = drawn(level + 1, len(tree)) if cuts else np.zeros((len(tree), 1), bool)
        goes_on = ((classes > 0).sum(axis=1) > 1) & chosen.any(axis=1) & (level + 1 < depth)
        # a row's next node is counted from its tree's first
        following = Level(trees, tree[goes_on], chosen[goes_on])
        numbers = np.full(len(tree), -1)
        numbers[goes_on] = np.arange(goes_on.sum()) - following.start[following.tree]
        now.next[np.repeat(split, 2)] = numbers
        levels.append(following)
        places, n_nodes = child[goes_on], n_nodes + len(tree)
        if not len(places):
            break
        held, alive = held if level else made["classes"][0].sum(), classes[goes_on].sum()
        if settle and alive <= SETTLE_SHARE * held and level + 1 <= 16:  # nodes of a tree by 16 bits
            held = alive
            before, table = table, materialize(settled(table, levels, trees, seed, kind, bagged), "forest-settled", **LARGE_ROWS)
            discard(before)
            levels = levels[-1:]
    discard(table)
    return {k: np.concatenate(v) for k, v in made.items()}


def pruned(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Without leaves of one parent that predict alike, and with place: a node's number in its tree, which Spark ML counts depth first."""
    said = nodes["classes"].argmax(axis=1)
    column, left, right, level = nodes["column"].copy(), nodes["left"], nodes["right"], nodes["level"]
    size = np.ones(len(said), np.int64)
    by_level = [np.flatnonzero(level == i) for i in range(level.max() + 1)]
    for at in reversed(by_level):
        at = at[column[at] >= 0]
        a, b = left[at], right[at]
        alike = (column[a] < 0) & (column[b] < 0) & (said[a] == said[b])
        column[at[alike]] = -1
        at, a, b = at[~alike], a[~alike], b[~alike]
        size[at] = 1 + size[a] + size[b]
    place = np.where(level == 0, 0, -1)  # -1: no longer in its tree
    for at in by_level:
        at = at[(column[at] >= 0) & (place[at] >= 0)]
        place[left[at]] = place[at] + 1
        place[right[at]] = place[at] + 1 + size[left[at]]
    return {**nodes, "column": column, "place": place, "said": said}


def as_model(spark: SparkSession, nodes: dict[str, np.ndarray], cuts: list[np.ndarray], numbers: list[int], n_columns: int, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """The trees as Spark ML's model, read from files of its own format; numbers: the places of the columns with cuts among all."""
    nodes = pruned(nodes)
    keep = np.flatnonzero(nodes["place"] >= 0)
    keep = keep[np.lexsort((nodes["place"][keep], nodes["tree"][keep]))]
    tree, column, classes, place = (nodes[k][keep] for k in ("tree", "column", "classes", "place"))
    inner, n = column >= 0, classes.sum(axis=1)
    with np.errstate(all="ignore"):
        impurity = np.where(n > 0, 1 - ((classes / n[:, None]) ** 2).sum(axis=1), 0.0)
    child = {k: np.where(inner, nodes["place"][nodes[k][keep]], -1).astype(np.int32) for k in ("left", "right")}
    thresholds = [cuts[c][b] for c, b in zip(column[inner], nodes["cut"][keep][inner], strict=True)]
    offsets = np.r_[0, np.cumsum(inner)].astype(np.int32)
    split = pa.StructArray.from_arrays([pa.array(np.where(inner, np.array([*numbers, -1])[column], -1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(thresholds, pa.float64())), pa.array(np.full(len(keep), -1, np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.ListArray.from_arrays(pa.array((np.arange(len(keep) + 1) * classes.shape[1]).astype(np.int32)), pa.array(classes.ravel()))
    data = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(nodes["said"][keep].astype(np.float64)), pa.array(impurity), stats, pa.array(np.rint(n).astype(np.int64)), pa.array(np.where(inner, nodes["gain"][keep], -1.0)), pa.array(child["left"]), pa.array(child["right"]), split], ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    given = {p.name: v for p, v in forest.extractParamMap().items() if forest.isSet(p)}
    defaults = {p.name: v for p, v in forest.extractParamMap().items() if not forest.isSet(p)}
    about = lambda kind, uid, **more: json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, **more})
    n_trees = int(tree.max()) + 1
    path = f"{shared_dir(spark)}/winlens-forest-{uuid.uuid4().hex}"
    try:
        whole = about("RandomForestClassificationModel", forest.uid, paramMap=given, defaultParamMap=defaults, numFeatures=n_columns, numClasses=classes.shape[1], numTrees=n_trees)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        each = [(t, about("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", paramMap={}, defaultParamMap={}), 1.0) for t in range(n_trees)]
        spark.createDataFrame(each, "treeID int, metadata string, weights double").toDF("_1", "_2", "_3").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(pa.table([pa.array(tree.astype(np.int32)), data], ["treeID", "nodeData"])).coalesce(1).write.parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)
    finally:
        delete(spark, path)


def fit(rows: DataFrame, columns: list[str], label: str, trees: int, seed: int, weight: str | None, depth: int, bagged: bool = True) -> RandomForestClassificationModel:
    """A forest of rows whose columns have no empties; its model takes the columns as a vector named features. bagged: each tree draws its rows."""
    spark = rows.sparkSession
    names = {"label": label, **({"weight": weight} if weight else {})}
    stored = materialize(rows.select(F.monotonically_increasing_id().alias("id"), *(F.col(c).cast("float").alias(f"c{i}") for i, c in enumerate(columns)), *(F.col(v).cast("double").alias(k) for k, v in names.items())), "forest-rows")
    of = [f"c{i}" for i in range(len(columns))]
    cuts, n_classes, n_rows = survey(stored, of, "label", "weight" if weight else None)
    useful = [i for i, c in enumerate(cuts) if len(c)]
    table = materialize(blocks(stored, [of[i] for i in useful] or of[:1], [cuts[i] for i in useful] or cuts[:1], "label", n_classes, "weight" if weight else None), "forest-blocks", **LARGE_ROWS)
    discard(stored)
    used = [cuts[i] for i in useful]
    nodes = grow(table, used, len(columns), n_classes, trees, seed, depth, bagged, n_rows > SETTLE_ROWS)
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed, maxDepth=depth, bootstrap=bagged, **({"weightCol": weight} if weight else {}))
    return as_model(spark, nodes, used, useful, len(columns), forest)
