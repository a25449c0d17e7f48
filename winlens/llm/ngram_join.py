"""Exact n-gram Jaccard join by a forest of signature trees.

1. A text's set is its distinct word shingles; equal sets become one node (its smallest id).
2. Trees grow where linked sets must meet. Of a link (x, y), x the smaller, at most D(x) shingles of x and E(y) of y are not in the
   other. So they share a shingle of the sampled universe (one hash in SAMPLE) unless both have too few of it, and then the first
   that they share, in the order of how many sets hold it, is among the first D + 1 of x and E + 1 of y. These are the roots; what
   is held by one set alone roots nothing, and a set with more than E of such has no link at all. Sets that are thin in the sampled
   universe also meet at the first shingles of all, by hash. Roots with equal members are one tree.
3. A leaf of a tree is a set: a bitmap of its shingles, 4 to 8 bits for each, its size, and how many of its shingles share bits. An inner
   node holds the OR of FAN nodes of similar size, the range of their sizes and their largest slack. Two trees (or one with itself)
   are walked together from the top: a pair of nodes is cut if the sizes exclude links, or if the bits in common and the slack
   can't give the overlap that the smallest sizes need, or if all of it is one component already.
4. A first walk links each tree by those pairs that promise most (a maximum spanning forest); the full sets confirm them, and links give
   components. A second walk, in trees that still have several components, gives all pairs between components that bounds admit.
   So near copies of one text aren't expanded into all pairs, and yet no link between components is lost.

Trees of more than BLOCK members are dealt in blocks: the first walk pairs each with block 0, the second all blocks of trees that are
still open. Nothing is broadcast or sent to the driver.

Defined cases: null and blank texts have an empty set and are linked with nothing; a text with fewer words than a shingle is one
shingle; very long texts have long bitmaps and whole sets; rows that share an id are one document; rows without id are linked with nothing
and have a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table, text_rows
from winlens.llm.near_dedup import Shingler, components, confirmed, shingle_sets

SAMPLE = 8
BLOCK, FAN = 256, 8
#: Words of bitmaps that are compared at once.
WORDS = 1 << 19
_TAG = np.uint64(0xA5A5A5A55A5A5A5A)


def spare(size: int, threshold: int) -> tuple[int, int]:
    """D and E: how many shingles of a set may be missing in a linked one that is no smaller, or that is of any size."""
    return (100 - threshold) * size // (100 + threshold), (100 - threshold) * size // 100


def sketch(words: int, threshold: int):
    """(doc_id, text) to doc_id, n_shingles, two digests of the set, sampled shingles, thin ones, how many of these come first enough for D, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sizes, highs, lows, sampled, thin, index, maps = [], [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingler.shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d, e = spare(len(s), threshold)
                some = s[(s >> np.uint64(8)) % np.uint64(SAMPLE) == 0]
                first = (s[: e + 1] ^ _TAG) if len(some) <= e else s[:0]
                sizes.append(len(s))
                highs.append(int.from_bytes(digest[:8], "little", signed=True))
                lows.append(int.from_bytes(digest[8:], "little", signed=True))
                sampled.append(some.view(np.int64))
                thin.append(first.view(np.int64))
                index.append(d + 1 if len(some) <= d else 0)
                maps.append(bitmap(s).tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(sampled, longs), pa.array(thin, longs), pa.array(index, pa.int64()), pa.array(maps, pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "sampled", "thin", "thin_index", "bitmap"])

    return run


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Words of a bitmap of a power of two bits, 4 to 8 for each shingle and 64 at least."""
    bits = max(64, 4 << (max(1, len(shingles)) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(shingles >> np.uint64(24)) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Tree:
    """Levels of nodes over leaves sorted by size; a node spans FAN of the level below."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, component: np.ndarray):
        slack = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, slack, component)]
        while len(self.levels[-1][1]) > FAN:
            bits, low, high, slack, component = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            least, most = np.minimum.reduceat(component, at), np.maximum.reduceat(component, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.where(least == most, least, -1)))

    def narrow(self) -> Tree:
        """The same leaves with bitmaps of half the bits."""
        bits, size, _, _, component = self.levels[0]
        half = bits.shape[1] // 2
        return Tree(bits[:, :half] | bits[:, half:], size, component)


def admitted(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i, j) of nodes of two levels may hold a link, and the largest overlap that they may have."""
    bits_a, low_a, high_a, slack_a, own_a = a
    bits_b, low_b, high_b, slack_b, own_b = b
    ok = (100 * high_a[i] >= threshold * low_b[j]) & (100 * high_b[j] >= threshold * low_a[i])
    ok &= (own_a[i] != own_b[j]) | (own_a[i] < 0)
    best = np.zeros(len(i), np.int64)
    todo, step = np.flatnonzero(ok), max(1, WORDS // bits_a.shape[1])
    for at in range(0, len(todo), step):
        k = todo[at : at + step]
        best[k] = np.bitwise_count(bits_a[i[k]] & bits_b[j[k]]).sum(1, dtype=np.int64) + np.minimum(slack_a[i[k]], slack_b[j[k]])
    return ok & ((100 + threshold) * best >= threshold * (low_a[i] + low_b[j])), best


def walk(a: Tree, b: Tree, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that no bound excludes, and their largest overlap; within one tree each pair once."""
    top = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(level(a, top)[1])), np.arange(len(level(b, top)[1])), indexing="ij"))
    for k in range(top, -1, -1):
        if a is b:
            i, j = i[i <= j], j[i <= j]
        ok, best = admitted(level(a, k), level(b, k), i, j, threshold)
        if a is b and k == 0:
            ok &= i != j
        i, j, best = i[ok], j[ok], best[ok]
        if k:
            i, j = children(i, len(level(a, k - 1)[1]), k < len(a.levels)), j
            # each child of i with each child of j
            j = np.repeat(j, FAN)
            i, keep = i.ravel(), i.ravel() >= 0
            i, j = i[keep], j[keep]
            below = children(j, len(level(b, k - 1)[1]), k < len(b.levels))
            i, j = np.repeat(i, FAN), below.ravel()
            i, j = i[j >= 0], j[j >= 0]
    return i, j, best


def children(nodes: np.ndarray, below: int, deeper: bool) -> np.ndarray:
    """Rows of FAN children for each node, -1 where there is none; the node itself where its tree has no deeper level."""
    out = nodes[:, None] * FAN + np.arange(FAN) if deeper else np.where(np.arange(FAN) == 0, nodes[:, None], -1)
    return np.where(out < below, out, -1)


def spanning(pairs: np.ndarray, promise: np.ndarray) -> np.ndarray:
    """Of pairs of positions those that make a maximum spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept, left = [], len(np.unique(pairs)) - 1
    for k in np.argsort(-promise, kind="stable").tolist():
        x, y = find(int(pairs[k, 0])), find(int(pairs[k, 1]))
        if x != y:
            root[x] = y
            kept.append(k)
            left -= 1
            if not left:
                break
    return pairs[kept]


def candidates(members: pa.Table, threshold: int, forest: bool) -> np.ndarray:
    """Pairs (a, b) of nodes of one block, or of two, that may be linked: all, or those that span."""
    node, size, component = (members.column(c).to_numpy() for c in ("node", "size", "component"))
    order = np.lexsort((node, size))
    node, size, component = node[order], size[order], component[order]
    maps = members.column("bitmap").to_pylist()
    maps = [maps[k] for k in order.tolist()]
    widths = np.array([len(m) // 8 for m in maps])
    trees = {}
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        bits = np.frombuffer(b"".join(maps[k] for k in own.tolist()), np.uint64).reshape(len(own), w)
        trees[w] = own, Tree(bits, size[own], component[own])
    found, promise = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for w, (own, tree) in trees.items():
        others = [(own, tree, tree)]
        if 2 * w in trees:  # linked sets differ less than twofold in size, so in width
            others.append((trees[2 * w][0], tree, trees[2 * w][1].narrow()))
        for theirs, a, b in others:
            i, j, best = walk(a, b, threshold)
            i, j = own[i], theirs[j]
            found.append(np.stack([i, j], 1))
            promise.append(best / np.maximum(1, size[i] + size[j] - best))
    pairs, promise = np.concatenate(found), np.concatenate(promise)
    apart = node[pairs[:, 0]] != node[pairs[:, 1]]
    pairs, promise = pairs[apart], promise[apart]
    if forest and len(pairs):
        pairs = spanning(pairs, promise)
    return np.sort(node[pairs], 1)


def walk_trees(threshold: int, forest: bool):
    """Members sorted by tree and blocks to candidate pairs; a tree's blocks may go over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, []

        def ended() -> np.ndarray:
            return candidates(pa.Table.from_batches(open_), threshold, forest) if open_ else np.zeros((0, 2), np.int64)

        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            found = []
            for at, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if (now := tuple(keys[at])) != key:
                    found.append(ended())
                    key, open_ = now, []
                open_.append(b.slice(at, end - at))
            yield rows(found)
        yield rows([ended()])

    return run


def roots(nodes: DataFrame, key: list[str], threshold: int) -> DataFrame:
    """nodes(key, size, sampled, thin, thin_index) to the trees' members (root, key, size, n): n members in all, two at least."""
    spare_any, spare_index = F.expr(f"{100 - threshold} * size div 100"), F.expr(f"{100 - threshold} * size div {100 + threshold}")
    postings = nodes.select(*key, F.explode("sampled").alias("root"))
    shared = postings.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    own = postings.join(shared, "root").groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("n", "root"))).alias("own"))
    own = own.join(nodes.select(*key, "size", F.size("sampled").alias("some")), key).withColumn("alone", F.col("some") - F.size("own")).filter(F.col("alone") <= spare_any)
    prefix = own.withColumn("head", F.slice("own", F.lit(1), F.greatest(F.lit(0), spare_any - F.col("alone") + 1).cast("int"))).select(*key, "size", "alone", F.posexplode("head").alias("at", "x"))
    prefix = prefix.select("x.root", *key, "size", (F.col("alone") + F.col("at") <= spare_index).alias("index"))
    thin = nodes.filter("size(thin) > 0").select(*key, "size", "thin_index", F.posexplode("thin").alias("at", "root")).select("root", *key, "size", (F.col("at") < F.col("thin_index")).alias("index"))
    prefix = materialize(prefix.unionByName(thin), "roots")
    lists = prefix.groupBy("root").agg(F.count("*").alias("n"), F.bool_or("index").alias("index"), F.bit_xor(F.xxhash64(*key, "size")).alias("x"), F.bit_xor(F.xxhash64("size", *key)).alias("y")).filter("n > 1 and index")
    trees = lists.groupBy("n", "x", "y").agg(F.min("root").alias("root")).select("root", "n")
    return materialize(prefix.join(trees, "root").select("root", *key, "size", "n"), "members")


def grown(members: DataFrame, bitmaps: DataFrame, key: list[str], threshold: int, forest: bool) -> DataFrame:
    """members(root, key, size, n, component) to candidate pairs (a, b) of nodes."""
    rows = bitmaps.join(members, key)
    blocks, own = F.ceil(F.col("n") / BLOCK).cast("int"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    if forest:
        others = F.when(F.col("own") > 0, F.array(F.lit(0))).when(F.col("blocks") > 1, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    else:
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("other", F.explode(others)).withColumns({"low_block": F.least("own", "other"), "high_block": F.greatest("own", "other")})
    rows = rows.select("root", "low_block", "high_block", "node", "size", "component", "bitmap")
    keys = ["root", "low_block", "high_block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk_trees(threshold, forest), "a long, b long").distinct()


def confirmed_pairs(pairs: DataFrame, texts: DataFrame, words: int, threshold: int, name: str) -> DataFrame:
    """The pairs that are links. Full sets are made of the texts in pairs alone."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(texts.join(ids, "doc_id", "left_semi").mapInArrow(shingle_sets(words), "node long, shingles binary").distinct(), f"{name}-sets")
    return confirmed(pairs, sets, threshold, name)


def join_components(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; links have a Jaccard similarity of threshold percent (over 50) or more."""
    texts = text_rows(docs, id_col, text_col)
    rows = materialize(texts.mapInArrow(sketch(words, threshold), "doc_id long, n_shingles long, high long, low long, sampled array<long>, thin array<long>, thin_index long, bitmap binary"), "join-sketches")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    groups = materialize(full.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "join-groups")
    # a node is its first id, and its digest too where ids stand for several sets
    key = ["node", "low"] if groups.groupBy("node").count().filter("count > 1").limit(1).count() else ["node"]
    nodes = full.withColumnRenamed("doc_id", "node").withColumnRenamed("n_shingles", "size").join(groups.select(*key), key, "left_semi")
    members = roots(nodes.select(*key, "size", "sampled", "thin", "thin_index"), key, threshold)
    bitmaps = nodes.select(*key, "bitmap").join(members.select(*key).distinct(), key, "left_semi")
    tried = materialize(grown(members.withColumn("component", F.col("node")), bitmaps, key, threshold, True), "join-pairs")
    links = confirmed_pairs(tried, texts, words, threshold, "join-links")
    labels = components(links)

    placed = members.filter("n > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    still = placed.groupBy("root").agg((F.min("component") < F.max("component")).alias("open")).filter("open").select("root")
    rest = grown(placed.join(still, "root", "left_semi").select("root", *key, "size", "n", "component"), bitmaps, key, threshold, False)
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "join-rest")
    more = confirmed_pairs(rest, texts, words, threshold, "join-more")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    moved = groups.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node")).filter("copies > 1 or component_id <> node").select("high", "low", "component_id")
    out = rows.select("doc_id", "n_shingles", "high", "low").join(moved, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), words=3, threshold=90)


SQL = r"""
WITH RECURSIVE
w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams
    FROM w),
s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT g.doc_id, len(grams) AS n_shingles, c.component_id FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON g.doc_id = c.a
"""
