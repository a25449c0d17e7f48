"""Near-duplicate detection: MinHash signatures joined through an inverted index of their coordinates.

1. A text's set is its distinct word shingles; equal sets become one node (its smallest id). A node's signature has
   COORDINATES minima; a coordinate with its value is a posting key, and every node is posted under all of its keys.
2. Pairs must agree in MATCHES coordinates at least. Keys with one node can't agree with anything, so nodes with fewer
   than MATCHES shared keys leave. The others keep the prefix of their shared keys, shortest lists first, that any such
   pair must meet in; the long rest is skipped. (Links at the threshold are missed with a chance of about 1e-6.)
3. Within a short list all pairs are candidates. In a long one every node is paired with a few central hubs only.
   Candidates are confirmed on full sets; confirmed links give components.
4. What hubs did not connect is settled exactly: the members of long lists with several components are joined on the prefix of their own
   shingles, those found in no hub first, with length and position filters, for pairs not yet in one component.
   Copies of one text are so linked through hubs, without all of their pairs, and yet no link between components is lost.

Nothing but the hubs' shingles (at most HUBS sets of HUB_SHINGLES) is sent to the driver or broadcast.

Defined cases: null and blank texts have an empty set and are linked with nothing; a text with fewer words than a shingle
is one shingle; a very long text's set is whole, its signature taken in parts; rows that share an id are one document; rows without id are linked with nothing and have a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import discard, materialize, table, text_rows

COORDINATES, MATCHES = 32, 14
#: Which shingles are called popular matters to the order of prefixes and so to speed alone: those of the hubs of lists over
#: HUB_LIST members, of the HUBS that serve most of these and have at most HUB_SHINGLES.
#: Lists up to this length give all of their pairs; hubs are the most central node of each of so many parts of a longer list.
SHORT_LIST, HUB_PARTS = 3, 2
HUBS, HUB_SHINGLES, HUB_LIST = 500, 5000, 100
#: Members of a long list that one task pairs with the hubs.
SALTED = 400
CACHED_WORDS = 50_000
_RNG = np.random.default_rng(20240)
_FLIP = _RNG.integers(0, 1 << 64, COORDINATES, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct hashed shingles of texts: A-Z lower-cased, words split at blanks of ASCII."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        found = self.known[w] = xxhash.xxh3_64_intdigest(w) | 1
        return found

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes."""
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        get, word = self.known.get, self.word
        h = np.array([get(w) or word(w) for w in words], np.uint64)
        n = min(self.words, len(h))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                acc = (acc ^ h[k : len(h) - n + 1 + k]) * _MIX
                acc ^= acc >> np.uint64(32)
        return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES posting keys: the least permuted hash, its last bits replaced by the coordinate's number."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = (shingles[at : at + 4096, None] ^ _FLIP) * _TIMES
            least = np.minimum(least, (part ^ part >> np.uint64(33)).min(0))
    return (least & ~np.uint64(COORDINATES - 1) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def sketch(words: int):
    """(doc_id, text) to doc_id, n_shingles, two digests of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sizes, highs, lows, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingler.shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                highs.append(int.from_bytes(digest[:8], "little", signed=True))
                lows.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(signature(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "high", "low", "keys"])

    return run


def shingle_sets(words: int):
    """(doc_id, text) to node, its full set as bytes of sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler.shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    return run


def confirm(threshold: int):
    """(a, b, shingles of both) to the pairs with 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, name: str) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return materialize(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(confirm(threshold), "a long, b long"), name)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for every node with a link. Labels spread and jump until none changes."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    stored = labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = materialize(spread.join(jump, "component").select("node", "old", F.least("component", "next").alias("component")), "cc-labels")
        discard(stored)
        stored, labels = now, now.select("node", "component")
        if not now.filter("component <> old").limit(1).count():
            return labels


def compatible(threshold: int) -> Column:
    """Sizes alone do not rule the pair out."""
    return (F.col("size") * 100 >= F.col("other") * threshold) & (F.col("other") * 100 >= F.col("size") * threshold)


def candidate_lists(nodes: DataFrame) -> DataFrame:
    """nodes(node, size, keys): prefix postings (key, node, size, central) of all nodes that may have a partner."""
    postings = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    own = postings.join(shared, "key").groupBy("node", "size").agg(F.collect_list(F.struct("n", "key")).alias("own"))
    own = own.filter(F.size("own") >= MATCHES).withColumn("own", F.sort_array("own"))
    central = F.aggregate("own", F.lit(0.0), lambda s, x: s + F.log(x["n"].cast("double")))
    prefix = own.select("node", "size", F.round(central, 3).alias("central"), F.explode(F.slice("own", F.lit(1), F.size("own") - MATCHES + 1)).alias("x"))
    return prefix.select("node", "size", "central", F.col("x.key").alias("key"))


def near_components(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links have Jaccard similarity of threshold percent or more."""
    texts = text_rows(docs, id_col, text_col)
    rows = materialize(texts.mapInArrow(sketch(words), "doc_id long, n_shingles long, high long, low long, keys array<long>"), "sketches")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    groups = materialize(full.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "groups")
    first = groups.select(F.col("node").alias("doc_id"), "high", "low")
    nodes = full.join(first, ["doc_id", "high", "low"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "keys")
    prefix = materialize(candidate_lists(nodes), "prefix")

    lists = materialize(prefix.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    listed = materialize(prefix.join(lists, "key"), "listed")
    other = lambda df: df.select("key", F.col("node").alias("b"), F.col("size").alias("other"))
    fits = compatible(threshold)
    short = listed.filter(F.col("n") <= SHORT_LIST)
    pairs = short.withColumnRenamed("node", "a").join(other(short), "key").filter((F.col("a") < F.col("b")) & fits).select("a", "b")
    long = listed.filter(F.col("n") > SHORT_LIST)
    hubs = long.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUB_PARTS)).alias("part")).agg(F.max(F.struct("central", "node", "size")).alias("hub"), F.max("n").alias("n"))
    hubs = materialize(hubs.select("key", "n", F.col("hub.node").alias("b"), F.col("hub.size").alias("other")), "hubs")
    # a list of any length is dealt to as many tasks as it has SALTED members; its hubs go to all of them
    parts = F.ceil(F.col("n") / SALTED)
    dealt = long.withColumnRenamed("node", "a").withColumn("salt", F.pmod(F.xxhash64("a"), parts))
    stars = dealt.join(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n"), ["key", "salt"]).filter((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "pairs")

    wanted = prefix.select(F.col("node").alias("doc_id")).distinct()
    # a node's set is that of its first text; a document that repeats under its id with other texts brings several sets
    sets = materialize(texts.join(wanted, "doc_id", "left_semi").mapInArrow(shingle_sets(words), "node long, shingles binary").distinct(), "sets")
    links = confirmed(pairs, sets, threshold, "links")
    labels = components(links)

    own = long.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = own.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).filter("open").select("key")
    rest = residual_pairs(own.join(open_lists, "key", "left_semi").select("node").distinct(), hubs, sets, labels, threshold)
    more = confirmed(rest, sets, threshold, "more-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    moved = groups.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node")).filter("copies > 1 or component_id <> node").select("high", "low", "component_id")
    out = rows.select("doc_id", "n_shingles", "high", "low").join(moved, ["high", "low"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def residual_pairs(members: DataFrame, hubs: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Pairs of long lists' members in different components that may reach the threshold: exact, by prefixes of their shingles."""
    top = hubs.filter((F.col("n") > HUB_LIST) & (F.col("other") <= HUB_SHINGLES)).groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("uses")).orderBy(F.desc("uses"), "node").limit(HUBS)
    popular = [np.frombuffer(r["shingles"], np.uint64) for r in sets.join(F.broadcast(top), "node").select("shingles").collect()]  # HUBS sets of bounded size
    shared = sets.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(1, np.uint64), *popular])))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in batches:
            node, shingle, place, size = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(v.as_buffer(), np.uint64)
                known = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                s = np.concatenate([s[~known], s[known]])
                n = len(s) - -(-threshold * len(s) // 100) + 1
                node += [i] * n
                shingle.append(s[:n].view(np.int64))
                place += range(n)
                size += [len(s)] * n
            flat = np.concatenate(shingle) if shingle else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(flat, pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32())], ["node", "shingle", "place", "size"])

    entries = sets.join(members, "node", "left_semi").mapInArrow(prefixes, "node long, shingle long, place int, size int")
    entries = materialize(entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "entries")
    e = entries.withColumnRenamed("node", "a")
    f = entries.select("shingle", F.col("node").alias("b"), F.col("place").alias("place_b"), F.col("size").alias("other"), F.col("component").alias("component_b"))
    reach = F.least(F.col("size") - F.col("place"), F.col("other") - F.col("place_b"))
    enough = (100 + threshold) * reach >= threshold * (F.col("size") + F.col("other"))
    return materialize(e.join(f, (e.shingle == f.shingle) & (F.col("a") < F.col("b")) & (F.col("component") != F.col("component_b")) & enough).select("a", "b").distinct(), "residual")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=4)
