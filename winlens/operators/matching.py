"""Matching of rows between two tables: multisets, presence, cascades, nearest rows, positions, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.operators.profile import relative_deviation, values_equal
from winlens.sources.scratch import materialize


def quantise(columns: list[str], digits: int = 9) -> list[Column]:
    """Values rounded to a number of significant digits: one NaN, no negative zero."""
    out = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
        out.append(F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).when(v == 0, 0.0).otherwise(F.round(v * scale) / scale).alias(c))
    return out


def row_hash(columns: list[str]) -> Column:
    """One hash for rows equal in all columns; -0 and 0 agree, and NaN with NaN."""
    clean = [F.when(F.col(f"`{c}`") == 0, F.lit(0.0)).otherwise(F.col(f"`{c}`").cast("double")) for c in columns]
    return F.xxhash64(*clean)


def multiset_match(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_ours, n_theirs, matched): equal rows pair one to one.

    Counted per key, so a key with many copies is one row, not many.
    """
    a = ours.groupBy(*key).agg(F.count("*").alias("n_ours"))
    b = theirs.groupBy(*key).agg(F.count("*").alias("n_theirs"))
    both = a.join(b, key, "full_outer").na.fill(0, ["n_ours", "n_theirs"])
    return both.withColumn("matched", F.least("n_ours", "n_theirs"))


def present(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    return ours.join(theirs.select(*key).distinct(), key, "left_semi")


def cascade(rows: DataFrame, reference: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """reason: the first variant (name -> key columns) under which a row is present in the reference, else other."""
    out = rows
    for i, (name, key) in enumerate(variants.items()):
        marks = reference.select(*key).distinct().withColumn(f"_m{i}", F.lit(name))
        out = out.join(marks, key, "left")
    found = [f"_m{i}" for i in range(len(variants))]
    return out.withColumn("reason", F.coalesce(*found, F.lit("other"))).drop(*found)


def best_other_label(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """(label, other, share): the other label that holds the largest share of a label's distinct vectors (ties: the smallest label)."""
    d = rows.select(*key, label).distinct()
    total = d.groupBy(label).agg(F.count("*").alias("total"))
    labels = d.groupBy(*key).agg(F.collect_set(label).alias("all"))  # labels of one vector: bounded by the number of labels
    pairs = labels.filter(F.size("all") > 1).select(F.explode("all").alias(label), "all").select(label, F.explode("all").alias("other")).filter(F.col(label) != F.col("other"))
    share = pairs.groupBy(label, "other").agg(F.count("*").alias("n")).join(total, label).withColumn("share", F.col("n") / F.col("total"))
    return share.groupBy(label).agg(F.max_by(F.struct("other", "share"), F.struct("share", (-F.col("other")).alias("o"))).alias("x")).select(label, "x.other", "x.share")


def nearest(samples: DataFrame, reference: DataFrame, sample_id: str, keys: list[list[str]], columns: list[str], pairs: int = 4_000_000) -> DataFrame:
    """(sample_id, outcome, n_differ, differing): the reference row that shares a key (two keys are tried in order) with fewest differing columns.

    Reference rows equal in all columns are one. Outcome tells which key found it; none where no key did. Ties: the first by differing.
    In blocks of more than `pairs` pairs not all are compared: of columns in k + 1 groups one is equal as a whole wherever k columns differ at
    most, so for k = 1, 2, .. samples meet the rows that share the key and a group's values, and those whose best row differs in no more than k
    columns are settled. Joins on key and values are dealt anew by Spark where one of them is hot.
    """
    ref = materialize(reference.select(*columns, *{c for k in keys for c in k if c not in columns}).distinct(), "nearest-reference")
    found = materialize(samples, "nearest-samples")
    samples, ids = found, found.select(sample_id)
    out = ids
    for i, key in enumerate(keys):
        best = nearest_in_blocks(samples, ref, sample_id, key, columns, pairs)
        out = out.join(best.select(sample_id, F.struct(F.lit(f"key{i + 1}").alias("outcome"), "n_differ", "differing").alias(f"x{i}")), sample_id, "left")
    x = F.coalesce(*(F.col(f"x{i}") for i in range(len(keys))))
    return out.select(sample_id, F.coalesce(x["outcome"], F.lit("none")).alias("outcome"), x["n_differ"].alias("n_differ"), x["differing"].alias("differing"))


def nearest_in_blocks(samples: DataFrame, ref: DataFrame, sample_id: str, key: list[str], columns: list[str], pairs: int) -> DataFrame:
    """(sample_id, n_differ, differing) of the samples whose key the reference has."""
    free = [c for c in columns if c not in key]
    theirs = lambda c: F.col(f"_r_{c}")
    differ = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(theirs(c)), F.lit(c)) for c in free)))
    in_order = F.filter(F.array(*map(F.lit, columns)), lambda c: F.array_contains(differ, c))
    rows = samples.select(sample_id, *dict.fromkeys([*key, *columns]))
    named = ref.select(*key, *(F.col(c).alias(f"_r_{c}") for c in free))
    best = F.min(F.struct(F.size(differ).alias("n_differ"), in_order.alias("differing"))).alias("x")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).join(ref.groupBy(*key).agg(F.count("*").alias("_m")), key)
    hot = materialize(sizes.filter(F.col("_n") * F.col("_m") > pairs).select(*key), "hot-blocks")
    if not hot.limit(1).count():
        return rows.join(named, key).groupBy(sample_id).agg(best).select(sample_id, "x.*")
    settled = [rows.join(hot, key, "left_anti").join(named, key).groupBy(sample_id).agg(best).select(sample_id, "x.*")]
    open_ = materialize(rows.join(hot, key, "left_semi"), "open-samples")
    for k in range(1, len(free)):
        if not open_.limit(1).count():
            break
        value = lambda of, g: F.struct(F.lit(g).alias("g"), F.xxhash64(F.lit(g), *(F.struct(of(c)) for c in free[g :: k + 1])).alias("h"))  # noqa: E731, B023
        groups = lambda of: F.explode(F.array(*(value(of, g) for g in range(k + 1))))  # noqa: E731, B023
        a = open_.withColumn("_v", groups(F.col))
        b = named.withColumn("_v", groups(theirs))
        each = a.join(b, [*key, "_v"]).groupBy(sample_id).agg(best)
        each = materialize(each.filter(F.col("x.n_differ") <= k).select(sample_id, "x.*"), "nearest")
        settled.append(each)
        open_ = materialize(open_.join(each.select(sample_id), sample_id, "left_anti"), "open-samples")
    rest = open_.select(sample_id, F.lit(len(free)).alias("n_differ"), F.array(*(F.lit(c) for c in columns if c in free)).cast("array<string>").alias("differing"))
    for each in settled:
        rest = rest.unionByName(each)
    return rest


def coverage(ours: DataFrame, theirs: DataFrame, key: list[str], label: str) -> DataFrame:
    """(label, n_rows, covered): reference rows of each label that ours cover, as multisets."""
    a = ours.groupBy(*key).agg(F.count("*").alias("n_ours"))
    b = theirs.groupBy(*key, label).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*key).orderBy(label).rowsBetween(Window.unboundedPreceding, -1))
    got = F.greatest(F.lit(0), F.least("n", F.coalesce("n_ours", F.lit(0)) - F.coalesce(run, F.lit(0))))
    return b.join(a, key, "left").withColumn("got", got).groupBy(label).agg(F.sum("n").alias("n_rows"), F.sum("got").alias("covered"))


def train_leaks(train: DataFrame, test: DataFrame, key: list[str], label: str) -> DataFrame:
    """(label, n): test rows whose vector is in training, by training label (a row with several labels counts for each)."""
    return test.select(*key).join(train.select(*key, label).distinct(), key).groupBy(label).agg(F.count("*").alias("n"))


def positional(ours: DataFrame, theirs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(col, n, n_differ, first, worst): values at equal positions, column by column, in one pass."""
    b = theirs.select(*keys, *(F.col(c).alias(f"_t_{c}") for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("a"), F.col(f"_t_{c}").cast("double").alias("b")) for c in columns)))
    rows = ours.join(b, keys).select(*keys, each.alias("x"))
    same = values_equal(F.col("x.a"), F.col("x.b"))
    place = F.struct(*keys)
    return rows.groupBy("x.col").agg(F.count("*").alias("n"), F.count_if(~same).alias("n_differ"), F.min(F.when(~same, place)).alias("first"), F.max(F.when(same, F.coalesce(relative_deviation(F.col("x.a"), F.col("x.b")), F.lit(0.0)))).alias("worst"))


def place_blocks(ours: DataFrame, official: DataFrame, block: str, row: str, position: str, key: list[str], rare: int = 16) -> DataFrame:
    """(block, at, votes): where each block starts in the official order, and how many of its rows stand there (ties: most votes, then the earliest).

    rows are numbered from 0 in their block and positions without gaps. Rows that the official order has `rare` times at most propose
    places. Blocks without any are looked up by chains of 2, 4, 8.. rows in a row, as these are rarer, and, once a chain is more than half of
    the block, by the first place of each of its chains and of the whole block; a block that has none of these anywhere is not placed. Every proposed place is then judged by all rows
    of the block. So rows that repeat often are never joined with each other, and yet count.
    """
    digest = F.xxhash64(*(F.col(c) for c in key))
    mine = materialize(ours.select(F.col(block).alias("_b"), F.col(row).cast("long").alias("_i"), digest.alias("_h")), "block-rows")
    theirs = materialize(official.select(F.col(position).cast("long").alias("_p"), digest.alias("_h")), "official-rows")
    sizes = materialize(mine.groupBy("_b").agg(F.count("*").alias("_n")), "block-sizes")
    chains, places, open_, length, proposals = mine, theirs, sizes, 1, None
    while open_.limit(1).count():
        here = chains.join(open_, "_b").filter(F.col("_i") <= F.col("_n") - length)
        counts = places.join(here.select("_h").distinct(), "_h", "left_semi").groupBy("_h").agg(F.count("*").alias("_k"), F.min("_p").alias("_first"))
        found = here.join(counts, "_h")
        few = places.join(counts.filter(F.col("_k") <= rare).select("_h"), "_h", "left_semi")
        near = found.filter(F.col("_k") <= rare).select("_b", "_i", "_h").join(few, "_h").select("_b", (F.col("_p") - F.col("_i")).alias("at"))
        first = found.filter((F.col("_k") > rare) & (F.col("_n") < 2 * length)).select("_b", (F.col("_first") - F.col("_i")).alias("at"))
        # a whole block is its first chain and its last one, so many rows later
        gap = F.col("_n") - length
        ends = found.filter((F.col("_n") < 2 * length) & (F.col("_k") > rare) & (F.col("_i") == 0)).select("_b", F.col("_h").alias("_a"), gap.alias("_gap"))
        ends = ends.join(here.filter(F.col("_i") == gap).select("_b", F.col("_h").alias("_z")), "_b")
        pairs = ends.select("_a", "_z", "_gap").distinct()
        whole = places.join(pairs, F.col("_h") == F.col("_a")).select("_a", "_z", "_gap", F.col("_p").alias("at"), (F.col("_p") + F.col("_gap")).alias("_end"))
        whole = whole.join(places.select(F.col("_p").alias("_end"), F.col("_h").alias("_z")), ["_end", "_z"]).groupBy("_a", "_z", "_gap").agg(F.min("at").alias("at"))
        first = first.unionByName(ends.join(whole, ["_a", "_z", "_gap"]).select("_b", "at"))
        now = materialize(near.unionByName(first).distinct(), "block-places")
        proposals = now if proposals is None else proposals.unionByName(now)
        open_ = materialize(open_.filter(F.col("_n") >= 2 * length).join(now.select("_b").distinct(), "_b", "left_anti"), "open-blocks")
        # a chain of twice the length is this one and the one that begins after it
        link = F.xxhash64("_h", "_g")
        chains = materialize(chains.join(chains.select("_b", (F.col("_i") - length).alias("_i"), F.col("_h").alias("_g")), ["_b", "_i"], "left").select("_b", "_i", F.when(F.col("_g").isNull(), F.col("_h")).otherwise(link).alias("_h")), "chains")
        places = materialize(places.join(places.select((F.col("_p") - length).alias("_p"), F.col("_h").alias("_g")), "_p", "left").select("_p", F.when(F.col("_g").isNull(), F.col("_h")).otherwise(link).alias("_h")), "chains")
        length *= 2
    if proposals is None:
        return sizes.limit(0).select(F.col("_b").alias(block), F.lit(0).cast("long").alias("at"), F.col("_n").alias("votes"))
    stands = mine.join(proposals, "_b").withColumn("_p", F.col("at") + F.col("_i")).join(theirs, ["_p", "_h"])
    votes = stands.groupBy("_b", "at").agg(F.count("*").alias("votes"))
    best = votes.groupBy("_b").agg(F.max(F.struct("votes", (-F.col("at")).alias("neg"))).alias("x"))
    return best.select(F.col("_b").alias(block), (-F.col("x.neg")).alias("at"), "x.votes")


def row_weights(rows: DataFrame, population: DataFrame, label: str) -> DataFrame:
    """weight: rows of the label in the whole set (label, total) over its rows here."""
    own = rows.groupBy(label).agg(F.count("*").alias("_own"))
    per = own.join(population, label).select(label, (F.col("total") / F.col("_own")).alias("weight"))
    return rows.join(per, label)
