import collections
import random

import pytest

from winlens.operators import matching as ma


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_repeated_rows(spark, seed):
    """Blocks of a few different rows, some of them all alike, against votes over all pairs."""
    rng = random.Random(seed)
    blocks = [[rng.choice("abc" if b % 3 else "a") for _ in range(rng.choice([1, 5, 8, 13]))] for b in range(25)]
    blocks += [["z", "a", "a", "a"], ["missing"] * 3, ["a"] * 6]
    order = rng.sample(range(26), 26)
    official = [r for b in order for r in blocks[b]]
    ours = [(b, i, r) for b, rows in enumerate(blocks) for i, r in enumerate(rows)]
    got = ma.place_blocks(spark.createDataFrame(ours, "b long, i long, k string"), spark.createDataFrame(list(enumerate(official)), "p long, k string"), "b", "i", "p", ["k"], rare=3)
    got = {r["b"]: (r["at"], r["votes"]) for r in got.collect()}
    for b, rows in enumerate(blocks):
        votes = collections.Counter(p - i for i, r in enumerate(rows) for p, o in enumerate(official) if r == o)
        if b == 26:
            assert b not in got
        else:
            at, n = got[b]
            assert votes[at] == n and (b not in order or n == len(rows))  # a place of the whole block, where there is one
    start = sum(len(blocks[b]) for b in order[: order.index(25)])
    assert got[25] == (start, 4)


def test_a_constant_block_is_no_join_of_all_pairs(spark):
    n = 4000
    ours = spark.range(n).selectExpr("0L as b", "id as i", "'x' as k")
    official = spark.range(3 * n).selectExpr("id as p", "'x' as k")
    assert [tuple(r) for r in ma.place_blocks(ours, official, "b", "i", "p", ["k"]).collect()] == [(0, 0, n)]


@pytest.mark.parametrize("pairs", [0, 60, 1_000_000])
def test_nearest_row_is_that_of_all_pairs(spark, pairs):
    rng = random.Random(6)
    row = lambda: [rng.choice([0, 1]), rng.choice([0, 1, None]), *(rng.choice([0, 1, 2, 3, 4, None]) for _ in range(4))]
    names, keys = [f"q{i}" for i in range(6)], [["q0", "q1"], ["q0"]]
    ours, theirs = [[i, *row()] for i in range(80)] + [[99, 7, 7, 0, 0, 0, 0]], [row() for _ in range(30)]
    schema = ", ".join(f"{c} long" for c in names)
    got = ma.nearest(spark.createDataFrame(ours, f"id long, {schema}"), spark.createDataFrame(theirs + theirs[:5], schema), "id", keys, names, pairs).collect()
    for r in got:
        mine = next(x[1:] for x in ours if x[0] == r["id"])
        want = ("none", None, None)
        for i, key in enumerate(keys):
            at = [names.index(c) for c in key]
            block = [t for t in theirs if all(mine[k] is not None and mine[k] == t[k] for k in at)]
            if block:
                d = min((sum(a != b for a, b in zip(mine, t, strict=True)), [c for c, a, b in zip(names, mine, t, strict=True) if a != b]) for t in block)
                want = (f"key{i + 1}", d[0], d[1])
                break
        assert (r["outcome"], r["n_differ"], r["differing"]) == want
    assert len(got) == len(ours) and {r["outcome"] for r in got} == {"key1", "key2", "none"}
