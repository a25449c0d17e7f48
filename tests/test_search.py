import random

import pytest

from winlens.operators import search as se


@pytest.mark.parametrize("k", [1, 3])
def test_bounds_change_nothing(spark, k):
    """Whatever counts as frequent, the first sections of every query are those of a search that looks up everything."""
    rng = random.Random(k)
    words = [f"{a}{b}lmn" for a in "bcdfg" for b in "aeiou"]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice([2, 6, 25])]) for _ in range(n))
    sections = spark.createDataFrame([(i, i * 7 % 61, pick(2), pick(8), pick(1)) for i in range(60)], "section long, `order` long, title string, body string, document string")
    queries = spark.createDataFrame([(q, pick(rng.randint(1, 5))) for q in range(25)] + [(99, "nothing")], "query long, text string")
    got = [sorted(map(tuple, se.search(sections, queries, k, frequent=n).collect())) for n in (0, 3, 12, 10_000)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) > 20


def test_index_holds_only_stems_that_are_asked_for(spark, monkeypatch):
    """What no query asks for is not shuffled or written, and frequent stems are looked up without rows for each query and section in a shuffle."""
    made = {}
    keep = se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, name: made.setdefault(name, keep(df, name)))
    sections = spark.createDataFrame([(i, i, "", " ".join(f"{a}{i % 10}x" for a in "abcdefghij"), "") for i in range(50)], "section long, `order` long, title string, body string, document string")
    queries = spark.createDataFrame([(q, f"a{q % 10}x b{q % 10}x") for q in range(30)], "query long, text string")
    got = se.search(sections, queries, 3, frequent=2)
    assert made["stem-index"].count() == 2 * 50
    assert got.count() == 30 * 3 and {r["points"] for r in got.collect()} == {2}
    summed = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(query" in line and "section" in line]
    assert len(summed) <= 1  # the rare stems' alone: at most `frequent` sections each
