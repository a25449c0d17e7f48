"""The Merkle manifest, the audit of filters and the signature-tree join against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA, normal
from winlens.llm import filter_audit, merkle, ngram_join, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_filter_audit", "op13_ngram_join"])
def test_queries_match_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert normal(ours).equals(normal(theirs))


def tables(spark, tmp_path, docs, labels=()):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return str(tmp_path), con


ODD = [
    (5, "a\nb", "en", None, 3), (-7, "x\n\ny", None, "", 4), (1 << 40, "", "de", "b", None), (63, None, "de", "b", 0), (64, "ÄÖ\nü", "fr", "b", 5), (None, "no id\n", "en", "b", 6),
    (None, None, None, None, None), (3, "twice\n", "en", "b", 6), (3, "twice\n", "en", "b", 6), (3, "other", "en", "b", 5), (-(1 << 63), "least\n", "en", "ä", 1), ((1 << 63) - 1, "most\n", "en", "z", 1),
    (8, "#$ LOUD LOUD LOUD", "en", "b", 1), (9, "#$ LOUD LOUD LOUD", "en", "b", 1), (10, "one two " * 3000, "en", "b", 1), (11, "\x0b\x0c \t", "", "b", 1)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    """Rows of op11 from lists and loops."""

    def leaf(row, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    def tree(nodes):
        """The root, and for each node the runs that it stands in from the bottom up: (siblings before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                run = p // 3 * 3
                paths[k].append((nodes[run:p], nodes[p + 1 : run + 3]))
            nodes, at = [H(*nodes[r : r + 3]) for r in range(0, len(nodes), 3)], [p // 3 for p in at]
        return nodes[0], paths

    by = collections.defaultdict(list)
    for row in docs:
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        by[b"" if row[3] is None else b"s" + row[3].encode()].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, row[1].replace("\n", "") if even and row[1] else row[1]), row[0]))
    groups = [sorted(by[k]) for k in sorted(by)]
    trees = [tree([x[2] for x in g]) for g in groups]
    root, upper = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(groups, trees, upper, strict=True):
        for x, path in zip(g, paths, strict=True):
            acc = x[3]
            for before, after in path + above:
                acc = H(*before, acc, *after)
            out.append((x[4], x[2], subroot, root, H(*(s for level in path + above for side in level for s in side)), acc, acc == root))
    return collections.Counter(out)


@pytest.mark.parametrize("n", [0, 1, 16, 2300])
def test_manifest(spark, tmp_path, n):
    rng = random.Random(n)
    docs = ODD[:n] + [(rng.choice([i, i * 7919, None, 4]) if i % 50 == 0 else i, rng.choice(["a\nb", "c", None]), "en", rng.choice(["a", "b", "b", "b"]), i) for i in range(max(0, n - len(ODD)))]
    sf, con = tables(spark, tmp_path, docs)
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf)
    assert collections.Counter(tuple(r) for r in got.collect()) == (plain_manifest(docs) if docs else {})
    if docs:
        assert normal(got.toPandas()).equals(normal(con.execute(queries.ORACLES["op11_merkle_manifest"]).df()))


def test_ranks_of_many_copies(spark):
    """A row that repeats beyond what one task numbers, and ids of every magnitude."""
    rows = [(7, f"t{i % 3}", "en", "s", 1) for i in range(3 * merkle.COPIES + 5)] + [(1 << k, "x", "en", "s", 1) for k in range(63)]
    placed = merkle.coordinates(merkle.leaves(spark.createDataFrame(rows, DOCS))).orderBy("pos").toPandas()
    assert list(placed.pos) == list(range(len(rows)))
    assert list(zip(placed.doc_id, placed.leaf, strict=True)) == sorted(zip(placed.doc_id, placed.leaf, strict=True))


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    rows = []
    for d, text, lang, _, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [e for e, other, *_ in docs if (other or "") == text and e is not None]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > min(copies)}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if f in r[1] and not r[1] & before]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit(spark, tmp_path):
    rng = random.Random(1)
    docs = ODD + [(100 + i, rng.choice(["w " * rng.choice([5, 120]), " ".join(map(str, range(rng.choice([5, 120])))), "A" * rng.randint(1, 9), "# x"]), rng.choice(["en", "de", None]), "s", 1) for i in range(60)]
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d, *_ in docs[::2] if d is not None] + [(100, 0, 1), (100, 1, 0), (None, 1, 1)]
    sf, con = tables(spark, tmp_path, docs, labels)
    got = queries.QUERIES["op12_filter_audit"](spark, sf).toPandas()
    order = ["part", "filter_order", "step", *filter_audit.MEASURES, "shapley"]
    assert {tuple(r) for r in got[order].itertuples(index=False)} == plain_audit(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})
    assert normal(got).equals(normal(con.execute(queries.ORACLES["op12_filter_audit"]).df()))


def test_audit_of_nothing(spark, tmp_path):
    sf, _ = tables(spark, tmp_path, [])
    assert queries.QUERIES["op12_filter_audit"](spark, sf).count() == 0
    assert queries.QUERIES["op13_ngram_join"](spark, sf).count() == 0


def plain_join(docs, words, threshold):
    sets = {}
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(d, len(sets[d]), find(d) if d is not None else None) for d in sets}


def variants(rng, n_base, copies, vocabulary=400):
    """Texts that share passages, with copies changed by so many words that they fall on both sides of the threshold."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(30)] for _ in range(3)]
    out = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([2, 4, 9, 15, 40, 130, 300]))]
        if rng.random() < 0.4:
            base += rng.choice(passages)
        for _ in range(rng.choice(copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "block", "words", "threshold"), [(1, 256, 3, 90), (2, 8, 3, 90), (3, 4, 1, 70)])
def test_join(spark, monkeypatch, seed, block, words, threshold):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(seed)
    docs = list(enumerate(variants(rng, 60, [1, 2, 5, 12]), start=-20))
    docs += [(1000, None), (1001, " \t"), (1002, "One"), (1003, "one"), (1004, "x " * 5000), (1005, "ONE two"), (None, "one")]
    got = ngram_join.join_components(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, root int"), words, threshold)
    got = {tuple(r) for r in got.collect()}
    assert got == plain_join(docs, words, threshold)
    assert len({c for _, _, c in got}) < len(docs)


def test_tree_bounds():
    """A walk gives every linked pair, once, and in trees of several levels cuts most of the others."""
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << 63, 100, np.uint64) for _ in range(100)]
    sets = [np.unique(np.r_[b[: 100 - k], rng.integers(0, 1 << 63, k, np.uint64)]) for b in bases for k in (0, 2, 30)]
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    bits = np.stack([ngram_join.bitmap(s) for s in sets])
    tree = ngram_join.Tree(bits[order], size[order], np.arange(len(sets)))
    i, j, best = ngram_join.walk(tree, tree, 90)
    pairs = {frozenset((order[a], order[b])) for a, b in zip(i, j, strict=True)}
    assert len(pairs) == len(i) < 1000
    assert {frozenset((3 * k, 3 * k + 1)) for k in range(100)} <= pairs
    both = np.array([len(np.intersect1d(sets[order[a]], sets[order[b]])) for a, b in zip(i, j, strict=True)])
    assert (both <= best).all()


def test_chats_without_id_and_long_ones(spark):
    from pyspark.sql import functions as F

    from winlens.llm import chat_format

    rng = random.Random(9)
    long = [(1, i, rng.choice(["user", "assistant", "a:b"]), rng.choice(["x", "</turn> ### ", "\\b<part/>", "", None])) for i in range(3000)]
    rows = long + [(None, 0, "assistant", "same")] * 5 + [(None, 1, "user", "### ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    assert sorted((len(r["t"]), r["l"]) for r in out if r["conv_id"] is None) == [(1, "")] + [(1, "same")] * 5
    one = next(r for r in out if r["conv_id"] == 1)
    assert [tuple(t) for t in one["t"]] == [(role, text or "") for _, _, role, text in long]
    assert one["l"] == "".join(text or "" for _, _, role, text in long if role == "assistant")
