"""The corpus operators against brute force, round trips and edge cases."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA, normal
from tests.llm.test_brute import plain_leaks
from winlens.llm import chat_format, decontamination, exact_dedup, language_id, lm_scoring, near_dedup, pii, prefix_bpe, quality, sharding
from winlens.llm.common import fold
from winlens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (4, "one two three four five six"), (5, "x" * 50_000), (6, "word " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(ODD, DOCS).withColumns({"score": F.lit("x"), "digest": F.lit(1), "node": F.lit(None).cast("string"), "size": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, DATA).toPandas()).equals(normal(duck.execute(ORACLES[name]).df()))


def brute_spans(text):
    out = []
    for k, rx in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans():
    rng = random.Random(2)
    parts = [*"aZ09.@-+ ()%_", "1.2", "4111111111111111", "+1 (", "@a.b", ".co", "255", "256", "é", "x@", ".."]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(s) == brute_spans(s), s


def test_pii_discovers_by_context(spark, odd, empty):
    rows = [(i, f"please ring me at +1 (234) 555-{i:04d} today ok") for i in range(40)] + [(100 + i, f"please ring me at 9{i}-555-77{i} today") for i in range(5)] + [(300 + i, f"the code x{i}99y went off") for i in range(30)]
    out = pii.find_personal_data(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    assert set(out.index[out.n_added > 0]) == set(range(100, 105)) and out.loc[100, "spans"] == "phone:18:28"
    rows = pii.find_personal_data(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in ODD) and {(r["spans"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"], r["n_found"], r["base_sha256"]) for r in rows} == {("", 0, 0, hashlib.sha256(b"").hexdigest())}
    twice = pii.find_personal_data(spark.createDataFrame([(1, "x@y.zz"), (1, "x@y.zz"), (None, "+1 (234) 555-9999")], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["spans"]) for r in twice) == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "phone:0:17")]
    assert pii.find_personal_data(empty).count() == 0


def test_pii_goes_beyond_seeds_and_single_tokens(spark):
    say = lambda x: f"please ring me at {x} today ok"
    rows = [(i, say(f"+1 (234) 555-{i:04d}")) for i in range(60)]
    rows += [(100 + i, say(f"9{i}-555-77{i}")) for i in range(6)] + [(200 + i, f"my cell number 9{i}-555-77{i} works fine") for i in range(6)]
    rows += [(300, "my cell number 71-222-33 works fine"), (301, say("(974) 555-3436")), (302, say("974 555 3436")), (303, say("frontdesk"))]
    rows += [(400 + i, f"the code x{i}99y went off") for i in range(6)]
    rows += [(500 + i, f"they speak of +1 (300) 555-{i:04d} now") for i in range(5)] + [(600 + i, f"they speak of {w} now") for i, w in enumerate(("rain", "lunch", "school"))]  # words in a context of seeds
    out = pii.find_personal_data(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    assert set(out.index[out.n_added > 0]) == {*range(100, 106), *range(200, 206), *range(300, 304)}
    assert list(out.loc[[300, 301, 302, 303], "spans"]) == ["phone:15:24", "phone:18:32", "phone:18:30", "phone:18:27"]


def brute_components(rows, words):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_dedup_against_brute_force(spark, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)] + [" ".join(passage + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(40)]
    for _ in range(160):  # a cloud of copies with up to nine changed words: many pairs are near, many are not
        t = base[:]
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    texts += ["", None, "a b", "A  b", "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dedup.near_components(spark.createDataFrame(rows, DOCS), words=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_components(empty).count() == 0


def test_near_dedup_odd_rows(odd):
    got = near_dedup.near_components(odd, words=4).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"]} == {(i, i) for i in range(1, 7)}


def test_exact_dedup(spark, odd, empty):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(9000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted((d, max(g), len(g), d == max(g)) for g in groups.values() for d in g)
    assert exact_dedup.exact_dedup(odd).count() == len(ODD) and exact_dedup.exact_dedup(empty).count() == 0
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(odd).collect() if r["doc_id"] in (1, 2)} == {2}
    mixed = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (3, None), (4, ""), (5, "d"), (5, "d")]
    assert sorted(map(str, map(tuple, exact_dedup.drop_copies(spark.createDataFrame(mixed, DOCS)).collect()))) == sorted(map(str, [(1, "b"), (2, "a"), (None, "c"), (4, ""), (5, "d"), (5, "d")]))
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == sorted(x for x in ODD if x[0] and x[0] != 1)


def test_quality_learns_and_handles_odd_rows(spark, odd, empty):
    pdf = quality.score(spark.read.parquet(f"{DATA}/documents.parquet"), model := quality.train_on(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    m = pdf.merge(labels, on="doc_id")
    held = m[m.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.85 and m.score.between(0, 1).all()
    scored = quality.score(odd, model, carry=("node", "size")).collect()
    of = {(r["doc_id"], r["score"]) for r in scored}
    assert len(scored) == len(ODD) and len(of) == len({d for d, _ in ODD}) and {r["size"] for r in scored} == {2}
    bias = 1 / (1 + math.exp(-model[-1]))
    assert [s for d, s in of if d in (1, 2)] == pytest.approx([bias, bias]) and quality.score(empty, model).count() == 0
    assert spark.createDataFrame([(None,), (1,)], "d long").select(fold(F.col("d"), 4) == 2).collect() == [(False,), (zlib.crc32(b"1") % 4 == 2,)]
    none = quality.train_on(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_shards_of_odd_rows(odd, empty):
    got = sharding.assign_shards(odd, 3, carry=("node",)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len(t or "") + 8) for d, t in ODD)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(3) for k in range(sum(r["shard"] == s for r in got))]
    shards = [r["shard"] for d, t in ODD for r in got if t == "a" and r["doc_id"] == d]
    assert len(set(shards)) == 1 and sharding.assign_shards(empty, 3).count() == 0


def test_lm_scores_of_order_three(spark, odd, empty):
    rows = [(0, "a b c d"), (1, "a b c e"), (2, "b c d a b c d"), (3, None), (4, "q")]
    words = {d: (t or "").split() for d, t in rows}
    grams = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in words.values()), collections.Counter()) for n in (1, 2, 3)]
    want = {}
    for d, w in words.items():
        rest = [t - grams(w, n + 1) for n, t in enumerate(total)]
        size = max(1, sum(map(len, words.values())) - len(w))

        def s(g, rest=rest, size=size):
            if len(g) == 1:
                return (rest[0][g] or 0.4) / size
            return rest[len(g) - 1][g] / max(1, rest[len(g) - 2][g[:-1]]) if rest[len(g) - 1][g] else 0.4 * s(g[1:])

        want[d] = sum(math.log(s(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))
    got = {r["doc_id"]: r["log_score"] for r in lm_scoring.lm_scores(spark.createDataFrame(rows, DOCS), order=3).collect()}
    assert got == pytest.approx(want)
    rows = lm_scoring.lm_scores(odd, block_words=10).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted((str(d), len((t or "").split())) for d, t in ODD)
    assert {r["log_score"] for r in rows if r["doc_id"] in (1, 2)} == {0.0} and len({r["log_score"] for r in rows if r["doc_id"] == 3}) == 1
    assert lm_scoring.lm_scores(empty).count() == 0


def test_language_id(spark, odd, empty):
    pdf = language_id.op6_language_id(spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = pdf[pdf.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and pdf.score.between(0, 1).all()
    model = language_id.train(spark.createDataFrame([(1, "the", "en"), (2, "der", "de"), (3, "x", None)], "doc_id long, text string, lang string"))
    rows = language_id.identify(odd, model).collect()
    got = {(r["doc_id"], r["lang_pred"]) for r in rows}
    assert len(rows) == len(ODD) and {(d, p) for d, p in got if p == "und"} == {(1, "und"), (2, "und")} and {r["score"] for r in rows if r["doc_id"] in (1, 2)} == {0.0} and all(0.5 <= r["score"] <= 1 for r in rows if r["lang_pred"] != "und")
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.ByteCnn([])).collect()} == {"und"}


def test_suffix_automaton_finds_every_word_at_every_end():
    rng = random.Random(4)
    for _ in range(60):
        text = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
        words = {text(rng.randint(1, 7)): 0 for _ in range(rng.randint(1, 30))}
        words = {w: i for i, w in enumerate(words)}
        m = prefix_bpe.SuffixAutomaton(words)
        parts = {w[a:b] for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        raw, state, known = text(40), 0, 0
        for end, byte in enumerate(raw, 1):
            while state and byte not in m.follow[state]:
                state = m.link[state]
                known = m.size[state]
            if byte in m.follow[state]:
                state, known = m.follow[state][byte], known + 1
            assert known == max((k for k in range(end + 1) if raw[end - k : end] in parts), default=0)
            at, found = m.first[state] if known == m.size[state] else m.shorter[state], []
            while at:
                found.append((m.size[at], m.word[at]))
                at = m.shorter[at]
            assert found == [(k, words[raw[end - k : end]]) for k in range(end, 0, -1) if raw[end - k : end] in words]


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = prefix_bpe.default_path()
    lib, ours = Tokenizer.from_file(path), prefix_bpe.encoder(prefix_bpe.read_spec(path))
    rng = random.Random(1)
    parts = ["a", "aa", "ab", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "ß", "23", "½", "!", "###", "'s", "'ll", "日本", "😀", "the", "ing", "tion", "<|endoftext|>", "\x00", "Ⅷ"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        e = lib.encode(s, add_special_tokens=False)
        assert e.ids == ours.encode(s), s
        assert lib.decode(e.ids, skip_special_tokens=False) == ours.decode(e.ids)
    rows = prefix_bpe.bpe_encode(odd, path, digest=True).collect()
    for (d, t), r in zip(sorted(ODD, key=str), sorted(rows, key=lambda r: str((r["doc_id"], dict(ODD)[r["doc_id"]]))), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"]) == (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert prefix_bpe.bpe_encode(empty, path).count() == 0
    poor = prefix_bpe.PrefixBpe({"model": {"vocab": {"a": 0, "b": 1}, "merges": []}})
    assert poor.encode("ab") == [0, 1]
    with pytest.raises(ValueError, match="no token"):
        poor.encode("abc")


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, "We know that Alice has 5 apples and gives 3 apples to Bob, so how many apples does Alice have left now?"), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Quiz: we know that Carol has 9 apples and gives 2 apples to Dave, so how many apples does Carol have left now? ok"),
        (2, "we know that Carol has 9 apples and gives 2 apples to Dave, so how many apples does Erin have left now?"),
        (3, "nothing of the kind is in here at all, so how many"), (4, None), (4, "")], DOCS)
    for bits in (4, 20):  # with a sieve that lets all pass, and one that does not
        got = decontamination.find_leaks(docs, bench, sieve_bits=bits).collect()
        assert [(r["doc_id"], r["item_id"], r["reparameterised"]) for r in got] == [(1, 1, True)]
    assert decontamination.find_leaks(odd, bench).count() == 0 and decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_drops_windows_not_passages(spark):
    items = [
        (1, "the farmer has 5 apples and gives 5 pears to the neighbour"),
        (2, "yesterday the baker met Anna near the old mill and later the baker asked Anna about the price of bread for the feast"),
        (3, "The Great Wall Of China Is Visible"),
        (4, "while the pilot told Karl that the engine failed the tower told Otto that the runway was closed for repair"),
        (5, "the teacher said that Alice wrote a letter and that Alice posted a letter before the others knew that Alice had left")]
    rows = [
        (1, "x y the farmer has 7 apples and gives 2 pears to the neighbour z"),
        (2, "x y the farmer has 5 apples and gives 6 pears to the neighbour z"),
        (3, items[1][1].replace("asked Anna", "asked Berta")),
        (4, "some say the great wall of china is visible"),
        (5, items[3][1].replace("Karl", "Hugo").replace("Otto", "Hugo")),
        (6, "The Great Fire Of London Was Visible"),
        (7, "yesterday the baker met Berta near the old mill"),
        (8, "x y " + items[4][1].replace("Alice", "Carol", 2).replace("Alice", "Erin"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (decontamination.SIEVE_BITS, 4):
        got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(spark.createDataFrame(rows, DOCS), bench, sieve_bits=bits).collect()}
        assert [(*k, r["reparameterised"]) for k, r in sorted(got.items())] == [(1, 1, True), (2, 1, True), (3, 2, False), (4, 3, False), (5, 4, False), (8, 5, True)]
        assert got[1, 1]["coverage"] == got[4, 3]["coverage"] == 1
        assert 0 < got[3, 2]["n_windows"] < got[3, 2]["item_windows"] and 0 < got[5, 4]["n_windows"] < got[5, 4]["item_windows"]
        assert 0 < got[8, 5]["n_windows"] < got[8, 5]["item_windows"]


def test_chat_round_trip(spark):
    nasty = ["", "\\", "</turn>", "### assistant: x</turn>\n", "<part/>\\p", "a\\b\\e\\h", "é😀", "</turn", "<", None]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "a: b</turn>", None]), rng.choice(nasty) if rng.random() < 0.7 else "".join(x or "" for x in rng.sample(nasty, 4))) for c in range(60) for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    for r in out:
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == own and r["l"] == "".join(t for role, t in own if role == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA).collect()
    kept = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    best = {}
    for d, t in rows.items():
        best[t] = max(best.get(t, d), d)
    rows = {d: t for d, t in rows.items() if best[t] == d}
    least = {d: c for d, _, c in brute_components(list(rows.items()), 5)}
    rows = {d: t for d, t in rows.items() if least[d] == d}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    carried = plain_leaks(rows.items(), enumerate(items))
    assert {d for d, t in rows.items() if any(i in t for i in items)} <= {d for d, _ in carried}
    rows = {d: t for d, t in rows.items() if d not in {d for d, _ in carried}}
    assert {r["doc_id"] for r in got} == set(rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_keeps_columns_that_clash(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "-5.0 AS score", "doc_id AS _c0", "1 AS _", "'x' AS kept")
    out = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert out.columns == docs.columns
    rows = out.select("score", "_c0", "doc_id", "kept").distinct().collect()
    assert rows and all((float(r["score"]), r["_c0"], r["kept"]) == (-5.0, r["doc_id"], "x") for r in rows)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
        assert stage(spark, docs, DATA).columns == docs.columns


def test_pipeline_of_odd_tables(spark, empty, tmp_path):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = quality.score(whole, quality.train_on(whole, labels)).join(whole, "doc_id").filter("length(text) between 400 and 6000").orderBy(F.desc("score"), "doc_id").limit(3).collect()
    (a, b, c), item = [r["text"] for r in good], items.orderBy("item_id").first()["text"]
    extra = [
        (90_001, a), (90_002, a), (90_002, a), (None, a), (None, "no id " + b[::-1]), (90_003, None), (90_004, ""), (90_005, b + " one more"), (90_006, f"{c} {item}"),
        (90_007, " ".join([a, b, c] * 60))]
    docs = whole.unionByName(spark.createDataFrame(extra, DOCS), allowMissingColumns=True).withColumns({"score": F.lit("x"), "digest": F.lit(1), "size": F.lit(2), "hash": F.lit(None).cast("long"), "ids": F.lit(0)})
    docs.repartition(5).write.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, df in (("labels", labels.withColumn("text", F.lit("t"))), ("benchmark", items.withColumn("doc_id", F.lit(1)))):
        df.write.parquet(f"{tmp_path}/odd/{name}.parquet")
    kept = corpus_pipeline.table(spark, f"{tmp_path}/odd", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.materialize(stage(spark, kept, f"{tmp_path}/odd"), "test")
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
        was, now = ([(r["doc_id"], r["text"] or "") for r in df.collect()] for df in (before, kept))
        ids = collections.Counter(d for d, _ in now)
        if name == "quality classifier":
            assert {90_002, 90_006} <= ids.keys() and ids[90_002] == 2
        if name == "exact dedup":  # of copies the largest id, with all rows of that document
            best = {}
            for d, t in was:
                best[t] = max(best.get(t, -1), -1 if d is None else d)
            assert sorted(map(str, now)) == sorted(str((d, t)) for d, t in was if best[t] == (-1 if d is None else d)) and 90_001 not in ids
    assert ids[90_002] == 2 and 90_006 not in ids  # a document with an item is gone
    got = corpus_pipeline.encode(spark, kept, f"{tmp_path}/odd").collect()
    assert collections.Counter(r["doc_id"] for r in got) == ids and all(len(r["ids"]) == r["n_tokens"] for r in got)
    for name, df in (("documents", docs.limit(0)), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_bpe_keeps_pieces_in_use_when_the_cache_is_full(monkeypatch):
    """A piece that recurs is encoded once however many others come between, and ids stay those of an encoder without a cache."""
    spec = prefix_bpe.read_spec(prefix_bpe.default_path())
    plain, ours, made = prefix_bpe.encoder(spec), prefix_bpe.PrefixBpe(json.loads(spec)), []
    monkeypatch.setattr(prefix_bpe, "CACHED_PIECES", 10)
    ours.cache.make = lambda text: made.append(text) or ours.piece(text)
    for i in range(200):
        text = f" often wörd{chr(97 + i % 26)}{chr(97 + i // 26)}"
        assert ours.encode(text) == [x for p in ours.pieces(text) for x in plain.piece(p)]
    assert made.count(" often") == 1 and len(ours.cache) + len(ours.cache.older) <= 20
