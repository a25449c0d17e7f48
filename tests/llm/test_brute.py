"""Corpus operators against plain versions that look at everything."""

import bisect
import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from winlens.llm import decontamination as dc
from winlens.llm import language_id, lm_scoring, pii, quality, sharding

DOCS = "doc_id long, text string"


# op1


def plain_bootstrap(mentions):
    """mentions (kind, instance, pattern, rare): confident (pattern, kind, rare), accepted (instance, kind)."""
    kinds = range(len(pii.KINDS))
    edges = {}
    for kind, instance, pattern, rare in mentions:
        old_rare, seeds = edges.get((pattern, instance), (True, frozenset()))
        edges[pattern, instance] = (old_rare and rare, seeds | ({kind} if kind is not None else set()))
    seeds = collections.defaultdict(set)
    for (_, i), (_, s) in edges.items():
        seeds[i] |= s
    score = {i: [float(k in s) for k in kinds] for i, s in seeds.items()}
    of = collections.defaultdict(list)
    for (p, i), (rare, s) in edges.items():
        of[p].append((i, rare, s))
    while True:
        sure = {}
        for p, rows in of.items():
            for k in kinds:
                n = sum(k in s or not seeds[i] and score[i][k] >= pii.ACCEPT for i, _, s in rows)
                for side, part in (("c", [score[i][k] for i, rare, _ in rows if not rare]), ("a", [score[i][k] for i, _, _ in rows])):
                    mean = sum(part) / len(part) if part else 0
                    sure[p, side, k] = mean if n >= pii.MIN_SEEDS and mean >= pii.CONFIDENT else 0
        new = {}
        for i in score:
            new[i] = score[i] if seeds[i] else [1 - math.prod(max(1e-9, 1 - sure[p, "a" if rare else "c", k]) for p, rows in of.items() for j, rare, _ in rows if j == i) for k in kinds]
        rise = max(b - a for i in score for a, b in zip(score[i], new[i], strict=True))
        score = new
        if rise <= pii.SAME:
            break
    best = lambda xs: max(kinds, key=lambda k: (xs[k], -k))
    confident = {(p, best([sure[p, side, k] for k in kinds]), side == "a") for p in of for side in "ca" if any(sure[p, side, k] for k in kinds)}
    return confident, {(i, best(x)) for i, x in score.items() if not seeds[i] and max(x) >= pii.ACCEPT}


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap(spark, seed):
    rng = random.Random(seed)
    mentions = []
    for p in range(25):
        kind = rng.choice([0, 0, 3, 4, None])
        for _ in range(rng.randint(3, 25)):
            own = kind if rng.random() < 0.7 else None
            i = f"{'u' if own is None else 's'}{own if own is not None else ''}-{rng.randrange(25)}"
            mentions.append((own, i, f"p{p}", own is None and rng.random() < 0.3))
    rows = spark.createDataFrame(mentions, "kind int, instance string, pattern string, rare boolean")
    confident, accepted = pii.bootstrap(rows)
    got = {tuple(r) for r in confident.collect()}, {tuple(r) for r in accepted.collect()}
    assert got == plain_bootstrap(mentions) and got[0]


def test_planted_identifiers_by_kind(spark):
    """Recall and precision of identifiers that no base form has, in contexts taught by base ones; and groups of digits of any length, whole."""
    form = {"phone": "please call my number {} now", "email": "write to the mailbox {} any time", "ip": "the server answers at host {} behind it", "card": "she paid with plastic {} at once"}
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881", "5105105105105100", "378282246310005"]
    seed = {"phone": lambda i: f"+1 (234) 555-{i:04d}", "email": lambda i: f"user{i}@mail.example.org", "ip": lambda i: f"10.0.{i}.7", "card": lambda i: cards[i % len(cards)]}
    hidden = {"phone": ["555 12 34", "1 2", "0049-171-55", ("1234567890 " * 9).strip()], "email": ["anna(at)web.example", "berta_AT_web", "carl[at]mail"], "ip": ["fe80::17", "myhost.local", "2001:db8::5"], "card": ["41111111111x", "XXXX-4242", "4111"]}
    rows, want = [], {}
    for k, kind in enumerate(form):
        rows += [(1000 * k + i, f"{form[kind].format(seed[kind](i))} and word{i}") for i in range(60)]
        for j, x in enumerate(hidden[kind]):
            rows.append((1000 * k + 500 + j, form[kind].format(x)))
            at = form[kind].index("{}")
            want[1000 * k + 500 + j] = f"{kind}:{at}:{at + len(x)}"
    rows += [(9000 + i, f"chapter {i} has 12 34 pages and a note(at)the end of item {i}") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).filter("n_added > 0").collect()}
    recall = {kind: sum(got.get(d) == w for d, w in want.items() if w.startswith(kind)) / len(hidden[kind]) for kind in form}
    assert set(got) <= set(want) and min(recall.values()) == 1, (recall, got)


def test_contexts_of_any_length(spark):
    long = "w" * 90
    number = "9" * 70
    rows = [(i, f"{long} {'x' * 200} +1 (234) 555-{i:04d} ok") for i in range(40)]
    rows += [(100, f"{long} {'x' * 200} 12-34-56 ok"), (101, f"{'v' * 90} {'y' * 200} 12-34-57 no"), (102, f"{long} {'x' * 200} {number} ok"), (103, f"{long} {'x' * 200} 7381 ok")]
    out = pii.find_personal_data(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    assert set(out.index[out.n_added > 0]) == {100, 102, 103}
    assert out.loc[102, "spans"] == f"phone:292:{292 + 70}"


def test_secrets_need_a_context(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1"
    rows = [(i, f'some text {i % 7} token = "{key()}" and more') for i in range(9)] + [(50, f"the file has the sum {key()} today"), (51, 'so TOKEN = "hunter2hunter" it is')]
    out = pii.find_personal_data(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    assert set(out.index[out.n_added > 0]) == {*range(9), 51} and out.loc[51, "spans"] == "secret:12:25" and set(out.n_found[out.n_added == 0]) == {0}


# op3


def plain_features(text):
    words = text.split()
    hashed = quality.Hasher()
    slots = collections.Counter()
    word, shape = ([hashed.of_word(w)[k] for w in words] for k in (0, 1))
    all_ = word + shape
    mix, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for k, x in enumerate((word, shape)):
        all_ += [(a * mix & m) ^ (b + k & m) for a, b in itertools.pairwise(x)]
    all_ += [11 if words[i].lower() in [w.lower() for w in words[max(0, i - 2) : i]] else 12 for i in range(len(words))]
    for h in all_:
        h = h * mix & m
        slots[(h ^ h >> 29) & quality.BUCKETS - 1] += 1
    return {s: math.sqrt(n / len(words)) for s, n in slots.items()}


def test_quality_features_and_shapes():
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "The", "a1", "B-52", "x" * 40 + "1", "é", "##", "the"]) for _ in range(rng.randint(1, 40)))
        slots, values = quality.Hasher().features(text)
        assert dict(zip(slots.tolist(), values.tolist(), strict=True)) == pytest.approx(plain_features(text))
    assert quality.shape("x" * 30 + "7") == "a0" and quality.shape("x" * 30) == "a"


def test_ftrl_updates():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6).astype(np.float32), int(rng.random() < 0.4)) for _ in range(50)]
    z, n = np.zeros(31), np.zeros(31)
    quality.ftrl(rows, z, n, 2, 9)
    good = sum(y for *_, y in rows)
    weight = {0: 50 / (2 * (50 - good)), 1: 50 / (2 * good)}
    pz, pn = collections.defaultdict(float), collections.defaultdict(float)

    def w(i):
        return 0.0 if abs(pz[i]) <= quality.L1 else -(pz[i] - math.copysign(quality.L1, pz[i])) / ((quality.BETA + math.sqrt(pn[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(9)
    for _ in range(2):
        for r in order.permutation(50):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), 30: 1.0}
            y, now = rows[r][2], {i: w(i) for i in x}
            g = {i: (1 / (1 + math.exp(-sum(now[j] * x[j] for j in x))) - y) * weight[y] * x[i] for i in x}
            for i in x:
                sigma = (math.sqrt(pn[i] + g[i] ** 2) - math.sqrt(pn[i])) / quality.ALPHA
                pz[i] += g[i] - sigma * now[i]
                pn[i] += g[i] ** 2
    assert z.tolist() == pytest.approx([pz[i] for i in range(31)], abs=1e-5) and quality.weights(z, n).tolist() == pytest.approx([w(i) for i in range(31)], abs=1e-5)


def test_scores_are_sparse_dot_products(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train_on(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality.score(docs, model).filter("doc_id % 5 = 0").collect():
        t = sum(v * model[s] for s, v in plain_features(texts[r["doc_id"]]).items()) + model[-1] if texts[r["doc_id"]].split() else model[-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-t)), abs=1e-5)


# op4


def plain_shards(rows, shards, ranges):
    """rows (doc_id, size, key, tie): shard and slot of each."""
    total = sum(r[1] for r in rows)
    share, of = total / shards, collections.defaultdict(int)
    for _, size, key, _ in rows:
        of[key] += size
    large = sorted((k for k in of if of[k] >= min(0.01 * share, total / ranges)), key=lambda k: (-of[k], k))
    held, packed = [0] * shards, {}
    for k in large:
        s = min(range(shards), key=lambda s: (held[s], s))
        if held[s] + of[k] <= share:
            packed[k] = s
            held[s] += of[k]
    room = [max(0.0, share - h) for h in held]
    rest = sorted((r for r in rows if r[2] not in packed), key=lambda r: (r[2], r[3], r[1]))
    ends = list(np.cumsum(room) * (sum(r[1] for r in rest) / sum(room)))[:-1]
    shard = {r[0]: packed[r[2]] for r in rows if r[2] in packed}
    at = 0
    for key, group in itertools.groupby(rest, key=lambda r: r[2]):
        first = at
        for doc, size, *_ in group:
            middle = at + size / 2 if key in large else first + of[key] / 2
            shard[doc] = bisect.bisect_right(ends, middle)
            at += size
    slots = collections.Counter()
    out = {}
    for doc, *_ in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        out[doc] = shard[doc], slots[shard[doc]]
        slots[shard[doc]] += 1
    return out


@pytest.mark.parametrize(("ranges", "hot"), [(96, 3), (700, 3), (96, 60)])
def test_shards(spark, ranges, hot):
    docs = spark.range(9000).selectExpr("id doc_id", f"case when id % {hot} = 0 then 'a text that is held by many' when id % 7 = 0 then concat('group ', id % 40) else concat('t', id, repeat('x', cast(id % 13 as int))) end text").repartition(5)
    rows = [(r["doc_id"], r["size"], r["key"], r["tie"]) for r in sharding.keyed(docs, "doc_id", "text", ()).collect()]
    got = sharding.assign_shards(docs, 24, least_ranges=ranges).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == plain_shards(rows, 24, ranges)
    sums, keys = collections.Counter(), collections.defaultdict(set)
    for r in got:
        sums[r["shard"]] += r["size"]
        keys[r["text_crc32"]].add(r["shard"])
    assert len(sums) == 24 and max(sums.values()) < 1.02 * min(sums.values())
    assert sum(len(x) > 1 for x in keys.values()) == (hot == 3)  # only the text that is larger than a shard is split


# op5


def test_packed_and_relational_scores_are_the_same(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").unionByName(spark.createDataFrame([(-1, None), (-2, " \t"), (-3, "a"), (-3, "a b")], DOCS))
    for order in (1, 2, 3):
        a, b = ({(r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in f(docs, order=order).collect()} for f in (lm_scoring.lm_scores, lm_scoring.relational_scores))
        assert a == b
    shuffled = lm_scoring.lm_scores(docs.repartition(7, "doc_id"), block_words=500)  # an input that comes out of a shuffle
    assert {r["doc_id"] for r in shuffled.collect()} == {r["doc_id"] for r in docs.collect()}


# op6


def test_forward_pass_and_gradients():
    net = language_id.ByteCnn(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch = np.random.default_rng(2).integers(97, 123, (3, language_id.WINDOW)).astype(np.uint8)
    batch[2, 40:] = 0
    labels = np.array([0, 2, 1])

    def probabilities(row):
        emb = [net.p["e"][b] for b in row]
        tops = []
        for f in range(net.p["w"].shape[1]):
            filt = net.p["w"][:, f].reshape(language_id.WIDEST, language_id.EMBED)
            tops.append(max(sum(float(emb[at + k] @ filt[k]) for k in range(language_id.WIDEST)) for at in range(len(row) - language_id.WIDEST + 1)) + net.p["b"][f])
        out = np.array([sum(max(0.0, t) * net.p["v"][i, c] for i, t in enumerate(tops)) + net.p["c"][c] for c in range(3)])
        return np.exp(out - out.max()) / np.exp(out - out.max()).sum()

    assert net.forward(batch)[3] == pytest.approx(np.array([probabilities(r) for r in batch]), abs=1e-9)
    widths = [int((net.mask[:, f].reshape(language_id.WIDEST, -1)[:, 0] > 0).sum()) for f in range(net.mask.shape[1])]
    assert widths == [w for w in language_id.WIDTHS for _ in range(language_id.FILTERS)]
    loss = lambda: -np.log(net.forward(batch)[3][np.arange(3), labels]).mean()
    grads, rng = net.gradients(batch, labels), np.random.default_rng(5)
    for name, g in grads.items():
        where = np.argwhere(np.abs(g) > 1e-4)
        for at in map(tuple, where[rng.permutation(len(where))[:6]]):
            old = net.p[name][at]
            net.p[name][at] = old + 1e-6
            up = loss()
            net.p[name][at] = old - 1e-6
            down = loss()
            net.p[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=2e-2, abs=1e-5), (name, at)


# op8


def plain_template(text):
    """(word as it is, template word, type, value) of each word."""
    out, after_number = [], False
    for line in text.split("\n"):
        opens = True
        for w in line.split():
            bare = w.strip(dc.EDGE)
            low = bare.lower()
            kind = dc.LITERAL
            if low in dc.NUMBER_WORDS or bare and dc.NUMBER.fullmatch(bare):
                kind = dc.NUM
            elif low in dc.UNITS:
                kind = dc.UNIT if after_number else dc.LITERAL
            elif bare[:1].isupper() and dc.NAME.fullmatch(bare):
                kind = dc.LITERAL if opens else dc.NAMED
            elif bare[:1] in "+-$€£0123456789" and bare and dc.NUMBER_UNIT.fullmatch(low):
                kind = dc.GLUED
            out.append((low or w, low or w if kind == dc.LITERAL else kind, kind, low, opens))
            after_number = kind == dc.NUM
            tail = w[len(w.rstrip(dc.EDGE)) :]
            opens = w[-1] in ".!?:" or any(c in ".!?" for c in tail)
    return out


def dense(words, at):
    return sum(x[2] == dc.LITERAL for x in words[at : at + dc.WORDS]) < dc.POSTED


def plain_votes(votes):
    ends = lambda v: {(v[0], 0, v[1])} | ({(v[0], 1, v[2])} if v[0] == dc.NAMED else set())
    taken, kept = set(), set()
    for level in sorted({(-len(n), v[1] != v[2]) for v, n in votes.items()}):
        free = [v for v, n in votes.items() if (-len(n), v[1] != v[2]) == level and not ends(v) & taken]
        new = [e for v in free for e in ends(v)]
        if len(new) > len(set(new)):
            return set()
        taken |= set(new)
        kept |= set(free)
    return kept


def plain_leaks(docs, items):
    found = {}
    for (doc, text), (item, item_text) in itertools.product(docs, items):
        d, i = plain_template(text or ""), plain_template(item_text or "")
        n = min(dc.WORDS, len(i))
        if not n:
            continue
        ours = range(len(i) - n + 1)
        alone = lambda at: d[at][4] and (at + n == len(d) or d[at + n][4])  # noqa: E731, B023
        part = lambda words, at, k: [x[k] for x in words[at : at + n]]  # noqa: E731, B023
        exact = lambda k: n < dc.WORDS or dense(i, k)  # noqa: E731, B023
        pairs = [(at, k) for at in range(len(d) - n + 1) for k in ours if (part(d, at, 0) == part(i, k, 0) and (n == dc.WORDS or alone(at)) if exact(k) else not dense(d, at) and part(d, at, 1) == part(i, k, 1))]
        kept, changed = set(), False
        slots = lambda at, k: [] if exact(k) else [(d[at + j][2], i[k + j][3], d[at + j][3], at + j) for j in range(n) if d[at + j][2]]  # noqa: E731, B023
        for diagonal in {at - k for at, k in pairs}:
            votes = collections.defaultdict(set)
            for at, k in (p for p in pairs if p[0] - p[1] == diagonal):
                for kind, a, b, place in slots(at, k):
                    if kind in (dc.UNIT, dc.NAMED):
                        votes[kind, a, b].add(place)
            fair = plain_votes(votes)
            fit = [(at, k) for at, k in pairs if at - k == diagonal and all(a == b or kind not in (dc.UNIT, dc.NAMED) or (kind, a, b) in fair for kind, a, b, _ in slots(at, k))]
            covered = {k + j for _, k in fit for j in range(n)}
            other = [{place - diagonal for _, a, b, place in slots(at, k) if a != b} for at, k in fit]
            same = {k + j for (_, k), o in zip(fit, other, strict=True) for j in range(n) if k + j not in o}
            if len(same) >= max(min(dc.LITERALS, len(covered)), dc.EVIDENCE * len(covered)):
                kept |= {k for _, k in fit}
                changed |= any(other)
        if len(kept) >= min(dc.LEAST_WINDOWS, len(ours)) and len(kept) / len(ours) >= dc.LEAST_SHARE:
            found[doc, item] = len(kept), len(ours), changed
    return found


def test_leaks(spark):
    rng = random.Random(12)
    literals, names, numbers, units = "the farmer gives pears to neighbour and then walks home with bread".split(), ["Anna", "Berta", "Carl", "Dora"], ["3", "5", "seven", "12%", "5km"], ["km", "hours"]

    def sentence(n):
        out = []
        while len(out) < n:
            x = rng.random()
            out += [rng.choice(literals)] if x < 0.7 else [rng.choice(names)] if x < 0.82 else [rng.choice(numbers), rng.choice(units)] if x < 0.9 else [rng.choice(numbers) + rng.choice(["", ".", ","])]
        return out

    items = [(k, " ".join(sentence(rng.randint(4, 25)))) for k in range(25)] + [(30, "3 + 4 = 7 and 5 + 6 = 11"), (31, ""), (32, None), (33, "Anna paid Berta 5 and Carl 6"), (34, "home"), (35, "3 4 5 6 7 8 12% gives pears to the farmer")]
    docs = [(-1, None), (-2, ""), (-3, "home"), (-4, "so. Home!"), (-5, "home and"), (-6, "the 8 12% gives pears to the"), (-7, "1 1 1 1 1 1 1 gives pears to the farmer")]
    for k in range(150):
        words = (rng.choice(items)[1] or "").split()
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) if rng.random() < 0.5 else {}
        words = [swap.get(w, w) for w in words]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(sentence(1))
        if rng.random() < 0.3 and words:
            words.insert(rng.randrange(len(words)), "then")
        docs.append((k, " ".join(sentence(rng.randint(0, 5)) + words + sentence(rng.randint(0, 5)))))
    want = plain_leaks(docs, items)
    for bits in (6, dc.SIEVE_BITS):
        got = dc.find_leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), sieve_bits=bits).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in got} == want
    assert len(want) > 60 and any(x[2] for x in want.values()) and not all(x[2] for x in want.values())


def test_dense_short_and_german_items(spark):
    german = "Gestern kaufte Anna in Berlin drei Äpfel und Peter in Hamburg fünf Birnen"
    items = [(1, "3 4 5 6 7 8 9 tell us the sum"), (2, "open the book"), (3, german), (4, "Wie viele Bücher liest Karl im Jahr, wenn er jede Woche zwei Bücher liest?")]
    docs = [
        (1, "For rooms 8 9 tell us the sum of the rent"), (2, "1 1 2 3 5 8 13 tell us the sum"), (3, "they open the book of rules"), (4, "Now. Open the book! Read."), (5, "x\nopen the book\ny"),
        (6, "ja " + german.replace("Anna", "Maria").replace("Berlin", "Köln").replace("drei", "sieben").replace("Peter", "Jonas").replace("Hamburg", "Bonn").replace("fünf", "neun") + " ja"),
        (7, "Morgen fährt Maria nach Köln und Jonas nach Bonn"), (8, "7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (9, items[3][1].replace("Karl", "Emil").replace("zwei", "drei")), (10, "Gestern kaufte Maria in Köln Brot")]
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(2, 1), (4, 2), (5, 2), (6, 3), (9, 4)}
    assert got[2, 1][1] == 6 and got[6, 3][1] == 8 and got[6, 3][2] and not got[4, 2][2]
    assert got == plain_leaks(docs, items)


LANGUAGES = {
    "en": ("On {d} morning {a} drove {n} miles to {c} and bought {m} bottles of milk for the party that {b} gives in {e}", "Anna Berta Carl Dora Emil Frank".split(), "Oslo Lima Rome Bonn".split()),
    "de": ("Am Morgen fuhr {a} {n} Kilometer nach {c} und kaufte {m} Flaschen Milch für das Fest, das {b} im Sommer in {e} gibt", "Anna Berta Karl Dora Emil Franz".split(), "Oslo Lima Rom Bonn".split()),
    "fr": ("Le matin {a} a fait {n} kilomètres pour aller à {c} et a acheté {m} bouteilles de lait pour la fête que {b} donne à {e}", "Anne Berthe Carl Denise Emile Franck".split(), "Oslo Lima Rome Bonn".split()),
    "es": ("Por la mañana {a} condujo {n} kilómetros hasta {c} y compró {m} botellas de leche para la fiesta que {b} da en {e}", "Ana Berta Carlos Dora Emilio Franco".split(), "Oslo Lima Roma Bonn".split())}


def test_recall_of_reparameterised_items_by_language(spark):
    """Items with other names, places and numbers inside other text; and texts that share no more than names with them."""
    rng, items, docs, planted = random.Random(4), [], [], set()
    for k, (lang, (form, names, places)) in enumerate(LANGUAGES.items()):
        fill = lambda: form.format(d="that", a=(x := rng.sample(names, 2))[0], b=x[1], c=(y := rng.sample(places, 2))[0], e=y[1], n=rng.randint(2, 99), m=rng.randint(2, 99))  # noqa: E731, B023
        items.append((k, fill()))
        for j in range(30):
            planted.add((100 * k + j, k))
            docs.append((100 * k + j, f"vorher nachher avant antes {fill()} after all of it"))
        docs += [(100 * k + 50 + j, " ".join(rng.sample(names, 2) + rng.sample(places, 2) + [str(rng.randint(2, 99)), "and so on with", lang, "words of their own"])) for j in range(30)]
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {lang: len({p for p in planted & got if p[1] == k}) / 30 for k, lang in enumerate(LANGUAGES)}
    assert got <= planted and min(recall.values()) >= 0.9, recall


def test_all_verbatim_items_are_found(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()}
    whole = {(r["doc_id"], r["item_id"]) for r in docs.select("doc_id", "text").join(items.select("item_id", F.col("text").alias("t")), F.expr("instr(text, t) > 0")).collect()}
    assert whole and whole <= got
