import collections
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winlens.operators import incidents as inc
from winlens.operators import policy as po
from winlens.streaming import stateful as st

SCHEMA = "capture bigint, win bigint, start_ts double, end_ts double, category string, sources array<struct<addr:bigint,n:bigint>>, targets array<struct<addr:bigint,n:bigint>>"


def case(seed, n=150):
    rng = random.Random(seed)
    rows, t, mood = [], 0.0, "Benign"
    for i in range(n):
        if rng.random() < 0.2:
            mood = rng.choice(["Benign", "Benign", "DDoS", "Recon"])
        t += rng.choice([1, 1, 1, 1, 70])
        end = t + rng.choice([1.0, 2.0, 90.0 if rng.random() < 0.1 else 1.0])
        a = lambda: [{"addr": rng.randrange(1, 6), "n": rng.randrange(1, 9)}]  # noqa: E731, B023
        rows.append((seed, i, t, end, mood, a(), a()))
        t = end
    return rows


def fed(rows, policy):
    """Windows one by one, as a fold gets them."""
    last = None
    for c, win, start, end, category, s, t in rows:
        slow = end - start > policy.longest
        yield c, {"first_win": win, "last_win": win, "start_ts": start, "end_ts": end, "category": category, "sources": s, "targets": t, "unjudged": slow, "breaks": slow or last is not None and start - last > policy.silence}
        last = end


def one_by_one(rows, policy):
    fold = po.Fold(policy)
    return [(c, *d[:6]) for c, row in fed(rows, policy) for d in fold.feed(row)]


def ranked(votes, n):
    return [k for k, _ in sorted(collections.Counter(votes).items(), key=lambda kv: -kv[1])][:n]


def from_history(rows, policy):
    """The rules of the policy with nothing carried along but what happened: every question is answered by going through the past anew.

    Addresses are ranked at every window (refresh 1) and counters are never cut.
    """
    out, members, events = [], {}, []  # members: incident -> rows; events: ("judged" | "benign" | "break" | "own", incident)
    said = lambda row, side: [a["addr"] for a in row[side] for _ in range(a["n"])]
    ends = lambda row: {a for side in ("sources", "targets") for a in ranked(said(row, side), 1)}
    top = lambda rows_: set(ranked([a for side in ("sources", "targets") for r in rows_ for a in said(r, side)], policy.top))
    main = lambda rows_: ranked([r["category"] for r in rows_], 1)[0]

    def since(i):
        """Windows judged since the incident's last one, and benign ones among them; None after it closed."""
        past = []
        for kind, who in reversed(events):
            if kind == "own" and who == i:
                break
            past.append(kind)
        past.reverse()
        n = sum(k in ("judged", "benign") for k in past)
        return None if "break" in past or n >= policy.close_after else (n, past.count("benign"))

    order = lambda: [i for i in dict.fromkeys(reversed([w for k, w in events if k == "begin"]))][::-1]
    alive = lambda: [i for i in order() if since(i) is not None]
    pending, deaf = [], False
    for c, row in fed(rows, policy):
        win = row["first_win"]
        if row["breaks"]:
            events.append(("break", None))
        if row["breaks"] or row["category"] == po.BENIGN:
            pending, deaf = [], False
        if row["unjudged"]:
            out.append((c, win, win, "unjudged", None, 0, win))
            continue
        if row["category"] == po.BENIGN:
            if not alive():
                out.append((c, win, win, "background", None, 0, win))
            events.append(("benign", None))
            continue
        owner = next((i for i in alive() if main(members[i]) == row["category"]), None)
        owner = next((i for i in alive() if ends(row) & top(members[i])), None) if owner is None else owner
        if owner is not None:
            out.append((c, win, win, "attack", owner, since(owner)[1], win))
            members[owner].append(row)
            events.append(("judged", None))
            events.append(("own", owner))
            continue
        events.append(("judged", None))
        if deaf:
            continue
        pending = [*pending, row][-policy.in_a_row :]
        if len(pending) < policy.in_a_row:
            continue
        lead = main(pending)
        near = set().union(*(ends(r) for r in pending if r["category"] == lead))
        kin = [r for r in pending if r["category"] == lead or ends(r) & near]
        pending = [r for r in pending if r not in kin]
        began = kin[0]["start_ts"]
        former = [i for i in members if i not in alive() and began - members[i][-1]["end_ts"] <= policy.reopen_within and main(members[i]) == main(kin) and top(members[i]) & top(kin)]
        former = max(former, key=lambda i: (members[i][-1]["end_ts"], -i), default=None)
        if former is None and len(members) >= policy.most:
            deaf = True
            out.append((c, win, win, "over cap", None, 0, win))
            continue
        i = len(members) if former is None else former
        out.append((c, kin[0]["first_win"], win, "open" if former is None else "reopen", i, 0, win))
        members.setdefault(i, []).extend(kin)
        events += [("begin", i), ("own", i)]
        out += [(c, r["first_win"], r["first_win"], "attack", i, 0, win) for r in kin]
    return out


def spread(decisions):
    """Background ranges as windows; the place at which a range was written does not matter."""
    out = []
    for c, a, b, kind, i, benign, at in decisions:
        i = None if i is None or pd.isna(i) else int(i)
        out += [(c, w, kind, i, benign, at if kind != "background" else 0) for w in (range(a, b + 1) if kind == "background" else [a])]
    return sorted(out, key=str)


POLICY = po.Policy(in_a_row=3, close_after=4, most=5)


def test_run_lengths_change_nothing(spark):
    rows = [r for s in range(12) for r in case(s)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in po.decide(po.stretches(df, POLICY), POLICY).collect()]
    want = [d for s in range(12) for d in one_by_one(case(s), POLICY)]
    assert spread(got) == spread(want)
    assert {"open", "reopen", "attack", "background", "unjudged", "over cap"} == {d[3] for d in want}


@pytest.mark.parametrize("seed", range(40))
def test_fold_follows_the_rules(seed):
    rng = random.Random(seed)
    policy = po.Policy(in_a_row=rng.choice([1, 2, 3, 4]), close_after=rng.choice([1, 2, 4, 10]), most=rng.choice([2, 5, 20]), refresh=1, reopen_within=rng.choice([50.0, 300.0, 5000.0]))
    assert spread(one_by_one(case(seed), policy)) == spread(from_history(case(seed), policy))


@pytest.mark.parametrize(("within", "most"), [(300.0, 5), (300.0, 2), (50.0, 20), (5000.0, 4)])
def test_segments_change_nothing(spark, within, most):
    """Captures over many tasks, with reopenings over segments and without room, against the fold from end to end."""
    policy = po.Policy(in_a_row=2, close_after=4, most=most, reopen_within=within)
    rows = [r for s in range(10) for r in case(s, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in po.decide(po.stretches(df, policy, chunk=16), policy, segment=20).collect()]
    want = [d for s in range(10) for d in one_by_one(case(s, 200), policy)]
    assert spread(got) == spread(want)


def test_an_incident_opens_after_enough_windows_and_closes():
    w = lambda i, c: (1, i, i * 2.0, i * 2.0 + 1, c, [{"addr": 7, "n": 3}], [{"addr": 8, "n": 3}])
    rows = [w(0, "DDoS"), w(1, "DDoS"), w(2, "Benign"), w(3, "DDoS"), w(4, "DDoS"), w(5, "DDoS")] + [w(i, "Benign") for i in range(6, 12)]
    got = one_by_one(rows, POLICY)
    assert [(d[1], d[3]) for d in got if d[3] in ("open", "attack")] == [(3, "open"), (3, "attack"), (4, "attack"), (5, "attack")]
    assert [d[1] for d in got if d[3] == "background"] == [2, 10, 11]


def stream(spark, df, f, parts, order, tmp_path, mode="append"):
    """Rows of a stream that gets df in several files, cut by place in `order`."""
    src = str(tmp_path / "in")
    n = df.agg(F.max(order)).first()[0] + 1
    for k in range(parts):
        df.orderBy("capture", order).filter((F.col(order) >= k * n / parts) & (F.col(order) < (k + 1) * n / parts)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = f(s).writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    return spark.sql("select * from t").collect()


def test_policy_stream_equals_batch(spark, tmp_path):
    rows = [r for s in (1, 2) for r in case(s, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in stream(spark, df, lambda s: st.decide_stream(s, POLICY), 2, "win", tmp_path)]
    assert spread(got) == spread([d for s in (1, 2) for d in one_by_one(case(s, 60), POLICY)])


def test_count_windows_stream_equals_batch(spark, tmp_path):
    rows = [(c, i, float(i * i % 17 + i), 40 + i % 9, 6 if i % 3 else 17, float(i % 2)) for c in (1, 2) for i in range(47)]
    df = spark.createDataFrame(rows, "capture bigint, o bigint, ts double, size bigint, protocol bigint, syn double")
    got = stream(spark, df, lambda s: st.count_windows(s, (5, 10), ["syn"]), 3, "o", tmp_path)
    assert sorted((r["capture"], r["window_size"], r["win"]) for r in got) == sorted((c, s, w) for c in (1, 2) for s in (5, 10) for w in range(47 // s))
    for r in got:
        part = [x for x in rows if x[0] == r["capture"]][r["win"] * r["window_size"] : (r["win"] + 1) * r["window_size"]]
        assert r["tot_sum"] == sum(x[3] for x in part) and r["syn"] == pytest.approx(sum(x[5] for x in part) / len(part))
        assert r["start_ts"] == min(x[2] for x in part) and r["protocol_type"] == 6


def test_count_windows_flush_at_the_end(spark, tmp_path):
    rows = [(1, i, float(i), 40 + i, 6, 1.0, False) for i in range(7)] + [(1, 7, None, None, None, None, True)] + [(2, i, float(i), 50, 17, 0.0, False) for i in range(3)]
    df = spark.createDataFrame(rows, "capture bigint, o bigint, ts double, size bigint, protocol bigint, syn double, over boolean")
    got = stream(spark, df, lambda s: st.count_windows(s, (5,), ["syn"], "over"), 2, "o", tmp_path)
    assert sorted((r["capture"], r["win"], r["number"], r["tot_sum"]) for r in got) == [(1, 0, 5, 210), (1, 1, 2, 91)]


def test_scores_in_the_stream(spark, tmp_path):
    rows = [(c, i, float(i % 3), float(i % 5)) for c in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "capture bigint, win bigint, x double, y double")

    def predict(a):
        p = np.stack([a[:, 0] + 1, a[:, 1], a[:, 0] * 0 + 1], 1)
        return p / p.sum(1, keepdims=True)

    for limit in (None, 0.5):
        got = stream(spark, df, lambda s: st.score_stream(s, predict, ("Benign", "DDoS", "Recon"), ["x", "y"], limit, 7), 3, "win", tmp_path / str(limit))  # noqa: B023
        p = {(c, i): predict(np.array([[x, y]]))[0] for c, i, x, y in rows}
        for r in got:
            q = p[r["capture"], r["win"]]
            best = q.argmax() if limit is None else 1 + q[1:].argmax() if 1 - q[0] >= limit - 1e-12 else 0
            assert r["category"] == ("Benign", "DDoS", "Recon")[best] and r["confidence"] == pytest.approx(q[best])
        assert len(got) == len(rows)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def two_batches(spark, tmp_path, name, first, second, f, schema):
    """Rows that come out of a stream that gets one batch, is idle for longer than it waits, and gets another."""
    src, seen = str(tmp_path / name), []
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    q = f(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    time.sleep(3)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    time.sleep(1)
    q.processAllAvailable()
    q.stop()
    return seen


def test_idle_queues_go(spark, tmp_path, rocks):
    schema = "log bigint, incident bigint, seq bigint, type string, windows bigint, tokens bigint"
    first = [(1, 5, 1, "executed", 2, 3), (1, 5, 2, "proposed", 2, 3)]
    for idle, windows in ((1.0, 9), (60.0, 13)):  # log 1 begins anew, or goes on
        name = f"q{int(idle)}"
        got = two_batches(spark, tmp_path, name, first, [(2, 7, 1, "call", 1, 1)], lambda s: st.incident_queue(s, idle), schema)  # noqa: B023
        assert sorted((r["log"], r["incident"], r["windows"], r["waiting"]) for r in got) == [(1, 5, 4, 1), (2, 7, 1, 0)]
        src = str(tmp_path / name)
        spark.createDataFrame([(1, 5, 3, "call", 9, 1)], schema).coalesce(1).write.mode("append").parquet(src)
        seen = []
        q = st.incident_queue(spark.readStream.schema(schema).parquet(src), idle).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()  # noqa: B023
        q.awaitTermination(120)
        assert [(r["log"], r["windows"]) for r in seen] == [(1, windows)]


def test_idle_captures_flush(spark, tmp_path):
    schema = "capture bigint, o bigint, ts double, size bigint, protocol bigint, syn double"
    seen = []
    src = str(tmp_path / "in")
    rows = lambda c, n: spark.createDataFrame([(c, i, float(i), 40, 6, 1.0) for i in range(n)], schema).coalesce(1).write.mode("append").parquet(src)
    rows(1, 7)
    q = st.count_windows(spark.readStream.schema(schema).parquet(src), (5,), ["syn"], idle=1.0).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    time.sleep(3)
    rows(2, 5)
    q.processAllAvailable()
    q.stop()
    assert sorted((r["capture"], r["win"], r["number"]) for r in seen) == [(1, 0, 5), (1, 1, 2), (2, 0, 5)]


def test_incident_queue(spark, tmp_path, rocks):
    rng = random.Random(8)
    rows = [(k % 2, rng.randrange(4), k, rng.choice(["windows", "call", "proposed", "executed"]), rng.randrange(5), rng.randrange(9)) for k in range(80)]
    df = spark.createDataFrame(rows, "capture bigint, incident bigint, seq bigint, type string, windows bigint, tokens bigint")
    got = stream(spark, df, lambda s: st.incident_queue(s.withColumnRenamed("capture", "log")), 3, "seq", tmp_path, "update")
    last = {}
    for r in got:
        last[r["log"], r["incident"]] = max(last.get((r["log"], r["incident"]), (-1,)), (r["last_seq"], r["first_seq"], r["state"], r["windows"], r["tokens"], r["waiting"]))
    for (log, incident), found in last.items():
        own = [r for r in rows if r[:2] == (log, incident)]
        waiting = 0
        for r in own:
            waiting = max(0, waiting + (r[3] == "proposed") - (r[3] == "executed"))
        assert found == (own[-1][2], own[0][2], own[-1][3], sum(r[4] for r in own), sum(r[5] for r in own), waiting)
    assert len(last) == 8


def test_a_stream_watches_for_runs(spark, tmp_path):
    rows = [(c, i, "Benign" if (i + c) % 6 == 0 else "DDoS") for c in (1, 2) for i in range(30)]
    got = stream(spark, spark.createDataFrame(rows, "capture bigint, win bigint, category string"), lambda s: st.watch(s, 3), 3, "win", tmp_path)
    want, length = [], 0
    for c, i, category in rows:
        length = 0 if category == "Benign" or i == 0 else length
        length += category != "Benign"
        want += [(c, i)] if length == 3 and category != "Benign" else []
    assert sorted((r["capture"], r["win"]) for r in got if r["opens"]) == want and len(got) == len(rows)


def test_queues_take_turns(spark):
    rows = [([[1, 2, 3], [1, 4], [2, 5]], [1, 4, 2, 3, 5]), ([[], [7], []], [7]), ([[1, 2, 3, 4, 5, 6], [], []], [1, 2, 3, 4, 5]), ([[], [], []], [])]
    got = spark.createDataFrame(rows, "q array<array<bigint>>, want array<bigint>").select("want", inc.take_turns(F.col("q"), 5).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
