"""Assembly of incidents that SQL can name: an incident is a run of two or more attack windows in a row.

The incident policy is a fold beyond SQL, and the queries on its decisions have none (q_incidents). These queries put the same
assembly operators to work on runs, so that SQL checks all of them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winlens.operators import incidents as inc
from winlens.operators import windows as wi
from winlens.operators.profile import medians
from winlens.operators.ranking import main_features
from winlens.plans import adapters as ad
from winlens.plans.q_incidents import DAY, allowed, scans
from winlens.plans.q_windows import DECIDED
from winlens.sources.scratch import materialize

QUERIES: dict = {}
ORACLES: dict = {}
SILENCE = 30 * DAY
FEATURES = ("Rate", "IAT", "syn_flag_number", "AVG", "ICMP", "Std", "Time_To_Live")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def runs(spark, d, features=(), with_links=False):
    """windows (with the features asked for), links (if asked for), members (capture, incident, win, at_win, benign_before) and background."""
    category = F.expr("CASE WHEN syn_flag_number > 0.2 THEN 'DDoS' WHEN ICMP > 0.4 THEN 'Recon' ELSE 'Benign' END")
    w = ad.windows(spark, d, 10, [inc.ends_of_frames().alias("ends")] if with_links else []).withColumn("category", category)
    w = w.withColumn("confidence", F.when(F.col("category") == "DDoS", 0.5 + F.col("syn_flag_number") / 2).otherwise(0.6))
    whole = materialize(w.select("capture", "win", "start_ts", "end_ts", "category", "confidence", "has_attacker", "attacker_frames", *features, *(["ends"] if with_links else [])), "run-windows")
    w = whole.drop("ends")
    order = Window.partitionBy("capture").orderBy("win")
    run = Window.partitionBy("capture", "run")
    each = w.withColumn("run", F.sum((F.col("category") == "Benign").cast("int")).over(order)).filter("category <> 'Benign'")
    each = each.withColumns({"n": F.count("*").over(run), "k": F.row_number().over(run.orderBy("win")), "at": F.min("win").over(run) + 1}).filter("n > 1")
    each = each.withColumn("incident", F.dense_rank().over(Window.partitionBy("capture").orderBy("run")).cast("long") - 1)
    members = materialize(each.select("capture", "incident", "win", F.greatest("win", "at").alias("at_win"), F.lit(0).cast("long").alias("benign_before")), "run-members")
    back = w.filter("category = 'Benign'").select("capture", "win")
    return w, materialize(inc.tagged_links(whole, members, back), "run-links") if with_links else None, members, back


def run_roles(w, links, members, back):
    return tuple(materialize(x, "run-roles") for x in inc.roles(links, members, back, scans(w, members), allowed))


_INC = "capture, incident"
RUNS = f"""{DECIDED}, g AS (SELECT *, sum(CASE WHEN predicted = 'Benign' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY win) AS run FROM decided),
r AS (SELECT *, count(*) OVER (PARTITION BY capture, run) AS in_run, greatest(win, min(win) OVER (PARTITION BY capture, run) + 1) AS at_win FROM g WHERE predicted <> 'Benign'),
m AS (SELECT *, dense_rank() OVER (PARTITION BY capture ORDER BY run) - 1 AS incident, CASE WHEN predicted = 'DDoS' THEN 0.5 + syn_flag_number / 2 ELSE 0.6 END AS confidence FROM r WHERE in_run > 1),
b AS (SELECT capture, win FROM decided WHERE predicted = 'Benign')"""
LINKS = f"""{RUNS}, l AS (SELECT capture, frame_no // 10 AS win, src, dst, CASE WHEN protocol IN (6, 17) THEN dport END AS dport, protocol, count(*) AS frames, count(*) FILTER (syn_flag_number = 1 AND ack_flag_number = 0) AS opened, min(frame_no) AS first_no FROM kept GROUP BY ALL),
ml AS (SELECT m.incident, l.* FROM l JOIN m USING (capture, win)),
pr AS (SELECT {_INC}, src, dst, sum(frames) AS frames, sum(opened) AS opened, min((win, first_no)) AS seen FROM ml GROUP BY ALL),
fl AS (SELECT {_INC}, addr, sum(s) AS sent, sum(r) AS received, sum(o) AS opened, sum(w) AS was_opened, min(seen) AS seen FROM (
  SELECT {_INC}, src AS addr, frames AS s, 0 AS r, opened AS o, 0 AS w, seen FROM pr UNION ALL SELECT {_INC}, dst, 0, frames, 0, opened, seen FROM pr) GROUP BY ALL),
tm AS (SELECT {_INC}, count(*) AS t FROM m GROUP BY ALL), tb AS (SELECT capture, count(*) AS t FROM b GROUP BY ALL)"""


def _prominence(side: str, name: str) -> str:
    return f"""{name} AS (SELECT o.capture, o.incident, o.addr, o.n AS n_windows, coalesce(q.n / tb.t, 0) AS background_share, o.n / tm.t - coalesce(q.n / tb.t, 0) AS prominence
 FROM (SELECT {_INC}, {side} AS addr, count(DISTINCT win) AS n FROM ml GROUP BY ALL) o JOIN tm USING ({_INC}) LEFT JOIN (SELECT capture, {side} AS addr, count(DISTINCT win) AS n FROM l JOIN b USING (capture, win) GROUP BY ALL) q ON q.capture = o.capture AND q.addr = o.addr LEFT JOIN tb ON tb.capture = o.capture)"""


ROLES = f"""{LINKS}, {_prominence("src", "ps")}, {_prominence("dst", "pd")},
sc AS (SELECT {_INC}, arg_min(predicted, (-n, first)) = 'Recon' AS is_scan FROM (SELECT {_INC}, predicted, count(*) AS n, min(win) AS first FROM m GROUP BY ALL) GROUP BY ALL),
cand AS (SELECT *, max(prominence) OVER (PARTITION BY {_INC}) AS best FROM ps JOIN fl USING ({_INC}, addr) WHERE prominence > 0 AND sent > 0 AND addr NOT IN (0, 255)),
strong AS (SELECT *, opened - was_opened AS net_opened, sent - received AS net FROM cand WHERE prominence >= 0.5 * best),
att AS (SELECT {_INC}, addr AS attacker FROM strong QUALIFY row_number() OVER (PARTITION BY {_INC} ORDER BY net_opened >= 3 DESC, CASE WHEN net_opened >= 3 THEN net_opened END DESC NULLS LAST, CASE WHEN net_opened < 3 THEN net END DESC NULLS LAST, CASE WHEN net_opened < 3 THEN prominence END DESC NULLS LAST, seen, addr) = 1),
hits AS (SELECT pr.*, attacker, coalesce(pd.prominence, 0) AS tp FROM pr JOIN att USING ({_INC}) LEFT JOIN pd ON pd.capture = pr.capture AND pd.incident = pr.incident AND pd.addr = pr.dst WHERE src = attacker AND dst <> attacker AND dst NOT IN (0, 255)),
tgt AS (SELECT {_INC}, dst AS target FROM hits QUALIFY row_number() OVER (PARTITION BY {_INC} ORDER BY tp DESC, frames DESC, seen, dst) = 1),
oscan AS (SELECT att.* FROM att JOIN tgt USING ({_INC}) JOIN sc USING ({_INC}) WHERE is_scan),
so AS (SELECT {_INC}, addr, sent AS frames, seen FROM oscan JOIN fl USING ({_INC}) WHERE addr = attacker),
st AS (SELECT {_INC}, dst AS addr, frames, seen FROM hits SEMI JOIN oscan USING ({_INC})),
fo AS (SELECT pr.capture, pr.incident, src AS addr, pr.frames, pr.seen FROM pr JOIN tgt USING ({_INC}) JOIN sc USING ({_INC}) JOIN strong ON strong.capture = pr.capture AND strong.incident = pr.incident AND strong.addr = pr.src WHERE NOT is_scan AND dst = target AND src <> target),
ft AS (SELECT {_INC}, dst AS addr, sum(frames) AS frames, min(seen) AS seen FROM pr WHERE (capture, incident, src) IN (SELECT (capture, incident, addr) FROM fo) AND (capture, incident, dst) NOT IN (SELECT (capture, incident, addr) FROM fo) GROUP BY ALL),
ruled AS (SELECT * FROM so UNION ALL SELECT * FROM fo),
rest AS (SELECT * FROM pr WHERE (capture, incident) NOT IN (SELECT (capture, incident) FROM ruled)),
vt AS (SELECT {_INC}, dst AS addr, frames, seen FROM (SELECT {_INC}, dst, sum(frames) AS frames, count(*) AS fan, min(seen) AS seen FROM rest WHERE dst NOT IN (0, 255) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_INC} ORDER BY frames DESC, fan DESC, seen, dst) = 1),
vo AS (SELECT rest.capture, rest.incident, src AS addr, rest.frames, rest.seen FROM rest JOIN vt ON vt.capture = rest.capture AND vt.incident = rest.incident AND vt.addr = rest.dst),
og AS (SELECT *, count(*) OVER w AS n_origins, NOT is_scan AND max(frames) OVER w / sum(frames) OVER w < 0.8 AS distributed FROM (SELECT * FROM ruled UNION ALL SELECT * FROM vo) JOIN sc USING ({_INC}) WINDOW w AS (PARTITION BY {_INC})),
tg AS (SELECT * FROM st UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM vt),
og10 AS (SELECT *, row_number() OVER (PARTITION BY {_INC} ORDER BY frames DESC, seen, addr) AS place FROM og QUALIFY place <= 10),
tg10 AS (SELECT *, row_number() OVER (PARTITION BY {_INC} ORDER BY frames DESC, seen, addr) AS place FROM tg QUALIFY place <= 10),
ports AS (SELECT *, row_number() OVER (PARTITION BY {_INC} ORDER BY frames DESC, seen, dst, dport, protocol) AS place FROM (SELECT {_INC}, dst, dport, protocol, sum(frames) AS frames, min((win, first_no)) AS seen FROM ml WHERE protocol IN (6, 17) AND (capture, incident, dst) IN (SELECT (capture, incident, addr) FROM tg10) GROUP BY ALL) QUALIFY place <= 5)"""
_I = "CAST(incident AS BIGINT) AS incident"


@query("j13_truth_in_runs", f"{RUNS} SELECT capture, {_I}, count(*) AS n_windows, count(*) FILTER (has_attacker) AS with_attacker, CAST(sum(attacker_frames) AS BIGINT) AS attacker_frames FROM m GROUP BY ALL")
def j13(spark, d):
    w, _, members, _ = runs(spark, d)
    return members.join(w.select("capture", "win", "has_attacker", "attacker_frames"), ["capture", "win"]).groupBy(*inc.INC).agg(F.count("*").alias("n_windows"), F.count_if("has_attacker").alias("with_attacker"), F.sum("attacker_frames").alias("attacker_frames"))


@query("r5_background_of_runs", f"{LINKS} SELECT capture, src AS addr, count(DISTINCT win) AS n_windows, round(count(DISTINCT win) / any_value(tb.t), 9) AS share FROM l JOIN b USING (capture, win) JOIN tb USING (capture) GROUP BY capture, src")
def r5(spark, d):
    _, links, _, back = runs(spark, d, with_links=True)
    return inc.presence(links, "src", back, ["capture"]).withColumn("share", F.round("share", 9))


@query("r6_snapshot_of_runs", f"{RUNS} SELECT capture, {_I}, win, at_win FROM m QUALIFY at_win <= min(at_win) OVER (PARTITION BY capture, incident)")
def r6(spark, d):
    from winlens.operators.policy import snapshot

    members = runs(spark, d)[2]
    attack = members.select("capture", "incident", F.col("win").alias("first_win"), "at_win", "benign_before", F.lit("attack").alias("kind"))
    opened = members.groupBy(*inc.INC).agg(F.min("at_win").alias("at_win")).withColumns({"kind": F.lit("open"), "first_win": F.col("at_win"), "benign_before": F.lit(0).cast("long")})
    return snapshot(attack.unionByName(opened)).select(*inc.INC, "win", "at_win")


@query("i1_roles_of_runs", f"{ROLES} SELECT capture, {_I}, addr, CAST(frames AS BIGINT) AS frames, 'origin' AS role, n_origins, distributed FROM og UNION ALL SELECT capture, {_I}, addr, CAST(frames AS BIGINT), 'destination', NULL, NULL FROM tg")
def i1(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    o, t = run_roles(w, links, members, back)
    origin = o.select(*inc.INC, "addr", "frames", F.lit("origin").alias("role"), "n_origins", "distributed")
    return origin.unionByName(t.select(*inc.INC, "addr", "frames", F.lit("destination").alias("role")), allowMissingColumns=True)


@query("k2_ports_of_runs", f"{ROLES} SELECT capture, {_I}, dst, dport, protocol, CAST(frames AS BIGINT) AS frames, place FROM ports")
def k2(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    out = inc.ports(links, members, run_roles(w, links, members, back)[1])
    return out.withColumns({"place": F.col("place").cast("long"), "protocol": F.col("protocol").cast("int"), "dport": F.col("dport").cast("int")})


@query("i4_records_of_runs", f"""{ROLES}, rec AS (SELECT {_INC}, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_windows FROM m GROUP BY ALL),
mc AS (SELECT {_INC}, arg_min(predicted, (-n, first)) AS model_category, list_sort(list(predicted || ':' || n)) AS windows_per_category FROM (SELECT {_INC}, predicted, count(*) AS n, min(win) AS first FROM m GROUP BY ALL) GROUP BY ALL),
o1 AS (SELECT {_INC}, any_value(n_origins) AS n_origins, any_value(distributed) AS distributed FROM og GROUP BY ALL),
ol AS (SELECT {_INC}, list(addr ORDER BY place) AS origins FROM og10 GROUP BY ALL), tl AS (SELECT {_INC}, list(addr ORDER BY place) AS destinations FROM tg10 GROUP BY ALL)
SELECT capture, {_I}, start_ts, end_ts, n_windows, model_category, CASE WHEN model_category = 'DDoS' THEN CASE WHEN distributed THEN 'DDoS' ELSE 'DoS' END ELSE model_category END AS category, n_origins, distributed, array_to_string(windows_per_category, ',') AS windows_per_category, array_to_string(origins, ',') AS origins, array_to_string(destinations, ',') AS destinations, 0 AS n_defects
FROM rec JOIN mc USING ({_INC}) LEFT JOIN o1 USING ({_INC}) LEFT JOIN ol USING ({_INC}) LEFT JOIN tl USING ({_INC})""")
def i4(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    o, t = run_roles(w, links, members, back)
    rec = inc.records(w, members, o, t)
    rec = rec.join(inc.contract_defects(rec, inc.ports(links, members, t)), inc.INC)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["addr"].cast("string")), ",")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("windows_per_category")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rec.select(*inc.INC, "start_ts", "end_ts", "n_windows", "model_category", "category", "n_origins", "distributed", counts.alias("windows_per_category"), names("origins").alias("origins"), names("destinations").alias("destinations"), F.size("defects").alias("n_defects"))


@query("x8_defects_of_runs", f"""{ROLES}, bad AS (SELECT capture, incident, incident % 3 = 0 AS moved, incident % 4 = 1 AS renamed FROM tm), known AS (SELECT capture, incident, count(*) FILTER (place > 1) AS left_ FROM tg10 GROUP BY ALL), used AS (SELECT capture, incident, count(*) AS n, count(*) FILTER ((capture, incident, dst) NOT IN (SELECT (capture, incident, addr) FROM tg10 WHERE place > 1)) AS outside FROM ports GROUP BY ALL)
SELECT capture, {_I}, coalesce(moved AND outside > 0, false) AS unlisted_port, renamed AS wrong_category FROM bad LEFT JOIN used USING ({_INC})""")
def x8(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    o, t = run_roles(w, links, members, back)
    rec = inc.records(w, members, o, t)
    # records with the first destination left out, or with a category that is none of the model's
    listed = F.when(F.col("incident") % 3 == 0, F.slice("destinations", 2, 10)).otherwise(F.col("destinations"))
    bad = rec.withColumns({"destinations": listed, "category": F.when(F.col("incident") % 4 == 1, "Web").otherwise(F.col("category"))})
    out = inc.contract_defects(bad, inc.ports(links, members, t))
    has = lambda x: F.array_contains("defects", x)
    return out.select(*inc.INC, has("port of an unlisted destination").alias("unlisted_port"), has("category does not fit").alias("wrong_category"))


@query("i5_kept_of_runs", f"""{RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY {_INC} ORDER BY win) - 1 AS place, count(*) OVER (PARTITION BY {_INC}) AS n FROM m) SELECT capture, {_I}, win, "AVG" AS mean_size FROM p WHERE place % greatest(1, CAST(ceil(n / 3) AS BIGINT)) = 0""")
def i5(spark, d):
    w, _, members, _ = runs(spark, d, ["AVG"])
    return inc.kept_windows(w.select("capture", "win", "AVG"), members, 3).select(*inc.INC, "win", F.col("AVG").alias("mean_size"))


_TRUTH = f"""{ROLES}, tw AS (SELECT capture, win, start_ts, end_ts, CASE WHEN start_ts - lag(end_ts) OVER (PARTITION BY capture ORDER BY win) <= {SILENCE} THEN 0 ELSE 1 END AS new_ FROM decided WHERE has_attacker),
isl AS (SELECT capture, island, min(start_ts) AS from_ts, max(end_ts) AS to_ts FROM (SELECT *, sum(new_) OVER (PARTITION BY capture ORDER BY win) AS island FROM tw) GROUP BY ALL),
ii AS (SELECT {_INC}, min(start_ts) AS start_ts, bool_or(has_attacker) AS is_true, arg_min(end_ts, (at_win, win)) AS first_end FROM m GROUP BY ALL),
onset AS (SELECT ii.capture, ii.incident, max(from_ts) AS onset FROM ii JOIN isl USING (capture) WHERE from_ts <= first_end AND ii.start_ts - to_ts <= {SILENCE} GROUP BY ALL),
flags AS (SELECT ii.capture, ii.incident, is_true, o.addr % 97 = 0 AS first_origin_is_attacker, t.addr % 97 = 0 AS first_target_is_attacker, start_ts - onset AS delay_s FROM ii LEFT JOIN onset USING ({_INC})
 LEFT JOIN (SELECT * FROM og10 WHERE place = 1) o USING ({_INC}) LEFT JOIN (SELECT * FROM tg10 WHERE place = 1) t USING ({_INC}))"""


def _flags(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    o, t = run_roles(w, links, members, back)
    return w, inc.truth_flags(w, members, o, t, F.col("addr") % 97 == 0, SILENCE)


@query("i7_j14_truth_of_runs", f"{_TRUTH} SELECT capture, {_I}, is_true, first_origin_is_attacker, first_target_is_attacker, delay_s FROM flags")
def i7(spark, d):
    return _flags(spark, d)[1]


@query("a38_evaluation_of_runs", f"""{_TRUTH}, hrs AS (SELECT capture, (max(end_ts) - min(start_ts)) / 3600 AS hours FROM decided GROUP BY ALL), per AS (SELECT capture, count(incident) AS n_incidents, count(*) FILTER (is_true) AS n_true, count(*) FILTER (first_origin_is_attacker) AS n_origin, max(hours) AS hours FROM hrs LEFT JOIN flags USING (capture) GROUP BY ALL)
SELECT capture, CAST(sum(n_incidents) AS BIGINT) AS n_incidents, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_origin) AS BIGINT) AS n_origin, round(sum(hours), 6) AS hours, round((sum(n_incidents) - sum(n_true)) / sum(hours), 9) AS false_per_hour FROM per GROUP BY ROLLUP (capture)""")
def a38(spark, d):
    from winlens.plans.q_incidents import evaluation

    out = evaluation(*_flags(spark, d))
    return out.withColumns({"hours": F.round("hours", 6), "false_per_hour": F.round("false_per_hour", 9)})


_SUMMARY = f"""{DECIDED}, runs_ AS (SELECT *, sum(CASE WHEN predicted = 'Benign' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY win) AS run FROM decided),
 placed AS (SELECT *, row_number() OVER (PARTITION BY capture, run, predicted = 'Benign' ORDER BY win) AS p FROM runs_),
 per AS (SELECT CAST(rule AS INT) AS rule, capture, count(*) AS n_windows, count(*) FILTER (predicted <> 'Benign') AS n_attack, count(*) FILTER (predicted <> 'Benign' AND p = rule) AS n_incidents, (max(end_ts) - min(start_ts)) / 3600 AS hours,
   arg_min(end_ts, win) FILTER (predicted <> 'Benign' AND p = rule) - min(start_ts) AS first_alarm_s FROM placed, (SELECT unnest([2, 3, 4]) AS rule) GROUP BY ALL)"""


def _alarm_rules(spark, d):
    """Replay summaries of rules that open an incident on the n-th attack window in a row, and never close one before the run ends."""
    w = runs(spark, d)[0].withColumn("is_attack", F.col("category") != "Benign")
    out = None
    for n in (2, 3, 4):
        hit = wi.alarms(w, n).filter("alarm").select("capture", F.col("win").alias("at_win"), F.lit("open").alias("kind"))
        one = inc.replay_summary(w, hit).withColumn("rule", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("r11_rules_by_alarms", f"{_SUMMARY} SELECT rule, capture, n_windows, n_attack, n_incidents, round(hours, 6) AS hours, first_alarm_s FROM per")
def r11(spark, d):
    return _alarm_rules(spark, d).select("rule", "capture", "n_windows", "n_attack", "n_incidents", F.round("hours", 6).alias("hours"), "first_alarm_s")


@query("a37_comparison_by_alarms", f"""{_SUMMARY} SELECT rule, CASE WHEN capture % 8 = 0 THEN 'benign' ELSE 'attack' END AS "group", count(*) AS captures, round(sum(hours), 4) AS hours, CAST(sum(n_incidents) AS BIGINT) AS incidents, count(*) FILTER (n_incidents > 0) AS with_alarm, quantile_cont(first_alarm_s, 0.5) AS median_delay_s,
 CASE WHEN capture % 8 = 0 THEN round(sum(n_incidents) / sum(hours), 9) END AS false_per_hour FROM per GROUP BY rule, capture % 8 = 0, "group" """)
def a37(spark, d):
    out = inc.rule_summary(_alarm_rules(spark, d), F.col("capture") % 8 == 0)
    return out.withColumns({"hours": F.round("hours", 4), "false_per_hour": F.round("false_per_hour", 9)})


_MED = ", ".join(f'quantile_cont("{c}", 0.5) AS "{c}"' for c in FEATURES)


@query("k6_features_of_runs", f"""{RUNS}, own AS (SELECT {_INC}, {_MED} FROM (SELECT * REPLACE (CASE WHEN isinf("Rate") THEN NULL ELSE "Rate" END AS "Rate") FROM m) GROUP BY ALL), ref AS (SELECT {_MED} FROM (SELECT * REPLACE (CASE WHEN isinf("Rate") THEN NULL ELSE "Rate" END AS "Rate") FROM decided WHERE predicted = 'Benign')),
 x AS (UNPIVOT own ON {", ".join(f'"{c}"' for c in FEATURES)} INTO NAME feature VALUE v), y AS (UNPIVOT ref ON {", ".join(f'"{c}"' for c in FEATURES)} INTO NAME feature VALUE ref_v),
 k AS (SELECT *, list_position([{", ".join(f"'{c}'" for c in FEATURES)}], feature) AS rank_ FROM x JOIN y USING (feature)), p AS (SELECT *, row_number() OVER (PARTITION BY {_INC} ORDER BY rank_) AS place FROM k)
SELECT capture, {_I}, feature, place, round(v, 3) AS value, round(ref_v, 3) AS reference FROM p WHERE place <= 5""")
def k6(spark, d):
    w, _, members, _ = runs(spark, d, FEATURES)
    w = w.withColumn("Rate", F.when(F.abs("Rate") != float("inf"), F.col("Rate")))
    order = spark.createDataFrame([(c, i) for i, c in enumerate(FEATURES)], "feature string, rank int")
    own = members.join(w, ["capture", "win"]).groupBy(*inc.INC).agg(*(F.percentile(F.col(c), 0.5).alias(c) for c in FEATURES))
    out = main_features(own, w.filter("category = 'Benign'").agg(*(F.percentile(F.col(c), 0.5).alias(c) for c in FEATURES)), list(FEATURES), order, inc.INC, 5)
    return out.select(*inc.INC, "feature", F.col("place").cast("long").alias("place"), F.round("value", 3).alias("value"), F.round("reference", 3).alias("reference"))


@query("i3_k4_candidates_of_runs", f"""{ROLES.replace("WITH", "WITH RECURSIVE", 1)}, src_ AS (SELECT ps.*, fl.sent, fl.received, fl.opened, fl.was_opened, og10.place AS rule FROM ps JOIN fl USING ({_INC}, addr) LEFT JOIN og10 USING ({_INC}, addr) WHERE n_windows >= 2),
qs AS (SELECT {_INC}, list(addr ORDER BY rule) FILTER (rule IS NOT NULL) AS q0, list(addr ORDER BY prominence DESC, sent DESC, addr) FILTER (addr NOT IN (0, 255) AND prominence >= 0.1 AND sent > 0) AS q1, list(addr ORDER BY received - sent, addr) FILTER (addr NOT IN (0, 255) AND sent > received) AS q2 FROM src_ GROUP BY ALL),
turns AS (SELECT {_INC}, q0, q1, q2, 0 AS t, CAST([] AS BIGINT[]) AS taken FROM qs UNION ALL
  SELECT {_INC}, q0, q1, q2, t + 1, CASE WHEN len(taken) < 5 AND nxt IS NOT NULL THEN list_append(taken, nxt) ELSE taken END FROM (SELECT *, list_filter(coalesce(CASE t % 3 WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, []), lambda x: NOT list_contains(taken, x))[1] AS nxt FROM turns WHERE t < 15)),
ch AS (SELECT {_INC}, unnest(taken) AS addr FROM turns WHERE t = 15)
SELECT capture, {_I}, addr, row_number() OVER (PARTITION BY {_INC} ORDER BY prominence DESC, sent DESC, addr) AS place, n_windows, round(background_share, 4) AS background_share, CAST(sent AS BIGINT) AS sent, CAST(received AS BIGINT) AS received, CAST(opened AS BIGINT) AS opened, CAST(was_opened AS BIGINT) AS was_opened,
 (SELECT array_to_string(list(dst ORDER BY f DESC, s, dst)[:3], ',') FROM (SELECT dst, sum(frames) AS f, min((win, first_no)) AS s FROM ml WHERE ml.capture = c.capture AND ml.incident = c.incident AND ml.src = c.addr GROUP BY dst)) AS targets
FROM (SELECT * FROM ch JOIN src_ USING ({_INC}, addr)) c""")
def i3(spark, d):
    w, links, members, back = runs(spark, d, with_links=True)
    o, _ = run_roles(w, links, members, back)
    out = inc.candidates(links, members, back, o, allowed)
    return out.select(*inc.INC, "addr", F.col("place").cast("long").alias("place"), "n_windows", F.round("background_share", 4).alias("background_share"), "sent", "received", "opened", "was_opened", F.array_join(F.transform("targets", lambda x: x["dst"].cast("string")), ",").alias("targets"))
