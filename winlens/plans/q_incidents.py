"""Queries of the incident policy and of what is assembled from its decisions.

The policy itself is a fold that SQL does not express; tests hold it against a window-by-window version.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winlens.operators import incidents as inc
from winlens.operators import policy as po
from winlens.operators.profile import medians
from winlens.plans import adapters as ad
from winlens.plans.adapters import FRAMES_CTE, windows_cte
from winlens.plans.q_windows import DECIDED
from winlens.sources.scratch import materialize

QUERIES: dict = {}
ORACLES: dict = {}
DAY = 86400.0
POLICY = po.Policy(in_a_row=2, close_after=5, silence=30 * DAY, longest=80 * DAY, reopen_within=300 * DAY)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def allowed(column: str):
    return (F.col(column) != 0) & (F.col(column) != 255)


#: What the policy and its measures need of a window.
POLICY_COLUMNS = ["capture", "win", "start_ts", "end_ts", "category", "confidence", "has_attacker", "attacker_frames", "sources", "targets"]


def replay(spark, d, policy=POLICY, with_links=False, features=True):
    """windows (without features: POLICY_COLUMNS), links (if asked for), decisions, members, background of the whole table."""
    # windows follow numbering in the same tasks; links are taken from the windows' frames
    w = ad.windows(spark, d, 10, [inc.ends_of_frames().alias("ends")]).withColumn("category", F.expr("CASE WHEN syn_flag_number > 0.2 THEN 'DDoS' WHEN ICMP > 0.4 THEN 'Recon' ELSE 'Benign' END"))
    w = w.withColumn("confidence", F.when(F.col("category") == "DDoS", 0.5 + F.col("syn_flag_number") / 2).otherwise(0.6))
    attack = F.col("category") != po.BENIGN
    w = w.select("*", *(F.when(attack, inc.address_counts(F.col("ends"), c)).alias(n) for c, n in (("src", "sources"), ("dst", "targets"))))
    ends = ["ends"] if with_links else []
    w = materialize(w.select(*POLICY_COLUMNS, *ends) if not features else w if with_links else w.drop("ends"), "windows")
    decisions = materialize(po.decide(po.stretches(w.drop("ends"), policy), policy), "decisions")
    members, back = po.incident_windows(decisions), po.background_windows(decisions)
    links = materialize(inc.tagged_links(w, members, back), "links") if with_links else None
    return w.drop("ends"), links, decisions, members, back


def scans(w, members):
    per = members.join(w, ["capture", "win"]).groupBy("capture", "incident", "category").agg(F.count("*").alias("n"), F.min("win").alias("first"))
    main = inc.first_by(per, inc.INC, [F.col("n").desc(), "first"])
    return main.select(*inc.INC, (F.col("category") == "Recon").alias("is_scan"))


def stored_roles(links, members, back, w):
    return tuple(materialize(x, "roles") for x in inc.roles(links, members, back, scans(w, members), allowed))


def stored_origins(links, members, back, w):
    return materialize(inc.roles(links, members, back, scans(w, members), allowed)[0], "roles")


def stored_destinations(links, members, back, w):
    return materialize(inc.roles(links, members, back, scans(w, members), allowed)[1], "roles")


@query("r4_policy_decisions")
def r4(spark, d):
    return replay(spark, d, features=False)[2]


@query("r5_background_presence")
def r5(spark, d):
    _, links, _, _, back = replay(spark, d, with_links=True, features=False)
    return inc.presence(links, "src", back, ["capture"])


@query("r6_opening_snapshot")
def r6(spark, d):
    return po.snapshot(replay(spark, d, features=False)[2])


@query("r11_rules")
def r11(spark, d):
    w, _, decisions, *_ = replay(spark, d, features=False)
    parts = materialize(po.stretches(w, POLICY), "rule-stretches")  # the rules differ in in_a_row alone, which stretches do not depend on
    out = None
    for n in (2, 3, 4):  # a job for each rule over the same stored windows
        p = po.Policy(n, POLICY.close_after, POLICY.silence, POLICY.longest, POLICY.reopen_within)
        s = inc.replay_summary(w, decisions if p == POLICY else po.decide(parts, p)).withColumn("rule", F.lit(n))
        out = s if out is None else out.unionByName(s)
    return out


@query("a37_rule_comparison")
def a37(spark, d):
    return inc.rule_summary(r11(spark, d), F.col("capture") % 8 == 0)


@query("j13_truth_in_incidents")
def j13(spark, d):
    w, _, _, members, _ = replay(spark, d, features=False)
    return members.join(w.select("capture", "win", "has_attacker", "attacker_frames"), ["capture", "win"]).groupBy(*inc.INC).agg(F.count("*").alias("n_windows"), F.count_if("has_attacker").alias("with_attacker"), F.sum("attacker_frames").alias("attacker_frames"))


@query("j15_prominence")
def j15(spark, d):
    _, links, _, members, back = replay(spark, d, with_links=True, features=False)
    return inc.prominence(links, "src", members, back)


@query("i1_i2_roles")
def i1(spark, d):
    w, links, _, members, back = replay(spark, d, with_links=True, features=False)
    o, t = stored_roles(links, members, back, w)
    return o.select(*inc.INC, "addr", "frames", F.lit("origin").alias("role")).unionByName(t.select(*inc.INC, "addr", "frames", F.lit("destination").alias("role")))


@query("i3_k4_k5_candidates")
def i3(spark, d):
    w, links, _, members, back = replay(spark, d, with_links=True, features=False)
    return inc.candidates(links, members, back, stored_origins(links, members, back, w), allowed)


@query("i4_x8_incident_records")
def i4(spark, d):
    w, links, _, members, back = replay(spark, d, with_links=True, features=False)
    o, t = stored_roles(links, members, back, w)
    rec = inc.records(w, members, o, t)
    return rec.join(inc.contract_defects(rec, inc.ports(links, members, t)), inc.INC)


@query("i5_kept_windows")
def i5(spark, d):
    w, _, _, members, _ = replay(spark, d)
    return inc.kept_windows(w.select("capture", "win", "start_ts", "AVG"), members, 20)


@query("i6_replay_summary")
def i6(spark, d):
    w, _, decisions, *_ = replay(spark, d, features=False)
    return inc.replay_summary(w, decisions)


@query("i7_j14_truth_flags")
def i7(spark, d):
    w, links, _, members, back = replay(spark, d, with_links=True, features=False)
    o, t = stored_roles(links, members, back, w)
    return inc.truth_flags(w, members, o, t, F.col("addr") % 97 == 0, POLICY.silence)


def evaluation(w, flags):
    """Incidents, true ones, right first origins and false ones an hour, of each capture and of all."""
    hours = w.groupBy("capture").agg(((F.max("end_ts") - F.min("start_ts")) / 3600).alias("hours"))
    per = flags.join(hours, "capture", "right").groupBy("capture").agg(F.count("incident").alias("n_incidents"), F.count_if("is_true").alias("n_true"), F.count_if("first_origin_is_attacker").alias("n_origin"), F.max("hours").alias("hours"))
    out = per.rollup("capture").agg(*(F.sum(c).alias(c) for c in ("n_incidents", "n_true", "n_origin", "hours")))
    return out.withColumn("false_per_hour", (F.col("n_incidents") - F.col("n_true")) / F.col("hours"))


@query("a38_evaluation_summary")
def a38(spark, d):
    w, links, decisions, members, back = replay(spark, d, with_links=True, features=False)
    o, t = stored_roles(links, members, back, w)
    return evaluation(w, inc.truth_flags(w, members, o, t, F.col("addr") % 97 == 0, POLICY.silence))


@query("k2_incident_ports")
def k2(spark, d):
    w, links, _, members, back = replay(spark, d, with_links=True, features=False)
    return inc.ports(links, members, stored_destinations(links, members, back, w))


@query("s20_log_drafts")
def s20(spark, d):
    w, _, decisions, members, _ = replay(spark, d, features=False)
    return inc.log_drafts(w, decisions, members)


@query("a20_incident_medians")
def a20(spark, d):
    w, _, _, members, _ = replay(spark, d)
    return medians(members.join(w, ["capture", "win"]), ["AVG", "Std", "IAT", "syn_flag_number"], inc.INC)


@query("k6_main_features")
def k6(spark, d):
    from winlens.operators.ranking import main_features

    w, _, _, members, _ = replay(spark, d)
    cols = ["AVG", "Std", "IAT", "Rate", "syn_flag_number", "ICMP", "Time_To_Live"]
    order = spark.createDataFrame([(c, i) for i, c in enumerate(("Rate", "IAT", "syn_flag_number", "AVG", "ICMP", "Std", "Time_To_Live"))], "feature string, rank int")
    own = medians(members.join(w, ["capture", "win"]), cols, inc.INC)
    return main_features(own, medians(w.filter("category = 'Benign'"), cols), cols, order, inc.INC, 5)


#: Windows as incidents, one for each capture, to check the parts that do not need the policy.
_ALL = f"{DECIDED}, m AS (SELECT capture, win, predicted FROM decided WHERE predicted <> 'Benign'), b AS (SELECT capture, win FROM decided WHERE predicted = 'Benign')"


def flat(spark, d):
    w = ad.windows(spark, d, 10).withColumn("predicted", F.expr("CASE WHEN syn_flag_number > 0.2 THEN 'DDoS' WHEN ICMP > 0.4 THEN 'Recon' ELSE 'Benign' END"))
    members = w.filter("predicted <> 'Benign'").select("capture", F.lit(0).cast("long").alias("incident"), "win")
    return w, inc.window_links(ad.kept(spark, d), 10), members, w.filter("predicted = 'Benign'").select("capture", "win")


@query("j15_presence_against_background", f"""{_ALL}, s AS (SELECT DISTINCT capture, frame_no // 10 AS win, src AS addr FROM kept), p AS (SELECT capture, addr, count(*) AS n FROM s JOIN m USING (capture, win) GROUP BY ALL), q AS (SELECT capture, addr, count(*) AS n FROM s JOIN b USING (capture, win) GROUP BY ALL),
 tm AS (SELECT capture, count(*) AS t FROM m GROUP BY 1), tb AS (SELECT capture, count(*) AS t FROM b GROUP BY 1) SELECT p.capture, p.addr, p.n AS n_windows, round(p.n / tm.t - coalesce(q.n / tb.t, 0), 9) AS prominence FROM p JOIN tm USING (capture) LEFT JOIN q USING (capture, addr) LEFT JOIN tb ON tb.capture = p.capture""")
def j15f(spark, d):
    _, links, members, back = flat(spark, d)
    return inc.prominence(links, "src", members, back).select("capture", "addr", "n_windows", F.round("prominence", 9).alias("prominence"))


@query("k1_top_addresses", f"""{_ALL}, n AS (SELECT k.capture, k.src AS addr, count(*) AS frames, min((k.frame_no // 10, k.frame_no)) AS seen FROM kept k JOIN m ON m.capture = k.capture AND m.win = k.frame_no // 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY frames DESC, seen) AS place FROM n) SELECT capture, addr, frames, place FROM r WHERE place <= 10""")
def k1(spark, d):
    _, links, members, _ = flat(spark, d)
    sent = inc.flows(inc.pairs(links, members)).filter("sent > 0").select(*inc.INC, "addr", F.col("sent").alias("frames"))
    seen = inc.pairs(links, members).groupBy(*inc.INC, F.col("src").alias("addr")).agg(F.min("seen").alias("seen"))
    return inc.listed(sent.join(seen, [*inc.INC, "addr"])).select("capture", "addr", "frames", F.col("place").cast("long").alias("place"))


@query("i2_roles_by_volume", f"""{_ALL}, p AS (SELECT k.capture, k.src, k.dst, count(*) AS frames, min((k.frame_no // 10, k.frame_no)) AS seen FROM kept k JOIN m ON m.capture = k.capture AND m.win = k.frame_no // 10 GROUP BY ALL), t AS (SELECT capture, dst, sum(frames) AS f, count(*) AS fan, min(seen) AS seen FROM p WHERE dst <> 0 GROUP BY ALL),
 x AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY f DESC, fan DESC, seen) AS r FROM t) SELECT p.capture, p.src AS addr, p.frames FROM p JOIN x ON x.capture = p.capture AND x.dst = p.dst WHERE r = 1""")
def i2(spark, d):
    _, links, members, _ = flat(spark, d)
    return inc.roles_by_volume(inc.pairs(links, members), F.col("dst") != 0)[0].select("capture", "addr", "frames")


@query("x6_map_difference", f"{DECIDED}, c AS (SELECT capture, predicted, count(*) AS a, count(*) FILTER (win < 20) AS b FROM decided GROUP BY ALL) SELECT capture, predicted AS key, a - b AS value FROM c WHERE a > b")
def x6(spark, d):
    w = flat(spark, d)[0]
    n = w.groupBy("capture", "predicted").agg(F.count("*").alias("a"), F.count_if(F.col("win") < 20).alias("b")).groupBy("capture").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("predicted", "b"))).alias("b"))
    return n.select("capture", F.explode(inc.map_difference(F.col("a"), F.col("b"))))
