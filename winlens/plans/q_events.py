"""Queries over the event log and the runs measured on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from winlens.operators import decisions as de
from winlens.operators import events as ev
from winlens.operators import labels as la
from winlens.operators import ranking as ra
from winlens.plans import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}

#: Columns in both dialects; {k} differs.
LOG = {
    "log": "user_id % 10", "line": "event_id + 1", "seq": "event_id + 1", "ts": "CAST(ts AS TIMESTAMP)", "incident": "user_id", "value": "value", "k": "{k}",
    "type": "CASE event_type WHEN 'view' THEN 'windows' WHEN 'click' THEN 'call' WHEN 'signup' THEN 'proposed' WHEN 'purchase' THEN 'executed' ELSE 'effect' END",
    "agent": "CASE {k} % 4 WHEN 0 THEN 'triage' WHEN 1 THEN 'analyst' WHEN 2 THEN 'responder' ELSE 'reviewer' END",
    "place": "CASE WHEN {k} % 2 = 0 THEN 'local' ELSE 'cloud' END",
    "action": "CASE {k} % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'isolate' WHEN 2 THEN 'limit' WHEN 3 THEN 'observe' ELSE 'notify' END",
    "config": "{k} % 3", "proposal": "user_id * 100 + {k} % 7", "address": "CAST({k} % 20 AS VARCHAR(9))", "tokens_in": "CAST({k} * 10 AS BIGINT)", "tokens_out": "CAST({k} AS BIGINT)",
}
_COLS = ", ".join(f"{e.format(k='CAST(regexp_extract(props, chr(91) || chr(48) || chr(45) || chr(57) || chr(93) || chr(43)) AS BIGINT)')} AS {c}" for c, e in LOG.items())
E = f"WITH log AS (SELECT {_COLS} FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def log(spark, d):
    rows = ad.table(spark, d, "events").withColumn("k_", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    return rows.selectExpr(*(f"{e.format(k='k_').replace('VARCHAR(9)', 'STRING')} AS {c}" for c, e in LOG.items()))


@query("s9_strict_violations", f"{E}, l AS (SELECT *, seq + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS id, row_number() OVER (PARTITION BY log ORDER BY line) AS pos, lag(ts2) OVER (PARTITION BY log ORDER BY line) AS before FROM (SELECT *, CASE WHEN k % 23 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts2 FROM log)) SELECT log, line, id AS seq, 'id' AS reason FROM l WHERE id <> pos UNION ALL SELECT log, line, id, 'time' FROM l WHERE ts2 < before UNION ALL SELECT log, line, id, 'incident' FROM l WHERE k % 31 = 0")
def s9(spark, d):
    rows = log(spark, d).withColumns({"seq": F.col("seq") + F.when(F.col("k") % 17 == 0, 1).otherwise(0), "ts": F.when(F.col("k") % 23 == 0, F.col("ts") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts")), "inner": F.when(F.col("k") % 31 == 0, -1).otherwise(F.col("incident"))})
    return ev.strict_violations(rows, "inner")


_LEN = f"{E}, l AS (SELECT *, CASE WHEN k % 29 = 0 THEN NULL ELSE seq - k % 3 END AS id FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY log, id ORDER BY line) AS n FROM l)"


def messy(spark, d):
    return log(spark, d).withColumn("seq", F.when(F.col("k") % 29 != 0, F.col("seq") - F.col("k") % 3))


@query("s10_lenient_log", f"{_LEN} SELECT log, id AS seq, line, row_number() OVER (PARTITION BY log ORDER BY id) AS position FROM r WHERE id IS NOT NULL AND n = 1")
def s10(spark, d):
    return ev.lenient(messy(spark, d))[0].select("log", "seq", "line", "position")


@query("s10_log_anomalies", f"{_LEN} SELECT log, line, id AS seq, CASE WHEN id IS NULL THEN 'malformed' ELSE 'repeated' END AS anomaly FROM r WHERE id IS NULL OR n > 1")
def s10a(spark, d):
    return ev.lenient(messy(spark, d))[1]


@query("s11_run_keys", """SELECT event_id, 'cap-' || (user_id % 38) AS capture, CAST(user_id % 5 AS BIGINT) AS incident, CASE WHEN event_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS config, CAST(event_id % 3 + 1 AS BIGINT) AS repeat FROM events""")
def s11(spark, d):
    from winlens.sources.logs import run_key

    name = F.concat(F.lit("cap-"), F.col("user_id") % 38, F.lit("__inc-"), F.col("user_id") % 5, F.when(F.col("event_id") % 2 == 0, "__local").otherwise("__cloud"), F.lit("__r"), F.col("event_id") % 3 + 1, F.lit(".jsonl.gz"))
    return ad.table(spark, d, "events").select("event_id", run_key(name).alias("r")).select("event_id", "r.*")


@query("s13_incident_flags", f"{E} SELECT seq, CASE WHEN k % 3 > 0 AND value > 1 THEN true ELSE false END AS is_true, k % 5 > 2 AS in_test, k AS windows FROM log WHERE type = 'executed'")
def s13(spark, d):
    from winlens.sources.logs import incident_rows

    nested = log(spark, d).filter("type = 'executed'").select("seq", F.array(F.struct(F.col("k").alias("windows"), F.when(F.col("value") > 1, F.col("k") % 3).otherwise(F.lit(0)).alias("windows_with_attacker"), F.greatest(F.lit(0), F.col("k") % 5 - 2).alias("windows_in_test"))).alias("incidents"))
    return incident_rows(nested, ["seq"]).select("seq", "is_true", "in_test", "windows")


@query("s19_append", f"{E}, o AS (SELECT log, max(seq) AS id, max(ts) AS t FROM log WHERE seq <= 7000 GROUP BY 1), b AS (SELECT *, ts - INTERVAL 12 HOUR AS ts2 FROM log WHERE seq > 7000) SELECT log, line, id + row_number() OVER w AS seq, epoch_us(greatest(max(ts2) OVER w, t)) AS ts_us FROM b JOIN o USING (log) WINDOW w AS (PARTITION BY log ORDER BY line)")
def s19(spark, d):
    rows = log(spark, d)
    batch = rows.filter("seq > 7000").select("log", "line", F.col("line").alias("order"), (F.col("ts") - F.expr("INTERVAL 12 HOURS")).alias("ts"))
    return ev.append_batch(rows.filter("seq <= 7000"), batch).select("log", "line", "seq", F.unix_micros("ts").alias("ts_us"))


@query("w11_latest", f"{E} SELECT incident, proposal, arg_max(type, seq) AS type, arg_max(value, seq) AS value, max(seq) AS seq FROM log WHERE type IN ('proposed', 'executed', 'effect') GROUP BY ALL")
def w11(spark, d):
    return ev.latest(log(spark, d), ["incident", "proposal"], ["type", "value", "seq"], F.col("type").isin("proposed", "executed", "effect"))


@query("w12_running_totals", f"{E} SELECT seq, CAST(sum(CASE WHEN type = 'call' THEN tokens_in + tokens_out ELSE 0 END) OVER w AS BIGINT) AS tokens, CAST(sum(CASE WHEN type = 'windows' THEN k ELSE 0 END) OVER w AS BIGINT) AS windows FROM log WINDOW w AS (PARTITION BY log ORDER BY seq)")
def w12(spark, d):
    return ev.running_totals(log(spark, d), {"tokens": F.when(F.col("type") == "call", F.col("tokens_in") + F.col("tokens_out")).otherwise(0), "windows": F.when(F.col("type") == "windows", F.col("k")).otherwise(0)}).select("seq", "tokens", "windows")


@query("w12_busiest_step", f"{E}, r AS (SELECT log, seq, CAST(sum(CASE type WHEN 'proposed' THEN 1 WHEN 'executed' THEN -1 ELSE 0 END) OVER (PARTITION BY log ORDER BY seq) AS BIGINT) AS pending FROM log) SELECT log, arg_max(seq, (pending, -seq)) AS seq, max(pending) AS pending FROM r GROUP BY 1")
def w12b(spark, d):
    return ev.busiest_step(log(spark, d), F.col("type") == "proposed", F.col("type") == "executed")


_LABELS = f"{E}, f AS (SELECT incident, place AS role, address, min(seq) AS first_ FROM log GROUP BY ALL), labels AS (SELECT incident, role, address, role || '-' || row_number() OVER (PARTITION BY incident, role ORDER BY first_, address) AS label FROM f)"


@query("w13_neutral_labels", f"{_LABELS} SELECT * FROM labels")
def w13(spark, d):
    return ev.neutral_labels(log(spark, d).withColumnRenamed("place", "role"), "incident", "role", "address")


@query("j17_pseudonyms", f"{_LABELS} SELECT seq, label, replace('drop from [' || l.address || '] now', '[' || l.address || ']', label) AS text FROM log l JOIN labels b ON b.incident = l.incident AND b.role = l.place AND b.address = l.address WHERE type = 'proposed'")
def j17(spark, d):
    rows = log(spark, d).withColumnRenamed("place", "role")
    named = rows.filter("type = 'proposed'").join(ev.neutral_labels(rows, "incident", "role", "address"), ["incident", "role", "address"])
    from winlens.functions.text import replace_addresses

    text = F.concat(F.lit("drop from ["), F.col("address"), F.lit("] now"))
    pairs = F.array(F.struct(F.concat(F.lit("["), F.col("address"), F.lit("]")).alias("address"), F.col("label").alias("label")))
    return named.select("seq", "label", replace_addresses(text, pairs).alias("text"))


@query("w14_stages", f"{E} SELECT seq, min(CASE WHEN type = 'effect' THEN seq END) OVER (PARTITION BY incident ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stage_end, CAST(coalesce(sum(CASE WHEN type = 'executed' THEN 1 ELSE 0 END) OVER (PARTITION BY incident ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS round FROM log")
def w14(spark, d):
    return ev.stages(log(spark, d), F.col("type") == "effect", F.col("type") == "executed").select("seq", "stage_end", "round")


ALLOWED = {None: ("proposed",), "proposed": ("executed",), "executed": ("effect",), "effect": ("proposed",)}


@query("w16_l1_transitions", f"{E}, l AS (SELECT *, lag(type) OVER (PARTITION BY incident, proposal ORDER BY seq) AS before FROM log WHERE type IN ('proposed', 'executed', 'effect')) SELECT incident, proposal, seq, before, type FROM l WHERE (coalesce(before, '-'), type) NOT IN (('-', 'proposed'), ('proposed', 'executed'), ('executed', 'effect'), ('effect', 'proposed'))")
def l1(spark, d):
    return ev.transition_violations(log(spark, d).filter("type in ('proposed', 'executed', 'effect')"), ["incident", "proposal"], ALLOWED)


@query("l1_lenient_replay", f"""{E}, n AS (SELECT *, row_number() OVER (PARTITION BY incident, proposal ORDER BY seq) AS i FROM log WHERE type IN ('proposed', 'executed', 'effect')),
fold AS (WITH RECURSIVE f AS (SELECT incident, proposal, seq, type, i, type = 'proposed' AS applied, CASE WHEN type = 'proposed' THEN 'proposed' ELSE '' END AS state FROM n WHERE i = 1
 UNION ALL SELECT n.incident, n.proposal, n.seq, n.type, n.i, (f.state, n.type) IN (('', 'proposed'), ('proposed', 'executed'), ('executed', 'effect'), ('effect', 'proposed')), CASE WHEN (f.state, n.type) IN (('', 'proposed'), ('proposed', 'executed'), ('executed', 'effect'), ('effect', 'proposed')) THEN n.type ELSE f.state END FROM n JOIN f ON n.incident = f.incident AND n.proposal = f.proposal AND n.i = f.i + 1) SELECT * FROM f)
SELECT incident, proposal, seq, type, applied FROM fold""")
def l1l(spark, d):
    return ev.lenient_replay(log(spark, d).filter("type in ('proposed', 'executed', 'effect')"), ["incident", "proposal"], ALLOWED)


@query("l2_active_measures", f"{E}, s AS (SELECT incident, proposal, arg_max(type, seq) AS type, arg_max(action, seq) AS action FROM log WHERE type IN ('proposed', 'executed', 'effect') GROUP BY ALL) SELECT action, count(*) AS n_active, count(DISTINCT incident) AS n_incidents FROM s WHERE type = 'executed' GROUP BY 1")
def l2(spark, d):
    s = ev.latest(log(spark, d), ["incident", "proposal"], ["type", "action"], F.col("type").isin("proposed", "executed", "effect"))
    return s.filter("type = 'executed'").groupBy("action").agg(F.count("*").alias("n_active"), F.count_distinct("incident").alias("n_incidents"))


@query("l3_incident_summary", f"{_LABELS}, s AS (SELECT incident, min(ts) AS t0, max(ts) AS t1, arg_max(value, seq) FILTER (type = 'effect') AS last_effect, bool_or(type = 'effect' AND value > 30) AS resolved FROM log GROUP BY 1) SELECT incident, round((epoch_us(t1) - epoch_us(t0)) / 1e6, 3) AS duration_s, last_effect, resolved, (SELECT count(*) FROM labels l WHERE l.incident = s.incident) AS n_labels FROM s")
def l3(spark, d):
    rows = log(spark, d)
    eff = F.col("type") == "effect"
    s = rows.groupBy("incident").agg(F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, 3).alias("duration_s"), F.max_by(F.when(eff, F.col("value")), F.when(eff, F.col("seq"))).alias("last_effect"), F.bool_or(eff & (F.col("value") > 30)).alias("resolved"))
    n = ev.neutral_labels(rows.withColumnRenamed("place", "role"), "incident", "role", "address").groupBy("incident").agg(F.count("*").alias("n_labels"))
    return s.join(n, "incident")


@query("l4_risk_reasons", f"""{E}, p AS (SELECT *, coalesce(max(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY incident, address ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rej, row_number() OVER (PARTITION BY incident ORDER BY seq) AS ni, row_number() OVER (PARTITION BY log ORDER BY seq) AS nl FROM log WHERE type = 'proposed')
SELECT seq, [x FOR x IN [CASE WHEN action = 'isolate' THEN 'always' END, CASE WHEN address IN ('1', '2') THEN 'protected' END, CASE WHEN rej = 1 THEN 'rejected' END, CASE WHEN ni > 8 THEN 'incident budget' END, CASE WHEN nl > 150 THEN 'global budget' END] IF x IS NOT NULL] AS reasons FROM p""")
def l4(spark, d):
    p = log(spark, d).filter("type = 'proposed'").withColumn("rejected", F.col("k") % 11 == 0).withColumnRenamed("address", "target")
    return ev.high_risk(p, ["isolate"], ["1", "2"], 8, 150).select("seq", "reasons")


@query("l4_all_risk_reasons", f"""{E}, p AS (SELECT *, coalesce(max(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY incident, address ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rej, CASE WHEN k % 20 < 7 THEN 'origin' WHEN k % 20 < 13 THEN 'destination' ELSE 'none' END AS role FROM log WHERE type = 'proposed'),
a AS (SELECT seq, sum(delta) OVER (PARTITION BY log, incident ORDER BY seq) AS here, sum(delta) OVER (PARTITION BY log ORDER BY seq) AS anywhere FROM (SELECT log, incident, seq, CASE WHEN type = 'executed' AND k % 4 <> 0 THEN 1 WHEN type = 'effect' AND k % 5 = 0 THEN -1 ELSE 0 END AS delta FROM log))
SELECT seq, CASE WHEN action = 'notify' THEN ['new'] ELSE [x FOR x IN [CASE WHEN action = 'isolate' THEN 'always' END, CASE WHEN action <> 'isolate' AND k % 40 > 30 THEN 'term' END, CASE WHEN action IN ('block', 'observe') AND role = 'destination' THEN 'destination' END,
 CASE WHEN action IN ('block', 'observe') AND k % 3 = 0 THEN 'local' END, CASE WHEN action <> 'isolate' AND here >= 2 THEN 'incident budget' END, CASE WHEN action <> 'isolate' AND anywhere >= 20 THEN 'global budget' END, CASE WHEN role = 'none' THEN 'outside' END, CASE WHEN address IN ('1', '2') THEN 'protected' END, CASE WHEN rej = 1 THEN 'rejected' END] IF x IS NOT NULL] END AS reasons FROM p JOIN a USING (seq)""")
def l4_all(spark, d):
    rows = log(spark, d)
    role = F.when(F.col("k") % 20 < 7, "origin").when(F.col("k") % 20 < 13, "destination").otherwise("none")
    p = rows.filter("type = 'proposed'").select("log", "incident", "seq", "action", F.col("address").alias("target"), (F.col("k") % 40).alias("term"), role.alias("role"), (F.col("k") % 3 == 0).alias("local"), (F.col("k") % 11 == 0).alias("rejected"))
    delta = F.when((F.col("type") == "executed") & (F.col("k") % 4 != 0), 1).when((F.col("type") == "effect") & (F.col("k") % 5 == 0), -1)
    catalogue = spark.createDataFrame([("isolate", True, 30, "both"), ("block", False, 30, "origins"), ("limit", False, 30, "both"), ("observe", False, 30, "origins")], "action string, always boolean, longest long, targets string")
    return ev.all_risk_reasons(p, rows.withColumn("delta", delta).filter("delta is not null"), catalogue, ["1", "2"], 2, 20)


@query("x11_masked_payloads", f"""{E} SELECT seq, '{{"k": ' || k || ', "who": "[address]", "more": ["to [address] ok", 5, {{"x": "v1.2.3"}}]}}' AS payload FROM log""")
def x11(spark, d):
    from winlens.functions.text import mask_payload

    text = lambda c: c.cast("string")
    body = F.concat(F.lit('{"k": '), text(F.col("k")), F.lit(', "who": "10.0.'), text(F.col("k") % 7), F.lit("."), text(F.col("k") % 200), F.lit('", "more": ["to 192[.]168[.]1[.]'), text(F.col("k") % 250), F.lit(' ok", 5, {"x": "v1.2.3"}]}'))
    return log(spark, d).select("seq", mask_payload(body).alias("payload"))


@query("l5_s21_agent_costs", f"{E}, c AS (SELECT incident, config, agent, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, sum(value) AS model_s, sum(CASE WHEN place = 'cloud' THEN (tokens_in * 3.0 + tokens_out * 15.0) / 1e6 ELSE 0 END) AS cost FROM log WHERE type = 'call' GROUP BY ALL) SELECT incident, config, agent, calls, tokens_in, tokens_out, round(model_s, 6) AS model_s, round(cost, 9) AS cost FROM c UNION ALL SELECT incident, config, NULL, CAST(sum(calls) AS BIGINT), CAST(sum(tokens_in) AS BIGINT), CAST(sum(tokens_out) AS BIGINT), round(sum(model_s), 6), round(sum(cost), 9) FROM c GROUP BY incident, config")
def l5(spark, d):
    c = ev.agent_costs(log(spark, d).filter("type = 'call'"), ["incident", "config"], 3.0, 15.0)
    return ev.with_run_totals(c, ["incident", "config"]).withColumns({"model_s": F.round("model_s", 6), "cost": F.round("cost", 9)})


_RUNS = """, runs AS (SELECT incident, config, incident % 3 <> 0 AS is_true, arg_max(CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END, seq) FILTER (type = 'call' AND k % 3 < 2) AS label, count(*) FILTER (type = 'proposed') AS n_proposals, count(*) FILTER (type = 'proposed' AND action IN ('block', 'limit')) AS n_acceptable,
 arg_min(action, seq) FILTER (type = 'proposed') AS first_action, count(*) FILTER (type = 'executed') AS n_approved, count(*) FILTER (type = 'effect' AND value < 5) AS n_rejected FROM log GROUP BY ALL)"""


def runs(spark, d):
    t = lambda x: F.col("type") == x
    said = t("call") & (F.col("k") % 3 < 2)
    return log(spark, d).groupBy("incident", "config", (F.col("incident") % 3 != 0).alias("is_true")).agg(
        F.max_by(F.when(said, F.when(F.col("k") % 3 == 0, "true").otherwise("false")), F.when(said, F.col("seq"))).alias("label"), F.count_if(t("proposed")).alias("n_proposals"), F.count_if(t("proposed") & F.col("action").isin("block", "limit")).alias("n_acceptable"),
        F.min_by(F.when(t("proposed"), F.col("action")), F.when(t("proposed"), F.col("seq"))).alias("first_action"), F.count_if(t("executed")).alias("n_approved"), F.count_if(t("effect") & (F.col("value") < 5)).alias("n_rejected"))


_CORRECT = "CASE WHEN label IS NULL THEN NULL WHEN is_true THEN label = 'true' ELSE label = 'false' END"


@query("l6_p27_run_measures", f"{E}{_RUNS} SELECT *, {_CORRECT} AS triage_correct FROM runs")
def l6(spark, d):
    return runs(spark, d).withColumn("triage_correct", ev.triage_correct(F.col("is_true"), F.col("label")))


@query("l7_config_summary", f"{E}{_RUNS} SELECT config, count(*) AS n_runs, count(*) FILTER (label IS NULL) AS n_silent, count(*) FILTER ({_CORRECT}) AS n_correct, CAST(sum(n_proposals) AS BIGINT) AS n_proposals, CAST(sum(n_acceptable) AS BIGINT) AS n_acceptable FROM runs GROUP BY 1")
def l7(spark, d):
    r = l6(spark, d)
    return r.groupBy("config").agg(F.count("*").alias("n_runs"), F.count_if(F.col("label").isNull()).alias("n_silent"), F.count_if("triage_correct").alias("n_correct"), F.sum("n_proposals").alias("n_proposals"), F.sum("n_acceptable").alias("n_acceptable"))


@query("l8_group_summary", f"{E}{_RUNS} SELECT incident % 7 AS grp, count(*) AS n, count(*) FILTER (n_proposals = 0) AS n_error, round(count(*) FILTER (n_proposals > 0 AND {_CORRECT}) / nullif(count(*) FILTER (n_proposals > 0), 0), 9) AS correct_rate, quantile_cont(n_proposals, 0.5) FILTER (n_proposals > 0) AS median_proposals FROM runs GROUP BY 1")
def l8(spark, d):
    ok = F.col("n_proposals") > 0
    return l6(spark, d).groupBy((F.col("incident") % 7).alias("grp")).agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_error"), F.round(F.try_divide(F.count_if(ok & F.col("triage_correct")), F.count_if(ok)), 9).alias("correct_rate"), F.median(F.when(ok, F.col("n_proposals"))).alias("median_proposals"))


_TIMES = f"{E}, g AS (SELECT incident, config, min(seq) FILTER (type = 'call') AS c, min(seq) FILTER (type = 'executed') AS a FROM log GROUP BY ALL), times AS (SELECT g.incident, g.config, round(epoch_us(y.ts) / 1e6 - (epoch_us(x.ts) / 1e6 - x.value), 3) AS agents_s, y.k % 2 AS risk FROM g JOIN log x ON x.seq = g.c JOIN log y ON y.seq = g.a)"


def times(spark, d):
    rows = log(spark, d).withColumn("risk", F.col("k") % 2)
    return ev.first_action_times(rows, ["incident", "config"], F.col("type") == "call", F.col("type") == "executed").withColumn("agents_s", F.round("agents_s", 3))


@query("l9_remediation_time", f"{_TIMES} SELECT risk, count(*) AS n, round(quantile_cont(agents_s + 1.5, 0.5), 3) AS median_s FROM times GROUP BY 1")
def l9(spark, d):
    return times(spark, d).groupBy("risk").agg(F.count("*").alias("n"), F.round(F.median(F.col("agents_s") + 1.5), 3).alias("median_s"))


@query("j19_detection_plus_agents", f"{_TIMES}, det AS (SELECT incident, round(avg(value), 6) AS detection_s FROM log WHERE type = 'windows' GROUP BY 1) SELECT t.incident, t.config, round(detection_s + agents_s, 3) AS to_remediation_s FROM times t JOIN det USING (incident)")
def j19(spark, d):
    det = log(spark, d).filter("type = 'windows'").groupBy("incident").agg(F.round(F.avg("value"), 6).alias("detection_s"))
    return times(spark, d).join(det, "incident").select("incident", "config", F.round(F.col("detection_s") + F.col("agents_s"), 3).alias("to_remediation_s"))


@query("l10_by_agent_and_place", f"{E} SELECT agent, place, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, round(avg(value), 6) AS mean_s, list_sort(list(DISTINCT config)) AS models FROM log WHERE type = 'call' GROUP BY ALL")
def l10(spark, d):
    return log(spark, d).filter("type = 'call'").groupBy("agent", "place").agg(F.count("*").alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.avg("value"), 6).alias("mean_s"), F.sort_array(F.collect_set("config")).alias("models"))


@query("l11_queue_view", f"{E} SELECT incident, arg_max(type, seq) AS state, CAST(coalesce(sum(k) FILTER (type = 'windows'), 0) AS BIGINT) AS windows, count(DISTINCT address) AS n_addresses, greatest(0, count(*) FILTER (type = 'proposed') - count(*) FILTER (type = 'executed')) AS waiting FROM log GROUP BY 1")
def l11(spark, d):
    t = lambda x: F.col("type") == x
    return log(spark, d).groupBy("incident").agg(F.max_by("type", "seq").alias("state"), F.coalesce(F.sum(F.when(t("windows"), F.col("k"))), F.lit(0)).alias("windows"), F.count_distinct("address").alias("n_addresses"), F.greatest(F.lit(0), F.count_if(t("proposed")) - F.count_if(t("executed"))).alias("waiting"))


@query("l13_run_reading", f"{E}{_RUNS} SELECT incident, config, CASE WHEN label IS NULL THEN 'n/a' WHEN {_CORRECT} THEN 'right' ELSE 'wrong' END AS triage, CASE WHEN n_proposals = 0 THEN 'n/a' WHEN n_acceptable > 0 THEN 'right' ELSE 'wrong' END AS action FROM runs")
def l13(spark, d):
    r = l6(spark, d)
    return r.select("incident", "config", F.when(F.col("label").isNull(), "n/a").when(F.col("triage_correct"), "right").otherwise("wrong").alias("triage"), F.when(F.col("n_proposals") == 0, "n/a").when(F.col("n_acceptable") > 0, "right").otherwise("wrong").alias("action"))


@query("l14_over_queue_limit", f"{E}, r AS (SELECT incident, seq, CAST(sum(CASE type WHEN 'proposed' THEN 1 WHEN 'executed' THEN -1 ELSE 0 END) OVER (PARTITION BY incident ORDER BY seq) AS BIGINT) AS pending FROM log) SELECT * FROM r WHERE pending > 3")
def l14(spark, d):
    return ev.over_limit(log(spark, d), F.col("type") == "proposed", F.col("type") == "executed", 3).select("incident", "seq", "pending")


@query("l15_incident_detail", f"{E}, m AS (SELECT *, last_value(CASE WHEN type = 'call' THEN config END IGNORE NULLS) OVER (PARTITION BY incident, agent ORDER BY seq) AS model FROM log) SELECT seq, incident, agent, action, model FROM m WHERE type IN ('proposed', 'executed')")
def l15(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("incident", "agent").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    m = log(spark, d).withColumn("model", F.last(F.when(F.col("type") == "call", F.col("config")), True).over(w))
    return m.filter("type in ('proposed', 'executed')").select("seq", "incident", "agent", "action", "model")


@query("l16_authorship", f"{E}, b AS (SELECT incident, proposal, min(seq) AS born FROM log WHERE type = 'proposed' GROUP BY ALL) SELECT seq, agent, type, (agent, type) NOT IN (('triage', 'windows'), ('analyst', 'call'), ('responder', 'proposed'), ('responder', 'executed'), ('reviewer', 'effect')) AS foreign_type, coalesce(born >= seq, true) AS dangling FROM log LEFT JOIN b USING (incident, proposal) WHERE type IN ('executed', 'effect')")
def l16(spark, d):
    rows = log(spark, d).filter("type in ('proposed', 'executed', 'effect')")
    allowed = spark.createDataFrame([("triage", "windows"), ("analyst", "call"), ("responder", "proposed"), ("responder", "executed"), ("reviewer", "effect")], "agent string, type string").withColumn("ok", F.lit(True))
    bad = ev.dangling(rows, F.col("type") == "proposed", F.col("type").isin("executed", "effect"), ["incident", "proposal"]).select("seq", F.lit(True).alias("dangling"))
    uses = rows.filter("type in ('executed', 'effect')").join(allowed, ["agent", "type"], "left").join(bad, "seq", "left")
    return uses.select("seq", "agent", "type", F.col("ok").isNull().alias("foreign_type"), F.coalesce("dangling", F.lit(False)).alias("dangling"))


@query("j20_dangling_references", f"{E}, b AS (SELECT incident, proposal, min(seq) AS born FROM log WHERE type = 'proposed' GROUP BY ALL) SELECT seq, incident, proposal FROM log LEFT JOIN b USING (incident, proposal) WHERE type = 'executed' AND coalesce(born >= seq, true)")
def j20(spark, d):
    return ev.dangling(log(spark, d), F.col("type") == "proposed", F.col("type") == "executed", ["incident", "proposal"]).select("seq", "incident", "proposal")


@query("j18_proposal_scores", f"""{E} SELECT seq, CASE WHEN action = 'notify' THEN 'new action' WHEN address IN ('1', '2', '3') THEN 'protected' WHEN (incident % 2, action, CASE WHEN k % 20 < 10 THEN 'origin' ELSE 'destination' END) NOT IN ((0, 'block', 'origin'), (0, 'limit', 'origin'), (1, 'isolate', 'destination'), (1, 'block', 'origin')) THEN 'not in key' END AS reason FROM log WHERE type = 'proposed'""")
def j18(spark, d):
    p = log(spark, d).filter("type = 'proposed'").select("seq", (F.col("incident") % 2).alias("category"), "action", F.col("address").alias("target"), F.when(F.col("k") % 20 < 10, "origin").otherwise("destination").alias("role"))
    key = spark.createDataFrame([(0, "block", "origin"), (0, "limit", "origin"), (1, "isolate", "destination"), (1, "block", "origin")], "category long, action string, role string")
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    return ev.score_proposals(p, key, one(["1", "2", "3"], "target"), one(["block", "isolate", "limit", "observe"], "action")).select("seq", "reason")


@query("p24_shifted_instants", f"{E} SELECT seq, epoch_us(ts) + 90061000001 AS instant_us FROM log")
def p24(spark, d):
    from winlens.functions.scalars import shifted

    return log(spark, d).select("seq", F.unix_micros(shifted(F.col("ts"), 90061000001)).alias("instant_us"))


@query("p26_call_cost", f"{E} SELECT seq, round(CASE WHEN place = 'cloud' THEN (tokens_in * 3.0 + tokens_out * 15.0) / 1e6 ELSE 0 END, 9) AS cost FROM log WHERE type = 'call'")
def p26(spark, d):
    return ev.agent_costs(log(spark, d).filter("type = 'call'"), ["seq"], 3.0, 15.0).select("seq", F.round("cost", 9).alias("cost"))


@query("p28_target_role", f"{E} SELECT seq, CASE WHEN k % 20 < 7 THEN 'origin' WHEN k % 20 < 13 THEN 'destination' ELSE 'none' END AS role FROM log WHERE type = 'proposed'")
def p28(spark, d):
    a = lambda x, y: F.array(*(F.lit(str(i)) for i in range(x, y)))
    target = F.when(F.col("k") % 2 == 0, F.concat(F.lit("root@"), F.col("address"))).otherwise(F.col("address"))
    return log(spark, d).filter("type = 'proposed'").select("seq", ev.target_role(target, a(0, 7), a(7, 13)).alias("role"))


@query("p22_protected_addresses", f"{E} SELECT seq, address IN ('3', '4', '5') AS protected, k % 20 BETWEEN 8 AND 15 AS local FROM log WHERE type = 'proposed'")
def p22(spark, d):
    from winlens.functions.addresses import in_networks

    base = F.lit(10 << 24).cast("long") + F.col("k") % 20
    nets = lambda rows: spark.createDataFrame(rows, "low long, high long")
    p = log(spark, d).filter("type = 'proposed'").select("seq", base.alias("ip"))
    out = in_networks(p, "ip", nets([((10 << 24) + 3, (10 << 24) + 5)]), "protected")
    return in_networks(out, "ip", nets([((10 << 24) + 8, (10 << 24) + 15)]), "local").select("seq", "protected", "local")


@query("f10_only_recommend", f"{E}{_RUNS} SELECT incident, config FROM runs WHERE is_true AND n_proposals = 0")
def f10(spark, d):
    return runs(spark, d).filter("is_true and n_proposals = 0").select("incident", "config")


@query("k11_first_by_criteria", f"{E}{_RUNS}, c AS (SELECT *, CASE WHEN n_acceptable > 0 AND n_approved > 0 THEN 1 WHEN n_proposals > 0 THEN 2 ELSE 3 END AS criterion FROM runs) SELECT config, arg_min(incident, (criterion, incident)) AS incident, CAST(min(criterion) AS BIGINT) AS criterion FROM c GROUP BY 1")
def k11(spark, d):
    c = F.when((F.col("n_acceptable") > 0) & (F.col("n_approved") > 0), 1).when(F.col("n_proposals") > 0, 2).otherwise(3)
    r = runs(spark, d).withColumn("criterion", c)
    return ra.top_k(r, ["config"], [F.col("criterion"), F.col("incident")], 1).select("config", "incident", F.col("criterion").cast("long").alias("criterion"))


@query("o5_items_without_run", f"{E} SELECT DISTINCT incident FROM log EXCEPT SELECT incident FROM log WHERE type = 'proposed' AND config = 1")
def o5(spark, d):
    rows = log(spark, d)
    return rows.select("incident").distinct().join(rows.filter("type = 'proposed' and config = 1").select("incident").distinct(), "incident", "left_anti")


@query("o6_action_catalogue", f"{E} SELECT 0 AS place, action FROM (SELECT unnest(['block', 'isolate', 'limit', 'observe']) AS action) UNION ALL SELECT min(seq), 'new-' || proposal % 7 FROM log WHERE type = 'executed' AND action = 'notify' GROUP BY 2")
def o6(spark, d):
    base = spark.createDataFrame([(a,) for a in ("block", "isolate", "limit", "observe")], "action string").select(F.lit(0).cast("long").alias("place"), "action")
    new = log(spark, d).filter("type = 'executed' and action = 'notify'").groupBy(F.concat(F.lit("new-"), F.col("proposal") % 7).alias("action")).agg(F.min("seq").alias("place"))
    return base.unionByName(new)


_CONF = f"{E}, i AS (SELECT value / 50.0 AS confidence, k % 3 > 0 AS is_true, k % 5 > 2 AS in_test, k AS windows FROM log WHERE type = 'windows' AND (k % 3 = 0 OR value > 6)), g AS (SELECT unnest([0.05, 0.1, 0.2, 0.4, 0.8]) AS t), c AS (SELECT t, count(*) FILTER (NOT is_true AND confidence < t) AS false_below, count(*) FILTER (NOT is_true) AS n_false, count(*) FILTER (is_true AND confidence < t) AS true_below, count(*) FILTER (is_true) AS n_true FROM i, g WHERE NOT in_test GROUP BY 1)"


def triage(spark, d):
    return log(spark, d).filter("type = 'windows' and (k % 3 = 0 or value > 6)").select((F.col("value") / 50.0).alias("confidence"), (F.col("k") % 3 > 0).alias("is_true"), (F.col("k") % 5 > 2).alias("in_test"), F.col("k").alias("windows"))


@query("a33_confidence_counts", f"{_CONF} SELECT * FROM c")
def a33(spark, d):
    return de.confidence_counts(triage(spark, d).filter("not in_test"), "confidence", "is_true", [0.05, 0.1, 0.2, 0.4, 0.8])


@query("a33_confidence_choice", f"{_CONF} SELECT (SELECT t FROM c WHERE true_below = 0 AND n_false > 0 ORDER BY false_below DESC, t LIMIT 1) AS t")
def a33c(spark, d):
    return de.choose_confidence(a33(spark, d))


@query("a43_histogram_median", f"{E}, h AS (SELECT log, k, count(*) AS n FROM log GROUP BY ALL) SELECT log, quantile_cont(k, 0.5) AS median FROM log GROUP BY 1")
def a43(spark, d):
    return ev.histogram_median(log(spark, d).groupBy("log", "k").agg(F.count("*").alias("n")), "k", "n", ["log"])


@query("a44_count_comparison", f"{E}, a AS (SELECT type, count(*) AS n FROM log WHERE k % 2 = 0 AND type <> 'call' GROUP BY 1), b AS (SELECT type, count(*) AS n FROM log WHERE k % 2 = 1 AND type <> 'effect' GROUP BY 1) SELECT type, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, CASE WHEN type <> 'windows' THEN coalesce(b.n, 0) - coalesce(a.n, 0) END AS difference, CASE WHEN type <> 'windows' THEN round((coalesce(b.n, 0) - a.n) / a.n, 9) END AS share FROM a FULL JOIN b USING (type)")
def a44(spark, d):
    rows = log(spark, d)
    a, b = (rows.filter(c).groupBy("type").agg(F.count("*").alias("n")) for c in ("k % 2 = 0 and type <> 'call'", "k % 2 = 1 and type <> 'effect'"))
    return ev.compare_counts(a, b, "type", spark.createDataFrame([("windows",)], "type string")).withColumn("share", F.round("share", 9))


@query("a6_rows_per_label", f"{E} SELECT type, log, count(*) AS n FROM log GROUP BY CUBE (type, log)")
def a6(spark, d):
    return log(spark, d).cube("type", "log").agg(F.count("*").alias("n"))


_SPELL = "CASE event_id % 6 WHEN 0 THEN 'DDoS-SYN_Flood' WHEN 1 THEN 'ddos-syn_flood ' WHEN 2 THEN 'BENIGN' WHEN 3 THEN 'Benign_Final' WHEN 4 THEN 'xss' ELSE 'DoS-UDP_Flood' END"


@query("p5_p6_labels", "SELECT event_id, ['DDoS-SYN_Flood', 'DDoS-SYN_Flood', 'BenignTraffic', 'BenignTraffic', 'XSS', 'DoS-UDP_Flood'][event_id % 6 + 1] AS label, ['DDoS', 'DDoS', 'Benign', 'Benign', 'Web', 'DoS'][event_id % 6 + 1] AS category, ['Attack', 'Attack', 'Benign', 'Benign', 'Attack', 'Attack'][event_id % 6 + 1] AS \"binary\", ['DDoS+DoS', 'DDoS+DoS', 'Benign', 'Benign', 'Web', 'DDoS+DoS'][event_id % 6 + 1] AS target7 FROM events")
def p5(spark, d):
    return la.canonical_labels(ad.table(spark, d, "events").select("event_id", F.expr(_SPELL).alias("raw")), "raw").drop("raw")


_KINDS = ("DDoS", "DoS", "Recon", "Web", "Mirai", "Benign")


@query("p7_same_family", "SELECT event_id, event_id % 6 = user_id % 6 OR (event_id % 6 < 2 AND user_id % 6 < 2) AS same FROM events")
def p7(spark, d):
    kind = lambda c: F.element_at(F.array(*map(F.lit, _KINDS)), (F.col(c) % 6 + 1).cast("int"))
    return ad.table(spark, d, "events").select("event_id", la.same_family(kind("event_id"), kind("user_id")).alias("same"))


@query("x7_payload_defects", "SELECT event_id, [x FOR x IN [CASE WHEN event_id % 9 = 0 THEN 'k missing' END, CASE WHEN event_id % 9 = 1 THEN 'k negative' END, CASE WHEN event_id % 9 = 2 THEN 'not json' END] IF x IS NOT NULL] AS defects FROM events")
def x7(spark, d):
    from winlens.functions.text import payload_defects

    body = F.when(F.col("event_id") % 9 == 0, '{"j": 1}').when(F.col("event_id") % 9 == 1, '{"k": -4}').when(F.col("event_id") % 9 == 2, '{"k": ').otherwise(F.col("props"))
    return ad.table(spark, d, "events").select("event_id", payload_defects(body, "k bigint", {"k missing": lambda p: p["k"].isNull(), "k negative": lambda p: p["k"] < 0}).alias("defects"))


_FACTS = f"{E}, t AS (SELECT incident, seq, CASE type WHEN 'windows' THEN 'classified ' || k || ' windows' WHEN 'proposed' THEN 'proposed ' || action WHEN 'executed' THEN 'executed ' || action END AS line FROM log WHERE type IN ('windows', 'proposed', 'executed')) SELECT incident, string_agg(line, chr(10) ORDER BY seq) || CASE WHEN bool_or(line LIKE 'executed%') THEN '' ELSE chr(10) || 'nothing was executed' END AS facts FROM t GROUP BY 1"


@query("x9_incident_facts_all", _FACTS)
def x9(spark, d):
    return incident_facts(log(spark, d))


def incident_facts(rows):
    t = F.col("type")
    line = F.when(t == "windows", F.concat(F.lit("classified "), F.col("k"), F.lit(" windows"))).when(t == "proposed", F.concat(F.lit("proposed "), F.col("action"))).when(t == "executed", F.concat(F.lit("executed "), F.col("action")))
    rows = rows.withColumn("line", line).filter("line is not null")
    g = rows.groupBy("incident").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"), F.bool_or(t == "executed").alias("done"))
    return g.select("incident", F.concat_ws("\n", F.transform("l", lambda x: x["line"]), F.when(~F.col("done"), F.lit("nothing was executed"))).alias("facts"))


@query("x10_proposal_audit", f"""{E}, p AS (SELECT seq, action, k % 20 AS a, CASE action WHEN 'block' THEN '10.0.0.' || k % 20 WHEN 'isolate' THEN 'root@10.0.0.' || k % 20 WHEN 'limit' THEN k || '/tcp@10.0.0.' || k % 20 ELSE 'x' || k END AS target FROM log WHERE type = 'proposed') SELECT seq, CASE WHEN action IN ('observe', 'notify') THEN 'unknown action' WHEN a = 0 THEN 'special address' WHEN action = 'limit' AND regexp_extract(target, '^[0-9]+')::INT = 0 THEN 'bad port' END AS refusal FROM p""")
def x10(spark, d):
    from winlens.functions.addresses import audit_target

    a = F.col("k") % 20
    ip = F.concat(F.lit("10.0.0."), a)
    target = F.when(F.col("action") == "block", ip).when(F.col("action") == "isolate", F.concat(F.lit("root@"), ip)).when(F.col("action") == "limit", F.concat(F.col("k"), F.lit("/tcp@"), ip)).otherwise(F.concat(F.lit("x"), F.col("k")))
    return log(spark, d).filter("type = 'proposed'").select("seq", audit_target(F.col("action"), target, {"block": "ip", "isolate": "user@ip", "limit": "port@ip"}).alias("refusal"))
