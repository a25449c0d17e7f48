"""Analytics over a typed, ordered event log: conformance, state, labels, stages, runs, costs, times, risk.

A log has seq, ts, incident, type and columns of its payload. Nothing folds the log; everything is a window or a join by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.operators.ordered import running


def strict_violations(log: DataFrame, payload_incident: str | None = None) -> DataFrame:
    """(log, seq, reason): id not equal to the position, time going back, envelope and payload naming different incidents."""
    w = Window.partitionBy("log").orderBy("line")
    back = F.col("ts") < F.lag("ts").over(w)
    misplaced = F.col("seq") != F.row_number().over(w)
    foreign = F.lit(False) if payload_incident is None else F.col("incident") != F.col(payload_incident)
    reasons = F.array_compact(F.array(F.when(misplaced, F.lit("id")), F.when(back, F.lit("time")), F.when(foreign, F.lit("incident"))))
    return log.withColumn("reasons", reasons).select("log", "line", "seq", F.explode("reasons").alias("reason"))


def lenient(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, anomalies): lines without id or time are dropped, the first of a repeated id stays, kept lines are renumbered by id."""
    bad = F.col("seq").isNull() | F.col("ts").isNull()
    first = F.row_number().over(Window.partitionBy("log", "seq").orderBy("line"))
    rows = log.withColumn("anomaly", F.when(bad, "malformed").when(first > 1, "repeated"))
    kept = rows.filter("anomaly is null").drop("anomaly").withColumn("position", F.row_number().over(Window.partitionBy("log").orderBy("seq")))
    return kept, rows.filter("anomaly is not null").select("log", "line", "seq", "anomaly")


def append_batch(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's drafts (log, order, ts, ...) as events that continue a log: ids after its last one, instants never before it."""
    last = log.groupBy("log").agg(F.max("seq").alias("_id"), F.max("ts").alias("_ts"))
    w = Window.partitionBy("log").orderBy("order")
    out = batch.join(last, "log", "left")
    floor = F.greatest(F.max("ts").over(w), F.col("_ts"))
    return out.withColumns({"seq": F.coalesce("_id", F.lit(0)) + F.row_number().over(w), "ts": floor}).drop("_id", "_ts")


def latest(log: DataFrame, by: list[str], values: list[str], until: Column | None = None) -> DataFrame:
    """The last values of each entity by seq."""
    rows = log if until is None else log.filter(until)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "seq").alias("x")).select(*by, *(f"x.{v}" for v in values))


def running_totals(log: DataFrame, sums: dict[str, Column], by: str = "log") -> DataFrame:
    """log with the running sum of each of sums; a log of any length is summed in ranges."""
    given = log.withColumns({f"_in_{k}": c for k, c in sums.items()})
    return running(given, [by], ["seq"], {k: f"_in_{k}" for k in sums}, number="_at").select(*log.columns, *sums)


def busiest_step(log: DataFrame, up: Column, down: Column, by: str = "log") -> DataFrame:
    """(by, seq, pending): the first step with most pending."""
    r = running_totals(log, {"pending": F.when(up, 1).when(down, -1).otherwise(0)}, by)
    return r.groupBy(by).agg(F.max_by(F.struct("seq", "pending"), F.struct("pending", -F.col("seq"))).alias("x")).select(by, "x.seq", "x.pending")


def neutral_labels(log: DataFrame, incident: str, role: str, address: str) -> DataFrame:
    """(incident, role, address, label): role-n by first appearance."""
    first = log.filter(F.col(address).isNotNull()).groupBy(incident, role, address).agg(F.min("seq").alias("first"))
    n = F.row_number().over(Window.partitionBy(incident, role).orderBy("first", address))
    return first.select(incident, role, address, F.concat(F.col(role), F.lit("-"), n.cast("string")).alias("label"))


def stages(log: DataFrame, closes: Column, decides: Column) -> DataFrame:
    """stage_end: seq of the closing event at or after an event (null: still open); round: decisions before it, plus one."""
    w = Window.partitionBy("incident").orderBy("seq")
    ahead = F.first(F.when(closes, F.col("seq")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rounds = F.coalesce(F.sum(decides.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return log.select("*", ahead.alias("stage_end"), rounds.alias("round"))


def transition_violations(log: DataFrame, entity: list[str], allowed: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """(entity, seq, before, type): events whose predecessor of the same entity does not allow them; None: may come first."""
    before = F.lag("type").over(Window.partitionBy(*entity).orderBy("seq"))
    ok = F.lit(False)
    for k, types in allowed.items():
        ok = ok | ((F.col("before").isNull() if k is None else F.col("before") == k) & F.col("type").isin(*types))
    return log.withColumn("before", before).filter(~F.coalesce(ok, F.lit(False))).select(*entity, "seq", "before", "type")


def lenient_replay(log: DataFrame, entity: list[str], allowed: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """(entity, seq, type, applied): an event that its state does not allow is skipped and leaves the state as it was.

    Whether an event applies depends on which came before it were skipped; a fold over one entity's sorted types.
    """
    states = F.sort_array(F.collect_list(F.struct("seq", "type")))
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit("" if k is None else k), F.array(*map(F.lit, v)))))
    zero = F.struct(F.lit("").alias("state"), F.array().cast("array<struct<seq:bigint,type:string,applied:boolean>>").alias("out"))

    def step(acc, e):
        ok = F.coalesce(F.array_contains(F.coalesce(F.try_element_at(table, acc["state"]), F.array().cast("array<string>")), e["type"]), F.lit(False))
        return F.struct(F.when(ok, e["type"]).otherwise(acc["state"]).alias("state"), F.concat(acc["out"], F.array(F.struct(e["seq"].cast("long").alias("seq"), e["type"].alias("type"), ok.alias("applied")))).alias("out"))

    folded = log.groupBy(*entity).agg(states.alias("_e")).select(*entity, F.aggregate("_e", zero, step)["out"].alias("_o"))
    return folded.select(*entity, F.explode("_o").alias("x")).select(*entity, "x.seq", "x.type", "x.applied")


def dangling(log: DataFrame, is_definition: Column, is_use: Column, key: list[str]) -> DataFrame:
    """Uses whose key has no definition at an earlier seq."""
    first = log.filter(is_definition).groupBy(*key).agg(F.min("seq").alias("_born"))
    uses = log.filter(is_use).join(first, key, "left")
    return uses.filter(F.col("_born").isNull() | (F.col("_born") >= F.col("seq"))).drop("_born")


def agent_costs(log: DataFrame, by: list[str], price_in: float, price_out: float) -> DataFrame:
    """(by, agent, calls, tokens_in, tokens_out, model_s, cost): model calls; only calls in the cloud cost money."""
    cost = F.when(F.col("place") == "cloud", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6).otherwise(0.0)
    return log.groupBy(*by, "agent").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("value").alias("model_s"), F.sum(cost).alias("cost"))


def with_run_totals(costs: DataFrame, by: list[str]) -> DataFrame:
    """Rows per agent and a total row (agent null) per run."""
    sums = ("calls", "tokens_in", "tokens_out", "model_s", "cost")
    return costs.unionByName(costs.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums)).withColumn("agent", F.lit(None).cast("string")))


def verdict(text: Column) -> Column:
    """coerente, duvidoso or ruido as a triage answer states it, without regard to case and accents; null without one."""
    # fixed value: how an answer states its label; a table of the choices does not count
    pattern = r"rotulo da triagem\**\s*:\s*\**\s*(coerente|duvidoso|ruido)\b(?!\s*\|)"
    word = F.regexp_extract(F.translate(F.lower(text), "óí", "oi"), pattern, 1)
    return F.when(word != "", word)


def triage_correct(is_true: Column, label: Column) -> Column:
    return F.when(label.isNull(), None).otherwise(F.when(is_true, label == "true").otherwise(label == "false"))


def target_role(target: Column, origins: Column, destinations: Column) -> Column:
    """origin, destination or none; a target may be `user@address`."""
    address = F.substring_index(target, "@", -1)
    return F.when(F.array_contains(origins, address), "origin").when(F.array_contains(destinations, address), "destination").otherwise("none")


def score_proposals(proposals: DataFrame, key: DataFrame, protected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """reason: why a proposal is not acceptable (null: it is). key has category, action, role; the others one column each."""
    out = proposals.join(catalogue.withColumn("_known", F.lit(1)), "action", "left")
    out = out.join(protected.withColumn("_protected", F.lit(1)), "target", "left")
    out = out.join(key.withColumn("_ok", F.lit(1)), ["category", "action", "role"], "left")
    reason = F.when(F.col("_known").isNull(), "new action").when(F.col("_protected") == 1, "protected").when(F.col("_ok").isNull(), "not in key")
    return out.withColumn("reason", reason).drop("_known", "_protected", "_ok")


def high_risk(proposals: DataFrame, always: list[str], protected: list[str], low: int, high: int) -> DataFrame:
    """reasons: codes of all reasons at the proposal's point of the log: always-high action, protected target, target rejected
    before in the incident, and more than `low` earlier measures in the incident or `high` in the log."""
    inc = Window.partitionBy("incident").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rejected = F.max((F.col("rejected")).cast("int")).over(Window.partitionBy("incident", "target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    reasons = F.array_compact(F.array(
        F.when(F.col("action").isin(*always), F.lit("always")), F.when(F.col("target").isin(*protected), F.lit("protected")), F.when(rejected == 1, F.lit("rejected")),
        F.when(F.count(F.lit(1)).over(inc) >= low, F.lit("incident budget")), F.when(F.col("_at") > high, F.lit("global budget"))))
    return running(proposals, ["log"], ["seq"], number="_at").withColumn("reasons", reasons).drop("_at")


def all_risk_reasons(proposals: DataFrame, measures: DataFrame, catalogue: DataFrame, protected: list[str], low: int, high: int) -> DataFrame:
    """(seq, reasons): all reasons why a proposal is of high risk at its point of the log; none: it is of low risk.

    proposals has (log, incident, seq, action, target, term, role, local, rejected): role is the target's in the incident (origin, destination
    or none), rejected tells that a person has refused this proposal. measures has (log, incident, seq, delta): +1 where a measure without
    approval starts, -1 where it ends. catalogue has (action, always, longest, targets): the longest term of low risk, and whether the
    action may meet origins only or `both`. An action that is not in it is new, and nothing else is said of it.
    """
    rejected = F.max(F.col("rejected").cast("int")).over(Window.partitionBy("incident", "target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    asked = proposals.withColumns({"rejected_before": F.coalesce(rejected, F.lit(0)) == 1, "delta": F.lit(0)})
    both = asked.unionByName(measures.select("log", "incident", "seq", "delta", F.lit(True).alias("is_measure")), allowMissingColumns=True)
    here = F.coalesce(F.sum("delta").over(Window.partitionBy("log", "incident").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = running(both, ["log"], ["seq"], {"until": "delta"}, number="_at").withColumns({"here": here, "anywhere": F.col("until") - F.col("delta")}).filter("is_measure is null")
    rows = rows.join(catalogue.withColumn("known", F.lit(True)), "action", "left")
    may = ~F.col("always")
    when = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array_compact(F.array(
        when(F.col("always"), "always"), when(may & (F.col("term").isNull() | F.col("longest").isNull() | (F.col("term") > F.col("longest"))), "term"), when(may & (F.col("role") == "destination") & (F.col("targets") != "both"), "destination"),
        when(may & F.col("local") & (F.col("targets") == "origins"), "local"), when(may & (F.col("here") >= low), "incident budget"), when(may & (F.col("anywhere") >= high), "global budget"),
        when(F.col("role") == "none", "outside"), when(F.col("target").isin(*protected), "protected"), when(F.col("rejected_before"), "rejected")))
    return rows.select("seq", F.when(F.col("known").isNull(), F.array(F.lit("new"))).otherwise(reasons).alias("reasons"))


def over_limit(log: DataFrame, up: Column, down: Column, limit: int) -> DataFrame:
    """Events at which more than `limit` are pending in their incident."""
    return running_totals(log, {"pending": F.when(up, 1).when(down, -1).otherwise(0)}, "incident").filter(F.col("pending") > limit)


def first_action_times(log: DataFrame, run: list[str], call: Column, action: Column) -> DataFrame:
    """(run, agents_s, risk): seconds from the start of the first call (its end less its duration) to the first action."""
    g = log.groupBy(*run).agg(F.min(F.when(call, F.struct("seq", "ts", "value"))).alias("c"), F.min(F.when(action, F.struct("seq", "ts", "risk"))).alias("a"))
    seconds = lambda c: F.unix_micros(c) / 1e6
    return g.filter("c is not null and a is not null").select(*run, (seconds(F.col("a.ts")) - (seconds(F.col("c.ts")) - F.col("c.value"))).alias("agents_s"), F.col("a.risk").alias("risk"))


def histogram_median(hist: DataFrame, value: str, count: str, by: list[str] = ()) -> DataFrame:
    return hist.groupBy(*by).agg(F.percentile(F.col(value), 0.5, F.col(count)).alias("median"))


def compare_counts(a: DataFrame, b: DataFrame, key: str, cut: DataFrame | None = None) -> DataFrame:
    """(key, n_a, n_b, difference, share): two count tables (key, n) side by side; keys in cut keep their row but no difference."""
    both = a.select(key, F.col("n").alias("n_a")).join(b.select(key, F.col("n").alias("n_b")), key, "full_outer").na.fill(0)
    d = both.withColumn("difference", F.col("n_b") - F.col("n_a")).withColumn("share", F.try_divide(F.col("difference"), F.col("n_a")))
    if cut is None:
        return d
    m = d.join(cut.select(key).withColumn("_cut", F.lit(1)), key, "left")
    return m.withColumns({c: F.when(F.col("_cut").isNull(), F.col(c)) for c in ("difference", "share")}).drop("_cut")
