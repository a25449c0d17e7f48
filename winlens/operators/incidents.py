"""Assembly of incidents from their windows: presence against background, roles, candidates, ports, records, summaries.

Inputs are long tables. `links` has (capture, win, src, dst, dport, protocol, frames, opened, first_no), one row for each
combination in a window, or a row for each frame as `tagged_links` gives them; `members` has (capture, incident, win); `background` has (capture, win).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.sources.scratch import materialize

INC = ["capture", "incident"]
LEAST_OPENED, RELATIVE, TOP_SHARE, CANDIDATE_FROM, CANDIDATE_WINDOWS = 3, 0.5, 0.8, 0.1, 2
TRANSPORT = {6: "tcp", 17: "udp"}


def window_links(frames: DataFrame, size: int) -> DataFrame:
    opened = (F.col("syn_flag_number") == 1) & (F.col("ack_flag_number") == 0)
    port = F.when(F.col("protocol").isin(*TRANSPORT), F.col("dport"))
    return frames.filter("src is not null and dst is not null").groupBy("capture", F.floor(F.col("frame_no") / size).cast("long").alias("win"), "src", "dst", port.alias("dport"), "protocol").agg(F.count("*").alias("frames"), F.count_if(opened).alias("opened"), F.min("frame_no").alias("first_no"))


def ends_of_frames() -> Column:
    """An aggregate: number, source, target, port, protocol and opening of a window's frames."""
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    opened = F.coalesce((F.col("syn_flag_number") == 1) & (F.col("ack_flag_number") == 0), F.lit(False))
    port = F.when(F.col("protocol").isin(*TRANSPORT), F.col("dport"))
    return F.collect_list(F.when(whole, F.struct("frame_no", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), port.alias("dport"), "protocol", opened.cast("long").alias("opened"))))


def tagged_links(windows: DataFrame, members: DataFrame, background: DataFrame) -> DataFrame:
    """`links` of the windows of members and background, from `ends` of windows: with the incident (null: background) and new_src, new_dst,
    true once for each address of a window. The functions below then need neither joins with members nor distinct rows.

    Windows are joined while their frames are one row, and a capture's lie together, so sums by capture are combined before they are shuffled.
    """
    of = members.select("capture", "win", F.col("incident")).unionByName(background.select("capture", "win", F.lit(None).cast("long").alias("incident")))
    rows = windows.select("capture", "win", "ends", F.col("ends.src").alias("_src"), F.col("ends.dst").alias("_dst")).join(of, ["capture", "win"]).repartition("capture")
    new = lambda c: (F.array_position(F.col(f"_{c}"), F.col(f"f.{c}")) == F.col("i") + 1).alias(f"new_{c}")
    each = rows.select("capture", "incident", "win", "_src", "_dst", F.posexplode("ends").alias("i", "f"))
    return each.select("capture", "incident", "win", "f.src", "f.dst", "f.dport", "f.protocol", F.lit(1).cast("long").alias("frames"), "f.opened", F.col("f.frame_no").alias("first_no"), new("src"), new("dst"))


def of_members(links: DataFrame, members: DataFrame) -> DataFrame:
    """links of incidents, with their incident."""
    return links.filter("incident is not null") if "incident" in links.columns else links.join(members.select(*INC, "win"), ["capture", "win"])


def address_counts(ends: Column, side: str) -> Column:
    """Of ends_of_frames, (addr, n) of one side: most frequent first, ties by first seen. A window has few frames, so its array is searched for each address."""
    addrs = F.array_distinct(F.transform(F.array_sort(ends), lambda f: f[side]))
    counted = F.transform(addrs, lambda a, i: F.struct((-F.size(F.filter(ends, lambda f: f[side] == a))).alias("k"), i.alias("i"), a.alias("addr")))
    return F.transform(F.array_sort(counted), lambda x: F.struct(x["addr"].alias("addr"), (-x["k"]).cast("long").alias("n")))


def presence(links: DataFrame, column: str, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, addr, n_windows, share): in how many of the windows an address appears."""
    total = members.groupBy(*by).agg(F.count("*").alias("_total"))
    if "incident" in links.columns:
        tagged = F.col("incident").isNotNull() if "incident" in by else F.col("incident").isNull()
        n = links.filter(tagged & F.col(f"new_{column}")).groupBy(*by, F.col(column).alias("addr")).agg(F.count("*").alias("n_windows"))
        return n.join(total, by).withColumn("share", F.col("n_windows") / F.col("_total")).drop("_total")
    seen = links.select("capture", "win", F.col(column).alias("addr")).distinct().join(members.select(*by, *({"capture", "win"} - set(by))), ["capture", "win"])
    n = seen.groupBy(*by, "addr").agg(F.count("*").alias("n_windows"))
    return n.join(total, by).withColumn("share", F.col("n_windows") / F.col("_total")).drop("_total")


def prominence(links: DataFrame, column: str, members: DataFrame, background: DataFrame) -> DataFrame:
    """(capture, incident, addr, n_windows, background_share, prominence): presence in the incident less that in benign windows."""
    own = presence(links, column, members, INC)
    back = presence(links, column, background, ["capture"]).select("capture", "addr", F.col("share").alias("background_share"))
    out = own.join(back, ["capture", "addr"], "left").na.fill(0.0, ["background_share"])
    return out.withColumn("prominence", F.col("share") - F.col("background_share")).drop("share")


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    return of_members(links, members).groupBy(*INC, "src", "dst").agg(F.sum("frames").alias("frames"), F.sum("opened").alias("opened"), F.min(F.struct("win", "first_no")).alias("seen"))


def flows(pair: DataFrame) -> DataFrame:
    """(.., addr, sent, received, opened, was_opened, seen)."""
    each = F.explode(F.array(
        F.struct(F.col("src").alias("addr"), F.col("frames").alias("sent"), F.lit(0).cast("long").alias("received"), F.col("opened").alias("o"), F.lit(0).cast("long").alias("w")),
        F.struct(F.col("dst").alias("addr"), F.lit(0).cast("long").alias("sent"), F.col("frames").alias("received"), F.lit(0).cast("long").alias("o"), F.col("opened").alias("w"))))
    return pair.select(*INC, "seen", each.alias("x")).groupBy(*INC, F.col("x.addr").alias("addr")).agg(F.sum("x.sent").alias("sent"), F.sum("x.received").alias("received"), F.sum("x.o").alias("opened"), F.sum("x.w").alias("was_opened"), F.min("seen").alias("seen"))


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def roles(links: DataFrame, members: DataFrame, background: DataFrame, scan: DataFrame, allowed: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """(origins, destinations): (capture, incident, addr, frames, ...) with origins also carrying n_origins and distributed.

    allowed gives the condition (unicast and not protected) on a column; scan marks incidents (capture, incident, is_scan).
    """
    pair = materialize(pairs(links, members), "pairs")  # these three have many users below
    flow = flows(pair)
    source = prominence(links, "src", members, background)
    target = prominence(links, "dst", members, background).select(*INC, F.col("addr").alias("dst"), F.col("prominence").alias("target_prominence"))
    cand = source.join(flow, [*INC, "addr"]).filter((F.col("prominence") > 0) & (F.col("sent") > 0) & allowed("addr"))
    best = F.max("prominence").over(Window.partitionBy(*INC))
    strong = cand.withColumn("strong", F.col("prominence") >= RELATIVE * best).filter("strong").withColumns({"net_opened": F.col("opened") - F.col("was_opened"), "net": F.col("sent") - F.col("received")})
    strong = materialize(strong, "strong")
    starts = F.col("net_opened") >= LEAST_OPENED
    attacker = first_by(strong, INC, [starts.desc(), F.when(starts, F.col("net_opened")).desc_nulls_last(), F.when(~starts, F.col("net")).desc_nulls_last(), F.when(~starts, F.col("prominence")).desc_nulls_last(), F.col("seen"), F.col("addr")]).select(*INC, F.col("addr").alias("attacker"))
    dst_ok = allowed("dst")
    hits = pair.join(attacker, INC).filter((F.col("src") == F.col("attacker")) & (F.col("dst") != F.col("attacker")) & dst_ok).join(target, [*INC, "dst"], "left").na.fill(0.0, ["target_prominence"])
    hits = materialize(hits, "hits")
    main = first_by(hits, INC, [F.col("target_prominence").desc(), F.col("frames").desc(), F.col("seen"), F.col("dst")]).select(*INC, F.col("dst").alias("target"))

    of_scan = attacker.join(main, INC).join(scan.filter("is_scan"), INC).select(*INC, "attacker")
    scan_origins = of_scan.join(flow.select(*INC, F.col("addr").alias("attacker"), F.col("sent").alias("frames"), "seen"), [*INC, "attacker"]).select(*INC, F.col("attacker").alias("addr"), "frames", "seen")
    scan_targets = hits.join(of_scan.select(*INC), INC, "left_semi").select(*INC, F.col("dst").alias("addr"), "frames", "seen")

    floods = main.join(scan.filter("not is_scan").select(*INC), INC)
    flood_origins = pair.join(floods, INC).filter((F.col("dst") == F.col("target")) & (F.col("src") != F.col("target"))).join(strong.select(*INC, F.col("addr").alias("src")), [*INC, "src"], "left_semi").select(*INC, F.col("src").alias("addr"), "frames", "seen")
    is_origin = flood_origins.select(*INC, F.col("addr").alias("src"))
    sent_on = pair.join(is_origin, [*INC, "src"], "left_semi").join(is_origin.withColumnRenamed("src", "dst"), [*INC, "dst"], "left_anti")
    flood_targets = sent_on.groupBy(*INC, F.col("dst").alias("addr")).agg(F.sum("frames").alias("frames"), F.min("seen").alias("seen"))

    ruled = scan_origins.unionByName(flood_origins)
    rest = members.select(*INC).distinct().join(ruled.select(*INC).distinct(), INC, "left_anti")
    vol_o, vol_t = roles_by_volume(pair.join(rest, INC, "left_semi"), dst_ok)
    origins = ruled.unionByName(vol_o)
    w = Window.partitionBy(*INC)
    scans = scan.select(*INC, "is_scan")
    origins = origins.withColumns({"n_origins": F.count("*").over(w), "_max": F.max("frames").over(w), "_sum": F.sum("frames").over(w)}).join(scans, INC)
    origins = origins.withColumn("distributed", ~F.col("is_scan") & (F.col("_max") / F.col("_sum") < TOP_SHARE)).drop("_max", "_sum", "is_scan")
    return origins, scan_targets.unionByName(flood_targets).unionByName(vol_t)


def unicast(column: str) -> Column:
    last = F.col(column).bitwiseAND(F.lit(255))
    return (F.shiftright(F.col(column), 24).bitwiseAND(F.lit(255)) < 224) & (last != 0) & (last != 255)


def roles_by_volume(pair: DataFrame, dst_ok: Column) -> tuple[DataFrame, DataFrame]:
    """Target: receives most frames, then most senders; all its senders are origins."""
    per = pair.filter(dst_ok).groupBy(*INC, "dst").agg(F.sum("frames").alias("frames"), F.count("*").alias("fan"), F.min("seen").alias("seen"))
    main = first_by(per, INC, [F.col("frames").desc(), F.col("fan").desc(), F.col("seen"), F.col("dst")])
    origins = pair.join(main.select(*INC, "dst"), [*INC, "dst"]).select(*INC, F.col("src").alias("addr"), "frames", "seen")
    return origins, main.select(*INC, F.col("dst").alias("addr"), "frames", "seen")


def listed(addresses: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest addresses (or ports) of each incident, ties by first seen and then by the address or port, with their place."""
    w = Window.partitionBy(*INC).orderBy(F.col("frames").desc(), "seen", *(c for c in ("addr", "dst", "dport", "protocol") if c in addresses.columns))
    return addresses.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def ports(links: DataFrame, members: DataFrame, destinations: DataFrame, k: int = 5) -> DataFrame:
    """(capture, incident, dst, dport, protocol, frames, place): the busiest ports among the listed destinations, TCP and UDP only."""
    used = of_members(links.filter(F.col("protocol").isin(*TRANSPORT)), members)
    used = used.groupBy(*INC, "dst", "dport", "protocol").agg(F.sum("frames").alias("frames"), F.min(F.struct("win", "first_no")).alias("seen"))
    used = used.join(listed(destinations).select(*INC, F.col("addr").alias("dst")), [*INC, "dst"], "left_semi")
    return listed(used, k).drop("seen")


def take_turns(queues: Column, places: int) -> Column:
    """Entries of an array of queues in the order they are taken: turn by turn the first of the next queue that is not taken yet."""

    def turn(taken: Column, k: Column) -> Column:
        queue = F.get(queues, k % F.size(queues))
        entry = F.get(F.filter(queue, lambda x: ~F.array_contains(taken, x)), 0)
        return F.when((F.size(taken) < places) & entry.isNotNull(), F.concat(taken, F.array(entry))).otherwise(taken)

    # a round in which nobody has an entry is the last, so `places` rounds are enough
    return F.aggregate(F.sequence(F.lit(0), F.size(queues) * places - 1), F.array().cast("array<bigint>"), turn)


def candidates(links: DataFrame, members: DataFrame, background: DataFrame, origins: DataFrame, allowed: Callable[[str], Column], places: int = 5) -> DataFrame:
    """(capture, incident, addr, place, n_windows, background_share, sent, received, opened, was_opened, targets, ports).

    Three queues take turns: the origins the rule named, the most prominent, the largest net senders.
    """
    flow = flows(pairs(links, members))
    source = prominence(links, "src", members, background).join(flow, [*INC, "addr"]).filter(F.col("n_windows") >= CANDIDATE_WINDOWS)
    named = listed(origins).select(*INC, "addr", F.col("place").alias("rule"))
    rows = source.join(named, [*INC, "addr"], "left").withColumn("ok", allowed("addr"))
    w = Window.partitionBy(*INC)
    rank = lambda cond, *order: F.when(cond, F.row_number().over(w.orderBy(F.when(cond, 0).otherwise(1), *order)))
    prominent = F.col("ok") & (F.col("prominence") >= CANDIDATE_FROM) & (F.col("sent") > 0)
    senders = F.col("ok") & (F.col("sent") > F.col("received"))
    rows = rows.withColumns({"q2": rank(prominent, F.col("prominence").desc(), F.col("sent").desc(), "addr"), "q3": rank(senders, F.col("received") - F.col("sent"), "addr")})
    # at most `places` entries of a queue are skipped and as many taken
    queue = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= 3 * places, F.struct(c, "addr")))), lambda x: x["addr"].cast("long"))
    taken = rows.groupBy(*INC).agg(F.array(queue("rule"), queue("q2"), queue("q3")).alias("queues")).select(*INC, F.explode(take_turns(F.col("queues"), places)).alias("addr"))
    order = Window.partitionBy(*INC).orderBy(F.col("prominence").desc(), F.col("sent").desc(), "addr")
    chosen = rows.join(taken, [*INC, "addr"], "left_semi").select(*INC, "addr", F.row_number().over(order).alias("place"))
    facts = chosen.join(source.select(*INC, "addr", "n_windows", F.round("background_share", 4).alias("background_share"), "sent", "received", "opened", "was_opened"), [*INC, "addr"])
    own = of_members(links, members).withColumnRenamed("src", "addr")

    def top(key: list[str], k: int, name: str) -> DataFrame:
        n = own.filter(F.col(key[0]).isNotNull()).groupBy(*INC, "addr", *key).agg(F.sum("frames").alias("frames"), F.min(F.struct("win", "first_no")).alias("seen")).join(chosen, [*INC, "addr"], "left_semi")
        r = F.row_number().over(Window.partitionBy(*INC, "addr").orderBy(F.col("frames").desc(), "seen", *key))
        first = n.withColumn("r", r).filter(F.col("r") <= k)
        return first.groupBy(*INC, "addr").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", *key, "frames"))), lambda x: F.struct(*(x[c].alias(c) for c in (*key, "frames")))).alias(name))

    return facts.join(top(["dst"], 3, "targets"), [*INC, "addr"], "left").join(top(["dport", "protocol"], 3, "ports"), [*INC, "addr"], "left")


def records(windows: DataFrame, members: DataFrame, origins: DataFrame, destinations: DataFrame, merged: str = "DDoS") -> DataFrame:
    """One row per incident: categories (a flood is DDoS if distributed, else DoS), confidence, span, counts, listed addresses, windows per category.

    windows has (capture, win, start_ts, end_ts, category, confidence).
    """
    rows = members.join(windows, ["capture", "win"])
    per = rows.groupBy(*INC, "category").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.min("win").alias("first"))
    main = first_by(per, INC, [F.col("n").desc(), "first"]).select(*INC, F.col("category").alias("model_category"), F.round("confidence", 2).alias("confidence"))
    counts = per.groupBy(*INC).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("windows_per_category"))
    span = rows.groupBy(*INC).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_windows"), F.sum("benign_before").alias("n_benign"))
    o = origins.groupBy(*INC).agg(F.first("n_origins").alias("n_origins"), F.first("distributed").alias("distributed"))
    tops = lambda df, name: listed(df).groupBy(*INC).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "addr", "frames"))), lambda x: F.struct(x["addr"].alias("addr"), x["frames"].alias("frames"))).alias(name))
    out = span.join(main, INC).join(counts, INC).join(o, INC, "left").join(tops(origins, "origins"), INC, "left").join(tops(destinations, "destinations"), INC, "left")
    return out.withColumn("category", F.when(F.col("model_category") == merged, F.when(F.col("distributed"), "DDoS").otherwise("DoS")).otherwise(F.col("model_category")))


def contract_defects(incident: DataFrame, port: DataFrame) -> DataFrame:
    """(capture, incident, defects): ports of unlisted destinations, a category that does not fit the model's."""
    used = port.groupBy(*INC).agg(F.collect_set("dst").alias("port_dsts"))
    rows = incident.join(used, INC, "left")
    named = F.transform(F.coalesce("destinations", F.array().cast("array<struct<addr:bigint,frames:bigint>>")), lambda x: x["addr"].cast("long"))
    extra = F.size(F.array_except(F.coalesce(F.transform("port_dsts", lambda x: x.cast("long")), F.array().cast("array<bigint>")), named)) > 0
    floods = ("DDoS", "DoS")
    fits = F.when(F.col("model_category").isin(*floods), F.col("category").isin(*floods)).otherwise(F.col("category") == F.col("model_category"))
    return rows.select(*INC, F.array_compact(F.array(F.when(extra, F.lit("port of an unlisted destination")), F.when(~fits, F.lit("category does not fit")))).alias("defects"))


def truth_flags(windows: DataFrame, members: DataFrame, origins: DataFrame, destinations: DataFrame, is_attacker: Column, silence: float) -> DataFrame:
    """(capture, incident, is_true, first_origin_is_attacker, first_target_is_attacker, delay_s).

    windows has (capture, win, start_ts, end_ts, has_attacker). The onset is the start of the stretch of attacker windows, with
    gaps up to `silence`, that holds or is the last before the incident's first window.
    """
    truth = windows.filter("has_attacker")
    w = Window.partitionBy("capture").orderBy("win")
    gap = F.coalesce(F.col("start_ts") - F.lag("end_ts").over(w) > silence, F.lit(True))
    islands = truth.withColumn("island", F.sum(gap.cast("int")).over(w)).groupBy("capture", "island").agg(F.min("start_ts").alias("from_ts"), F.max("end_ts").alias("to_ts"))
    rows = members.join(windows, ["capture", "win"])
    inc = rows.groupBy(*INC).agg(F.min("start_ts").alias("start_ts"), F.bool_or("has_attacker").alias("is_true"), F.min_by("end_ts", F.struct("at_win", "win")).alias("first_end"))
    near = inc.join(islands, "capture").filter(F.col("from_ts") <= F.col("first_end")).filter(F.col("start_ts") - F.col("to_ts") <= silence)
    onset = near.groupBy(*INC).agg(F.max("from_ts").alias("onset"))
    first = lambda df, name: listed(df, 1).select(*INC, is_attacker.alias(name))
    out = inc.join(onset, INC, "left").join(first(origins, "first_origin_is_attacker"), INC, "left").join(first(destinations, "first_target_is_attacker"), INC, "left")
    return out.select(*INC, "is_true", "first_origin_is_attacker", "first_target_is_attacker", (F.col("start_ts") - F.col("onset")).alias("delay_s"))


def replay_summary(windows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of each capture: windows, judged, unjudged, attack windows, incidents, reopenings, over cap, seconds to the first opening."""
    w = windows.groupBy("capture").agg(F.count("*").alias("n_windows"), F.min("start_ts").alias("begin"), F.max("end_ts").alias("end"), F.count_if(F.col("category") != "Benign").alias("n_attack"))
    k = lambda x: F.col("kind") == x
    d = decisions.groupBy("capture").agg(F.count_if(k("unjudged")).alias("n_unjudged"), F.count_if(k("open")).alias("n_incidents"), F.count_if(k("reopen")).alias("n_reopened"), F.count_if(k("over cap")).alias("n_over_cap"), F.min(F.when(k("open"), F.col("at_win"))).alias("first_open"))
    at = windows.select("capture", F.col("win").alias("first_open"), F.col("end_ts").alias("open_ts"))
    out = w.join(d, "capture", "left").join(at, ["capture", "first_open"], "left")
    return out.select("capture", "n_windows", "n_attack", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_unjudged", "n_incidents", "n_reopened", "n_over_cap")), ((F.col("end") - F.col("begin")) / 3600).alias("hours"), (F.col("open_ts") - F.col("begin")).alias("first_alarm_s"))


def rule_summary(summaries: DataFrame, benign: Column) -> DataFrame:
    """(rule, group, captures, hours, incidents, with_alarm, median_delay_s, false_per_hour) over replay summaries by rule."""
    group = F.when(benign, "benign").otherwise("attack")
    n = F.col("n_incidents") + F.col("n_over_cap")
    out = summaries.groupBy("rule", group.alias("group")).agg(F.count("*").alias("captures"), F.sum("hours").alias("hours"), F.sum(n).alias("incidents"), F.count_if(n > 0).alias("with_alarm"), F.median("first_alarm_s").alias("median_delay_s"))
    return out.withColumn("false_per_hour", F.when(F.col("group") == "benign", F.try_divide(F.col("incidents").cast("double"), F.col("hours"))))


def kept_windows(windows: DataFrame, members: DataFrame, most: int = 1000) -> DataFrame:
    """At most `most` of an incident's windows, evenly spaced by a step."""
    w = Window.partitionBy(*INC)
    rows = members.join(windows, ["capture", "win"]).withColumns({"_p": F.row_number().over(w.orderBy("win")) - 1, "_n": F.count("*").over(w)})
    return rows.filter(F.col("_p") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_p", "_n")


def log_drafts(windows: DataFrame, decisions: DataFrame, members: DataFrame, shift: Column | float = 0.0) -> DataFrame:
    """(capture, ts, order, type, incident, counts): batch counts before each opening, the opening, its last update, and the remainder.

    counts is a map of windows per category; batches are differences of running counts, so every window is in one of them.
    """
    opens = decisions.filter("kind = 'open'").select("capture", "incident", F.col("at_win"))
    edge = opens.select("capture", F.col("at_win").alias("win"), F.lit(1).alias("_edge"))
    marked = windows.join(edge.distinct(), ["capture", "win"], "left")
    batch = F.coalesce(F.sum("_edge").over(Window.partitionBy("capture").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = marked.withColumn("batch", batch).groupBy("capture", "batch", "category").agg(F.count("*").alias("n"), F.max("end_ts").alias("ts"))
    batches = per.groupBy("capture", "batch").agg(F.max("ts").alias("ts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("counts"))
    none = F.lit(None).cast("map<string,bigint>")
    at = windows.select("capture", F.col("win").alias("at_win"), F.col("end_ts").alias("ts"))
    opened = opens.join(at, ["capture", "at_win"]).select("capture", "ts", F.lit(1).alias("order"), F.lit("incident_opened").alias("type"), "incident", none.alias("counts"))
    last = members.join(windows, ["capture", "win"]).groupBy(*INC).agg(F.max("end_ts").alias("ts")).select("capture", "ts", F.lit(2).alias("order"), F.lit("incident_updated").alias("type"), "incident", none.alias("counts"))
    counted = batches.select("capture", "ts", F.lit(0).alias("order"), F.lit("windows_classified").alias("type"), F.lit(None).cast("long").alias("incident"), "counts")
    return counted.unionByName(opened).unionByName(last).withColumn("ts", F.col("ts") + shift)


def map_difference(now: Column, before: Column) -> Column:
    """Positive differences of two count maps."""
    d = F.map_zip_with(now, before, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return F.map_filter(d, lambda k, v: v > 0)
