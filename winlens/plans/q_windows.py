"""Queries over captured frames and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from winlens.operators import frames as fr
from winlens.operators import windows as wi
from winlens.plans import adapters as ad
from winlens.plans.adapters import FRAMES_CTE, MEASURES, windows_cte

QUERIES: dict = {}
ORACLES: dict = {}
SIZE = 10
FEATURES = (*MEASURES, "Rate", "ack_count", "syn_count", "fin_count", "rst_count", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number", "Variance", "Protocol Type")
_FEATURES = ", ".join(f'"{c}"' for c in FEATURES)
WITH = f"WITH {FRAMES_CTE}"
WIN = f"WITH {FRAMES_CTE}{windows_cte(SIZE)}"
#: Window decisions without a model: mostly SYN is an attack, many ICMP a scan.
DECISION = "CASE WHEN syn_flag_number > 0.35 THEN 'DDoS' WHEN ICMP > 0.5 THEN 'Recon' ELSE 'Benign' END"
DECIDED = f"{WIN}, decided AS (SELECT *, CASE WHEN \"syn_flag_number\" > 0.2 THEN 'DDoS' WHEN \"ICMP\" > 0.4 THEN 'Recon' ELSE 'Benign' END AS predicted FROM win_)"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def decided(spark, d):
    return ad.windows(spark, d, SIZE).withColumn("predicted", F.expr("CASE WHEN syn_flag_number > 0.2 THEN 'DDoS' WHEN ICMP > 0.4 THEN 'Recon' ELSE 'Benign' END"))


@query("a1_window_features", f"{WIN} SELECT capture, win, start_ts, end_ts, {_FEATURES} FROM win_")
def a1(spark, d):
    return ad.windows(spark, d, SIZE).select("capture", "win", "start_ts", "end_ts", *FEATURES)


_SIZE_FREE = [c for c in FEATURES if c not in wi.SIZE_DEPENDENT]


@query("p11_size_free_features", f"""{WIN} SELECT capture, win, {", ".join(f'"{c}"' for c in _SIZE_FREE)} FROM win_""")
def p11(spark, d):
    return wi.size_free(ad.windows(spark, d, SIZE).select("capture", "win", *FEATURES))


@query("a10_label_summary", f"""{WIN} SELECT category, count(*) AS n_windows, count(DISTINCT capture) AS n_captures, CAST(sum("Number") AS BIGINT) AS n_frames,
  round(avg("AVG"), 4) AS mean_size, round(max("Std"), 4) AS max_std, min("Min") AS min_size, max("Max") AS max_size, round(avg("IAT"), 4) AS mean_iat,
  CAST(sum(syn_count) AS BIGINT) AS syn, CAST(sum(ack_count) AS BIGINT) AS ack FROM win_ GROUP BY category""")
def flagship(spark, d):
    return ad.windows(spark, d, SIZE).groupBy("category").agg(
        F.count("*").alias("n_windows"), F.count_distinct("capture").alias("n_captures"), F.sum("Number").alias("n_frames"), F.round(F.avg("AVG"), 4).alias("mean_size"),
        F.round(F.max("Std"), 4).alias("max_std"), F.min("Min").alias("min_size"), F.max("Max").alias("max_size"), F.round(F.avg("IAT"), 4).alias("mean_iat"),
        F.sum("syn_count").alias("syn"), F.sum("ack_count").alias("ack"))


@query("a10_protocol_histogram", f"""{WIN} SELECT category, "Protocol Type" AS protocol, count(*) AS n FROM win_ GROUP BY ALL""")
def a10(spark, d):
    return ad.windows(spark, d, SIZE).groupBy("category", F.col("Protocol Type").alias("protocol")).agg(F.count("*").alias("n"))


@query("f1_dropped_by_type", f"""{WITH} SELECT CAST(ethertype AS BIGINT) AS ethertype, CASE ethertype WHEN 34525 THEN 'IPv6' ELSE '?' END AS type_name, count(*) AS n_frames FROM frames WHERE ethertype NOT IN (2048, 2054) GROUP BY ALL""")
def f1(spark, d):
    return fr.dropped_by_type(ad.frames(spark, d)).withColumn("ethertype", F.col("ethertype").cast("long"))


@query("p4_ethertype_names", """SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_partkey % 7 = 0 THEN 'IPv4' WHEN l_partkey % 7 = 1 THEN 'ARP' WHEN l_partkey % 7 = 2 THEN 'IPv6' WHEN l_partkey % 7 = 3 THEN 'VLAN 802.1Q'
  WHEN l_partkey % 7 = 4 THEN 'IEEE 802.3 LLC' WHEN l_partkey % 7 = 5 THEN 'short frame' ELSE '0x88cc' END AS name FROM lineitem""")
def p4(spark, d):
    code = F.element_at(F.array(*map(F.lit, (0x0800, 0x0806, 0x86DD, 0x8100, 0x0026, -1, 0x88CC))), (F.col("l_partkey") % 7 + 1).cast("int"))
    return ad.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), fr.ethertype_name(code).alias("name"))


@query("p1_header_decode", """SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_partkey AS p, l_quantity AS q, CAST(CASE WHEN l_returnflag = 'R' THEN 6 ELSE 17 END AS BIGINT) AS protocol, 32 + l_orderkey % 200 AS ttl,
  3232235520 + l_partkey % 256 AS src, 167772160 + l_orderkey % 256 AS dst, 1024 + l_orderkey % 500 AS sport, CAST(20 + l_linenumber AS BIGINT) AS dport,
  CASE WHEN l_returnflag = 'R' THEN l_partkey % 256 ELSE 0 END AS flags, CAST(CASE WHEN l_returnflag = 'R' THEN 20 ELSE 8 END AS BIGINT) AS header_len, '02:00:00:00:00:0' || l_linenumber AS src_mac FROM lineitem""")
def p1(spark, d):
    li = ad.table(spark, d, "lineitem")
    h = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    tcp = F.col("l_returnflag") == "R"
    ports = F.concat(h(1024 + F.col("l_orderkey") % 500, 2), h((20 + F.col("l_linenumber")).cast("long"), 2))
    l4 = F.when(tcp, F.concat(ports, F.lit("00000001000000025000").substr(1, 16), F.lit("50"), h(F.col("l_partkey") % 256, 1), F.lit("0000000000000000").substr(1, 12))).otherwise(F.concat(ports, F.lit("00080000")))
    ip = F.concat(F.lit("4500001c000100"), F.lit("00"), h(32 + F.col("l_orderkey") % 200, 1), F.when(tcp, "06").otherwise("11"), F.lit("0000"), F.lit("C0A800"), h(F.col("l_partkey") % 256, 1), F.lit("0A0000"), h(F.col("l_orderkey") % 256, 1))
    frame = F.unhex(F.concat(F.lit("010000000001"), F.lit("02000000000"), F.col("l_linenumber").cast("string"), F.lit("0800"), ip, l4))
    rows = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), frame.alias("frame"))
    return fr.decode_frames(rows).filter("decoded").select("o", "l", "p", "q", "protocol", "ttl", "src", "dst", "sport", "dport", "flags", "header_len", "src_mac")


@query("p2_port_indicators", f"""{WITH} SELECT capture, {", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in ("HTTP", "HTTPS", "Telnet", "SMTP", "SSH", "IRC", "DNS", "DHCP"))} FROM kept GROUP BY capture""")
def p2(spark, d):
    port = fr.port_indicators("protocol", "sport", "dport")
    return fr.keep_decoded(ad.frames(spark, d)).groupBy("capture").agg(*(F.sum(c).alias(n) for n, c in port.items()))


@query("p3_wire_size", """SELECT l_suppkey AS capture, CAST(sum(least(greatest(CAST(l_quantity AS BIGINT) * 40, CASE WHEN l_linenumber = 7 THEN 0 ELSE 60 END), 1514)) AS BIGINT) AS on_wire, CAST(sum(CAST(l_quantity AS BIGINT) * 40) AS BIGINT) AS recorded FROM lineitem GROUP BY 1""")
def p3(spark, d):
    return ad.frames(spark, d).groupBy("capture").agg(F.sum(fr.wire_size("length", "cut")).alias("on_wire"), F.sum(fr.wire_size("length", "cut", False, False)).alias("recorded"))


@query("s3_short_records", """SELECT l_suppkey AS capture, count(*) AS n_frames, count(*) FILTER (l_quantity < l_discount * 300) AS n_short FROM lineitem GROUP BY 1""")
def s3(spark, d):
    return ad.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("capture")).agg(F.count("*").alias("n_frames"), F.count_if(F.col("l_quantity") < F.col("l_discount") * 300).alias("n_short"))


@query("w1_frame_numbers", f"{WITH} SELECT capture, frame_no, ts, o1, o2, o3, frame_no // 10 AS win_10, frame_no // 100 AS win_100 FROM kept")
def w1(spark, d):
    # two levels: a capture of any length is numbered by many tasks
    numbered = fr.number_frames(fr.keep_decoded(ad.frames(spark, d)), "capture", ad.FRAME_ORDER, chunk=F.floor(F.col("ts") / (90 * 86400)))
    return numbered.select("capture", "frame_no", "ts", "o1", "o2", "o3", wi.window_no(10).alias("win_10"), wi.window_no(100).alias("win_100"))


@query("w3_pieces", f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)}, n AS (SELECT capture, length, row_number() OVER (PARTITION BY capture ORDER BY {", ".join(ad.FRAME_ORDER)}) - 1 AS i FROM frames),
walk AS (SELECT capture, i, 0 AS piece, 0 AS piece_no, 24 + 16 + length AS written FROM n WHERE i = 0 UNION ALL
  SELECT n.capture, n.i, CASE WHEN written > 100000 THEN piece + 1 ELSE piece END, CASE WHEN written > 100000 THEN 0 ELSE piece_no + 1 END, CASE WHEN written > 100000 THEN 24 ELSE written END + 16 + length FROM walk JOIN n ON n.capture = walk.capture AND n.i = walk.i + 1)
SELECT capture, piece, count(*) AS n_frames, CAST(max(piece_no) AS BIGINT) AS last_no, min(i) AS first_frame FROM walk GROUP BY ALL""")
def w3(spark, d):
    p = wi.pieces(fr.number_frames(ad.frames(spark, d), "capture", ad.FRAME_ORDER), 100_000)
    return p.groupBy("capture", "piece").agg(F.count("*").alias("n_frames"), F.max("piece_no").alias("last_no"), F.min("frame_no").alias("first_frame"))


@query("w2_inter_arrival", f"{WITH} SELECT capture, count(*) AS n, sum(iat) AS total, max(iat) AS longest, count(*) FILTER (iat = 0) AS zero FROM kept GROUP BY capture")
def w2(spark, d):
    # in two levels as well; the captures of other queries are short enough for a task each (README)
    numbered = fr.number_frames(fr.keep_decoded(ad.frames(spark, d)), "capture", ad.FRAME_ORDER, F.floor(F.col("ts") / (90 * 86400)), "ts")
    return numbered.groupBy("capture").agg(F.count("*").alias("n"), F.sum("iat").alias("total"), F.max("iat").alias("longest"), F.count_if(F.col("iat") == 0).alias("zero"))


@query("a2_address_sets", f"""{WITH} SELECT capture, frame_no // 10 AS win, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, list_sort(list(DISTINCT src)) AS src_set, list_sort(list(DISTINCT dst)) AS dst_set FROM kept GROUP BY ALL""")
def a2(spark, d):
    return wi.address_sets(ad.kept(spark, d), SIZE, ["src", "dst"])


@query("a3_window_counters", f"""{WITH}, k AS (SELECT *, frame_no // 10 AS win FROM kept)
SELECT capture, win, 'src' AS counter, CAST(src AS VARCHAR) AS key, count(*) AS n FROM k GROUP BY ALL UNION ALL
SELECT capture, win, 'dst', CAST(dst AS VARCHAR), count(*) FROM k GROUP BY ALL UNION ALL
SELECT capture, win, 'pair', src || '>' || dst, count(*) FROM k GROUP BY ALL UNION ALL
SELECT capture, win, 'opening', src || '>' || dst, count(*) FROM k WHERE syn_flag_number = 1 AND ack_flag_number = 0 GROUP BY ALL UNION ALL
SELECT capture, win, 'dst_port', dst || ':' || protocol || ':' || dport, count(*) FROM k WHERE protocol IN (6, 17) GROUP BY ALL UNION ALL
SELECT capture, win, 'src_port', src || ':' || protocol || ':' || dport, count(*) FROM k WHERE protocol IN (6, 17) GROUP BY ALL""")
def a3(spark, d):
    opening = (F.col("syn_flag_number") == 1) & (F.col("ack_flag_number") == 0)
    port = F.col("protocol").isin(6, 17)
    text = lambda sep, *c: F.concat_ws(sep, *(F.col(x).cast("string") for x in c))
    keys = {"src": F.col("src"), "dst": F.col("dst"), "pair": text(">", "src", "dst"), "opening": F.when(opening, text(">", "src", "dst")),
            "dst_port": F.when(port, text(":", "dst", "protocol", "dport")), "src_port": F.when(port, text(":", "src", "protocol", "dport"))}
    return wi.counters(ad.kept(spark, d), SIZE, keys)


@query("a4_frames_per_address", f"""{WITH}, roles AS (SELECT capture, src AS addr, 1 AS s, 0 AS t FROM kept UNION ALL SELECT capture, dst, 0, 1 FROM kept),
  n AS (SELECT capture, addr, CAST(sum(s) AS BIGINT) AS as_src, CAST(sum(t) AS BIGINT) AS as_dst FROM roles GROUP BY ALL),
  total AS (SELECT capture, count(*) AS frames FROM kept GROUP BY 1),
  ranked AS (SELECT *, addr % 97 = 0 AS listed, row_number() OVER (PARTITION BY capture, addr % 97 = 0 ORDER BY as_src + as_dst DESC, addr) AS r FROM n)
SELECT capture, addr, as_src, as_dst, listed, round((as_src + as_dst) / frames, 6) AS share, (as_src + as_dst) / frames >= 0.01 AS cited FROM ranked JOIN total USING (capture) WHERE listed OR r <= 10""")
def a4(spark, d):
    return wi_top_addresses(ad.kept(spark, d).select("capture", "src", "dst"), 10)


def wi_top_addresses(frames, k):
    from winlens.operators.ranking import top_addresses

    return top_addresses(frames, F.col("addr") % 97 == 0, k)


@query("a5_windows_per_size", f"""{WITH}, s AS (SELECT unnest([10, 100]) AS size_), w AS (SELECT capture, size_, frame_no // size_ AS win, count(*) AS n, bool_or(attacker) AS has FROM kept, s GROUP BY ALL)
SELECT capture, CAST(size_ AS BIGINT) AS size, count(*) FILTER (n = size_) AS extracted, count(*) FILTER (n = size_ AND has) AS with_attacker, count(*) FILTER (n = size_ AND NOT has) AS without, count(*) FILTER (n < size_) AS incomplete FROM w GROUP BY ALL""")
def a5(spark, d):
    both = ad.kept(spark, d).select("capture", "frame_no", "attacker", F.explode(F.array(F.lit(10), F.lit(100))).alias("size"))
    w = both.groupBy("capture", "size", wi.window_no(F.col("size")).alias("win")).agg(F.count("*").alias("n"), F.bool_or("attacker").alias("has"))
    full = F.col("n") == F.col("size")
    return w.groupBy("capture", F.col("size").cast("long").alias("size")).agg(F.count_if(full).alias("extracted"), F.count_if(full & F.col("has")).alias("with_attacker"), F.count_if(full & ~F.col("has")).alias("without"), F.count_if(~full).alias("incomplete"))


@query("f2_f3_window_side", f"""{WIN} SELECT capture, win, category, has_attacker, CASE WHEN category = 'Benign' OR has_attacker THEN 'kept' ELSE 'background' END AS side FROM win_""")
def f3(spark, d):
    from winlens.operators.labels import window_side

    return ad.windows(spark, d, SIZE).select("capture", "win", "category", "has_attacker", window_side(F.col("category") == "Benign", F.col("has_attacker")).alias("side"))


@query("f6_from_window", f"""{WIN}, t AS (SELECT capture, count(*) AS n FROM win_ GROUP BY 1) SELECT capture, count(*) FILTER (win < floor(0.7 * n + 0.5)) AS skipped, count(*) FILTER (win >= floor(0.7 * n + 0.5)) AS judged FROM win_ JOIN t USING (capture) GROUP BY 1""")
def f6(spark, d):
    from winlens.operators.splits import time_cut

    cut = time_cut(ad.windows(spark, d, SIZE), 0.3)
    return cut.groupBy("capture").agg(F.count_if(F.col("win") < F.col("cut")).alias("skipped"), F.count_if(F.col("win") >= F.col("cut")).alias("judged"))


@query("f7_slow_windows", f"""{WIN} SELECT capture, count(*) FILTER (end_ts - start_ts > 50 * 86400) AS unjudged, count(*) FILTER (end_ts - start_ts <= 50 * 86400) AS judged FROM win_ GROUP BY 1""")
def f7(spark, d):
    w = wi.judge_status(ad.windows(spark, d, SIZE), 50 * 86400)
    return w.groupBy("capture").agg(F.count_if(F.col("status") == "unjudged").alias("unjudged"), F.count_if(F.col("status") == "judged").alias("judged"))


@query("f8_complete_windows", f"""{WITH}, w AS (SELECT capture, frame_no // 100 AS win, count(*) AS n FROM kept GROUP BY ALL) SELECT capture, count(*) AS n_windows FROM w WHERE n = 100 GROUP BY 1""")
def f8(spark, d):
    w = ad.kept(spark, d).groupBy("capture", wi.window_no(100).alias("win")).agg(F.count("*").alias("Number"))
    return wi.complete(w, 100).groupBy("capture").agg(F.count("*").alias("n_windows"))


@query("f11_physical_checks", f"""{WIN} SELECT category, count(*) FILTER ("Min" > "AVG" + 1e-9 OR "AVG" > "Max" + 1e-9) AS broken, count(*) FILTER ("Min" = "Max") AS flat, count(*) AS n FROM win_ GROUP BY 1""")
def f11(spark, d):
    low, mid, high = F.col("Min"), F.col("AVG"), F.col("Max")
    return ad.windows(spark, d, SIZE).groupBy("category").agg(F.count_if((low > mid + 1e-9) | (mid > high + 1e-9)).alias("broken"), F.count_if(low == high).alias("flat"), F.count("*").alias("n"))


@query("p15_window_duration", f"""{WIN} SELECT capture, win, round(CASE WHEN isinf("Rate") THEN 0 ELSE "Number" / "Rate" END, 6) AS duration FROM win_""")
def p15(spark, d):
    return ad.windows(spark, d, SIZE).select("capture", "win", F.round(wi.duration(), 6).alias("duration"))


@query("p20_ip_text", """SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_partkey AS p, (l_partkey % 256) || '.' || (l_orderkey % 256) || '.' || l_linenumber || '.' || (l_orderkey % 3) AS ip, l_partkey % 256 < 224 AND l_orderkey % 3 <> 0 AS unicast FROM lineitem""")
def p20(spark, d):
    v = F.shiftleft(F.col("l_partkey") % 256, 24) + F.shiftleft(F.col("l_orderkey") % 256, 16) + F.shiftleft(F.col("l_linenumber").cast("long"), 8) + F.col("l_orderkey") % 3
    return ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"), F.col("l_partkey").alias("p"), fr.ip_text(v).alias("ip"), fr.is_unicast(v).alias("unicast"))


@query("w4_alarms", f"""{DECIDED}, runs AS (SELECT *, sum(CASE WHEN predicted = 'Benign' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY win) AS run FROM decided),
 placed AS (SELECT *, row_number() OVER (PARTITION BY capture, run, predicted = 'Benign' ORDER BY win) AS p FROM runs) SELECT capture, win, predicted FROM placed WHERE predicted <> 'Benign' AND p = 4""")
def w4(spark, d):
    return wi.alarms(decided(spark, d).withColumn("is_attack", F.col("predicted") != "Benign"), 4).filter("alarm").select("capture", "win", "predicted")


@query("w5_first_alarm", f"""{DECIDED}, runs AS (SELECT *, sum(CASE WHEN predicted = 'Benign' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY win) AS run FROM decided),
 placed AS (SELECT *, row_number() OVER (PARTITION BY capture, run, predicted = 'Benign' ORDER BY win) AS p, row_number() OVER w AS place, sum(end_ts - start_ts) OVER w AS elapsed FROM runs WINDOW w AS (PARTITION BY capture ORDER BY win)),
 hit AS (SELECT *, predicted <> 'Benign' AND p = 4 AS alarm FROM placed)
SELECT capture, count(*) AS n_windows, count(*) FILTER (alarm) AS n_alarms, CAST(min(place) FILTER (alarm) AS BIGINT) AS first_place, min(elapsed) FILTER (alarm) AS first_seconds FROM hit GROUP BY 1""")
def w5(spark, d):
    out = wi.first_alarm(wi.alarms(decided(spark, d).withColumn("is_attack", F.col("predicted") != "Benign"), 4))
    return out.withColumn("first_place", F.col("first_place").cast("long"))


@query("w6_interleave", f"""{WIN} SELECT capture, win, CASE WHEN category = 'Benign' OR has_attacker THEN 'kept' ELSE 'background' END AS side, "AVG" AS mean_size FROM win_""")
def w6(spark, d):
    w = ad.windows(spark, d, SIZE).select("capture", "win", F.col("AVG").alias("mean_size"), "category", "has_attacker")
    keep = (F.col("category") == "Benign") | F.col("has_attacker")
    cols = ["capture", "win", "mean_size"]
    return wi.interleave(w.filter(keep).select(cols), w.filter(~keep).select(cols)).select("capture", "win", "side", "mean_size")


@query("w7_autocorrelation", f"""{DECIDED}, x AS (SELECT capture, win, CASE WHEN predicted = 'Benign' THEN 0.0 ELSE 1.0 END AS v FROM decided), c AS (SELECT *, count(*) OVER (PARTITION BY capture) AS n, v - avg(v) OVER (PARTITION BY capture) AS c FROM x),
 p AS (SELECT *, lead(c) OVER (PARTITION BY capture ORDER BY win) AS e FROM c), r AS (SELECT count(*) AS n, sum(c * e) FILTER (n > 2) / sqrt(sum(c * c) FILTER (n > 2 AND e IS NOT NULL) * sum(e * e) FILTER (n > 2)) AS rho FROM p)
SELECT n, round(rho, 6) AS rho, round(n * (1 - rho) / (1 + rho), 3) AS n_effective FROM r""")
def w7(spark, d):
    return wi.lag1(decided(spark, d).withColumn("hit", F.col("predicted") != "Benign"), "hit").select("n", F.round("rho", 6).alias("rho"), F.round("n_effective", 3).alias("n_effective"))


@query("w8_sessions", f"""{WIN}, g AS (SELECT *, CASE WHEN start_ts - lag(end_ts) OVER (PARTITION BY capture ORDER BY win) > 8 * 86400 THEN 1 ELSE 0 END AS new_ FROM win_)
SELECT capture, win, CAST(sum(new_) OVER (PARTITION BY capture ORDER BY win) AS BIGINT) AS session FROM g""")
def w8(spark, d):
    return wi.sessions(ad.windows(spark, d, SIZE), 8 * 86400).select("capture", "win", "session")


@query("w15_evenly_spaced", f"""{WIN}, n AS (SELECT capture, win, row_number() OVER (PARTITION BY capture ORDER BY win) - 1 AS pos, count(*) OVER (PARTITION BY capture) AS n FROM win_)
SELECT capture, win FROM n WHERE n <= 7 OR pos IN (SELECT (i * (n - 1)) // 6 FROM range(7) t(i))""")
def w15(spark, d):
    return wi.evenly_spaced(ad.windows(spark, d, SIZE).select("capture", "win"), 7, ["win"], ["capture"])


@query("o1_o2_union_sides", f"""{WIN} SELECT CASE WHEN category = 'Benign' OR has_attacker THEN category ELSE 'Benign' END AS train_class, count(*) AS n FROM win_ GROUP BY 1""")
def o1(spark, d):
    w = ad.windows(spark, d, SIZE).select("capture", "win", "category", "has_attacker")
    keep = (F.col("category") == "Benign") | F.col("has_attacker")
    both = wi.interleave(w.filter(keep), w.filter(~keep)).withColumn("train_class", F.when(F.col("side") == "background", "Benign").otherwise(F.col("category")))
    return both.groupBy("train_class").agg(F.count("*").alias("n"))


@query("a9_relations", f"""{WIN}, r AS (
  SELECT 'Variance' AS col, "Variance" AS a, "Std" * "Std" AS b FROM win_ UNION ALL SELECT 'Tot size', "Tot size", "AVG" FROM win_ UNION ALL SELECT 'LLC', "LLC", "IPv" FROM win_ UNION ALL SELECT 'ARP', "ARP", 1 - "IPv" FROM win_
  UNION ALL SELECT 'Tot sum', "Tot sum", "AVG" * "Number" FROM win_ UNION ALL SELECT 'ack_count', ack_count, ack_flag_number * "Number" FROM win_ UNION ALL SELECT 'syn_count', syn_count, syn_flag_number * "Number" FROM win_
  UNION ALL SELECT 'fin_count', fin_count, fin_flag_number * "Number" FROM win_ UNION ALL SELECT 'rst_count', rst_count, rst_flag_number * "Number" FROM win_)
SELECT col, count(*) AS n, count(*) FILTER (abs(a - b) > greatest(1e-6 * greatest(abs(a), abs(b)), 1e-6)) AS violations FROM r GROUP BY 1""")
def a9(spark, d):
    from winlens.operators.profile import RELATIONS, relation_report

    return relation_report(ad.windows(spark, d, SIZE), RELATIONS, rel=1e-6, abs_=1e-6).select("col", "n", "violations")


@query("a19_source_summary", f"""{WIN} SELECT category, min(n_src) AS least, quantile_cont(n_src, 0.25) AS p25, quantile_cont(n_src, 0.5) AS median, quantile_cont(n_src, 0.75) AS p75, max(n_src) AS most, round(avg(n_src), 6) AS mean, round(count(*) FILTER (n_src <= 1) / count(*), 6) AS share_one FROM win_ GROUP BY 1""")
def a19(spark, d):
    q = lambda p: F.percentile("n_src", p)
    return ad.windows(spark, d, SIZE).groupBy("category").agg(F.min("n_src").alias("least"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("n_src").alias("most"), F.round(F.avg("n_src"), 6).alias("mean"), F.round(F.count_if(F.col("n_src") <= 1) / F.count("*"), 6).alias("share_one"))


_MED = ("AVG", "Std", "IAT", "Time_To_Live", "syn_flag_number", "Tot sum")


@query("a20_benign_reference", f"""{WIN} SELECT {", ".join(f'round(quantile_cont("{c}", 0.5), 6) AS "{c}"' for c in _MED)} FROM win_ WHERE category = 'Benign'""")
def a20(spark, d):
    from winlens.operators.profile import medians

    return medians(ad.windows(spark, d, SIZE).filter("category = 'Benign'"), list(_MED))


@query("a27_range_buckets", f"""{DECIDED} SELECT CASE WHEN "Time_To_Live" < 100 THEN '0-100' WHEN "Time_To_Live" < 130 THEN '100-130' WHEN "Time_To_Live" < 160 THEN '130-160' ELSE '160-' END AS bucket, count(*) AS n, count(*) FILTER (predicted <> 'Benign') AS n_attack FROM decided GROUP BY 1""")
def a27(spark, d):
    from winlens.operators.profile import rate_by_range

    return rate_by_range(decided(spark, d), "Time_To_Live", [100, 130, 160], F.col("predicted") != "Benign")


@query("a28_odd_sizes", f"""{WITH}, w AS (SELECT capture, frame_no // 10 AS win, bool_or(length < 60) AS small, bool_or(length > 1514) AS large FROM kept GROUP BY ALL HAVING count(*) = 10)
SELECT {ad.CATEGORY} AS category, NULL AS capture, round(avg(CASE WHEN small THEN 1.0 ELSE 0 END), 6) AS small, round(avg(CASE WHEN large THEN 1.0 ELSE 0 END), 6) AS large FROM w GROUP BY 1
UNION ALL SELECT NULL, capture, round(avg(CASE WHEN small THEN 1.0 ELSE 0 END), 6), round(avg(CASE WHEN large THEN 1.0 ELSE 0 END), 6) FROM w GROUP BY capture""")
def a28(spark, d):
    w = ad.kept(spark, d).groupBy("capture", wi.window_no(10).alias("win")).agg(F.bool_or(F.col("length") < 60).alias("s"), F.bool_or(F.col("length") > 1514).alias("l"), F.count("*").alias("Number"))
    w = wi.complete(w, 10).withColumn("category", F.expr(ad.CATEGORY))
    share = lambda c: F.round(F.avg(F.col(c).cast("int").cast("double")), 6)
    return w.groupingSets([[F.col("category")], [F.col("capture")]], "category", "capture").agg(share("s").alias("small"), share("l").alias("large"))


@query("a40_duration_percentiles", f"""{WIN} SELECT category, quantile_cont(end_ts - start_ts, 0.5) AS p50, round(quantile_cont(end_ts - start_ts, 0.9), 3) AS p90, round(quantile_cont(end_ts - start_ts, 0.99), 3) AS p99 FROM win_ GROUP BY 1""")
def a40(spark, d):
    p = F.percentile(F.col("end_ts") - F.col("start_ts"), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return ad.windows(spark, d, SIZE).groupBy("category").agg(p.alias("p")).select("category", F.get("p", 0).alias("p50"), F.round(F.get("p", 1), 3).alias("p90"), F.round(F.get("p", 2), 3).alias("p99"))


@query("a42_window_size_of_label", f"""{WITH}, w AS (SELECT capture, frame_no // 100 AS win, count(*) AS n FROM kept GROUP BY ALL), l AS (SELECT {ad.CATEGORY} AS label, max(n) AS size_, count(*) AS rows_ FROM w GROUP BY 1)
SELECT size_ AS size, list_sort(list(label)) AS labels, arg_max(label, (rows_, label)) AS largest, arg_min(label, (rows_, label)) AS smallest FROM l GROUP BY 1""")
def a42(spark, d):
    w = ad.kept(spark, d).groupBy("capture", wi.window_no(100).alias("win")).agg(F.count("*").alias("n"))
    per = w.groupBy(F.expr(ad.CATEGORY).alias("label")).agg(F.max("n").alias("size"), F.count("*").alias("n_rows"))
    return per.groupBy("size").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.max_by("label", F.struct("n_rows", "label")).alias("largest"), F.min_by("label", F.struct("n_rows", "label")).alias("smallest"))


@query("s18_capture_manifest", f"""{WITH}, w AS (SELECT capture, frame_no // 10 AS win, count(*) AS n, bool_or(attacker) AS has FROM kept GROUP BY ALL), m AS (SELECT capture, count(*) FILTER (n = 10) AS extracted, count(*) FILTER (n = 10 AND (capture % 8 = 0 OR has)) AS kept_windows, count(*) FILTER (n = 10 AND capture % 8 <> 0 AND NOT has) AS background, count(*) FILTER (n < 10) AS incomplete FROM w GROUP BY 1),
 f AS (SELECT capture, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM frames GROUP BY 1) SELECT * FROM f JOIN m USING (capture)""")
def s18(spark, d):
    from winlens.operators.labels import capture_manifest

    return capture_manifest(ad.frames(spark, d), ad.kept(spark, d), 10, F.col("capture") % 8 == 0)


@query("k10_first_per_capture", f"""{WIN} SELECT capture, win FROM (SELECT capture, win, row_number() OVER (PARTITION BY capture ORDER BY win) AS r FROM win_ WHERE win >= 5) WHERE r <= 3""")
def k10(spark, d):
    from winlens.operators.ranking import top_k

    return top_k(ad.windows(spark, d, SIZE).filter("win >= 5"), ["capture"], [F.col("win")], 3).select("capture", "win")
