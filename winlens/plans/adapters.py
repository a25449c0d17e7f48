"""Projections of the star-schema, event, vector and text tables onto the engine's inputs, in Spark and as SQL for the oracle.

Expressions valid in both dialects are written once; `{epoch}` is the one that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.operators import frames as fr

#: lineitem as captured frames. The rank order of a capture's frames is FRAME_ORDER.
FRAME_COLUMNS = {
    "capture": "l_suppkey",
    "ts": "CAST({epoch} AS DOUBLE)",
    "ethertype": "CASE WHEN l_partkey % 53 = 0 THEN 34525 WHEN l_partkey % 41 = 0 THEN 2054 ELSE 2048 END",
    "protocol": "CASE WHEN l_partkey % 41 = 0 THEN 0 WHEN l_returnflag = 'R' THEN 6 WHEN l_returnflag = 'A' THEN 17 ELSE 1 END",
    "ttl": "32 + l_orderkey % 200",
    "sport": "1024 + l_orderkey % 500",
    "dport": "CASE l_linenumber WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53 WHEN 4 THEN 23 WHEN 5 THEN 22 WHEN 6 THEN 25 ELSE 21 END",
    "flags": "l_partkey % 256",
    "opt_len": "4 * (l_linenumber % 3)",
    "length": "CAST(l_quantity AS BIGINT) * 40",
    "cut": "l_linenumber = 7",
    "src": "l_partkey % 97",
    "dst": "l_orderkey % 50",
    "attacker": "l_partkey % 97 = 0",
    "o1": "l_orderkey", "o2": "CAST(l_linenumber AS BIGINT)", "o3": "l_partkey", "o4": "l_extendedprice", "o5": "l_quantity",
}
FRAME_ORDER = ("ts", "o1", "o2", "o3", "o4", "o5")
#: Frames that a task numbers and sums up, but for longer captures: what it holds of them stays in memory.
TASK_FRAMES = 250_000
#: Each capture's category: 0 is benign.
CATEGORY = "CASE capture % 8 WHEN 0 THEN 'Benign' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'DoS' WHEN 3 THEN 'Mirai' WHEN 4 THEN 'Recon' WHEN 5 THEN 'Spoofing' WHEN 6 THEN 'Web' ELSE 'BruteForce' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(columns: dict[str, str], epoch: str) -> list[str]:
    return [f"{e.format(epoch=epoch)} AS {c}" for c, e in columns.items()]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of lineitem, without numbers."""
    return table(spark, sf_dir, "lineitem").selectExpr(*exprs(FRAME_COLUMNS, "unix_timestamp(l_shipdate)"))


#: The 25 columns that a window averages, in both dialects, over the columns above.
MEASURES = {
    "Header_Length": "CASE protocol WHEN 17 THEN 8 WHEN 6 THEN 20 + opt_len ELSE 0 END",
    "Time_To_Live": "CASE WHEN ethertype = 2048 THEN ttl ELSE 0 END",
    **{f"{n}_flag_number": f"CASE WHEN protocol = 6 AND flags % {2 * b} >= {b} THEN 1 ELSE 0 END" for n, b in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("ece", 64), ("cwr", 128))},
    **{n: f"CASE WHEN protocol = 6 AND (sport = {p} OR dport = {p}) THEN 1 ELSE 0 END" for n, p in (("HTTP", 80), ("HTTPS", 443))},
    "DNS": "CASE WHEN protocol = 17 AND (sport = 53 OR dport = 53) THEN 1 ELSE 0 END",
    **{n: f"CASE WHEN protocol = 6 AND (sport = {p} OR dport = {p}) THEN 1 ELSE 0 END" for n, p in (("Telnet", 23), ("SMTP", 25), ("SSH", 22), ("IRC", 21))},
    "TCP": "CASE WHEN protocol = 6 THEN 1 ELSE 0 END",
    "UDP": "CASE WHEN protocol = 17 THEN 1 ELSE 0 END",
    "DHCP": "CASE WHEN protocol = 17 AND (sport = 67 AND dport = 68 OR sport = 68 AND dport = 67) THEN 1 ELSE 0 END",
    "ARP": "CASE WHEN ethertype = 2054 THEN 1 ELSE 0 END",
    "ICMP": "CASE WHEN protocol = 1 THEN 1 ELSE 0 END",
    "IGMP": "CASE WHEN protocol = 2 THEN 1 ELSE 0 END",
    "IPv": "CASE WHEN ethertype = 2048 THEN 1 ELSE 0 END",
    "LLC": "CASE WHEN ethertype = 2048 THEN 1 ELSE 0 END",
}

_SIZE_SQL = "least(greatest(length, CASE WHEN cut THEN length ELSE 60 END), 1514)"
_DUCK_FRAMES = ", ".join(exprs(FRAME_COLUMNS, "epoch(l_shipdate)"))
_DUCK_MEASURES = ", ".join(f'{e} AS "{c}"' for c, e in MEASURES.items())
_ORDER = ", ".join(FRAME_ORDER)

#: frames, kept (numbered, measured) as CTEs for the oracle.
FRAMES_CTE = f"""
frames AS (SELECT {_DUCK_FRAMES} FROM lineitem),
kept AS (
  SELECT *, {_DUCK_MEASURES}, {_SIZE_SQL} AS size, row_number() OVER w - 1 AS frame_no,
         coalesce(ts - lag(ts) OVER w, 0) AS iat
  FROM frames WHERE ethertype IN (2048, 2054) WINDOW w AS (PARTITION BY capture ORDER BY {_ORDER}))"""


def windows_cte(size: int = 10, name: str = "win_") -> str:
    """(capture, win, start_ts, end_ts, the 39 columns, category) of complete windows; follows FRAMES_CTE."""
    means = ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in MEASURES)
    return f""",
modes AS (SELECT capture, frame_no // {size} AS win, protocol, count(*) AS n FROM kept GROUP BY ALL),
{name} AS (
  SELECT k.*, m.protocol_type AS "Protocol Type", {CATEGORY} AS category FROM (
    SELECT capture, frame_no // {size} AS win, min(ts) AS start_ts, max(ts) AS end_ts, {means},
      CASE WHEN max(ts) > min(ts) THEN count(*) / (max(ts) - min(ts)) ELSE CAST('inf' AS DOUBLE) END AS "Rate",
      sum(ack_flag_number) AS ack_count, sum(syn_flag_number) AS syn_count, sum(fin_flag_number) AS fin_count, sum(rst_flag_number) AS rst_count,
      sum(size) AS "Tot sum", min(size) AS "Min", max(size) AS "Max", round(avg(size), 6) AS "AVG", round(stddev_samp(size), 6) AS "Std",
      round(avg(size), 6) AS "Tot size", round(avg(iat), 6) AS "IAT", count(*) AS "Number", round(var_samp(size), 4) AS "Variance",
      bool_or(attacker) AS has_attacker, count(*) FILTER (attacker) AS attacker_frames,
      count(DISTINCT CASE WHEN ethertype = 2048 THEN src END) AS n_src, count(DISTINCT CASE WHEN ethertype = 2048 THEN dst END) AS n_dst
    FROM kept GROUP BY ALL HAVING count(*) = {size}) k
  JOIN (SELECT capture, win, arg_min(protocol, (-n, protocol)) AS protocol_type FROM modes GROUP BY ALL) m USING (capture, win))"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the kept types with their numbers, dealt by capture to as many tasks as the table's rows ask for."""
    n_tasks = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // TASK_FRAMES + 1)
    rows = fr.keep_decoded(frames(spark, sf_dir)).repartition(n_tasks, "capture")
    return fr.number_frames(rows, "capture", FRAME_ORDER, ts="ts")


def measured(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", fr.wire_size("length", "cut")).selectExpr("*", *(f"{e} AS `{c}`" for c, e in MEASURES.items()))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and measured frames of the kept types; what is measured is not shuffled."""
    return measured(numbered(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str, size: int = 10, more: list[Column] = (), rows: DataFrame | None = None) -> DataFrame:
    """Complete windows with category, attacker facts and distinct addresses; rows: kept frames, where they are at hand."""
    from winlens.operators import windows as wi

    # sets of a window's few addresses: a distinct count would expand every frame into several rows
    ip = lambda c: F.size(F.collect_set(F.when(F.col("ethertype") == 2048, F.col(c)))).cast("long")
    extra = [F.bool_or("attacker").alias("has_attacker"), F.count_if("attacker").alias("attacker_frames"), ip("src").alias("n_src"), ip("dst").alias("n_dst"), *more]
    out = wi.aggregate_windows(kept(spark, sf_dir) if rows is None else rows, size, list(MEASURES), extra=extra)
    return wi.complete(out, size).withColumn("category", F.expr(CATEGORY))
