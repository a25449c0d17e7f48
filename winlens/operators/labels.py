"""Labels, categories and sides of windows, label dimensions, capture names and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winlens.operators.windows import window_no
from winlens.operators.ordered import running

#: Categories and their labels.
GROUPS = {
    "DDoS": ("DDoS-ACK_Fragmentation", "DDoS-UDP_Flood", "DDoS-SlowLoris", "DDoS-ICMP_Flood", "DDoS-RSTFINFlood", "DDoS-PSHACK_Flood", "DDoS-HTTP_Flood", "DDoS-UDP_Fragmentation", "DDoS-ICMP_Fragmentation", "DDoS-TCP_Flood", "DDoS-SYN_Flood", "DDoS-SynonymousIP_Flood"),
    "DoS": ("DoS-TCP_Flood", "DoS-HTTP_Flood", "DoS-SYN_Flood", "DoS-UDP_Flood"),
    "Mirai": ("Mirai-greip_flood", "Mirai-greeth_flood", "Mirai-udpplain"),
    "Recon": ("Recon-PingSweep", "Recon-OSScan", "VulnerabilityScan", "Recon-PortScan", "Recon-HostDiscovery"),
    "Spoofing": ("MITM-ArpSpoofing", "DNS_Spoofing"),
    "Web": ("SqlInjection", "CommandInjection", "Backdoor_Malware", "Uploading_Attack", "XSS", "BrowserHijacking"),
    "BruteForce": ("DictionaryBruteForce",),
    "Benign": ("BenignTraffic",),
}
CATEGORIES = tuple(GROUPS)
LABELS = tuple(x for v in GROUPS.values() for x in v)
OTHER_NAMES = {"benign": "BenignTraffic", "benign_final": "BenignTraffic"}


def label_dimension(spark: SparkSession) -> DataFrame:
    """(key, label, category, binary, target7): 36 spellings in lower case."""
    category = {x: k for k, v in GROUPS.items() for x in v}
    spelled = {x.lower(): x for x in LABELS} | OTHER_NAMES
    rows = [(k, v, category[v], "Benign" if category[v] == "Benign" else "Attack", "DDoS+DoS" if category[v] in ("DDoS", "DoS") else category[v]) for k, v in spelled.items()]
    return spark.createDataFrame(rows, "key string, label string, category string, binary string, target7 string")


def canonical_labels(rows: DataFrame, raw: str, strict: bool = True) -> DataFrame:
    """Adds label, category, binary and target7; an unknown spelling is an error, or null if not strict."""
    dim = F.broadcast(label_dimension(rows.sparkSession))
    out = rows.withColumn("key", F.lower(F.trim(raw))).join(dim, "key", "left").drop("key")
    if strict:
        out = out.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(raw, F.lit("null")))).cast("string")))
    return out


def same_family(a: Column, b: Column) -> Column:
    floods = ("DDoS", "DoS")
    return (a == b) | a.isin(*floods) & b.isin(*floods)


def capture_label_text(file_name: Column) -> Column:
    """The label in a capture's file name: without folder, extension, trailing digits, and - or _ before them."""
    base = F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[A-Za-z]+$", "")
    return F.regexp_replace(F.regexp_replace(base, r"[0-9]+$", ""), r"[-_]+$", "")


def natural_key(file_name: Column) -> Column:
    """(base in lower case, numeric suffix or 0, name): orders file names as people do."""
    name = F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[A-Za-z]+$", "")
    digits = F.regexp_extract(name, r"([0-9]{1,15})$", 1)
    return F.struct(F.regexp_replace(F.lower(F.regexp_replace(name, r"[0-9]{1,15}$", "")), "[-_]+$", "").alias("base"), F.coalesce(F.try_to_number(F.when(digits != "", digits), F.lit("999999999999999")).cast("long"), F.lit(0)).alias("suffix"), name.alias("name"))


def natural_order(rows: DataFrame, file_name: Column, identity: str) -> DataFrame:
    """place: rows numbered from 1 in the order of natural_key, then of identity; names of one base may be any number."""
    keyed = rows.withColumn("_k", natural_key(file_name))
    return running(keyed, [], ["_k", identity], number="place").drop("_k")


def window_side(benign_capture: Column, has_attacker: Column) -> Column:
    """kept or background: an attack capture keeps the windows with its attacker."""
    return F.when(benign_capture | has_attacker, "kept").otherwise("background")


def capture_manifest(frames: DataFrame, kept: DataFrame, size: int, benign: Column) -> DataFrame:
    """Of each capture: packets, bytes, windows extracted, kept, background and incomplete."""
    w = kept.groupBy("capture", window_no(size).alias("win")).agg(F.count("*").alias("n"), F.bool_or("attacker").alias("has"))
    full = F.col("n") == size
    side = window_side(benign, F.col("has"))
    m = w.groupBy("capture").agg(F.count_if(full).alias("extracted"), F.count_if(full & (side == "kept")).alias("kept_windows"), F.count_if(full & (side == "background")).alias("background"), F.count_if(~full).alias("incomplete"))
    return frames.groupBy("capture").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).join(m, "capture")
