"""Addresses: canonical forms, embedded IPv4, networks, and the audit of proposed targets."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4_TEXT = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@F.pandas_udf("canonical string, embedded array<string>")
def address_facts(text: pd.Series) -> pd.DataFrame:
    """Canonical text (null: not an address, or one with a zone) and the IPv4 addresses an IPv6 one carries."""
    out = []
    for t in text:
        try:
            ip = ipaddress.ip_address(str(t).strip())
            if getattr(ip, "scope_id", None):
                raise ValueError
        except ValueError:
            out.append((None, []))
            continue
        inner = []
        if ip.version == 6:
            if ip.ipv4_mapped:
                out.append((str(ip.ipv4_mapped), []))
                continue
            inner = [str(x) for x in (ip.sixtofour, *(ip.teredo or ())) if x]
            if ip in ipaddress.ip_network("64:ff9b::/96"):
                inner.append(str(ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)))
        out.append((str(ip), inner))
    return pd.DataFrame(out, columns=["canonical", "embedded"])


def canonical_addresses(rows: DataFrame, column: str) -> DataFrame:
    """Adds canonical and embedded. Every distinct address is parsed once and joined back."""
    facts = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_f", address_facts(F.col(column)))
    return rows.join(facts, column, "left").select(*rows.columns, "_f.canonical", "_f.embedded")


def in_networks(rows: DataFrame, ip: str, networks: DataFrame, name: str) -> DataFrame:
    """Adds a flag: the address (a number) is in one of the networks (low, high). Addresses are looked up once each, by equal blocks of
    65,536 addresses, so that networks of any number can be joined."""
    own = rows.select(ip).distinct().withColumn("_block", F.shiftright(ip, 16))
    blocks = networks.select("low", "high", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))).alias("_block"))
    inside = (own["_block"] == blocks["_block"]) & (F.col(ip) >= F.col("low")) & (F.col(ip) <= F.col("high"))
    hits = own.join(blocks, inside, "left_semi").select(ip, F.lit(True).alias(name))
    return rows.join(hits, ip, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def audit_target(action: Column, target: Column, forms: dict[str, str]) -> Column:
    """Why a target does not suit its action (null: it does): `ip`, `user@ip` or `port@ip` (port/proto@ip) by action."""
    kind = F.lit(None).cast("string")
    for a, form in forms.items():
        kind = F.when(action == a, form).otherwise(kind)
    patterns = {"ip": rf"^{IPV4_TEXT}$", "user@ip": rf"^[A-Za-z0-9._-]+@{IPV4_TEXT}$", "port@ip": rf"^[0-9]{{1,5}}/(?:tcp|udp)@{IPV4_TEXT}$"}
    fits = F.lit(False)
    for k, p in patterns.items():
        fits = fits | ((kind == k) & target.rlike(p))
    last = F.regexp_extract(target, r"\.([0-9]+)$", 1)
    first = F.try_to_number(F.regexp_extract(target, r"(?:^|@)([0-9]+)\.", 1), F.lit("999")).cast("int")
    port = F.try_to_number(F.regexp_extract(target, "^([0-9]+)/", 1), F.lit("99999")).cast("int")
    special = last.isin("0", "255") | (first >= 224) | first.isin(0, 127)
    return F.when(kind.isNull(), "unknown action").when(~fits, "malformed").when(special, "special address").when((kind == "port@ip") & ~port.between(1, 65535), "bad port")
