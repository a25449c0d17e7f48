"""Text functions: masking, labels in texts, stems, sections, payload checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "[address]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
_DOT = r"(?:\.|\[\.\]|\(\.\)|\[dot\])"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?![0-9])"
MAC = r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"
#: Groups of an IPv6 address: eight, or fewer around one `::`.
IPV6 = (
    r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?:%[0-9A-Za-z]+)?(?![0-9A-Za-z:])")
_WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "．："
#: Words without meaning for a search.
STOP = ("the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "was", "it", "by", "be", "are", "an", "or", "at", "from", "de", "la", "el", "en", "que", "un", "una", "los", "las", "der", "die", "das", "und", "von", "le", "les", "et", "des", "du")
_ACCENTS = ("áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def mask_addresses(text: Column, mark: str = MARK) -> Column:
    """IPv4 (also with defanged dots), MAC and IPv6 addresses replaced by a mark; full-width digits are folded first."""
    out = F.translate(text, _WIDE, "0123456789.:")
    for pattern in (MAC, IPV6, IPV4):
        out = F.regexp_replace(out, pattern, mark.replace("[", r"\[").replace("]", r"\]"))
    return out


def has_address(text: Column) -> Column:
    t = F.translate(text, _WIDE, "0123456789.:")
    return t.rlike(MAC) | t.rlike(IPV6) | t.rlike(IPV4)


def replace_addresses(text: Column, pairs: Column) -> Column:
    """Known addresses (array of address, label) replaced by labels, longest first, then all others masked."""
    ordered = F.reverse(F.sort_array(F.transform(pairs, lambda p: F.struct(F.length(p["address"]).alias("n"), p["address"].alias("address"), p["label"].alias("label")))))
    # marks keep a label from being read as part of another address
    return mask_addresses(F.aggregate(ordered, text, lambda t, p: F.replace(t, p["address"], p["label"])))


def visible(text: Column) -> Column:
    """Control and format characters other than line ends and tabs written as \\u0000-style codes are removed to a mark."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\n\t\r]]", "�")


def has_invisible(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\n\t\r]]"), F.lit(False))


def stems(text: Column, size: int = 5) -> Column:
    """Distinct stems in order: lower case, no accents, no stop words, cut at `size` letters."""
    words = F.split(F.regexp_replace(F.translate(F.lower(text), *_ACCENTS), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP)), lambda w: F.substring(w, 1, size)))


def stem_counts(text: Column, size: int = 5) -> Column:
    words = F.split(F.regexp_replace(F.translate(F.lower(text), *_ACCENTS), "[^a-z0-9]+", " "), " ")
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP)), lambda w: F.substring(w, 1, size))


def sections(docs: DataFrame, doc: str, text: str, heading: Column | None = None) -> DataFrame:
    """(doc, section, title, body): lines split into sections at headings; lines before the first heading are section 0."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    head = F.col("s").startswith("#") if heading is None else heading
    w = Window.partitionBy(doc).orderBy("line")
    lines = lines.withColumn("h", head).withColumn("section", F.sum(F.col("h").cast("int")).over(w))
    body = F.sort_array(F.collect_list(F.when(~F.col("h"), F.struct("line", "s"))))
    return lines.groupBy(doc, "section").agg(F.max(F.when(F.col("h"), F.col("s"))).alias("title"), F.array_join(F.transform(body, lambda x: x["s"]), "\n").alias("body"))


def payload_defects(body: Column, schema: str, rules: dict[str, Callable]) -> Column:
    """Names of what is wrong with a JSON payload: not json, or any of the rules over its fields."""
    parsed = F.from_json(body, schema)
    valid = F.try_parse_json(body).isNotNull()
    return F.when(~valid, F.array(F.lit("not json"))).otherwise(F.array_compact(F.array(*(F.when(F.coalesce(r(parsed), F.lit(False)), F.lit(k)) for k, r in rules.items()))))


def mask_payload(payload: Column) -> Column:
    """Every string value of a map or of raw JSON text without addresses; structure and other values stay."""
    return mask_addresses(payload)
