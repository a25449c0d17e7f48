"""Personal data by bootstrapped contextual extraction.

A pass over the texts finds base entities (e-mail, IP, card, phone), long hexadecimal strings that may be secrets, other tokens
with digits and groups of digits joined by blanks and marks, each with the lexical patterns around it: the two words before it
(L), the word before and the word after it (M), the word before an assignment's marks (A), and the part of its token in front of
`=` or `:` (P). Base entities and hexadecimal strings are seeds. Patterns and instances form a graph that Spark
scores in rounds: a pattern's confidence in a kind is the mean score of its instances, if enough different seeds or accepted
instances of the kind stand in it; an unknown instance scores the noisy-or of its confident patterns. Rounds end when no
score rises. Then all other tokens (without digits, short or long) and groups of digits of any length that stand where a confident
pattern holds, or were accepted, join the graph (tasks sift them by a bit map of one size, and joins tell which are meant), and rounds begin anew, until every confident pattern has been looked up so. These tokens are judged
by the confidence over all instances of a pattern, tokens with digits by that over tokens with digits. Unknown instances with
a high score, at places where a confident pattern holds, are added to the base spans, the longest where they overlap. So are
hexadecimal strings where a confident pattern of secrets holds; elsewhere (a checksum in plain text) they are left alone.

Defined cases: a null text counts as empty; very long texts, words and tokens are read whole (a word of over LONG characters
stands in a pattern by its digest); rows that repeat are extracted each on its own, and count once as seeds; of kinds with equal
scores the first in order wins; spans are in code points, end exclusive; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, islice, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table, text_rows
from winlens.llm.decontamination import sieve

#: Kinds of base entities, and secrets after them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = len(BASE_KINDS)
#: A pattern counts from so many different seeds or accepted instances and this confidence; an instance is accepted from this score.
#: Scores that rise by no more are the same.
MIN_SEEDS, CONFIDENT, ACCEPT = 5, 0.8, 0.9
SAME = 1e-6
#: Tokens with digits, and groups of digits, of other lengths are looked at only where a confident pattern holds; those found there are whole.
TOKEN_CHARS = (5, 64)
LONG = 64
#: Up to so many words before instances are searched for in a text before all of its tokens are looked at.
PROBED = 100
#: Bits of the map of what is looked for (16 MB, whatever there is), and answers that a task remembers.
MAP_BITS, REMEMBERED = 27, 50_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_GROUPS = re.compile(r"\(?[0-9]++(?:[ .()-]{1,3}[0-9]++)+")
_TOKEN = re.compile(r"\S+")
_PREFIX = re.compile(r"[A-Za-z_]+[=:]")
_EDGE = ".,;:!?\"'()[]{}<>"
_SPACE = re.compile(r"\s")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])")
_DIGIT = re.compile("[0-9]")
_AFTER = re.compile("[" + re.escape(_EDGE) + r"]*+\s*+(\S++)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base entities, in this order."""
    spans = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """Hexadecimal strings of 32 characters or more with letters and digits."""
    return [(m.start(), SECRET, m.end()) for m in _HEX.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]


def other_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens with a digit that touch none of the taken spans, without marks at their edges."""
    found, done, k = [], 0, 0
    taken = sorted((s, e) for s, _, e in taken)
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, m.end())
        done = end = gap.start() if gap else len(text)
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if usual(start, end) and not any(s < end and e > start for s, e in taken[k : k + 8]):
            found.append((start, end))
    return found


def overlaps(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span touches a taken one; both in order."""
    out, k = [], 0
    reach = list(accumulate((e for _, e in taken), max))
    for start, end in spans:
        while k < len(taken) and reach[k] <= start:
            k += 1
        out.append(any(e > start for _, e in takewhile(lambda t: t[0] < end, islice(taken, k, None))))
    return out


def usual(start: int, end: int) -> bool:
    return TOKEN_CHARS[0] <= end - start <= TOKEN_CHARS[1]


def groups_of(text: str) -> list[tuple[int, int]]:
    """Spans of two or more groups of digits, joined by blanks, dots, brackets or dashes, that hold a blank or bracket."""
    return [m.span() for m in _GROUPS.finditer(text) if " " in m[0] or "(" in m[0]]


def digit_groups(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """groups_of usual length that touch none of the taken spans."""
    found = [x for x in groups_of(text) if usual(*x)]
    return [x for x, hit in zip(found, overlaps(found, sorted((s, e) for s, _, e in taken)), strict=True) if not hit]


def plain(word: str) -> str:
    """A word as it stands in patterns: lower case, every digit 0, a very long one by its digest."""
    word = _DIGIT.sub("0", word.lower())
    return word if len(word) <= LONG else "\0" + hashlib.sha1(word.encode("utf-8", "surrogatepass")).hexdigest()


class Context:
    """The words of a text, found once for all of its mentions."""

    def __init__(self, text: str):
        self.text, self.starts = text, [m.start() for m in _TOKEN.finditer(text)]

    def before(self, at: int, n: int) -> list[str]:
        """The last n words, or parts of words, that end at or before a place."""
        k = bisect_left(self.starts, at)
        edges = [*self.starts[max(0, k - n) : k], at]
        return [plain(self.text[a:b].rstrip()) for a, b in zip(edges, edges[1:], strict=False)]

    def patterns(self, start: int, end: int) -> list[str]:
        before, after = self.before(start, 4), _AFTER.match(self.text, end)
        found = []
        if len(before) >= 2:
            found.append("L " + " ".join(before[-2:]))
        if before and after:
            found.append(f"M {before[-1]} _ {plain(after[1])}")
        marks = len(list(takewhile(lambda w: not any(map(str.isalnum, w)), reversed(before))))
        if 0 < marks < len(before) and any(c in "".join(before[-marks:]) for c in "=:"):
            found.append("A " + " ".join(before[-marks - 1 :]))
        prefix = _PREFIX.match(self.text, start, end)
        if prefix:
            found.append("P " + prefix[0].lower())
        return found


class Wanted:
    """What is looked for, as a bit map of hashes of one size: patterns, words before instances, and instances, told apart by a letter.

    A hit may be another key with the same bit; what is found is joined with the tables themselves afterwards. few: all words before
    instances, with the marks of P patterns, if they are few and no instance is looked for by itself.
    """

    def __init__(self, bits: np.ndarray, few: list[str] | None):
        self.bits, self.few = bits, few
        self.known: dict[str, bool] = {}

    def has(self, key: str) -> bool:
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            at = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), 42) >> 64 - MAP_BITS
            found = self.known[key] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found

    def probe(self) -> Callable[[str], bool]:
        """Whether a text can have rare tokens at all: it has none unless it holds what stands before instances. Saves time alone."""
        if self.few is None or any(c in p for p in self.few for c in "\0\u03c3\u03c2"):  # digests, and letters whose lower case depends on their neighbours
            return lambda text: True
        zeros = str.maketrans("123456789", "0" * 9)
        found = re.compile("|".join(map(re.escape, self.few)) or r"(?!)").search
        return lambda text: found(text.lower().translate(zeros)) is not None


def rare_tokens(text: str, mentions: list[dict], wanted: Wanted) -> list[tuple[int, int]]:
    """Spans of tokens, and of digit groups of unusual length, that touch no mention of a base entity and are no mention, but stand where a wanted pattern holds or are wanted."""
    known = {(m["start"], m["end"]) for m in mentions}
    context = Context(text)
    found, prior, has = [], "", wanted.has

    def look(span: tuple[int, int], bare: str) -> None:
        if span not in known and (has("i" + bare) or any(has("p" + p) for p in context.patterns(*span))):
            found.append(span)

    for m in _TOKEN.finditer(text):
        word = m[0]
        bare = word.strip(_EDGE)
        lead = word[: len(word) - len(word.lstrip(_EDGE))]
        before, prior = plain(lead) if lead else prior, plain(word)
        if bare and (has("h" + before) or "=" in bare or ":" in bare or has("i" + bare.lower())):
            start = m.start() + len(lead)
            look((start, start + len(bare)), bare.lower())
    for start, end in groups_of(text):
        if not usual(start, end):
            look((start, end), text[start:end].lower())
    taken = sorted((m["start"], m["end"]) for m in mentions if m["kind"] is not None)
    found = sorted(set(found))
    return [x for x, hit in zip(found, overlaps(found, taken), strict=True) if not hit]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>,rare:boolean>>"
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("rare", pa.bool_())])


def mention(context: Context, kind: int | None, start: int, end: int, rare: bool) -> dict:
    return {"kind": kind, "start": start, "end": end, "instance": context.text[start:end].lower(), "patterns": context.patterns(start, end), "rare": rare}


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, counts by kind, base spans, digest, text, and all mentions with their patterns (kind null: unknown)."""
    for b in batches:
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        spans, digests, mentions = [], [], []
        for text in b.column(1).to_pylist():
            base = base_spans(text)
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in base))
            spans.append(joined(base))
            digests.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            seeds = base + secret_spans(text)
            tokens = other_tokens(text, seeds)
            starts = {s for s, _ in tokens}
            of = [(k, s, e, False) for s, k, e in seeds] + [(None, s, e, False) for s, e in tokens] + [(None, s, e, s in starts) for s, e in digit_groups(text, seeds)]
            context = Context(text if of else "")
            mentions.append([mention(context, *x) for x in of])
        arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), b.column(1), pa.array(mentions, pa.list_(_MENTION))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "base", "text", "mentions"])


def look_up(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, text, mentions) to row and the mentions of rare_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Wanted(*wanted.value)
        may = own.probe()
        for b in batches:
            out = [[mention(c, None, s, e, True) for c in [Context(t)] for s, e in rare_tokens(t, m, own)] if may(t) else [] for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_MENTION))], ["row", "mentions"])

    return run


def bootstrap(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions(kind, instance, pattern, rare): confident patterns (pattern, kind, rare) and accepted unknown instances (instance, kind)."""
    ks = range(len(KINDS))
    edges = mentions.groupBy("pattern", "instance").agg(F.min("rare").alias("rare"), *(F.max((F.col("kind") == k).cast("int")).alias(f"seed{k}") for k in ks))
    edges = materialize(edges.na.fill(0), "pii-edges")
    seeds = edges.groupBy("instance").agg(*(F.max(f"seed{k}").cast("double").alias(f"s{k}") for k in ks))
    scores = materialize(seeds.withColumn("known", sum(F.col(f"s{k}") for k in ks) > 0), "pii-seeds")
    while True:
        support = lambda k: F.greatest(f"seed{k}", (~F.col("known") & (F.col(f"s{k}") >= ACCEPT)).cast("int"))
        conf = edges.join(scores, "instance").groupBy("pattern").agg(
            *(F.avg(F.when(~F.col("rare"), F.col(f"s{k}"))).alias(f"c{k}") for k in ks), *(F.avg(f"s{k}").alias(f"a{k}") for k in ks), *(F.sum(support(k)).alias(f"n{k}") for k in ks))
        sure = [F.when((F.col(f"n{k}") >= MIN_SEEDS) & (F.col(f"{c}{k}") >= CONFIDENT), F.col(f"{c}{k}")).otherwise(0.0).alias(f"{c}{k}") for c in "ca" for k in ks]
        confident = materialize(conf.select("pattern", *sure).filter(" or ".join(f"{c}{k} > 0" for c in "ca" for k in ks)), "pii-patterns")
        noisy_or = [1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.when(F.col("rare"), F.col(f"a{k}")).otherwise(F.col(f"c{k}")))))) for k in ks]
        unknown = edges.join(confident, "pattern").groupBy("instance").agg(*(x.alias(f"u{k}") for k, x in enumerate(noisy_or)))
        both = scores.join(unknown, "instance", "left")
        new = [F.when(F.col("known"), F.col(f"s{k}")).otherwise(F.coalesce(f"u{k}", F.lit(0.0))) for k in ks]
        rise = F.greatest(*(x - F.col(f"s{k}") for k, x in enumerate(new)))
        scores = materialize(both.select("instance", "known", *(x.alias(f"s{k}") for k, x in enumerate(new)), rise.alias("rise")), "pii-scores")
        # scores only rise: they are means and noisy-ors of what rose before
        if (scores.agg(F.max("rise")).first()[0] or 0) <= SAME:
            break
    best = lambda c: F.array_max(F.array(*(F.struct(F.col(f"{c}{k}").alias("score"), F.lit(-k).alias("kind")) for k in ks)))
    accepted = scores.filter(~F.col("known")).select("instance", best("s").alias("b")).filter(F.col("b.score") >= ACCEPT)
    sides = [confident.select("pattern", best(c).alias("b"), F.lit(c == "a").alias("rare")).filter("b.score > 0") for c in "ca"]
    return sides[0].union(sides[1]).select("pattern", (-F.col("b.kind")).alias("kind"), "rare"), accepted.select("instance", (-F.col("b.kind")).alias("kind"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base entities, base_sha256, spans (base and added, `kind:start:end`), n_added, n_found (all spans)."""
    fields = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    found = text_rows(docs, id_col, text_col).mapInArrow(extract, f"doc_id long, {fields}, base_sha256 string, base string, text string, mentions {_FOUND}")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    flat = lambda df: df.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("pattern", F.explode("patterns"))
    each, looked = flat(found), None
    while True:
        confident, accepted = bootstrap(each.select("kind", "instance", "pattern", "rare"))
        rare = each.filter("rare").join(accepted, "instance", "left_semi").select(F.lit("i").alias("what"), F.col("instance").alias("key"))
        now = confident.select(F.lit("p").alias("what"), F.col("pattern").alias("key")).unionByName(rare).distinct()
        fresh = materialize(now if looked is None else now.join(looked, ["what", "key"], "left_anti"), "pii-fresh")
        if not fresh.limit(1).count():
            break
        looked = materialize(fresh if looked is None else looked.unionByName(fresh), "pii-looked")
        each = flat(found).unionByName(materialize(rare_mentions(found, flat, looked), "pii-rare"))
    added = each.filter("kind is null").drop("kind").join(accepted, "instance").join(confident, ["pattern", "kind", "rare"], "left_semi")
    secrets = each.filter(F.col("kind") == SECRET).join(confident, ["pattern", "kind", "rare"], "left_semi")
    added = added.select("row", "kind", "start", "end").union(secrets.select("row", "kind", "start", "end")).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    inner = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x["end"] - x["start"] < y["end"] - y["start"])
    added = added.withColumn("added", F.filter("added", lambda x: ~F.exists("added", lambda y: inner(x, y))))
    return merged(found.join(added, "row", "left"))


def rare_mentions(found: DataFrame, flat: Callable[[DataFrame], DataFrame], looked: DataFrame) -> DataFrame:
    """The mentions of rare tokens of found that have a pattern among looked(what, key) or are an instance there."""
    spark = found.sparkSession
    text = F.when(F.col("what") == "i", F.col("key")).otherwise(F.expr("substring(key, 3)"))
    kind = F.substring("key", 1, 1)
    word = F.when(kind == "M", F.substring_index(text, " ", 1)).when(kind != "P", F.substring_index(text, " ", -1))
    heads = looked.filter("what = 'p'").select(word.alias("h"), F.when(kind == "P", text).alias("mark")).distinct()
    hashes = looked.select(F.xxhash64(F.concat("what", "key")).alias("hash")).unionByName(heads.filter("h is not null").select(F.xxhash64(F.concat(F.lit("h"), F.col("h"))).alias("hash")))
    some = heads.limit(PROBED + 1).collect()
    few = None if len(some) > PROBED or looked.filter("what = 'i'").limit(1).count() else [x for r in some for x in r if x is not None]
    wanted = spark.sparkContext.broadcast((sieve(hashes, MAP_BITS), few))
    rows = found.select("row", "text", "mentions").mapInArrow(look_up(wanted), f"row long, mentions {_FOUND}")
    seen = materialize(flat(rows), "pii-seen")
    place = ["row", "start", "end"]
    by_pattern = seen.join(looked.filter("what = 'p'").select(F.col("key").alias("pattern")), "pattern", "left_semi").select(*place)
    by_instance = seen.join(looked.filter("what = 'i'").select(F.col("key").alias("instance")), "instance", "left_semi").select(*place)
    return seen.join(by_pattern.unionByName(by_instance).distinct(), place, "left_semi")


def merged(rows: DataFrame) -> DataFrame:
    name: Column = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] < SECRET), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    all_ = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    text = F.array_join(F.transform(all_, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", text.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), F.size(all_).cast("long").alias("n_found"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
