"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units after numbers and capitalised words inside a sentence turn into typed placeholders, other
words are lower-cased and lose the marks at their edges. Every window of WORDS words of an item is matched in one of two ways: by the
hash of its template if that has POSTED real words at least, and else by the hash of its words as they are. A bit map of the
items' hashes, of one size whatever their number, is broadcast, so that of the documents' windows only those that may match are
written and shuffled.

Numbers may take any values. Changed names and units must be consistent over a matched passage: most of its places decide which value
of the document stands for one of the item, and different names stay different. A window that holds another changed name or unit
is dropped, as is every window with a changed one where places are tied. What is left of a passage counts only with evidence: LITERALS
places, and a share of EVIDENCE of all that it covers, have the same word in both, be it a real word or the unchanged value of a slot; so
nouns that German capitalises are evidence as any word, and two tables of numbers are no match. A document that so matches
enough of all windows of an item carries it, verbatim or re-parameterised.

Defined cases: null texts count as empty; items under WORDS words are too short for templates and are matched where a document
has them as a sentence or line of its own, word for word; an item without words is never matched; very long texts are read whole;
repeated document rows count once, as do a document's repeats of a window; rows without id are left out; places that are tied decide
nothing; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table

WORDS, POSTED = 6, 2
LITERALS, EVIDENCE = 4, 0.4
#: A document carries an item from so many of its windows (all, if it has fewer) and this share of them.
LEAST_WINDOWS, LEAST_SHARE = 3, 0.25
#: Leading bits of a hash that number its bit in the map (16 MB); with more items more windows pass the map, and the join drops these.
SIEVE_BITS = 27
#: Hashes of items that reach the driver at once, to be put into the map.
SLICE = 4_000_000
CACHED_WORDS = 50_000

NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?")
NUMBER_UNIT = re.compile(r"([+-]?[$€£]?[0-9][0-9.,]*)([a-z°µ]{1,4}[0-9²³]?)")
NAME = re.compile(r"[^\W\d_a-z][^\W\d_A-Z]+(?:['’-][^\W\d_]+)*")
#: Words that stand for numbers in English, German, French and Spanish (but for articles), and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze vingt trente quarante cinquante soixante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split())
UNITS = frozenset(
    "km m cm mm mi ft in yd kg g mg lb lbs oz l ml h hr hrs min mins s sec secs ms hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "gallon gallons dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons "
    "stunde stunden minuten sekunde sekunden tag tage woche wochen monat monate jahr jahre gramm prozent grad heure heures jour jours semaine semaines mois an ans litre litres "
    "mètre mètres kilomètre kilomètres gramme grammes hora horas minuto minutos segundo segundos día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos litro litros".split())
EDGE = ".,;:!?\"'()[]{}<>*#$%&|“”«»…"
LITERAL, NUM, UNIT, NAMED, GLUED = range(5)
#: Added to the length of a window of words as they are before it is hashed.
EXACT = 64
_TYPED = np.array([xxhash.xxh3_64_intdigest(f"<{k}>", 3) for k in range(5)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Canon:
    """Template words of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int8)

    def word(self, w: str) -> int:
        """A number, from 1, for the word, under which hashes has that of its literal, and flags: 1 number, 2 unit word, 4 may be a name, 8 number and unit, 16 ends a sentence."""
        bare = w.strip(EDGE)
        low = bare.lower()
        flags = 16 if w[-1] in ".!?:" or w[-1] in EDGE and set(w[len(w.rstrip(EDGE)) :]) & set(".!?") else 0
        if low in NUMBER_WORDS or bare and NUMBER.fullmatch(bare):
            flags |= 1
        elif low in UNITS:
            flags |= 2
        elif bare[:1].isupper() and NAME.fullmatch(bare):
            flags |= 4
        elif bare[:1] in "+-$€£0123456789" and bare and NUMBER_UNIT.fullmatch(low):
            flags |= 8
        at = self.known[w] = len(self.known) + 1
        if at == len(self.flags):
            self.hashes, self.flags = np.resize(self.hashes, 2 * at), np.resize(self.flags, 2 * at)
        self.hashes[at], self.flags[at] = xxhash.xxh3_64_intdigest(low or w), flags
        return at

    def template(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their own hashes, their template hashes, their types, and for each place (and the end) whether a sentence or line begins there."""
        words, starts = [], []
        for line in text.split("\n"):
            starts.append(len(words))
            words += line.split()
        if not words:
            return words, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.ones(1, bool)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        get, word = self.known.get, self.word
        at = np.array([get(w) or word(w) for w in words])
        own, flags = self.hashes[at], self.flags[at]
        opens = np.zeros(len(words) + 1, bool)
        opens[[*starts, len(words)]] = True
        opens[1:] |= flags & 16 > 0
        kinds = np.zeros(len(words), np.int8)
        kinds[flags & 1 > 0] = NUM
        after = np.zeros(len(words), bool)
        after[1:] = kinds[:-1] == NUM
        kinds[(flags & 2 > 0) & after] = UNIT
        kinds[(flags & 4 > 0) & ~opens[:-1]] = NAMED
        kinds[flags & 8 > 0] = GLUED
        hashes = own.copy()
        hashes[kinds > 0] = _TYPED[kinds[kinds > 0]]
        return words, own, hashes, kinds, opens

    def windows(self, text: str, lengths: list[tuple[int, bool]] | None) -> tuple[list[str], np.ndarray, list[tuple[int, bool, np.ndarray, np.ndarray]]]:
        """Words, types, and (length, exact, places, hashes) of windows: of an item (lengths None) each place once, of a document those of the given
        (length, exact), where exact ones under WORDS stand alone as a sentence or line."""
        words, own, hashes, kinds, opens = self.template(text)
        literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        real = lambda n: literal[n:] - literal[: len(words) - n + 1] >= POSTED
        n = min(WORDS, len(words))
        if lengths is None and 0 < n < WORDS:
            return words, kinds, [(n, True, np.zeros(1, np.int64), mixed(own, n, n + EXACT))]
        found = []
        for n, exact in ([(WORDS, False), (WORDS, True)] if lengths is None else lengths):
            if len(words) < n or not n:
                continue
            at = np.arange(len(words) - n + 1)
            if not exact:
                at = at[real(n)]
            elif n < WORDS:
                at = at[opens[: len(words) - n + 1] & opens[n:]]
            elif lengths is None:
                at = at[~real(n)]
            if len(at):
                found.append((n, exact, at, mixed(own if exact else hashes, n, n + EXACT * exact)[at]))
        return words, kinds, found


def mixed(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    with np.errstate(over="ignore"):
        acc = np.full(len(hashes) - n + 1, seed, np.uint64)
        for k in range(n):
            acc = (acc ^ hashes[k : len(hashes) - n + 1 + k]) * _MIX
            acc ^= acc >> np.uint64(31)
    return acc


def slot(words: list[str], kinds: np.ndarray, at: int, n: int) -> list[dict]:
    return [{"kind": int(kinds[i]), "at": i, "value": words[i].strip(EDGE).lower()} for i in range(at, at + n) if kinds[i]]


_SLOTS = pa.list_(pa.struct([("kind", pa.int32()), ("at", pa.int32()), ("value", pa.string())]))
_WINDOWS = "id long, n int, exact boolean, at int, hash long, slots array<struct<kind:int,at:int,value:string>>"


def all_windows(rows: DataFrame, lengths: list[tuple[int, bool]] | None, sift=None) -> DataFrame:
    """rows(id, text) to windows of Canon; sift: a broadcast bit map of the hashes to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        wanted = None if sift is None else sift.value
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, kinds, found = canon.windows(text, lengths)
                for n, as_is, at, hashes in found:
                    if wanted is not None:
                        hit = marked(wanted, hashes)
                        at, hashes = at[hit], hashes[hit]
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        for column, v in zip(out, (row_id, n, as_is, i, h, [] if as_is else slot(words, kinds, i, n)), strict=True):
                            column.append(v)
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), _SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "n", "exact", "at", "hash", "slots"])

    return rows.mapInArrow(run, _WINDOWS)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each hash."""
    at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def sieve(items: DataFrame, bits: int) -> np.ndarray:
    """The bit map of the hashes of items. These come to the driver in slices of at most about SLICE."""
    distinct = items.select("hash").distinct()
    slices = max(1, -(-distinct.count() // SLICE))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for k in range(slices):
        at = distinct.filter(F.pmod("hash", F.lit(slices)) == k).toPandas()["hash"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        np.bitwise_or.at(found, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return found


def settled(votes: list[dict]) -> list[dict]:
    """The pairs of values that most places agree on, unchanged ones first: one document value for an item value, one item value for a name; none if places are tied."""
    rank = lambda v: (-v["places"], v["item_value"] != v["doc_value"])
    ends = lambda v: [(v["kind"], 0, v["item_value"])] + [(NAMED, 1, v["doc_value"])] * (v["kind"] == NAMED)
    taken: set[tuple] = set()
    found = []
    for _, level in groupby(sorted(votes, key=rank), rank):
        free = [v for v in level if taken.isdisjoint(ends(v))]
        new = [e for v in free for e in ends(v)]
        if len(new) > len(set(new)):
            return []
        taken.update(new)
        found += free
    return found


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    voted = pa.list_(pa.struct([("kind", pa.int32()), ("item_value", pa.string()), ("doc_value", pa.string())]))
    for b in batches:
        found = [[{k: v[k] for k in ("kind", "item_value", "doc_value")} for v in settled(votes)] for votes in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, voted)], ["doc_id", "item_id", "diagonal", "voted"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """(doc_id, item_id, n_windows matched, item_windows, coverage, reparameterised) of each document that carries an item."""
    spark = docs.sparkSession
    rows = lambda df, i, t: df.filter(F.col(i).isNotNull()).select(F.col(i).cast("long").alias("id"), F.coalesce(F.col(t), F.lit("")).alias("text"))
    items = materialize(all_windows(rows(benchmark, item_col, item_text), None), "bench-windows")
    lengths = sorted((r["n"], r["exact"]) for r in items.select("n", "exact").distinct().collect())  # at most WORDS + 1
    sift = spark.sparkContext.broadcast(sieve(items, sieve_bits))
    found = all_windows(rows(docs, id_col, text_col), lengths, sift)
    item = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n", "exact", "hash", F.col("slots").alias("item_slots"))
    totals = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("at").alias("item_windows"))
    pairs = found.withColumnRenamed("id", "doc_id").join(item, ["hash", "n", "exact"])
    pairs = pairs.select("doc_id", "item_id", "n", "at", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "slots", "item_slots").distinct()
    pairs = materialize(pairs, "leak-pairs")

    # names and units on one diagonal
    zipped = F.transform(F.arrays_zip("slots", "item_slots"), lambda v: F.struct(v["slots"]["at"].alias("at"), v["slots"]["kind"].alias("kind"), v["item_slots"]["value"].alias("item_value"), v["slots"]["value"].alias("doc_value")))
    pairs = pairs.withColumn("values", zipped)
    on = ["doc_id", "item_id", "diagonal"]
    bound = F.filter("values", lambda v: v["kind"].isin(UNIT, NAMED))
    votes = pairs.withColumn("v", F.explode(bound)).groupBy(*on, "v.kind", "v.item_value", "v.doc_value").agg(F.countDistinct("v.at").alias("places"))
    votes = votes.groupBy(*on).agg(F.collect_list(F.struct("kind", "item_value", "doc_value", "places")).alias("votes"))
    voted = votes.mapInArrow(settle, "doc_id long, item_id long, diagonal int, voted array<struct<kind:int,item_value:string,doc_value:string>>")

    pair = lambda v: F.struct(v["kind"].alias("kind"), v["item_value"].alias("item_value"), v["doc_value"].alias("doc_value"))
    changed = F.exists("values", lambda v: v["doc_value"] != v["item_value"])
    stray = F.exists(bound, lambda v: (v["doc_value"] != v["item_value"]) & ~F.array_contains(F.coalesce("voted", F.array()), pair(v)))
    kept = pairs.join(voted, on, "left").filter(~stray).withColumn("changed", changed)
    covered = F.sequence("item_at", F.col("item_at") + F.col("n") - 1)
    other = F.transform(F.filter("values", lambda v: v["doc_value"] != v["item_value"]), lambda v: v["at"] - F.col("diagonal"))
    all_of = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a passage has at most as many windows as its item
    kept = kept.withColumns({"covered": covered, "same": F.array_except(covered, other)})
    passages = kept.groupBy(*on).agg(all_of("covered").alias("n_covered"), all_of("same").alias("n_same"), F.collect_set("item_at").alias("found"), F.max("changed").alias("changed"))
    passages = passages.filter((F.col("n_same") >= F.least(F.lit(LITERALS), F.col("n_covered"))) & (F.col("n_same") >= EVIDENCE * F.col("n_covered")))
    leaks = passages.select("doc_id", "item_id", "changed", F.explode("found").alias("item_at"))
    leaks = leaks.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.max("changed").alias("reparameterised")).join(totals, "item_id")
    leaks = leaks.withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    enough = (F.col("n_windows") >= F.least(F.lit(LEAST_WINDOWS), F.col("item_windows"))) & (F.col("coverage") >= LEAST_SHARE)
    return leaks.filter(enough).select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
