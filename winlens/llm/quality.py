"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are word and word-shape uni- and bigrams, and the mark of a word that repeats one of the two before
it, hashed into BUCKETS slots; a slot's value is the square root of its share of the text's n-grams, so long and short
texts weigh alike. Training: labelled rows (at most MAX_TRAIN, those with the least hash of their id) are dealt to
tasks; each runs FTRL-proximal over its rows and returns its weights, which are averaged and handed out again, ROUNDS
times. Scoring is one sparse dot product per text.

Defined cases: null texts count as empty, and an empty text has the model's bias as its score; a very long text is read whole,
words of any length included; a document with several labels counts as good only if all of them are; labels without a document
and null labels are ignored; with no labels at all every score is 0.5; repeated rows are scored each, and equally; a row without
id is never held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import fold, materialize, small_batches, table, text_rows

BUCKETS = 1 << 17
MAX_TRAIN, TRAIN_TASKS, ROUNDS, PASSES = 20_000, 6, 3, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
KEEP_FROM = 0.7
#: Words whose hashes are remembered by a task; bounds memory only.
CACHED_WORDS = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits as A, a and 0; other characters stay."""
    out, last = [], ""
    for c in word:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k != last:
            out.append(k)
        last = k
    return "".join(out)


class Hasher:
    """Slots and values of a text's features."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask = np.uint64(buckets - 1)
        self.known: dict[str, tuple[int, int]] = {}

    def of_word(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            found = self.known[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape(word), 1))
        return found

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        both = np.array([self.of_word(w) for w in words], np.uint64)
        parts = [both[:, 0], both[:, 1]]
        with np.errstate(over="ignore"):
            parts += [x[:-1] * _MIX ^ (x[1:] + np.uint64(k)) for k, x in enumerate(parts[:2])]
            again = np.zeros(len(words), bool)
            for d in (1, 2):
                again[d:] |= both[d:, 0] == both[:-d, 0]
            parts.append(np.where(again, np.uint64(11), np.uint64(12)))
            all_ = np.concatenate(parts) * _MIX
        slots, n = np.unique((all_ ^ all_ >> np.uint64(29)) & self.mask, return_counts=True)
        return slots.astype(np.int64), np.sqrt(n / len(words)).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, passes: int, seed: int) -> None:
    """FTRL-proximal over (slots, values, label) rows; z and n, with the bias in the last place, are changed in place."""
    order = np.random.default_rng(seed)
    good = sum(y for *_, y in rows)
    weight = (len(rows) / (2 * max(1, len(rows) - good)), len(rows) / (2 * max(1, good)))  # classes weigh alike
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            slots, values, y = rows[i]
            at, x = np.append(slots, len(z) - 1), np.append(values, np.float32(1))
            w = weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * weight[y] * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def trainer(start, seed: int):
    """applyInArrow function: one task's rows, from the weights in the broadcast start."""

    def train(batch):
        view = lambda column, kind: [np.frombuffer(v.as_buffer(), kind) for chunk in batch.column(column).chunks for v in chunk]  # noqa: E731  no copies
        slots, values, labels = view("slots", np.int32), view("values", np.float32), batch.column("label").to_pylist()
        rows = [(slots[i], values[i], labels[i]) for i in np.argsort(batch.column("doc_id").to_numpy(), kind="stable").tolist()]
        z, n = (x.copy() for x in start.value)
        ftrl(rows, z, n, PASSES, seed)
        return pa.table({"n": [len(rows)], "model": pa.array([np.stack([z, n]).astype(np.float32).tobytes()], pa.binary())})

    return train


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights (and the bias, last) from rows (doc_id, text, label). Only models of fixed size reach the driver, one per task."""
    spark = labelled.sparkSession

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            found = [hasher.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), b.column(2)], ["doc_id", "slots", "values", "label"])

    rows = materialize(labelled.mapInArrow(to_features, "doc_id long, slots binary, values binary, label int").repartition(TRAIN_TASKS, "doc_id"), "features")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(TRAIN_TASKS)).cast("int"))
    state = np.zeros((2, BUCKETS + 1))
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(state)

        models = rows.groupBy("part").applyInArrow(trainer(start, k), "n long, model binary").collect()
        seen = sum(m["n"] for m in models)
        if not seen:
            break
        state = sum(np.frombuffer(m["model"], np.float32).reshape(2, -1).astype(float) * (m["n"] / seen) for m in models)
        start.unpersist()
    return weights(*state)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), into: str = "score") -> DataFrame:
    """doc_id, the score (in column `into`) and carry for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = text_rows(docs, id_col, text_col) if not carry else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), shared.value
        for b in batches:
            scores = []
            for text in b.column(1).to_pylist():
                slots, values = hasher.features(text)
                scores.append(1 / (1 + np.exp(-np.clip(w[slots] @ values + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), *b.columns[2:]], ["doc_id", "score", *b.schema.names[2:]])

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(run, f"doc_id long, score double{extra}").select("doc_id", F.col("score").alias(into), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def train_on(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """A model from the labelled documents whose fold is not 2: at most max_train, a documented bound on the fit alone."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(fold(F.col("doc_id"), 4) != 2)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = F.broadcast(materialize(known, "labels"))  # max_train rows of two numbers
    return fit(text_rows(docs).join(chosen, "doc_id").select("doc_id", "text", "label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
