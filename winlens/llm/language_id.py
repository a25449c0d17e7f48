"""Language identification with a byte convolutional network trained in numpy.

Texts are lower-cased, ASCII characters other than letters become blanks, and the UTF-8 bytes are cut into windows of
WINDOW bytes. Bytes are embedded; filters of several widths slide over a window, the largest response of each is kept,
and a softmax over these gives the window's languages. A text's prediction is the mean over all its windows, weighted by
their bytes. The fit uses a bounded sample, documented here: about PER_LANG documents for each language, and of each of them at
most WINDOWS_PER_DOC windows, evenly spaced over the whole text. Prediction covers every window of every text.

Defined cases: a null text, or one without any letter, is `und` with score 0; a very long text is predicted from all of its
windows; null languages are not learned; with no labelled text at all everything is `und`; between equal probabilities the
language first in order wins; repeated rows get equal results; a row without id is never held out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import fold, materialize, table, text_rows

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 12
#: Bounds of the fit (documents a language, windows of each of these), and its steps.
PER_LANG, WINDOWS_PER_DOC = 600, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
WIDEST = max(WIDTHS)


def normal_bytes(text: str) -> bytes:
    """Lower-case bytes with single blanks for all that isn't a letter of ASCII or a byte of another character."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(BLANKS).split())


def windows(raw: bytes) -> np.ndarray:
    """All windows of the bytes, the last one filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCnn:
    """Embedding, filters of several widths side by side (narrow ones have zeros behind), max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        hidden = FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(WIDEST) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBED)), "w": rng.normal(0, 0.3, (WIDEST * EMBED, hidden)) * self.mask, "b": np.zeros(hidden),
            "v": rng.normal(0, 0.3, (hidden, len(langs))), "c": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def patches(self, batch: np.ndarray) -> np.ndarray:
        emb = self.p["e"][batch]
        view = np.lib.stride_tricks.sliding_window_view(emb, WIDEST, axis=1)  # n, positions, embed, widest
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(batch), -1, WIDEST * EMBED)

    def forward(self, batch: np.ndarray):
        x = self.patches(batch)
        h = (x.reshape(-1, x.shape[2]) @ self.p["w"]).reshape(len(batch), -1, self.p["w"].shape[1])
        top = h.max(1) + self.p["b"]
        out = np.maximum(top, 0) @ self.p["v"] + self.p["c"]
        out = np.exp(out - out.max(1, keepdims=True))
        return x, h, top, out / out.sum(1, keepdims=True)

    def gradients(self, batch: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by parameter."""
        x, h, top, prob = self.forward(batch)
        n = len(batch)
        prob[np.arange(n), labels] -= 1
        prob /= n
        act = np.maximum(top, 0)
        d_top = (prob @ self.p["v"].T) * (top > 0)
        best = h.argmax(1)
        used = x[np.arange(n)[:, None], best]  # n, hidden, patch
        grads = {"v": act.T @ prob, "c": prob.sum(0), "b": d_top.sum(0), "w": np.einsum("nhp,nh->ph", used, d_top) * self.mask, "e": np.zeros_like(self.p["e"])}
        d_patch = (self.p["w"].T[None] * d_top[:, :, None]).reshape(n, -1, WIDEST, EMBED)
        where = best[:, :, None] + np.arange(WIDEST)
        np.add.at(grads["e"], batch[np.arange(n)[:, None, None], where], d_patch)
        return grads

    def fit(self, data: np.ndarray, labels: np.ndarray, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                batch = data[pick].copy()
                for row in batch[: len(batch) // 3]:  # short texts are learned as well
                    row[int(rng.integers(8, WINDOW)) :] = 0
                step += 1
                for k, g in self.gradients(batch, labels[pick]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, rows: list[np.ndarray], sizes: list[int], chunk: int = 128) -> np.ndarray:
        """Mean window probabilities of each text, given its windows and bytes."""
        out = np.zeros((len(rows), len(self.langs)))
        all_ = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        prob = np.concatenate([self.forward(all_[i : i + chunk])[3] for i in range(0, len(all_), chunk)])
        np.add.at(out, owner, prob * np.maximum(1, (all_ > 0).sum(1))[:, None])
        return out / out.sum(1, keepdims=True)


def sample_windows(docs: DataFrame, per_lang: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and language numbers of about per_lang documents for each language: some KB for each reach the driver."""
    known = docs.filter("lang is not null")
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    chosen = known.join(counts, "lang").filter(draw * F.col("n") < per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, parts = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = windows(normal_bytes(text))
                pick = np.unique(np.linspace(0, len(found) - 1, WINDOWS_PER_DOC).astype(int))
                langs += [lang] * len(pick)
                parts += [found[i].tobytes() for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    rows = chosen.select("lang", "text").mapInArrow(cut, "lang string, part binary").toPandas().sort_values(["lang", "part"])
    langs = sorted(rows["lang"].unique())
    data = np.frombuffer(b"".join(rows["part"]), np.uint8).reshape(-1, WINDOW)
    return data, np.searchsorted(langs, rows["lang"]) if langs else np.zeros(0, int), langs


def train(docs: DataFrame, per_lang: int = PER_LANG) -> ByteCnn:
    """A network from rows (doc_id, text, lang)."""
    data, labels, langs = sample_windows(docs, per_lang)
    model = ByteCnn(langs)
    if langs:
        model.fit(data, labels)
    return model


def identify(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if net.langs and any(map(str.isalpha, t))]
            for at in range(0, len(use), 200):
                part = use[at : at + 200]
                raw = [normal_bytes(texts[i]) for i in part]
                prob = net.predict([windows(r) for r in raw], [len(r) for r in raw])
                for i, p in zip(part, prob, strict=True):
                    pred[i], score[i] = net.langs[int(p.argmax())], float(min(1.0, p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang").filter(fold(F.col("doc_id"), 3) != 1)
    out = identify(docs, train(known))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
