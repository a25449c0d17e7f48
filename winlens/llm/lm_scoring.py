"""Language-model scores with stupid backoff.

Every document is scored by the n-gram counts of all other documents: its own occurrences are taken off the corpus
counts, otherwise no n-gram would ever be unseen. With c' for such counts and B the backoff,

    S(w | h) = c'(h w) / c'(h)   if c'(h w) > 0,   else B * S(w | shorter h);   S(w) = c'(w) / N', or B / N' if unseen

and a document's score is the sum of log S over its words. The relations:

    blocks   (block, documents, words as numbers into the block's vocabulary)          narrow
    grams    (block, bucket, n-gram hashes, counts)    blocks exploded, pre-aggregated, partitioned by hash
    totals   (block, bucket, corpus counts)            grams grouped by bucket, joined back to each block's rows
    scores   (document, sum)                           totals joined to blocks, summed per document

Hashes of one bucket travel as one packed column instead of a row each. An n-gram gives one entry for each block it is
in, however often it occurs, and the number of buckets follows the input, so no task holds a share of the corpus.
`relational_scores` is the same with one row for each n-gram of a document, in DataFrame functions alone; the README has the
figures of both.

Defined cases: words are runs of non-blank characters with A-Z lower-cased; a null or blank text has no words and score
0 (mean null); a very long text is scored whole, and ends its block; repeated rows count as documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table, text_rows

ORDER, BACKOFF = 2, 0.4
#: A block ends after so many words or different words (two bytes number these), and bytes of text for each bucket.
BLOCK_WORDS, BLOCK_VOCABULARY, BUCKET_BYTES = 300_000, 60_000, 2 << 20
CACHED_WORDS = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """The values' bytes plane by plane: of sorted hashes and small counts the high planes hardly vary, and shuffles compress them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(data, dtype) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def cut_blocks(block_words: int):
    """(doc_id, text) to blocks: block, doc_ids, words of each, the vocabulary's hashes, the words as numbers.

    A block's id is made of its task, its place in it and its contents, so that blocks cut twice from one scan are the same.
    """

    def pack(place: int, ids: list, sizes: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        vocab, words = np.unique(np.concatenate(hashes), return_inverse=True)
        words = words.astype(np.uint16 if len(vocab) <= 1 << 16 else np.uint32)
        task = TaskContext.get()
        name = xxhash.xxh3_64(f"{task.partitionId() if task else 0}:{place}:{ids}:{sizes}".encode())
        name.update(vocab.tobytes())
        name.update(words.tobytes())
        columns = [pa.array([name.intdigest() - (1 << 63)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed(vocab)], pa.binary()), pa.array([packed(words)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "vocab", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, sizes, hashes, n, seen, place = [], [], [], 0, set(), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = []
                for w in text.encode("utf-8", "replace").lower().split():
                    h = known.get(w)
                    if h is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    row.append(h)
                ids.append(doc_id)
                sizes.append(len(row))
                hashes.append(np.array(row, np.uint64))
                seen.update(row)
                n += len(row)
                if n >= block_words or len(seen) >= BLOCK_VOCABULARY or len(ids) >= block_words:
                    yield pack(place, ids, sizes, hashes)
                    ids, sizes, hashes, n, seen, place = [], [], [], 0, set(), place + 1
        if ids:
            yield pack(place, ids, sizes, hashes)

    return run


class Block:
    """A block's n-grams of all orders."""

    def __init__(self, row: dict, order: int):
        vocab = unpacked(row["vocab"], np.uint64)
        self.sizes = np.array(row["sizes"], np.int64)
        total = int(self.sizes.sum())
        wide = np.uint16 if len(row["words"]) == 2 * total else np.uint32
        hashes = vocab[unpacked(row["words"], wide)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(total) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        #: for each order, where its n-grams end and their hashes
        self.ends: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        run = hashes
        with np.errstate(over="ignore"):
            for n in range(1, order + 1):
                if n > 1:
                    run = np.concatenate([np.zeros(1, np.uint64), run[:-1]]) if total else run
                    run = (run ^ np.uint64(n)) * _MIX
                    run = (run ^ run >> np.uint64(29)) + hashes * np.uint64(2 * n + 1)
                    run ^= run >> np.uint64(32)
                end = np.flatnonzero(place >= n - 1)
                self.ends.append(end)
                grams.append(run[end])
        self.unique, inverse, self.counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        self.index = np.split(inverse, np.cumsum([len(g) for g in grams])[:-1])


def explode_grams(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, order)
                if not len(block.unique):
                    continue
                bucket = (block.unique >> np.uint64(64 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                counts = block.counts.astype(np.int32)
                cut = [(int(bucket[s]), packed(block.unique[s:e]), packed(counts[s:e])) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(cut), pa.int64()), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.binary()), pa.array([c[2] for c in cut], pa.binary())], ["block", "bucket", "grams", "counts"])

    return run


def total_counts(rows):
    """All blocks' rows of one bucket: the same rows with corpus counts (as int32, or int64 beyond) in place of the block's."""
    grams = [unpacked(x.as_buffer(), np.uint64) for x in rows.column("grams")]
    counts = np.concatenate([unpacked(x.as_buffer(), np.int32) for x in rows.column("counts")])
    unique, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(inverse, counts, len(unique)).astype(np.int64)
    totals = totals.astype(np.int32) if totals.max() < 1 << 31 else totals
    parts = np.split(totals[inverse], np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "n": pa.array([len(g) for g in grams], pa.int32()), "totals": pa.array([packed(p) for p in parts], pa.binary())})


def score_block(row: dict, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document of a block that has its totals: words, sum of log scores without the sizes N', and how many scores have a size."""
    block = Block(row, order)
    parts = sorted((t["bucket"], t["n"], t["totals"]) for t in row["totals"])
    totals = np.concatenate([unpacked(t, np.int32 if len(t) == 4 * n else np.int64).astype(np.float64) for _, n, t in parts]) if parts else np.zeros(0)
    words, docs = len(block.doc), len(block.sizes)
    if words and not parts:
        raise ValueError("a block has no totals: its documents were not cut the same way twice")
    others = []  # for each order, counts in other documents of the n-gram that ends at a word; -1 where there is none
    for n in range(order):
        end, index = block.ends[n], block.index[n]
        _, inverse, own = np.unique(block.doc[end] * np.int64(len(block.unique) or 1) + index, return_inverse=True, return_counts=True)
        found = np.full(words, -1.0)
        found[end] = totals[index] - own[inverse]
        others.append(found)
    score, sized = np.where(others[0] > 0, others[0], backoff), np.ones(words, bool)
    for n in range(1, order):
        history = np.concatenate([[-1.0], others[n - 1][:-1]]) if words else np.zeros(0)
        has = others[n] >= 0
        seen = others[n] > 0
        score = np.where(seen, others[n] / np.where(seen, np.maximum(history, 1), 1), np.where(has, backoff * score, score))
        sized = sized & ~seen
    if not words:
        return block.sizes, np.zeros(docs), np.zeros(docs, np.int64)
    return block.sizes, np.bincount(block.doc, np.log(score), docs), np.bincount(block.doc, sized, docs).astype(np.int64)


def stable(df: DataFrame) -> DataFrame:
    """df, stored first if it comes out of a shuffle: read twice, the rows of a task must come in one order."""
    return materialize(df, "lm-texts") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_words: int = BLOCK_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score) of every row; order is that of the longest n-gram."""
    texts = stable(text_rows(docs, id_col, text_col))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    # cut where it is needed, once for the counts and once for the scores: words are not written anywhere in between
    blocks = texts.mapInArrow(cut_blocks(block_words), "block long, doc_ids array<long>, sizes array<int>, vocab binary, words binary")
    grams = blocks.mapInArrow(explode_grams(order, bits), "block long, bucket long, grams binary, counts binary")
    totals = grams.groupBy("bucket").applyInArrow(total_counts, "block long, bucket long, n int, totals binary")
    back = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "totals")).alias("totals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                row["totals"] = row["totals"] or []
                words, score, sized = score_block(row, order, backoff)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64()), pa.array(sized, pa.int64())], ["doc_id", "n_words", "score", "sized"])

    parts = materialize(blocks.join(back, "block", "left").mapInArrow(run, "doc_id long, n_words long, score double, sized long"), "lm-scores")
    corpus = parts.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(1), F.lit(corpus) - F.col("n_words"))
    return parts.select("doc_id", "n_words", (F.col("score") - F.col("sized") * F.log(rest)).alias("log_score"))


def relational_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """lm_scores with a row for each n-gram: counts by n-gram joined to exploded n-grams, summed per document. Joins are on 64-bit hashes."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = materialize(text_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lower, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)).alias("words")), "lm-words")
    place = texts.filter(F.size("words") > 0).select("row", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("i"))
    hashed = lambda n: F.xxhash64(F.lit(n), F.array_join(F.slice("words", F.col("i") - n + 1, F.lit(n)), " "))
    grams = F.array(*(F.when(F.col("i") >= n, hashed(n)) for n in range(1, order + 1)))
    seen = place.select("row", "i", F.posexplode(grams).alias("n", "gram")).filter("gram is not null")
    own = seen.groupBy("row", "n", "gram").agg(F.count("*").alias("own"))
    total = own.groupBy("n", "gram").agg(F.sum("own").alias("total"))
    other = own.join(total, ["n", "gram"]).select("row", "n", "gram", (F.col("total") - F.col("own")).alias("other"))
    counts = seen.join(other, ["row", "n", "gram"]).groupBy("row", "i").agg(F.map_from_entries(F.collect_list(F.struct("n", "other"))).alias("c"))
    history = F.lag("c").over(Window.partitionBy("row").orderBy("i"))
    size = texts.agg(F.sum(F.size("words")).alias("size"))
    rows = counts.withColumn("h", history).join(texts.select("row", F.size("words").alias("n_words")), "row").crossJoin(F.broadcast(size))
    score = F.element_at("c", 0).cast("double")
    score = F.when(score > 0, score).otherwise(backoff) / F.greatest(F.lit(1), F.col("size") - F.col("n_words"))
    for n in range(1, order):
        c = F.try_element_at("c", F.lit(n))
        score = F.when(c > 0, c / F.greatest(F.lit(1), F.try_element_at("h", F.lit(n - 1)))).when(c.isNotNull(), backoff * score).otherwise(score)
    sums = rows.groupBy("row").agg(F.sum(F.log(score)).alias("log_score"))
    return texts.join(sums, "row", "left").select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scores.select("doc_id", "n_words", mean.alias("mean_log_score"))


SQL = """
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
seq AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM words),
c1 AS (SELECT w, count(*) AS n FROM words GROUP BY w), d1 AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
c2 AS (SELECT h, w, count(*) AS n FROM seq WHERE h IS NOT NULL GROUP BY ALL), d2 AS (SELECT doc_id, h, w, count(*) AS n FROM seq WHERE h IS NOT NULL GROUP BY ALL),
size_ AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), total AS (SELECT count(*) AS n FROM words),
counts AS (
  SELECT s.doc_id, s.h, c2.n - d2.n AS both_, ch.n - dh.n AS hist, cw.n - dw.n AS word, greatest(1, total.n - size_.n) AS rest
  FROM seq s JOIN size_ USING (doc_id) CROSS JOIN total
  JOIN c1 cw ON cw.w = s.w JOIN d1 dw ON dw.doc_id = s.doc_id AND dw.w = s.w
  LEFT JOIN c1 ch ON ch.w = s.h LEFT JOIN d1 dh ON dh.doc_id = s.doc_id AND dh.w = s.h
  LEFT JOIN c2 ON c2.h = s.h AND c2.w = s.w LEFT JOIN d2 ON d2.doc_id = s.doc_id AND d2.h = s.h AND d2.w = s.w),
scored AS (
  SELECT doc_id, count(*) AS n, sum(ln(CASE WHEN both_ > 0 THEN both_ / greatest(hist, 1)
    ELSE (CASE WHEN h IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN word > 0 THEN word::DOUBLE ELSE 0.4::DOUBLE END) / rest END)) AS total
  FROM counts GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(s.total / s.n, 6) AS mean_log_score FROM documents d LEFT JOIN scored s USING (doc_id)
"""
