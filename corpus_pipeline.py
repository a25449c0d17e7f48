"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir), decides over all that its predecessor kept, and returns the columns of documents;
the last one returns token ids. Near copies are judged on five-word shingles, the size that holds for stages (four words are what
the contract of the query op2 asks for).

Defined cases: a null text counts as empty; an empty text has the classifier's bias as its score, equals other empty texts, has
no shingle and no benchmark item, and no ids; very long texts pass all stages whole; rows without id are kept unless their text has
a copy with an id or is of low quality, as they can be neither near copies nor leaks of a known document; rows repeated with their
id are one document and share its fate; an empty table of documents gives no rows, and without labels every score is 0.5, so
nothing is kept; tables may have more columns, which stages carry to the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm import decontamination, exact_dedup, near_dedup, prefix_bpe, quality
from winlens.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; the classifier learns from labelled ones among docs."""
    model = quality.train_on(docs, table(spark, sf_dir, "labels"))
    own = "_" * (1 + max(map(len, docs.columns)))  # no column of docs has this name
    scored = quality.score(docs, model, carry=tuple(c for c in docs.columns if c != "doc_id"), into=own)
    return scored.filter(F.col(own) >= quality.KEEP_FROM).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with similarity 0.8 or more on five-word shingles, the one with the smallest id."""
    dropped = near_dedup.near_components(docs, words=5, threshold=80).filter("not kept").select("doc_id")
    return docs.join(materialize(dropped, "near-dropped"), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that carry no benchmark item."""
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(materialize(leaks, "leaks"), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from them."""
    coded = prefix_bpe.bpe_encode(docs, prefix_bpe.default_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
