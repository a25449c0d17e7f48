import collections
import hashlib
import re

import __spark_entry__ as entry
from tests.conftest import DATA, normal
from winlens.functions import text as tx
from winlens.plans import q_events, q_models


def matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, DATA).toPandas()
    assert normal(ours).equals(normal(duck.execute(entry.oracle_sql()[name]).df()))
    return ours


def test_incident_facts_of_the_whole_log(spark, duck):
    ours = matches_sql(spark, duck, "x9_incident_facts_all")
    says = {"windows": lambda r: f"classified {r.k} windows", "proposed": lambda r: f"proposed {r.action}", "executed": lambda r: f"executed {r.action}"}
    lines, done = collections.defaultdict(list), set()
    for r in sorted(q_events.log(spark, DATA).collect(), key=lambda r: r.seq):
        if r.type in says:
            lines[r.incident].append(says[r.type](r))
            done |= {r.incident} if r.type == "executed" else set()
    assert dict(zip(ours.incident, ours.facts, strict=True)) == {i: "\n".join(x + ["nothing was executed"] * (i not in done)) for i, x in lines.items()}


def test_all_blocks_are_placed(spark, duck):
    ours = matches_sql(spark, duck, "j11_block_placement_all")
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert ours.votes.sum() == n and sorted(ours.block) == list(range(-(-n // 50)))


def test_texts_with_digits_are_masked(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()

    def mask(t):
        for rx in (tx.MAC, tx.IPV6, tx.IPV4):
            t = re.sub(rx, tx.MARK, t.translate(str.maketrans(tx._WIDE, "0123456789.:")))
        return len(t), t.count(tx.MARK), hashlib.sha256(t.encode()).hexdigest()

    for name, first in (("x1_x11_masked_texts", str), ("x2_labels_in_all_texts", lambda t: t.replace("the", "<A>").replace("de", "<B>"))):
        got = {r["doc_id"]: (r["n"], r["n_marks"], r["digest"]) for r in entry.queries()[name](spark, DATA).collect()}
        assert got == {r["doc_id"]: mask(first(r["text"])) for r in docs} and any(n for _, n, _ in got.values())


def test_all_of_a_half_is_searched(spark, duck):
    ours = matches_sql(spark, duck, "j6_nearest_all")
    assert len(ours) == q_models.halves(spark, DATA)[0].count()
