"""Queries over class probabilities and feature vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winlens.operators import decisions as de
from winlens.operators import matching as ma
from winlens.operators import metrics as me
from winlens.operators import profile as pr
from winlens.plans import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}
CLASSES = list(range(10))
N = 8
#: Columns of a whole vector.
WIDTH = 64
#: Feature columns taken from the vectors, coarse keys that repeat, and two models' probabilities.
FEATS = [f"f{i}" for i in range(N)]
KEY = ["q0", "q1", "q2"]

_F = ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(N))
_Q = ", ".join(f"CAST(floor(embedding[{i + 1}]::DOUBLE * 6) AS BIGINT) AS q{i}" for i in range(6))
V = f"""WITH raw AS (SELECT vec_id, label AS truth, vec_id % 12 AS capture, vec_id // 12 AS win, {_F}, {_Q},
  [exp(8 * x::DOUBLE) FOR x IN embedding[1:10]] AS e1, [exp(8 * x::DOUBLE) FOR x IN embedding[11:20]] AS e2 FROM embeddings),
v AS (SELECT *, [x / list_sum(e1) FOR x IN e1] AS p, [x / list_sum(e2) FOR x IN e2] AS p2, list_position(e1, list_max(e1)) - 1 AS predicted, list_position(e2, list_max(e2)) - 1 AS predicted2 FROM raw)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vectors(spark, d):
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    raw = ad.table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("truth"), (F.col("vec_id") % 12).alias("capture"), F.floor(F.col("vec_id") / 12).alias("win"), e.alias("e"))
    cols = [F.get("e", i).alias(f"f{i}") for i in range(N)] + [F.floor(F.get("e", i) * 6).alias(f"q{i}") for i in range(6)]
    soft = lambda a: F.transform(F.slice("e", a, 10), lambda x: F.exp(x * 8))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    out = raw.select("vec_id", "truth", "capture", "win", *cols, soft(1).alias("e1"), soft(11).alias("e2")).withColumns({"s1": total("e1"), "s2": total("e2")})
    out = out.withColumns({"p": F.transform("e1", lambda x: x / F.col("s1")), "p2": F.transform("e2", lambda x: x / F.col("s2"))}).drop("e1", "e2", "s1", "s2")
    return out.withColumns({"predicted": de.argmax(F.col("p"), CLASSES), "predicted2": de.argmax(F.col("p2"), CLASSES)})


@query("p16_argmax", f"{V} SELECT vec_id, predicted FROM v")
def p16(spark, d):
    return vectors(spark, d).select("vec_id", F.col("predicted").cast("long").alias("predicted"))


_TH = "CASE WHEN 1 - p[1] >= {t} - 1e-12 THEN list_position(p[2:10], list_max(p[2:10])) ELSE 0 END"


@query("p17_threshold", f"{V} SELECT vec_id, {_TH.format(t=0.9)} AS predicted FROM v")
def p17(spark, d):
    return vectors(spark, d).select("vec_id", de.by_threshold(F.col("p"), CLASSES, 0, 0.9).cast("long").alias("predicted"))


@query("p18_category_threshold", f"{V} SELECT vec_id, CASE WHEN predicted IN (1, 2, 3) AND list_max(p) < 0.1 * (predicted + 2) - 1e-12 THEN 0 ELSE predicted END AS predicted FROM v")
def p18(spark, d):
    limits = spark.createDataFrame([(1, 0.1 * 3), (2, 0.1 * 4), (3, 0.1 * 5)], "category int, t double")
    return de.by_category(vectors(spark, d).drop("predicted"), limits, "p", CLASSES, 0).select("vec_id", F.col("predicted").cast("long").alias("predicted"))


@query("p19_rule_inputs", f"{V} SELECT vec_id, round(1 - p[1], 9) AS p_attack, predicted <> 0 AS argmax_attack FROM v")
def p19(spark, d):
    a, b = de.for_choice(F.col("p"), CLASSES, 0)
    return vectors(spark, d).select("vec_id", F.round(a, 9).alias("p_attack"), b.alias("argmax_attack"))


@query("a14_contingency", f"{V} SELECT CAST(truth AS BIGINT) AS truth, predicted, count(*) AS n FROM v GROUP BY ALL")
def a14(spark, d):
    return me.contingency(vectors(spark, d)).select(F.col("truth").cast("long").alias("truth"), F.col("predicted").cast("long").alias("predicted"), "n")


@query("a15_confusion_weighted", f"""{V}, c AS (SELECT truth, predicted, count(*) AS n FROM v GROUP BY ALL), o AS (SELECT truth, sum(n) AS own FROM c GROUP BY 1)
SELECT CAST(least(truth, 6) AS BIGINT) AS truth, predicted, round(sum(n * ((truth + 1) * 1000.0) / own), 6) AS n FROM c JOIN o USING (truth) GROUP BY ALL""")
def a15(spark, d):
    pop = spark.range(10).select(F.col("id").cast("int").alias("truth"), ((F.col("id") + 1) * 1000.0).alias("total"))
    m = me.confusion(me.contingency(vectors(spark, d)), F.least("truth", F.lit(6)), pop)
    return m.select(F.col("truth").cast("long").alias("truth"), F.col("predicted").cast("long").alias("predicted"), F.round("n", 6).alias("n"))


_METRICS = """, c AS (SELECT {by} truth, predicted, count(*) AS n FROM v {where} GROUP BY ALL), k AS (SELECT {by} c FROM (SELECT DISTINCT {by} truth AS c FROM c UNION SELECT DISTINCT {by} predicted FROM c)),
m AS (SELECT k.*, coalesce((SELECT sum(n) FROM c WHERE truth = k.c {on}), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = k.c {on}), 0) AS predicted_n, coalesce((SELECT sum(n) FROM c WHERE truth = k.c AND predicted = k.c {on}), 0) AS hit FROM k),
r AS (SELECT *, CASE WHEN predicted_n > 0 THEN hit / predicted_n WHEN support > 0 THEN 0 END AS precision, CASE WHEN support > 0 THEN hit / support END AS recall, (predicted_n - hit) / nullif(sum(support) OVER ({part}) - support, 0) AS fpr FROM m),
f AS (SELECT *, CASE WHEN support > 0 THEN CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END END AS f1 FROM r)"""
_M = _METRICS.format(by="", where="", on="", part="")


@query("a16_class_metrics", f"""{V}{_M} SELECT CAST(c AS BIGINT) AS class, CAST(support AS DOUBLE) AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM f""")
def a16(spark, d):
    m = me.class_metrics(me.confusion(me.contingency(vectors(spark, d))))
    return m.select(F.col("class").cast("long").alias("class"), "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fpr")))


@query("a16_overall_metrics", f"""{V}{_M} SELECT round(sum(hit) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(1 - max(recall) FILTER (c = 0), 9) AS benign_as_attack, round(max(predicted_n - hit) FILTER (c = 0) / (sum(support) - max(support) FILTER (c = 0)), 9) AS attack_as_benign FROM f""")
def a16o(spark, d):
    m = me.overall_metrics(me.confusion(me.contingency(vectors(spark, d))), 0)
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


_MC = _METRICS.format(by="capture, ", where="", on="AND c.capture = k.capture", part="PARTITION BY capture")


@query("a17_metrics_per_group", f"""{V}{_MC} SELECT capture, round(sum(hit) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(1 - max(recall) FILTER (c = 0), 9) AS benign_as_attack, round(max(predicted_n - hit) FILTER (c = 0) / (sum(support) - max(support) FILTER (c = 0)), 9) AS attack_as_benign FROM f GROUP BY capture""")
def a17(spark, d):
    m = me.overall_metrics(me.confusion(me.contingency(vectors(spark, d), by=["capture"]), by=["capture"]), 0, ["capture"])
    return m.select("capture", *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "benign_as_attack", "attack_as_benign")))


@query("l12_quality_panel", f"""{V}{_M} SELECT CAST(c AS BIGINT) AS class, CAST(support AS DOUBLE) AS support, round(coalesce(precision, 0), 9) AS precision, round(coalesce(recall, 0), 9) AS recall, round(coalesce(f1, 0), 9) AS f1 FROM f""")
def l12(spark, d):
    m = me.panel_metrics(me.confusion(me.contingency(vectors(spark, d))))
    return m.select(F.col("class").cast("long").alias("class"), "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("a18_predicted_share", f"{V} SELECT capture, count(*) AS n, count(*) FILTER (predicted = truth) AS expected_n, round(count(*) FILTER (predicted = truth) / count(*), 9) AS share FROM v GROUP BY 1")
def a18(spark, d):
    return me.predicted_share(vectors(spark, d), "capture", F.col("truth")).withColumn("share", F.round("share", 9))


_Z = me.Z


@query("a23_wilson", f"""{V}, r AS (SELECT CAST(truth AS BIGINT) AS truth, count(*) AS n, count(*) FILTER (predicted = truth) AS hits FROM v GROUP BY 1), i AS (SELECT *, hits / n AS p, {_Z} AS z FROM r)
SELECT truth, hits, n, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS high FROM i""")
def a23(spark, d):
    r = vectors(spark, d).groupBy(F.col("truth").cast("long").alias("truth")).agg(F.count_if(F.col("predicted") == F.col("truth")).alias("hits"), F.count("*").alias("n"))
    low, high = me.wilson(F.col("hits"), F.col("n"))
    return r.select("truth", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a29_swaps", f"""{V} SELECT count(*) FILTER (truth = 1 AND predicted = 2) AS one_as_two, count(*) FILTER (truth = 2 AND predicted = 1) AS two_as_one, count(*) FILTER (truth // 5 <> predicted // 5) AS across_groups, count(*) FILTER (truth = 0 AND predicted <> 0) AS benign_out FROM v""")
def a29(spark, d):
    c = me.contingency(vectors(spark, d))
    s = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0))
    return c.agg(s("truth = 1 and predicted = 2").alias("one_as_two"), s("truth = 2 and predicted = 1").alias("two_as_one"), s("floor(truth / 5) <> floor(predicted / 5)").alias("across_groups"), s("truth = 0 and predicted <> 0").alias("benign_out"))


_CURVE = "curve AS (SELECT g / 100 AS t, count(*) FILTER (1 - p[1] >= g / 100 - 1e-12 AND truth = 0) AS benign, count(*) FILTER (1 - p[1] >= g / 100 - 1e-12 AND truth <> 0) AS attack FROM v, range(1, 101) r(g) GROUP BY 1)"


def choice_rows(spark, d):
    a, b = de.for_choice(F.col("p"), CLASSES, 0)
    return vectors(spark, d).select(a.alias("p_attack"), b.alias("argmax_attack"), (F.col("truth") == 0).alias("is_benign"))


@query("a30_threshold_curve", f"{V}, {_CURVE} SELECT * FROM curve")
def a30(spark, d):
    return de.threshold_curve(choice_rows(spark, d), "p_attack", {"benign": F.col("is_benign"), "attack": ~F.col("is_benign")})


@query("a31_smallest_threshold", f"{V}, {_CURVE}, b AS (SELECT count(*) AS n FROM v WHERE truth = 0) SELECT target, (SELECT min(t) FROM curve, b WHERE benign <= target * n) AS t FROM (SELECT unnest([0.5, 0.25, 0.1, 0.01]) AS target)")
def a31(spark, d):
    rows = choice_rows(spark, d)
    curve = de.threshold_curve(rows, "p_attack", {"benign": F.col("is_benign"), "attack": ~F.col("is_benign")})
    total = rows.agg(F.count_if("is_benign").alias("n_benign"))
    targets = spark.createDataFrame([(0.5,), (0.25,), (0.1,), (0.01,)], "target double")
    found = curve.join(F.broadcast(total)).join(F.broadcast(targets), F.col("benign") <= F.col("target") * F.col("n_benign")).groupBy("target").agg(F.min("t").alias("t"))
    return targets.join(found, "target", "left")


@query("a32_rule_choice", f"""{V}, {_CURVE}, one AS (SELECT count(*) FILTER (truth = 0 AND predicted <> 0) AS benign, count(*) FILTER (truth <> 0 AND predicted <> 0) AS attack, count(*) FILTER (truth = 0) AS nb FROM v),
al AS (SELECT 'threshold' AS rule, t, benign, attack FROM curve UNION ALL SELECT 'argmax', NULL, benign, attack FROM one)
SELECT rule, t, benign AS benign_as_attack, attack AS recognised FROM al WHERE benign <= 0.5 * (SELECT nb FROM one) ORDER BY attack DESC, benign, rule <> 'argmax', coalesce(t, 0) LIMIT 1""")
def a32(spark, d):
    return de.choose_rule(choice_rows(spark, d), "p_attack", "argmax_attack", "is_benign", 0.5)


@query("j12_aligned_pairs", f"{V} SELECT vec_id, predicted AS a, predicted2 AS b FROM v")
def j12(spark, d):
    v = vectors(spark, d)
    return me.align(v.select("vec_id", F.col("predicted").cast("long").alias("a")), v.select("vec_id", F.col("predicted2").cast("long").alias("b")), ["vec_id"])


@query("j21_agreement", f"{V} SELECT count(*) AS n, count(*) FILTER (predicted <> predicted2) AS n_differ FROM v")
def j21(spark, d):
    v = vectors(spark, d)
    return me.agreement(v.select("vec_id", "predicted"), v.select("vec_id", F.col("predicted2").alias("predicted")), ["vec_id"])


@query("j16_population_weights", f"{V}, o AS (SELECT truth, count(*) AS own FROM v GROUP BY 1) SELECT vec_id, round((truth + 1) * 1000.0 / own, 9) AS weight FROM v JOIN o USING (truth)")
def j16(spark, d):
    pop = spark.range(10).select(F.col("id").cast("int").alias("truth"), ((F.col("id") + 1) * 1000.0).alias("total"))
    return ma.row_weights(vectors(spark, d), pop, "truth").select("vec_id", F.round("weight", 9).alias("weight"))


@query("p10_feature_matrix", "SELECT vec_id, " + ", ".join(f"CASE WHEN vec_id % 67 = {i} THEN NULL ELSE embedding[{i + 1}] END AS f{i}" for i in range(WIDTH)) + " FROM embeddings")
def p10(spark, d):
    # an infinity injected by a rule becomes empty
    e = ad.table(spark, d, "embeddings")
    val = lambda i: F.when(F.col("vec_id") % 67 == i, F.lit(float("inf"))).otherwise(F.get("embedding", i).cast("double"))
    cols = [val(i).cast("float") for i in range(WIDTH)]
    return e.select("vec_id", *(F.when(F.abs(c) != float("inf"), c).alias(f"f{i}") for i, c in enumerate(cols)))


@query("p13_vector_groups", f"{V} SELECT q0, q1, q2, count(*) AS n FROM v GROUP BY ALL")
def p13(spark, d):
    v = vectors(spark, d).withColumn("h", ma.row_hash(KEY))
    return v.groupBy("h").agg(*(F.first(k).alias(k) for k in KEY), F.count("*").alias("n")).drop("h")


_HALF = WIDTH // 2
_DIVERGE = ", ".join(f"CASE WHEN abs(e[{i + 1}] - e[{i + 1 + _HALF}]) > greatest(0.5 * greatest(abs(e[{i + 1}]), abs(e[{i + 1 + _HALF}])), 1e-12) THEN 'f{i}' END" for i in range(_HALF))


@query("p14_diverging_columns", f"""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), w AS (SELECT vec_id, [x FOR x IN [{_DIVERGE}] IF x IS NOT NULL] AS cols FROM v) SELECT vec_id, cols FROM w""")
def p14(spark, d):
    # the first half of a vector against its second half
    at = lambda i: F.get("embedding", i).cast("double")
    names = F.array_compact(F.array(*(F.when(~pr.values_equal(at(i), at(i + _HALF), 0.5), F.lit(f"f{i}")) for i in range(_HALF))))
    return ad.table(spark, d, "embeddings").select("vec_id", names.alias("cols"))


@query("p23_round_finite", f"{V} SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE round(f0, 6) END AS v FROM v")
def p23(spark, d):
    x = F.when(F.col("vec_id") % 14 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("f0"))
    return vectors(spark, d).select("vec_id", F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, 6)).alias("v"))


@query("a7_column_profile", f"""{V}, x AS (SELECT 'f' || i AS col, CASE WHEN vec_id % 9 = i THEN NULL WHEN vec_id % 10 = i THEN CAST('inf' AS DOUBLE) ELSE [f0, f1, f2, f3, 0.5][i + 1] END AS v FROM v, range(5) t(i))
SELECT col, count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (isinf(v)) AS n_inf, min(v) FILTER (NOT isinf(v)) AS least, max(v) FILTER (NOT isinf(v)) AS greatest, count(*) FILTER (v <> 0) AS n_nonzero, count(*) FILTER (v < 0) AS n_negative,
  count(*) FILTER (v IS NULL) = 0 AND count(*) FILTER (isinf(v)) = 0 AND min(v) = max(v) AS constant FROM x GROUP BY 1""")
def a7(spark, d):
    v = vectors(spark, d).withColumn("f4", F.lit(0.5))
    cols = [f"f{i}" for i in range(5)]
    inject = {c: F.when(F.col("vec_id") % 9 == i, None).when(F.col("vec_id") % 10 == i, float("inf")).otherwise(F.col(c)) for i, c in enumerate(cols)}
    return pr.column_profile(v.withColumns(inject), cols)


@query("a8_identical_columns", "SELECT 'f0' AS a, 'g0' AS b UNION ALL SELECT 'f1', 'g1'")
def a8(spark, d):
    v = vectors(spark, d).withColumns({"g0": F.col("f0"), "g1": F.col("f1") + 0.0, "g2": F.col("f2") + F.when(F.col("vec_id") == 3, 1).otherwise(0)})
    return pr.identical_columns(v, ["f0", "f1", "f2", "f3", "g0", "g1", "g2"])


_DUP = f"{V}, g AS (SELECT q0, q1, q2, count(*) AS n, count(DISTINCT truth) AS labels, count(DISTINCT truth // 4) AS cats FROM v GROUP BY ALL)"


@query("a11_duplicate_vectors", f"""{_DUP} SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_groups, CAST(sum(n) - count(*) AS BIGINT) AS n_repeats, CAST(coalesce(sum(n) FILTER (labels > 1), 0) AS BIGINT) AS other_label, CAST(coalesce(sum(n) FILTER (cats > 1), 0) AS BIGINT) AS other_category, max(n) AS largest FROM g""")
def a11(spark, d):
    return pr.duplicate_summary(vectors(spark, d).withColumn("cat", F.floor(F.col("truth") / 4)), KEY, "truth", "cat")


@query("a11_text_duplicates", """WITH g AS (SELECT text, count(*) AS n, count(DISTINCT lang) AS l, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_groups, CAST(sum(n) - count(*) AS BIGINT) AS n_repeats, CAST(coalesce(sum(n) FILTER (l > 1), 0) AS BIGINT) AS other_label, CAST(coalesce(sum(n) FILTER (s > 1), 0) AS BIGINT) AS other_category, max(n) AS largest FROM g""")
def a11d(spark, d):
    docs = ad.table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "lang", "source")
    return pr.duplicate_summary(docs, ["h"], "lang", "source")


@query("a11_label_combinations", f"""{V}, l AS (SELECT q0, q1, q2, truth, count(*) AS n FROM v GROUP BY ALL), g AS (SELECT q0, q1, q2, string_agg(truth, '+' ORDER BY truth) AS labels, count(*) AS k, sum(n) AS n FROM l GROUP BY ALL) SELECT labels, count(*) AS n_vectors, CAST(sum(n) AS BIGINT) AS n_rows FROM g WHERE k > 1 GROUP BY 1""")
def a11c(spark, d):
    return pr.label_combinations(vectors(spark, d), KEY, "truth")


_PER = f"{V}, per AS (SELECT q0, q1, q2, truth, count(*)::DOUBLE AS w FROM v GROUP BY ALL)"


@query("a12_favoured_errors", f"""{_PER}, g AS (SELECT q0, q1, q2, sum(w) AS total, max(w) AS best FROM per GROUP BY ALL), b AS (SELECT sum(total - best) AS base FROM g) SELECT CAST(truth AS BIGINT) AS favoured, CAST(max(base) + sum(best - w) AS BIGINT) AS misses FROM per JOIN g USING (q0, q1, q2), b GROUP BY 1""")
def a12(spark, d):
    return pr.favoured_errors(vectors(spark, d), KEY, "truth").select(F.col("favoured").cast("long").alias("favoured"), "misses")


@query("a13_ceiling", f"""{_PER}, a AS (SELECT q0, q1, q2, arg_min(truth, (-w, truth)) AS answer FROM per GROUP BY ALL) SELECT CAST(truth AS BIGINT) AS truth, sum(w) AS n, coalesce(sum(w) FILTER (truth = answer), 0) AS hit FROM per JOIN a USING (q0, q1, q2) GROUP BY 1""")
def a13(spark, d):
    return pr.ceiling(vectors(spark, d), KEY, "truth").select(F.col("truth").cast("long").alias("truth"), "n", "hit")


@query("a21_ks", """WITH x AS (SELECT 'f' || (generate_subscripts(embedding, 1) - 1) AS col, CAST(unnest(embedding) AS DOUBLE) AS v, label < 5 AS s FROM embeddings), c AS (SELECT col, v, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM x GROUP BY ALL),
 k AS (SELECT col, abs(sum(a) OVER r / sum(a) OVER (PARTITION BY col) - sum(b) OVER r / sum(b) OVER (PARTITION BY col)) AS g FROM c WINDOW r AS (PARTITION BY col ORDER BY v)) SELECT col, round(max(g), 9) AS distance FROM k GROUP BY 1""")
def a21(spark, d):
    rows = ad.table(spark, d, "embeddings").select("label", *(F.get("embedding", i).alias(f"f{i}") for i in range(WIDTH)))
    return pr.ks_distances(rows, [f"f{i}" for i in range(WIDTH)], F.col("label") < 5).withColumn("distance", F.round("distance", 9))


_AB = "a AS (SELECT * FROM v WHERE vec_id % 3 <> 0), b AS (SELECT * FROM v WHERE vec_id % 3 = 0)"


def halves(spark, d):
    v = vectors(spark, d)
    return v.filter("vec_id % 3 <> 0"), v.filter("vec_id % 3 = 0")


@query("j2_multiset_match", f"{V}, {_AB}, x AS (SELECT q0, q1, q2, count(*) AS n_ours FROM a GROUP BY ALL), y AS (SELECT q0, q1, q2, count(*) AS n_theirs FROM b GROUP BY ALL) SELECT q0, q1, q2, coalesce(n_ours, 0) AS n_ours, coalesce(n_theirs, 0) AS n_theirs, least(coalesce(n_ours, 0), coalesce(n_theirs, 0)) AS matched FROM x FULL JOIN y USING (q0, q1, q2)")
def j2(spark, d):
    return ma.multiset_match(*halves(spark, d), KEY)


@query("j3_present", f"{V}, {_AB} SELECT vec_id FROM a WHERE (q0, q1, q2) IN (SELECT (q0, q1, q2) FROM b)")
def j3(spark, d):
    return ma.present(*halves(spark, d), KEY).select("vec_id")


@query("j4_cascade", f"""{V}, {_AB} SELECT vec_id, CASE WHEN (q0, q1, q2, q3) IN (SELECT (q0, q1, q2, q3) FROM b) THEN 'repeated' WHEN (q0, q1, q2) IN (SELECT (q0, q1, q2) FROM b) THEN 'time' WHEN (q0, q1) IN (SELECT (q0, q1) FROM b) THEN 'size' ELSE 'other' END AS reason FROM a""")
def j4(spark, d):
    a, b = halves(spark, d)
    return ma.cascade(a, b, {"repeated": ["q0", "q1", "q2", "q3"], "time": ["q0", "q1", "q2"], "size": ["q0", "q1"]}).select("vec_id", "reason")


@query("j5_best_other_label", f"""{V}, k AS (SELECT DISTINCT q0, q1, q2, truth FROM v), t AS (SELECT truth, count(*) AS total FROM k GROUP BY 1), n AS (SELECT x.truth, y.truth AS other, count(*) AS n FROM k x JOIN k y USING (q0, q1, q2) WHERE x.truth <> y.truth GROUP BY ALL)
SELECT CAST(truth AS BIGINT) AS truth, CAST(arg_max(other, (n, -other)) AS BIGINT) AS other, round(max(n) / any_value(total), 9) AS share FROM n JOIN t USING (truth) GROUP BY truth""")
def j5(spark, d):
    return ma.best_other_label(vectors(spark, d), KEY, "truth").select(F.col("truth").cast("long").alias("truth"), F.col("other").cast("long").alias("other"), F.round("share", 9).alias("share"))


_NEAREST = f"""{V}, {_AB}, s AS (SELECT * FROM a), r AS (SELECT DISTINCT q0, q1, q2, q3, q4, q5 FROM b),
 d AS (SELECT s.vec_id, 1 AS k, min((s.q2 <> r.q2)::INT + (s.q3 <> r.q3)::INT + (s.q4 <> r.q4)::INT + (s.q5 <> r.q5)::INT) AS n FROM s JOIN r USING (q0, q1) GROUP BY 1 UNION ALL
  SELECT s.vec_id, 2, min((s.q0 <> r.q0)::INT + (s.q1 <> r.q1)::INT + (s.q4 <> r.q4)::INT + (s.q5 <> r.q5)::INT) FROM s JOIN r USING (q2, q3) GROUP BY 1)
SELECT s.vec_id, CASE min(k) WHEN 1 THEN 'key1' WHEN 2 THEN 'key2' ELSE 'none' END AS outcome, CAST(arg_min(n, k) AS BIGINT) AS n_differ FROM s LEFT JOIN d USING (vec_id) GROUP BY 1"""


@query("j6_nearest_all", _NEAREST)
def j6(spark, d):
    a, b = halves(spark, d)
    out = ma.nearest(a, b, "vec_id", [["q0", "q1"], ["q2", "q3"]], [f"q{i}" for i in range(6)])
    return out.select("vec_id", "outcome", F.col("n_differ").cast("long").alias("n_differ"))


@query("j7_coverage", f"""{V}, {_AB}, x AS (SELECT q0, q1, q2, count(*) AS n_ours FROM a GROUP BY ALL), y AS (SELECT q0, q1, q2, truth, count(*) AS n FROM b GROUP BY ALL), z AS (SELECT *, n + 0 AS m, coalesce(sum(n) OVER (PARTITION BY q0, q1, q2 ORDER BY truth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT CAST(truth AS BIGINT) AS truth, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(greatest(0, least(n, coalesce(n_ours, 0) - before))) AS BIGINT) AS covered FROM z LEFT JOIN x USING (q0, q1, q2) GROUP BY 1""")
def j7(spark, d):
    a, b = halves(spark, d)
    return ma.coverage(a, b, KEY, "truth").select(F.col("truth").cast("long").alias("truth"), "n_rows", "covered")


@query("j8_train_leaks", f"{V}, {_AB}, t AS (SELECT DISTINCT q0, q1, q2, truth FROM a) SELECT CAST(t.truth AS BIGINT) AS truth, count(*) AS n FROM b JOIN t USING (q0, q1, q2) GROUP BY 1")
def j8(spark, d):
    a, b = halves(spark, d)
    return ma.train_leaks(a, b, KEY, "truth").select(F.col("truth").cast("long").alias("truth"), "n")


@query("j9_test_in_train", f"{V}, {_AB} SELECT count(*) FILTER ((q0, q1, q2) IN (SELECT (q0, q1, q2) FROM a)) AS n_in_train, count(*) AS n FROM b")
def j9(spark, d):
    a, b = halves(spark, d)
    return ma.present(b, a, KEY).agg(F.count("*").alias("n_in_train")).join(F.broadcast(b.agg(F.count("*").alias("n"))))


@query("j10_positional", f"""{V}, x AS (SELECT vec_id, 'f' || i AS col, [f0, f1, f2][i + 1] AS a, CASE WHEN vec_id % (5 + i) = 0 THEN [f0, f1, f2][i + 1] + 1 ELSE [f0, f1, f2][i + 1] END AS b FROM v, range(3) t(i)) SELECT col, count(*) AS n, count(*) FILTER (a <> b) AS n_differ, min(vec_id) FILTER (a <> b) AS first, 0.0 AS worst FROM x GROUP BY 1""")
def j10(spark, d):
    v = vectors(spark, d).select("vec_id", "f0", "f1", "f2")
    other = v.select("vec_id", *((F.col(f"f{i}") + F.when(F.col("vec_id") % (5 + i) == 0, 1.0).otherwise(0.0)).alias(f"f{i}") for i in range(3)))
    return ma.positional(v, other, ["vec_id"], ["f0", "f1", "f2"]).withColumn("first", F.col("first.vec_id"))


_BLOCKS = "WITH b AS (SELECT CAST(vec_id // 50 AS BIGINT) AS block, count(*) AS votes FROM embeddings GROUP BY 1) SELECT block, (max(block) OVER () - block) * 50 AS at, votes FROM b"


@query("j11_block_placement_all", _BLOCKS)
def j11(spark, d):
    # the official file has all blocks in reversed order
    v = vectors(spark, d).select("vec_id", "f0", "f1").withColumn("block", F.floor(F.col("vec_id") / 50)).withColumn("row", F.col("vec_id") % 50)
    last = F.broadcast(v.agg(F.max("block").alias("last")))
    official = v.join(last).select("f0", "f1", ((F.col("last") - F.col("block")) * 50 + F.col("row")).alias("position"))
    return ma.place_blocks(v.select("block", "row", "f0", "f1"), official, "block", "row", "position", ["f0", "f1"])


_REPEATS = "CAST(CASE WHEN vec_id // 50 % 2 = 0 THEN 0 ELSE vec_id * vec_id % 7 END AS BIGINT)"


@query("j11_repeated_rows", f"""{V}, k AS (SELECT vec_id // 50 AS block, vec_id % 50 AS r, {_REPEATS} + CASE WHEN vec_id % 50 = 0 THEN 100 + vec_id // 50 % 40 ELSE 0 END AS key FROM v), l AS (SELECT max(block) AS last FROM k),
 o AS (SELECT key, (last - block) * 50 + r AS position FROM k, l), n AS (SELECT block, position - r AS "at", count(*) AS votes FROM k JOIN o USING (key) GROUP BY ALL),
 w AS (SELECT block, "at", votes, row_number() OVER (PARTITION BY block ORDER BY votes DESC, "at") AS place FROM n) SELECT block, "at", votes FROM w WHERE place = 1""")
def j11_repeats(spark, d):
    """Blocks of few different rows, most of them everywhere, in a file with the blocks in reverse."""
    v = vectors(spark, d).select("vec_id").withColumns({"block": F.floor(F.col("vec_id") / 50), "r": F.col("vec_id") % 50})
    key = F.when(F.col("block") % 2 == 0, 0).otherwise(F.col("vec_id") * F.col("vec_id") % 7) + F.when(F.col("r") == 0, 100 + F.col("block") % 40).otherwise(0)
    v = v.withColumn("key", key.cast("long"))
    last = F.broadcast(v.agg(F.max("block").alias("last")))
    official = v.join(last).select("key", ((F.col("last") - F.col("block")) * 50 + F.col("r")).alias("position"))
    return ma.place_blocks(v, official, "block", "r", "position", ["key"]).select("block", "at", "votes")


@query("a22_match_report", f"""{V}, {_AB}, x AS (SELECT q0, q1, q2, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT q0, q1, q2, count(*) AS m FROM b GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_ours, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS matched, CAST(sum(n - least(n, coalesce(m, 0))) AS BIGINT) AS unmatched, count(*) FILTER (n = 1) AS unique_rows, count(*) FILTER (n = 1 AND m >= 1) AS unique_matched FROM x LEFT JOIN y USING (q0, q1, q2)""")
def a22(spark, d):
    m = ma.multiset_match(*halves(spark, d), KEY).filter("n_ours > 0")
    return m.agg(F.sum("n_ours").alias("n_ours"), F.sum("matched").alias("matched"), F.sum(F.col("n_ours") - F.col("matched")).alias("unmatched"), F.count_if(F.col("n_ours") == 1).alias("unique_rows"), F.count_if((F.col("n_ours") == 1) & (F.col("n_theirs") > 0)).alias("unique_matched"))


@query("o3_without_pair", f"{V}, {_AB} SELECT q0, q1, q2 FROM a EXCEPT ALL SELECT q0, q1, q2 FROM b")
def o3(spark, d):
    a, b = halves(spark, d)
    return a.select(*KEY).exceptAll(b.select(*KEY))


@query("o4_in_common", f"{V}, {_AB} SELECT q0, q1, q2 FROM a INTERSECT ALL SELECT q0, q1, q2 FROM b")
def o4(spark, d):
    a, b = halves(spark, d)
    return a.select(*KEY).intersectAll(b.select(*KEY))


#: Measures per seed and rotation, made of the captures of the vectors.
_ROT = f"{V}, r AS (SELECT vec_id % 3 AS seed, capture % 4 AS rotation, count(*) FILTER (truth < 3 AND predicted >= 3)::DOUBLE / greatest(1, count(*) FILTER (truth < 3)) AS worst, count(*) FILTER (truth < 3 AND predicted >= 3) AS errors, count(*) FILTER (truth < 3) AS n FROM v GROUP BY ALL)"


def rotations(spark, d):
    b = F.col("truth") < 3
    e = F.count_if(b & (F.col("predicted") >= 3))
    return vectors(spark, d).groupBy((F.col("vec_id") % 3).alias("seed"), (F.col("capture") % 4).alias("rotation")).agg((e / F.greatest(F.lit(1), F.count_if(b))).alias("worst"), e.alias("errors"), F.count_if(b).alias("n"))


@query("a34_rotation_measures", f"{_ROT} SELECT seed, round(max(worst), 9) AS worst, round(sum(errors) / sum(n), 9) AS total FROM r GROUP BY 1")
def a34(spark, d):
    return rotations(spark, d).groupBy("seed").agg(F.round(F.max("worst"), 9).alias("worst"), F.round(F.sum("errors") / F.sum("n"), 9).alias("total"))


@query("a35_adoption", f"{_ROT}, m AS (SELECT round(avg(w), 9) AS worst, round(avg(t), 9) AS total FROM (SELECT max(worst) AS w, sum(errors) / sum(n) AS t FROM r GROUP BY seed)) SELECT *, worst <= 0.9 AS ok_worst, total >= 0.2 AS ok_total, worst <= 0.9 AND total >= 0.2 AS adopt FROM m")
def a35(spark, d):
    per = rotations(spark, d).groupBy("seed").agg(F.max("worst").alias("w"), (F.sum("errors") / F.sum("n")).alias("t"))
    return me.adoption(per.agg(F.round(F.avg("w"), 9).alias("worst"), F.round(F.avg("t"), 9).alias("total")), {"worst": ("max", 0.9), "total": ("min", 0.2)})


@query("a36_seed_noise", f"{_ROT} SELECT rotation, round(max(worst) - min(worst), 9) AS noise, round(min(worst), 9) AS least, round(max(worst), 9) AS most FROM r GROUP BY 1")
def a36(spark, d):
    m = me.seed_noise(rotations(spark, d), ["rotation"], "worst")
    return m.select("rotation", *(F.round(c, 9).alias(c) for c in ("noise", "least", "most")))


@query("a36_difference_reading", f"""{V}, a AS (SELECT capture % 4 AS rotation, vec_id % 3 AS seed, avg((predicted = truth)::INT) AS x, avg((predicted2 = truth)::INT) AS y FROM v GROUP BY ALL), m AS (SELECT rotation, min(y - x) AS least, max(y - x) AS most, max(x) - min(x) AS noise FROM a GROUP BY 1)
SELECT rotation, round(least, 9) AS least, round(most, 9) AS most, CASE WHEN least <= 0 AND most >= 0 THEN 'no direction' WHEN least(abs(least), abs(most)) <= noise THEN 'within noise' WHEN least > 0 THEN 'rises' ELSE 'falls' END AS reading FROM m""")
def a36r(spark, d):
    v = vectors(spark, d).withColumns({"rotation": F.col("capture") % 4, "seed": F.col("vec_id") % 3})
    rate = lambda c: v.groupBy("rotation", "seed").agg(F.avg((F.col(c) == F.col("truth")).cast("int")).alias("value"))
    before, after = rate("predicted"), rate("predicted2")
    out = me.read_difference(before, after, me.seed_noise(before, ["rotation"]), ["rotation"])
    return out.select("rotation", F.round("least", 9).alias("least"), F.round("most", 9).alias("most"), "reading")


@query("a46_run_over_run", f"""{V}, r AS (SELECT capture % 4 AS config, win % 6 AS round_, avg((predicted = truth)::INT) AS accuracy FROM v GROUP BY ALL) SELECT config, round_, round(accuracy, 9) AS accuracy, round(accuracy - lag(accuracy) OVER (PARTITION BY config ORDER BY round_), 9) AS change FROM r""")
def a46(spark, d):
    r = vectors(spark, d).groupBy((F.col("capture") % 4).alias("config"), (F.col("win") % 6).alias("round_")).agg(F.avg((F.col("predicted") == F.col("truth")).cast("int")).alias("accuracy"))
    change = F.col("accuracy") - F.lag("accuracy").over(Window.partitionBy("config").orderBy("round_"))
    return r.select("config", "round_", F.round("accuracy", 9).alias("accuracy"), F.round(change, 9).alias("change"))


@query("a47_size_mismatch", f"""{V}, c AS (SELECT capture % 4 AS cap, count(*) FILTER (vec_id % 2 = 0) AS nt, count(*) FILTER (vec_id % 2 = 0 AND predicted = truth) AS ht, count(*) FILTER (vec_id % 2 = 1) AS nc, count(*) FILTER (vec_id % 2 = 1 AND predicted = truth) AS hc FROM v GROUP BY 1), m AS (SELECT capture % 4 AS cap, predicted, count(*) AS n FROM v WHERE vec_id % 2 = 0 GROUP BY ALL)
SELECT c.cap, round(CASE WHEN nt > 0 AND nc > 0 THEN ht / nt - hc / nc END, 9) AS mismatch, (SELECT arg_max(predicted, (n, -predicted)) FROM m WHERE m.cap = c.cap) AS most_predicted FROM c""")
def a47(spark, d):
    v = vectors(spark, d).withColumns({"cap": F.col("capture") % 4, "t": F.col("vec_id") % 2 == 0, "ok": F.col("predicted") == F.col("truth")})
    share = lambda side: F.try_divide(F.count_if(side & F.col("ok")), F.count_if(side))
    diff = v.groupBy("cap").agg(F.round(share(F.col("t")) - share(~F.col("t")), 9).alias("mismatch"))
    most = v.filter("t").groupBy("cap", "predicted").agg(F.count("*").alias("n")).groupBy("cap").agg(F.max_by("predicted", F.struct("n", -F.col("predicted"))).cast("long").alias("most_predicted"))
    return diff.join(most, "cap", "left")


@query("a45_class_intervals", f"""{V}, r AS (SELECT CAST(truth AS BIGINT) AS truth, count(*) AS n, count(*) FILTER (predicted = truth) AS hits FROM v GROUP BY 1), i AS (SELECT *, hits / n AS p, {_Z} AS z FROM r)
SELECT truth, hits, n, round(p, 9) AS recall, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS high, (SELECT count(DISTINCT capture) FROM v WHERE v.truth = i.truth AND predicted = v.truth) AS captures_hit FROM i""")
def a45(spark, d):
    ok = F.col("predicted") == F.col("truth")
    r = vectors(spark, d).groupBy(F.col("truth").cast("long").alias("truth")).agg(F.count_if(ok).alias("hits"), F.count("*").alias("n"), F.count_distinct(F.when(ok, F.col("capture"))).alias("captures_hit"))
    low, high = me.wilson(F.col("hits"), F.col("n"))
    return r.select("truth", "hits", "n", F.round(F.col("hits") / F.col("n"), 9).alias("recall"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), "captures_hit")


@query("a24_block_interval")
def a24(spark, d):
    return me.block_interval(vectors(spark, d).withColumn("c", F.lit(0)), F.col("predicted") == F.col("truth"), 200, block=5)


@query("a25_paired_difference")
def a25(spark, d):
    v = vectors(spark, d).withColumn("seed", F.col("vec_id") % 3)
    return me.paired_difference(v, F.col("predicted") == F.col("truth"), F.col("predicted2") == F.col("truth"), 200, block=5)


@query("a26_all_comparisons")
def a26(spark, d):
    v = vectors(spark, d).withColumn("seed", F.col("vec_id") % 3)
    kinds = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("truth") == 0, F.lit("background")), F.when(F.col("capture") == 11, F.lit("held-out")), F.when(F.col("win") > 25, F.lit("time cut")))))
    return me.paired_difference(v.withColumn("comparison", kinds), F.col("predicted") == F.col("truth"), F.col("predicted2") == F.col("truth"), 100, block=5, by=["comparison"])


@query("p12_quantise")
def p12(spark, d):
    return vectors(spark, d).select("vec_id", *ma.quantise(FEATS))


@query("s23_long_measures", f"""{V}{_M} SELECT CAST(c AS BIGINT) AS class, measure, round(value, 9) AS value FROM f UNPIVOT (value FOR measure IN (precision, recall, f1))""")
def s23(spark, d):
    m = me.class_metrics(me.confusion(me.contingency(vectors(spark, d))))
    long = m.select(F.col("class").cast("long").alias("class"), "precision", "recall", "f1").unpivot("class", ["precision", "recall", "f1"], "measure", "value")
    return long.filter("value is not null").withColumn("value", F.round("value", 9))
