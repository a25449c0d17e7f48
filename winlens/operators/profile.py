"""Profiles of feature tables: relations, column facts, duplicates, ceilings, medians, Kolmogorov-Smirnov distances."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.operators.ordered import running
from winlens.sources.scratch import materialize

#: A derived column and the expression it should equal.
RELATIONS = {
    "Variance": "Std * Std", "Tot size": "AVG", "LLC": "IPv", "ARP": "1 - IPv", "Tot sum": "AVG * Number",
    **{f"{n}_count": f"{n}_flag_number * Number" for n in ("ack", "syn", "fin", "rst")},
}


def values_equal(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Null equals only null, infinity only itself, otherwise within a relative or absolute tolerance."""
    inf = lambda c: F.abs(c) == float("inf")
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(inf(a) | inf(b), a == b).otherwise(near)


def relation_report(rows: DataFrame, relations: dict[str, str], rel: float = 1e-9, abs_: float = 1e-12) -> DataFrame:
    """(col, n, violations, worst): one pass for all relations."""
    aggs = []
    for i, (c, e) in enumerate(relations.items()):
        a, b = F.col(f"`{c}`").cast("double"), F.expr(e).cast("double")
        aggs += [F.count_if(~values_equal(a, b, rel, abs_)).alias(f"v{i}"), F.max(relative_deviation(a, b)).alias(f"w{i}")]
    one = rows.agg(F.count("*").alias("n"), *aggs)
    each = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"v{i}").alias("violations"), F.col(f"w{i}").alias("worst")) for i, c in enumerate(relations)))
    return one.select("n", F.explode(each).alias("x")).select("x.col", "n", "x.violations", "x.worst")


def relative_deviation(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))


def medians(rows: DataFrame, columns: list[str], by: list[str] = (), digits: int = 6) -> DataFrame:
    """Exact medians of finite values."""
    finite = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")) & (F.abs(F.col(f"`{c}`")) != float("inf")), F.col(f"`{c}`").cast("double"))
    return rows.groupBy(*by).agg(*(F.round(F.percentile(finite(c), 0.5), digits).alias(c) for c in columns))


def rate_by_range(rows: DataFrame, value: str, edges: list[float], hit: Column) -> DataFrame:
    """(bucket, n, n_attack) of half-open ranges given by their edges."""
    bucket = F.lit(f"{edges[-1]}-")
    for low, high in reversed(list(zip([0, *edges[:-1]], edges, strict=True))):
        bucket = F.when(F.col(value) < high, f"{low}-{high}").otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_attack"))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(col, n, n_null, n_inf, least, greatest, n_nonzero, n_negative, constant) in one pass; least and greatest over finite values."""
    inf = float("inf")
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        finite = F.when(F.abs(v) != inf, v)
        aggs += [F.count_if(v.isNull()).alias(f"n_null{i}"), F.count_if(F.abs(v) == inf).alias(f"n_inf{i}"), F.min(finite).alias(f"least{i}"), F.max(finite).alias(f"greatest{i}"), F.count_if(v != 0).alias(f"n_nonzero{i}"), F.count_if(v < 0).alias(f"n_negative{i}")]
    names = ("n_null", "n_inf", "least", "greatest", "n_nonzero", "n_negative")
    each = F.array(*(F.struct(F.lit(c).alias("col"), *(F.col(f"{k}{i}").alias(k) for k in names)) for i, c in enumerate(columns)))
    out = rows.agg(F.count("*").alias("n"), *aggs).select("n", F.explode(each).alias("x")).select("x.col", "n", *(f"x.{k}" for k in names))
    return out.withColumn("constant", (F.col("n_null") == 0) & (F.col("n_inf") == 0) & (F.col("least") == F.col("greatest")))


def identical_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) pairs of columns equal in every row: one pass over all pairs."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*(F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("same")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(each).alias("x")).filter("x.same").select("x.a", "x.b")


def duplicate_summary(rows: DataFrame, key: list[str], label: str, category: str) -> DataFrame:
    """One row: rows, distinct vectors, repeated rows, rows whose vector also has another label or category, largest group."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.count_distinct(category).alias("categories"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), total(F.col("n") > 1).alias("in_groups"), (F.sum("n") - F.count("*")).alias("n_repeats"), total(F.col("labels") > 1).alias("other_label"), total(F.col("categories") > 1).alias("other_category"), F.max("n").alias("largest"))


def label_combinations(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """(labels, n_vectors, n_rows) of vectors held by more than one label; labels joined in order."""
    per = rows.groupBy(*key, label).agg(F.count("*").alias("n")).groupBy(*key).agg(F.sort_array(F.collect_list(label)).alias("labels"), F.sum("n").alias("n"))
    return per.filter(F.size("labels") > 1).groupBy(F.array_join("labels", "+").alias("labels")).agg(F.count("*").alias("n_vectors"), F.sum("n").alias("n_rows"))


def ceiling(rows: DataFrame, key: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """(label, n, hit): weight of each class, and of it under the best single answer per vector (ties: the smallest class)."""
    per = rows.groupBy(*key, label).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
    best = per.groupBy(*key).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(label).alias("answer"))).alias("b")).select(*key, F.col("b.answer").alias("answer"))
    return per.join(best, key).groupBy(label).agg(F.sum("w").alias("n"), F.sum(F.when(F.col(label) == F.col("answer"), F.col("w")).otherwise(0.0)).alias("hit"))


def favoured_errors(rows: DataFrame, key: list[str], category: str) -> DataFrame:
    """(favoured, misses): rows answered wrong if every vector that the favoured category has is given to it, others to their best."""
    per = rows.groupBy(*key, category).agg(F.count("*").alias("w"))
    groups = per.groupBy(*key).agg(F.sum("w").alias("total"), F.max("w").alias("best"))
    all_ = groups.agg(F.sum(F.col("total") - F.col("best")).alias("base"))
    own = per.join(groups, key).groupBy(F.col(category).alias("favoured")).agg(F.sum(F.col("best") - F.col("w")).alias("more"))
    return own.join(F.broadcast(all_)).select("favoured", (F.col("base") + F.col("more")).alias("misses"))


def ks_distances(rows: DataFrame, columns: list[str], side: Column) -> DataFrame:
    """(col, distance): two-sample Kolmogorov-Smirnov distance of each column between side true and false.

    Values are counted first; the running sums then go over the distinct values of a column, in ranges.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns)))
    counts = rows.select(side.alias("_s"), each.alias("x")).filter("x.v is not null").groupBy("x.col", "x.v").agg(F.count_if("_s").alias("a"), F.count_if(~F.col("_s")).alias("b"))
    summed = materialize(running(counts, ["col"], ["v"], {"run_a": "a", "run_b": "b"}), "ks")
    totals = summed.groupBy("col").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.try_divide(F.col("run_a").cast("double"), F.col("all_a")) - F.try_divide(F.col("run_b").cast("double"), F.col("all_b")))
    return summed.join(totals, "col").groupBy("col").agg(F.max(gap).alias("distance"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
