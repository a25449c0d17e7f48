"""A Merkle manifest of a dataset: leaves placed by bitmap ranks, levels reduced over slot arrays, proofs folded again.

1. A row's leaf is the digest of its fields. Each source has bitmaps of its doc_ids, kept as those 64-bit words that have a bit set and
   merged by bit_or, and a directory of popcounts over them in LEVELS levels of at most 2^FAN_BITS entries. A leaf's coordinate in its
   source is the directory's count before its word and the popcount of the bits below its own; no source is ever sorted.
2. Nodes meet in blocks of FANOUT^DEPTH coordinates, each an array keyed by slot, in which DEPTH levels are reduced at once; the tops of
   blocks are the nodes of the next layer, until each source has one. The subroots, numbered in the order of sources, make a tree of
   the same kind.
3. From the top down each block gets the siblings above it once, adds those of its own levels, and hands both to its slots, so no proof
   of a leaf is ever shuffled. Proofs are folded from the leaf as it is found (or tampered with) to a root that is compared.

All work is in DataFrame expressions. What one task holds of a group is bounded: a block, 64 ids, or a directory's node.

Defined cases: null fields count as absent ("-"); a null source is a source and comes first; rows without doc_id come first in their
source; several rows with one doc_id are leaves each, in the order of their digests (equal rows are interchangeable); an empty text is
the field "0:"; an empty table gives no rows; very long texts are digested whole where they are read; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table
from winlens.operators.ordered import running

FANOUT, DEPTH = 3, 6
WIDTH = FANOUT**DEPTH
#: The directory of popcounts: three levels of 15 bits over words of 64 ids, and the 13 bits that are left at the top.
FAN_BITS, LEVELS = 15, 4
#: Copies of one row that one task numbers.
COPIES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """- for null, else the UTF-8 byte count, a colon, the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """part (a text that orders sources, null first), doc_id, leaf, bent: the leaf with the tampered text, null where that is the same."""
    own = {c: F.col(c) for c in FIELDS}
    bent = F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(F.col("text")), leaf_of(own | {"text": tampered}))
    part = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(own).alias("leaf"), bent.alias("bent"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """(part, word, bits, n): the words of 64 ids that have any, and the rows behind each."""
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    return rows.filter("doc_id is not null").groupBy("part", F.shiftright("doc_id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """words with base: the rows of its part that stand before the word."""
    levels = [words.select("part", F.col("word").alias("at"), "n")]
    for _ in range(LEVELS - 1):
        levels.append(levels[-1].groupBy("part", F.shiftright("at", FAN_BITS).alias("at")).agg(F.sum("n").alias("n")))
    above = None
    for rows in reversed(levels):
        rows = rows.withColumn("up", F.shiftright("at", FAN_BITS) if above is not None else F.lit(0).cast("long"))
        before = Window.partitionBy("part", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("base", F.sum("n").over(before) - F.col("n"))
        if above is not None:
            rows = rows.join(above, ["part", "up"]).withColumn("base", F.col("base") + F.col("before"))
        above = rows.select("part", F.col("at").alias("up"), F.col("base").alias("before"))
    return words.join(above.select("part", F.col("up").alias("word"), F.col("before").alias("base")), ["part", "word"])


def coordinates(rows: DataFrame) -> DataFrame:
    """rows (part, doc_id, leaf, bent) with pos, their place from 0 in the order of doc_id in their part."""
    words = materialize(directory(materialize(bitmaps(rows), "bitmaps")), "ranks")
    several = words.filter("n > bit_count(bits)")
    unnamed = rows.filter("doc_id is null")
    single = rows.withColumn("word", F.shiftright("doc_id", 6)).join(words, ["part", "word"])
    rank = F.expr("base + bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")
    if not several.limit(1).count() and not unnamed.limit(1).count():
        return single.select("part", "doc_id", "leaf", "bent", rank.alias("pos"))
    nameless = unnamed.groupBy("part").agg(F.count("*").alias("nameless"))
    single = single.filter("n = bit_count(bits)").select("part", "doc_id", "leaf", "bent", rank.alias("pos"))
    crowd = rows.withColumn("word", F.shiftright("doc_id", 6)).join(several.select("part", "word", "base"), ["part", "word"])
    shifted = single.unionByName(crowded(crowd)).join(nameless, "part", "left").withColumn("pos", F.col("pos") + F.coalesce("nameless", F.lit(0))).drop("nameless")
    return shifted.unionByName(crowded(unnamed.withColumns({"word": F.lit(None).cast("long"), "base": F.lit(0).cast("long")})))


def crowded(rows: DataFrame) -> DataFrame:
    """Rows (part, word, base, doc_id, leaf, bent) of words in which ids repeat, placed by id, digest and copy."""
    kinds = materialize(rows.groupBy("part", "word", "base", "doc_id", "leaf", "bent").agg(F.count("*").alias("m")), "crowded").withColumn("head", F.substring("leaf", 1, 4))
    before = lambda by, order: F.sum("m").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    ids = kinds.groupBy("part", "word", "doc_id").agg(F.sum("m").alias("m")).select("part", "doc_id", before(("part", "word"), "doc_id").alias("of_id"))
    heads = kinds.groupBy("part", "doc_id", "head").agg(F.sum("m").alias("m")).select("part", "doc_id", "head", before(("part", "doc_id"), "head").alias("of_head"))
    kinds = kinds.withColumn("of_leaf", before(("part", "doc_id", "head"), "leaf")).alias("k")
    same = lambda other, *keys: F.expr(" and ".join(f"k.{c} <=> {other}.{c}" for c in keys))
    placed = kinds.join(ids.alias("i"), same("i", "part", "doc_id")).join(heads.alias("h"), same("h", "part", "doc_id", "head"))
    placed = placed.select("k.part", "k.doc_id", "k.leaf", "k.bent", "k.m", (F.col("k.base") + F.col("of_id") + F.col("of_head") + F.col("of_leaf")).alias("first"))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (m - 1) div {COPIES})"))).repartition("leaf", "run")
    copies = runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {COPIES}L, least(m, (run + 1) * {COPIES}L) - 1)")))
    return copies.select("part", "doc_id", "leaf", "bent", (F.col("first") + F.col("copy")).alias("pos"))


def depth_of(n: str) -> Column:
    """Levels above the leaves of a part with n of them."""
    return F.expr(f"size(filter(array({', '.join(f'{FANOUT**k}L' for k in range(40))}), p -> p < {n}))")


def with_levels(blocks: DataFrame) -> DataFrame:
    """blocks(d, slots) with l0 to l[DEPTH], the digests at each of the d levels of the block (the last one again above them)."""
    blocks = blocks.withColumn("l0", F.expr("transform(slots, s -> s.h)"))
    for k in range(DEPTH):
        runs = f"transform(sequence(0, cast((size(l{k}) - 1) div {FANOUT} as int)), r -> sha2(array_join(slice(l{k}, r * {FANOUT} + 1, {FANOUT}), ''), 256))"
        blocks = blocks.withColumn(f"l{k + 1}", F.expr(f"if(d > {k}, {runs}, l{k})"))
    return blocks


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The layers of the trees over nodes (part, pos, h, others): tables of blocks (part, block, d, top, slots), a block's slots in order.

    The last layer has one block for each part, whose top is the part's root.
    """
    extra = [c for c in nodes.columns if c not in ("part", "pos", "h")]
    sizes = materialize(nodes.groupBy("part").agg(F.count("*").alias("n")).withColumn("depth", depth_of("n")), f"{name}-sizes")
    most = sizes.agg(F.max("depth")).first()[0] or 0
    layers = []
    for layer in range(max(1, -(-most // DEPTH))):
        slot = F.struct(F.expr(f"cast(pos % {WIDTH} as int)").alias("slot"), "h", *extra)
        blocks = nodes.groupBy("part", F.expr(f"pos div {WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        blocks = blocks.join(sizes.select("part", F.expr(f"least({DEPTH}, greatest(0, depth - {layer * DEPTH}))").alias("d")), "part")
        blocks = materialize(with_levels(blocks).select("part", "block", "d", F.col(f"l{DEPTH}")[0].alias("top"), "slots"), f"{name}-layer-{layer}")
        layers.append(blocks)
        nodes, extra = blocks.select("part", F.col("block").alias("pos"), F.col("top").alias("h")), []
    return layers


def descend(layers: list[DataFrame], start: DataFrame) -> DataFrame:
    """(part, pos, slot, path, others of start) for every leaf; start(part, path, others) has a row for each part.

    path holds, level by level from the leaf, the siblings before and after the node, each as one text.
    """
    others = [c for c in start.columns if c not in ("part", "path")]
    above = start.withColumn("block", F.lit(0).cast("long"))
    siblings = []
    for k in range(DEPTH):
        at, run = f"cast(i div {FANOUT**k} as int)", f"cast(i div {FANOUT ** (k + 1)} as int) * {FANOUT}"
        siblings.append(f"struct(array_join(slice(l{k}, {run} + 1, {at} - {run}), '') as before, array_join(slice(l{k}, {at} + 2, {run} + {FANOUT - 1} - {at}), '') as after)")
    own = f"transform(sequence(0, size(slots) - 1), i -> struct(slots[i] as slot, slice(array({', '.join(siblings)}), 1, d) as path))"
    for blocks in reversed(layers):
        met = with_levels(blocks.join(above, ["part", "block"]))
        each = met.select("part", "block", *others, F.col("path").alias("above"), F.explode(F.expr(own)).alias("x"))
        below = each.select("part", F.expr(f"block * {WIDTH} + x.slot.slot").alias("pos"), "x.slot", F.expr("concat(x.path, above)").alias("path"), *others)
        above = below.withColumnRenamed("pos", "block").drop("slot")
    return below


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, pos, leaf, subroot, root, path, folded_root, verified: a row for each row of docs.

    tampered, where given, is the text as it is found later; folded_root is made from it.
    """
    placed = coordinates(materialize(leaves(docs, tampered), "leaves")).withColumnRenamed("leaf", "h")
    layers = grow(placed, "merkle")
    roots = layers[-1].select(F.col("part").alias("of"), F.col("top").alias("h"))
    sources = running(roots, [], ["of"]).select(F.lit("").alias("part"), (F.col("row") - 1).cast("long").alias("pos"), "h", "of")
    upper = grow(sources, "merkle-sources")
    none = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    over = descend(upper, upper[-1].select("part", none.alias("path"), F.col("top").alias("root")))
    over = materialize(over.select(F.col("slot.of").alias("part"), "path", F.col("slot.h").alias("subroot"), "root"), "merkle-parts")
    rows = descend(layers, over)
    source = F.when(F.col("part") != "n", F.expr("substring(part, 2)"))
    out = rows.select(F.col("slot.doc_id").alias("doc_id"), source.alias("source"), "pos", F.col("slot.h").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("slot.bent", "slot.h")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    out = manifest(docs, F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


SQL = r"""
WITH RECURSIVE
bits AS (
    SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length(doc_id::VARCHAR)), lambda i:
        CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::UBIGINT)),
        lambda crc, b: xor((xor(crc, b)) >> 1, CASE WHEN xor(crc, b) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS crc
    FROM documents WHERE doc_id IS NOT NULL),
d AS (
    SELECT documents.doc_id, coalesce('s' || source, 'n') AS part,
        coalesce(strlen(documents.doc_id::VARCHAR)::VARCHAR || ':' || documents.doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') ||
        coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
        text, CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bent
    FROM documents LEFT JOIN bits USING (doc_id)),
h AS (
    SELECT doc_id, part, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(bent)::VARCHAR || ':' || bent, '-')) AS bent FROM d),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM h),
nodes AS (
    SELECT 0 AS lvl, part, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT lvl + 1, part, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY lvl, part, pos // 3, n),
subroots AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
    SELECT 0 AS lvl, pos, h, n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
sib AS (
    SELECT a.part, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM nodes a JOIN nodes b ON a.part = b.part AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
upper_sib AS (
    SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (
    SELECT doc_id, part, leaf, pos AS first, 0 AS lvl, pos, '' AS proof, bent AS folded, n FROM leaves
    UNION ALL
    SELECT doc_id, part, leaf, first, lvl + 1, pos // 3, proof || before || after, sha256(before || folded || after), (n + 2) // 3
    FROM walk JOIN sib USING (part, lvl, pos) WHERE n > 1),
top AS (
    SELECT doc_id, leaf, s.h AS subroot, 0 AS lvl, s.pos, proof, folded, s.n FROM walk w JOIN subroots s USING (part) WHERE w.n = 1
    UNION ALL
    SELECT doc_id, leaf, subroot, lvl + 1, pos // 3, proof || before || after, sha256(before || folded || after), (n + 2) // 3
    FROM top JOIN upper_sib USING (lvl, pos) WHERE n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = (SELECT h FROM upper WHERE n = 1) AS verified
FROM top WHERE n = 1
"""
