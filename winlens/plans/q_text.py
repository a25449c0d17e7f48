"""Queries over texts, file names and conversations, and over splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winlens.functions import text as tx
from winlens.operators import labels as la
from winlens.operators import search as se
from winlens.operators import splits as sp
from winlens.plans import adapters as ad
from winlens.plans.adapters import FRAMES_CTE, windows_cte
from winlens.sources.scratch import materialize

QUERIES: dict = {}
ORACLES: dict = {}
WIN = f"WITH {FRAMES_CTE}{windows_cte(10)}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
#: The masked text differs from the text only by marks: their number and the length are compared.
_IP4 = f"(^|[^0-9.]){_OCT}(\\.{_OCT}){{3}}($|[^0-9])"


@query("x1_x11_mask_addresses", f"SELECT doc_id, regexp_matches(text, '{_IP4}') AS masked FROM documents")
def x1(spark, d):
    m = tx.mask_addresses(F.col("text"))
    return ad.table(spark, d, "documents").select("doc_id", m.contains(tx.MARK).alias("masked"))


@query("x1_has_address", f"SELECT lang, count(*) FILTER (regexp_matches(text, '{_IP4}')) AS n_with FROM documents GROUP BY 1")
def x1h(spark, d):
    return ad.table(spark, d, "documents").groupBy("lang").agg(F.count_if(tx.has_address(F.col("text"))).alias("n_with"))


@query("x2_labels_in_text", "SELECT doc_id, length(replace(replace(translate(text, '0123456789', ''), 'the', '<A>'), 'de', '<B>')) AS n FROM documents")
def x2(spark, d):
    pairs = F.array(F.struct(F.lit("de").alias("address"), F.lit("<B>").alias("label")), F.struct(F.lit("the").alias("address"), F.lit("<A>").alias("label")))
    # without digits, so that there is no address to mask: x2_labels_in_all_texts has these, and no SQL
    text = F.translate("text", "0123456789", "")
    return ad.table(spark, d, "documents").select("doc_id", F.length(tx.replace_addresses(text, pairs)).cast("long").alias("n"))


def marked(spark, d, text):
    n = F.regexp_count("masked", F.lit(r"\[address\]"))
    return ad.table(spark, d, "documents").select("doc_id", text.alias("masked")).select("doc_id", F.length("masked").cast("long").alias("n"), n.cast("long").alias("n_marks"), F.sha2("masked", 256).alias("digest"))


@query("x1_x11_masked_texts")
def x1_all(spark, d):
    return marked(spark, d, tx.mask_addresses(F.col("text")))


@query("x2_labels_in_all_texts")
def x2_all(spark, d):
    return marked(spark, d, tx.replace_addresses(F.col("text"), F.array(*(F.struct(F.lit(a).alias("address"), F.lit(b).alias("label")) for a, b in (("de", "<B>"), ("the", "<A>"))))))


@query("x3_invisible", "SELECT doc_id, doc_id % 10 = 0 AS hidden, length(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n FROM documents")
def x3(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("​"))).otherwise(F.col("text"))
    return ad.table(spark, d, "documents").select("doc_id", tx.has_invisible(t).alias("hidden"), F.length(tx.visible(t)).cast("long").alias("n"))


_STOP = "', '".join(tx.STOP)
_FOLD = "regexp_replace(translate(lower({c}), '" + tx._ACCENTS[0] + "', '" + tx._ACCENTS[1] + "'), '[^a-z0-9]+', ' ', 'g')"
_STEMS = "[substring(w, 1, 5) FOR w IN string_split(" + _FOLD + ", ' ') IF w <> '' AND w NOT IN ('" + _STOP + "')]"


@query("x4_stems", f"SELECT doc_id, CAST(len(list_distinct(s)) AS BIGINT) AS n_stems, list_min(s) AS first_stem FROM (SELECT doc_id, {_STEMS.format(c='text')} AS s FROM documents)")
def x4(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", tx.stems(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_stems"), F.array_min("s").alias("first_stem"))


_SECTIONS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT *, sum(CASE WHEN s LIKE 'T%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
sections AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(s) FILTER (s LIKE 'T%') AS title, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (s NOT LIKE 'T%'), '') AS body FROM h GROUP BY ALL)"""


def sections(spark, d):
    return tx.sections(ad.table(spark, d, "documents"), "doc_id", "text", F.col("s").startswith("T"))


@query("x5_sections", f"WITH {_SECTIONS} SELECT doc_id, section, title, length(body) AS n_body FROM sections")
def x5(spark, d):
    return sections(spark, d).select("doc_id", F.col("section").cast("long").alias("section"), "title", F.length("body").cast("long").alias("n_body"))


@query("k12_search", f"""WITH {_SECTIONS}, s AS (SELECT doc_id * 1000 + section AS section, doc_id * 1000 + section AS ord, coalesce(title, '') AS title, body, 'd' || doc_id % 7 AS document FROM sections),
t AS (SELECT section, ord, 'title' AS f, unnest({_STEMS.format(c='title')}) AS stem FROM s UNION ALL SELECT section, ord, 'text', unnest({_STEMS.format(c='body')}) FROM s UNION ALL SELECT section, ord, 'document', unnest({_STEMS.format(c='document')}) FROM s),
i AS (SELECT section, ord, stem, 3 * max((f = 'title')::INT) + least(3, count(*) FILTER (f = 'text')) + max((f = 'document')::INT) AS points FROM t GROUP BY ALL),
q AS (SELECT item_id AS query, unnest(list_distinct({_STEMS.format(c='text')})) AS stem FROM benchmark), p AS (SELECT query, section, ord, sum(points) AS points FROM q JOIN i USING (stem) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY points DESC, ord) AS place FROM p)
SELECT query, section, CAST(points AS BIGINT) AS points, place FROM r WHERE place <= 3""")
def k12(spark, d):
    key = (F.col("doc_id") * 1000 + F.col("section")).alias("section")
    s = sections(spark, d).select(key, key.alias("order"), "title", "body", F.concat(F.lit("d"), F.col("doc_id") % 7).alias("document"))
    q = ad.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return se.search(s, q, 3).withColumn("place", F.col("place").cast("long"))


@query("f9_mitigations", "WITH s AS (SELECT doc_id, unnest([lang, source]) AS category FROM documents WHERE doc_id % 3 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS place FROM s) SELECT category, doc_id, place FROM r WHERE place <= 4")
def f9(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("cats"), F.when(F.col("doc_id") % 3 > 0, "act").alias("action"))
    return se.mitigations(docs, "cats", "action", "doc_id", 4).select("category", "doc_id", F.col("place").cast("long").alias("place"))


@query("p25_triage_verdict", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'coerente' WHEN 1 THEN 'duvidoso' WHEN 2 THEN 'ruido' END AS verdict FROM conversations WHERE role = 'assistant'")
def p25(spark, d):
    from winlens.operators.events import verdict

    said = F.element_at(F.array(*map(F.lit, ("\n**Rótulo da triagem**: **Coerente**", " rótulo da triagem: duvidoso", " RÓTULO DA TRIAGEM: Ruído.", " rótulo da triagem: ruído | outro"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return ad.table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", verdict(F.concat(F.col("text"), said)).alias("verdict"))


@query("p29_conversation_size", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
def p29(spark, d):
    return ad.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text").cast("long")).alias("n_chars"))


_NAME = "['BenignTraffic', 'DDoS-ICMP_Flood', 'Recon-PortScan', 'XSS'][page_id % 4 + 1]"


@query("p8_capture_labels", f"SELECT page_id, {_NAME} AS label FROM pages")
def p8(spark, d):
    base = F.element_at(F.array(*map(F.lit, ("BenignTraffic", "DDoS-ICMP_Flood", "Recon-PortScan", "XSS"))), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("/data/x/"), base, F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("-"), F.col("page_id"))).otherwise(F.col("page_id").cast("string")), F.lit(".pcap"))
    return la.canonical_labels(ad.table(spark, d, "pages").select("page_id", la.capture_label_text(name).alias("raw")), "raw").select("page_id", "label")


@query("p9_natural_order", "SELECT page_id, row_number() OVER (ORDER BY page_id % 5, page_id // 5) AS place FROM pages")
def p9(spark, d):
    name = F.concat(F.lit("Cap"), F.element_at(F.array(*map(F.lit, "abcde")), (F.col("page_id") % 5 + 1).cast("int")), F.lit("-"), F.floor(F.col("page_id") / 5), F.lit(".pcap"))
    return la.natural_order(ad.table(spark, d, "pages").select("page_id"), name, "page_id").select("page_id", "place")


@query("s8_lines_per_label", "SELECT CAST(page_id % 4 AS BIGINT) AS label, count(*) AS n_files, CAST(sum(length(html) - length(replace(html, chr(10), ''))) AS BIGINT) AS n_lines, count(*) FILTER (html NOT LIKE '%' || chr(10)) AS n_open FROM pages GROUP BY 1")
def s8(spark, d):
    from winlens.sources.tables import line_counts

    return line_counts(ad.table(spark, d, "pages").select((F.col("page_id") % 4).alias("label"), F.col("html").alias("content")), "label", "content")


@query("s17_manifest_diff", "WITH m AS (SELECT page_id, length(html) AS bytes FROM pages WHERE page_id % 10 < 8), f AS (SELECT page_id, length(html) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS bytes FROM pages WHERE page_id % 10 > 1) SELECT page_id, CASE WHEN m.bytes IS NULL THEN 'new' WHEN f.bytes IS NULL THEN 'vanished' WHEN m.bytes <> f.bytes THEN 'changed' ELSE 'unchanged' END AS state FROM m FULL JOIN f USING (page_id)")
def s17(spark, d):
    from winlens.sources.tables import manifest_diff

    p = ad.table(spark, d, "pages").select("page_id", F.length("html").alias("bytes"))
    now = p.filter("page_id % 10 > 1").withColumn("bytes", F.col("bytes") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0))
    return manifest_diff(now, p.filter("page_id % 10 < 8"), ["page_id"], ["bytes"])


_CAPS = f"{WIN}, caps AS (SELECT capture, {ad.CATEGORY} AS label, count(*) AS total FROM win_ GROUP BY ALL)"


def captures(spark, d):
    return ad.windows(spark, d, 10).groupBy("capture", F.col("category").alias("label")).agg(F.count("*").alias("total")).withColumn("order", F.col("capture"))


_SIDES = f"{_CAPS}, sides AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN CASE WHEN row_number() OVER (PARTITION BY label ORDER BY capture DESC) = 1 THEN 0 ELSE total END ELSE CAST(floor(0.7 * total + 0.5) AS BIGINT) END AS cut FROM caps)"


@query("w9_capture_sides", f"{_SIDES} SELECT capture, label, total, CAST(cut AS BIGINT) AS cut FROM sides")
def w9(spark, d):
    return sp.capture_sides(captures(spark, d), 0.3).drop("order")


@query("w10_rotations", f"{_CAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY capture) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM caps) SELECT capture, CAST(r AS BIGINT) AS rotation, k = (n - 1 + r) % n AS held_out FROM k, range(4) t(r)")
def w10(spark, d):
    return sp.rotations(captures(spark, d), 4).select("capture", F.col("rotation").cast("long").alias("rotation"), "held_out")


@query("f4_f5_membership", f"{_SIDES} SELECT w.capture, w.win, CASE WHEN w.win < s.cut THEN 'train' ELSE 'test' END AS side, w.win >= floor(0.85 * s.cut + 0.5) AND w.win < s.cut AS validation FROM win_ w JOIN sides s USING (capture)")
def f4(spark, d):
    cuts = sp.validation_start(sp.capture_sides(captures(spark, d), 0.3)).select("capture", "cut", "validation_from")
    w = sp.mark_sides(ad.windows(spark, d, 10).join(cuts, "capture"))
    return w.select("capture", "win", "side", ((F.col("win") >= F.col("validation_from")) & (F.col("win") < F.col("cut"))).alias("validation"))


@query("j1_broadcast_dimension", f"{_SIDES} SELECT label, count(*) AS n_windows, count(*) FILTER (win < cut) AS n_train, CAST(sum(DISTINCT total) AS BIGINT) AS totals FROM win_ JOIN sides USING (capture) GROUP BY 1")
def j1(spark, d):
    dim = sp.capture_sides(captures(spark, d), 0.3).select("capture", "label", "cut", "total")
    return ad.windows(spark, d, 10).join(dim, "capture").groupBy("label").agg(F.count("*").alias("n_windows"), F.count_if(F.col("win") < F.col("cut")).alias("n_train"), F.sum_distinct("total").alias("totals"))


@query("m7_training_membership", f"{_SIDES} SELECT label, count(*) FILTER (win < floor(0.85 * cut + 0.5)) AS reduced, count(*) FILTER (win < cut) AS whole, count(*) FILTER (win < cut AND capture % 3 <> 0) AS without_held_out, count(*) FILTER (win < cut AND (label = 'Benign' OR has_attacker)) AS kept_only FROM win_ JOIN sides USING (capture) GROUP BY 1")
def m7(spark, d):
    dim = sp.validation_start(sp.capture_sides(captures(spark, d), 0.3)).select("capture", "label", "cut", "validation_from")
    w = ad.windows(spark, d, 10).join(dim, "capture")
    train = F.col("win") < F.col("cut")
    return w.groupBy("label").agg(F.count_if(F.col("win") < F.col("validation_from")).alias("reduced"), F.count_if(train).alias("whole"), F.count_if(train & (F.col("capture") % 3 != 0)).alias("without_held_out"), F.count_if(train & ((F.col("label") == "Benign") | F.col("has_attacker"))).alias("kept_only"))


def _u(seed: int, *columns: str) -> str:
    """The draw of splits.draw in SQL, as a whole number."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 13) AS BIGINT)"


@query("s22_k7_capped_sample", f"SELECT lang, doc_id, population FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS population, row_number() OVER (PARTITION BY lang ORDER BY {_u(7, 'lang', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 50")
def k7(spark, d):
    return sp.capped_sample(ad.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50, 7).select("lang", "doc_id", "population")


@query("k8_capped_windows", f"{WIN} SELECT category, capture, win FROM (SELECT category, capture, win, row_number() OVER (PARTITION BY category ORDER BY {_u(3, 'category', 'capture', 'win')}, capture, win) AS r FROM win_) WHERE r <= 300")
def k8(spark, d):
    return sp.capped_sample(ad.windows(spark, d, 10), "category", ["capture", "win"], 300, 3).select("category", "capture", "win")


_UNMATCHED = "SELECT doc_id FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)"


@query("k9_unmatched_sample", f"SELECT doc_id, population FROM (SELECT doc_id, count(*) OVER () AS population, row_number() OVER (ORDER BY {_u(5, '1', 'doc_id')}, doc_id) AS r FROM ({_UNMATCHED})) WHERE r <= 20")
def k9(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    rows = docs.join(docs.filter("doc_id % 3 = 0").select("h"), "h", "left_anti").withColumn("all_", F.lit(1))
    return sp.capped_sample(rows, "all_", ["doc_id"], 20, 5).select("doc_id", "population")


def _split(seed: int, fraction: float, rows: str, label: str, identity: str) -> str:
    """(.., side) of splits.stratified_split over a relation, in SQL."""
    return f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY {_u(seed, label, identity)}, {identity}) <= round(count(*) OVER (PARTITION BY {label}) * {fraction}) THEN 'test' ELSE 'train' END AS side FROM {rows}"


@query("m5_stratified_split", f"SELECT doc_id, lang, side FROM ({_split(42, 0.2, 'documents', 'lang', 'doc_id')})")
def m5(spark, d):
    return sp.stratified_split(ad.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 0.2, 42)


@query("m6_group_split", f"WITH d AS (SELECT doc_id, sha256(text) AS h, lang FROM documents), n AS (SELECT h, lang, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT h, arg_min(lang, (-n, lang)) AS main FROM n GROUP BY h), s AS ({_split(42, 0.2, 'm', 'main', 'h')}) SELECT doc_id, h, lang, side FROM d JOIN s USING (h)")
def m6(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    return sp.group_split(docs, ["h"], "lang", 0.2, 42).select("doc_id", "h", "lang", "side")


@query("a39_split_report", f"SELECT lang, count(*) AS n_rows, count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test, count(DISTINCT text) FILTER (side = 'train') AS n_distinct_train, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeats FROM ({_split(1, 0.3, 'documents', 'lang', 'doc_id')}) GROUP BY 1")
def a39(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    split = materialize(sp.stratified_split(docs, "lang", ["doc_id"], 0.3, 1), "split")
    each = split.groupBy("lang", "h").agg(F.count("*").alias("n"), F.bool_or(F.col("side") == "train").cast("long").alias("t"))
    n = each.groupBy("lang").agg(F.sum("t").alias("n_distinct_train"), F.count("h").alias("n_distinct"), (F.sum("n") - F.count("h")).alias("n_repeats"))
    return sp.split_report(split, "lang").join(n, "lang")


@query("a41_split_fingerprint")
def a41(spark, d):
    rows = sp.stratified_split(ad.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 0.2, 42)
    return sp.fingerprint(rows.filter("side = 'test'"), ["doc_id"])


@query("p21_canonical_addresses")
def p21(spark, d):
    from winlens.functions.addresses import canonical_addresses

    e = ad.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("::ffff:10.0.0."), F.col("user_id") % 256)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("fe80::"), F.hex(F.col("user_id")), F.lit("%eth0"))).otherwise(F.concat(F.lit("2001:DB8:0::"), F.hex(F.col("user_id")))).alias("address"))
    return canonical_addresses(e, "address")
