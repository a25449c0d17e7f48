r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns with one role become one block:

    ### role: text<part/>text</turn>\n

Control strings inside roles and texts are escaped with codes that start with a backslash, the backslash itself first
(\b), so that the markers above occur nowhere else and the output can be read back without loss.

Defined cases: null text and null role count as empty; turns sort by (turn, role, text), a null turn first, so ties and
repeated rows have one order; a row without conv_id belongs to no other and is a conversation of its own, so such rows are never
gathered; an empty table gives an empty result; other columns are ignored. A conversation is one row of the output, so its turns must
fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import table

#: Order matters: the backslash is escaped first and restored last.
CODES = (("\\", "\\b"), ("</turn>", "\\e"), ("<part/>", "\\p"), ("### ", "\\h"))
ROLE_CODE = (":", "\\c")
#: Parts whose places are summed up by one fold. Folds append to arrays, at a cost that grows with their square.
CHUNK = 256


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted text, loss spans (array of start, from 1, and len, in code points of it)."""
    empty = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    named = turns.filter(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    sorted_turns = named.unionByName(turns.filter(F.col(conv_col).isNull()).select(F.col(conv_col).alias("conv_id"), F.array(one).alias("turns")))
    n = F.size("turns")
    starts = sorted_turns.withColumn("starts", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])))
    block = lambda s, k: F.struct(
        F.get("turns", s - 1)["role"].alias("role"),
        F.transform(F.slice("turns", s, F.coalesce(F.get("starts", k + 1), n + 1) - s), lambda t: escape(t["text"])).alias("parts"),
    )
    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    head = lambda b: F.concat(F.lit("### "), escape(b["role"], (*CODES, ROLE_CODE)), F.lit(": "))
    full = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["parts"], "<part/>"), F.lit("</turn>\n")))
    # every part with the characters before it (marker or header) and after it
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p, i: F.struct(
        F.when(i == 0, F.length(head(b))).otherwise(F.lit(len("<part/>"))).alias("before"),
        F.length(p).alias("len"),
        F.when(i == F.size(b["parts"]) - 1, F.lit(len("</turn>\n"))).otherwise(F.lit(0)).alias("after"),
        (b["role"] == learn_role).alias("learn")))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
    walk = lambda acc, p: F.struct(
        (acc["at"] + p["before"] + p["len"] + p["after"]).alias("at"),
        F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["len"].alias("len"))))).otherwise(acc["spans"]).alias("spans"),
    )
    out = blocks.select("conv_id", F.array_join(full, "").alias("formatted"), pieces.alias("pieces"))
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(pieces) - 1) div {CHUNK} as int)")), lambda c: F.aggregate(F.slice("pieces", c * CHUNK + 1, F.lit(CHUNK)), zero, walk))
    out = out.select("conv_id", "formatted", chunks.alias("chunks"))
    begins = F.aggregate("chunks", F.array(F.lit(1)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    out = out.select("conv_id", "formatted", "chunks", begins.alias("begins"))
    spans = F.flatten(F.transform("chunks", lambda c, i: F.transform(c["spans"], lambda x: F.struct((x["start"] + F.get("begins", i)).alias("start"), x["len"].alias("len")))))
    return out.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds, in order."""
    blocks = F.filter(F.split(formatted, "</turn>\n", -1), lambda b: b != "")
    role = lambda b: unescape(F.regexp_extract(b, "^### ([^:]*): ", 1), (*CODES, ROLE_CODE))
    body = lambda b: F.regexp_replace(b, "^### [^:]*: ", "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), "<part/>", -1), lambda p: F.struct(role(b).alias("role"), unescape(p).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["len"]))), "")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose two turns hold control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(with_probe(table(spark, sf_dir, "conversations")))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESC = "replace(replace(replace(replace({0}, '\\', '\\b'), '</turn>', '\\e'), '<part/>', '\\p'), '### ', '\\h')"
SQL = f"""
WITH all_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
rows_ AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM all_),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens FROM rows_
  WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESC.format('text')}) + CASE WHEN opens THEN length(replace({_ESC.format('role')}, ':', '\\c')) + 14 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id, alone
"""
