"""Preference formatting of paired conversations, in DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as the prompt; what follows in each is its completion, with spans
that say which characters count for the loss (those of the trained role).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
_TURN = "struct<turn:long,role:string,text:string>"


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def loss_spans(turns: Column, trained: str = TRAINED) -> Column:
    """array<struct<start,end>> of code points, end exclusive: text and end mark of each trained turn."""
    one = "array<struct<start:long,end:long>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t["role"]))
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(one).alias("out")), step, lambda acc: acc["out"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns alike in role and text."""
    alike = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(alike, F.lit(False))
    return F.when(at == 0, F.size(alike).cast("long")).otherwise(at - 1)


def pair_conversations(conversations: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """(pair_id, chosen, rejected): turns of the two sides in the order of turn.

    Rows that repeat all of pair, side, turn, role and text count once; equal turn numbers
    are ordered by role, then text; a null turn number comes first, a null role is
    'user', a null text empty. A missing side has no turns. Rows
    without a pair or side belong to none.
    """
    rows = conversations.select(pair.cast("long").alias("pair_id"), is_chosen.alias("side"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter(F.col("pair_id").isNotNull() & F.col("side").isNotNull()).distinct()
    turns = F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text")))
    both = rows.groupBy("pair_id").agg(turns.alias("all"))
    side = lambda want: F.transform(F.filter("all", lambda t: t["side"] == F.lit(want)), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    return both.select("pair_id", side(True).alias("chosen"), side(False).alias("rejected"))


def format_preferences(pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """pair_id, n_prefix, prompt, and text and loss spans of both completions.

    Where the conversations are alike, both completions are empty. Other columns are not carried.
    """
    k = pairs.withColumn("n_prefix", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prefix").cast("int") + 1, F.greatest(F.size(c) - F.col("n_prefix").cast("int"), F.lit(0)))
    return k.select(
        "pair_id",
        "n_prefix",
        render(F.slice("chosen", F.lit(1), F.col("n_prefix").cast("int"))).alias("prompt"),
        render(rest(F.col("chosen"))).alias("chosen"),
        render(rest(F.col("rejected"))).alias("rejected"),
        loss_spans(rest(F.col("chosen")), trained).alias("chosen_spans"),
        loss_spans(rest(F.col("rejected")), trained).alias("rejected_spans"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is pair k's chosen one, 2k + 1 its rejected one."""
    table = read_table(spark, sf_dir, "conversations")
    pairs = pair_conversations(table, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    done = format_preferences(pairs)
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return done.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", as_text("chosen_spans"), as_text("rejected_spans"))


def op7_sql() -> str:
    side = lambda s: f"""
      coalesce(string_agg(h || text || e, '' ORDER BY i) FILTER (WHERE {s} AND i > n_prefix), '') AS {{}},
      coalesce(string_agg(CAST(pos + length(h) AS BIGINT) || ':' || CAST(pos + length(h || text || e) AS BIGINT), ',' ORDER BY i) FILTER (WHERE {s} AND i > n_prefix AND role = '{TRAINED}'), '') AS {{}}_spans"""  # noqa: E731
    end, close = END.replace("\n", "' || chr(10) || '"), CLOSE.replace("\n", "' || chr(10) || '")
    return f"""
    WITH r AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i,
                 '{OPEN}' || role || '{close}' AS h, '{end}' AS e FROM r),
    p AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE n < 2), max(i) + 1) - 1 AS n_prefix FROM (
            SELECT pair_id, i, max(n) AS n FROM (SELECT pair_id, i, role, text, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL) GROUP BY pair_id),
    x AS (SELECT *, sum(CASE WHEN i > n_prefix THEN length(h || text || e) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i)
                    - CASE WHEN i > n_prefix THEN length(h || text || e) ELSE 0 END AS pos FROM t JOIN p USING (pair_id))
    SELECT pair_id, CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
      coalesce(string_agg(h || text || e, '' ORDER BY i) FILTER (WHERE side AND i <= n_prefix), '') AS prompt,
      {side("side").format("chosen", "chosen")}, {side("NOT side").format("rejected", "rejected")}
    FROM x GROUP BY pair_id"""
